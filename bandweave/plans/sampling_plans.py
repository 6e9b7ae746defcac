"""Caps, samples, splits and dedupe on the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.keys import hash_text
from ..operators import sampling as S
from .registry import query
from .tables import DECISIONS, GRID, PIXELS, SPECTRA, cte, derive, load, greedy_sql

PIX, DEC, GRD, SPEC = cte(p=PIXELS), cte(p=DECISIONS), cte(p=GRID), cte(p=SPECTRA)
ROW = ["tile_id", "polygon_id", "pixel_row", "pixel_col"]
ROWS = ", ".join(ROW)


def h(seed: int, *cols: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({c} AS STRING)' for c in cols)}))"


H = h(7, *ROW)
UNIT = f"(CAST(('0x' || left({H}, 8)) AS BIGINT) / 4294967296e0)"


@query("cap_per_polygon", PIX + f"""
SELECT {ROWS} FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY {H}, {ROWS}) AS rn FROM p) q WHERE rn <= 40""")
def cap_per_polygon(spark, sf_dir):
    return S.cap_per_group(derive(spark, sf_dir, PIXELS).select(*ROW), ["tile_id"], ROW, 40, 7)


@query("cap_large", PIX + f"""
SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(pixel_row) AS BIGINT) AS rows_sum FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {H}, {ROWS}) AS rn FROM p) q WHERE rn <= 5000 GROUP BY split""")
def cap_large(spark, sf_dir):
    p = derive(spark, sf_dir, PIXELS).select(*ROW, "split")
    return S.cap_per_group(p, ["split"], ROW, 5000, 7).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pixel_row").alias("rows_sum"))


@query("subsample_rows", PIX + f"SELECT {ROWS} FROM p ORDER BY {H}, {ROWS} LIMIT 500")
def subsample_rows(spark, sf_dir):
    return S.subsample(derive(spark, sf_dir, PIXELS).select(*ROW), ROW, 500, 7)


@query("subsample_by_class", SPEC + f"""
SELECT vec_id, class FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {h(3, 'vec_id')}, vec_id) AS rn FROM p) q
WHERE rn <= 20 ORDER BY {h(3, 'vec_id')}, vec_id LIMIT 200""")
def subsample_by_class(spark, sf_dir):
    return S.subsample_classes(derive(spark, sf_dir, SPECTRA), "class", ["vec_id"], 200, 3, 10).select("vec_id", "class")


RANK = "CASE source WHEN 'ndviz' THEN 0 WHEN 'reassigned' THEN 1 WHEN 'tag' THEN 2 WHEN 'confirmed' THEN 3 WHEN 'hand' THEN 4 ELSE 99 END"
SOURCED = PIX + """, s AS (SELECT *, CASE WHEN polygon_id % 7 = 0 THEN 'ndviz' WHEN polygon_id % 7 < 3 THEN 'confirmed' WHEN polygon_id % 7 < 5 THEN 'reassigned' ELSE 'hand' END AS source FROM p)
"""


@query("precedence_dedupe", SOURCED + f"""
SELECT pixel_row, pixel_col, source, tile_id, polygon_id FROM (SELECT *, row_number() OVER (PARTITION BY pixel_row, pixel_col ORDER BY {RANK}, tile_id, polygon_id) AS rn FROM s) q WHERE rn = 1""")
def precedence_dedupe(spark, sf_dir):
    from ..operators.curate import source_rank
    from ..operators.joins import precedence_dedupe as dedupe
    m = F.col("polygon_id") % 7
    s = derive(spark, sf_dir, PIXELS).withColumn(
        "source", F.when(m == 0, "ndviz").when(m < 3, "confirmed").when(m < 5, "reassigned").otherwise("hand"))
    s = s.select("pixel_row", "pixel_col", "source", "tile_id", "polygon_id")
    return dedupe(s, ["pixel_row", "pixel_col"], source_rank(), ["tile_id", "polygon_id"])


@query("latest_decision", DEC + """
SELECT polygon_uid, event_id, decision, corrected_class, n_pixels FROM (SELECT *, row_number() OVER (PARTITION BY polygon_uid ORDER BY ts DESC, event_id DESC) AS rn FROM p) q WHERE rn = 1""")
def latest_decision(spark, sf_dir):
    d = S.latest(derive(spark, sf_dir, DECISIONS), "polygon_uid", ["ts", "event_id"])
    return d.select("polygon_uid", "event_id", "decision", "corrected_class", "n_pixels")


@query("last_decided_uids", DEC + """
SELECT polygon_uid, event_id FROM (SELECT *, row_number() OVER (PARTITION BY polygon_uid ORDER BY ts DESC, event_id DESC) AS rn FROM p WHERE predicted_class = 'lcp') q WHERE rn = 1 ORDER BY ts DESC, event_id DESC LIMIT 20""")
def last_decided_uids(spark, sf_dir):
    return S.last_decided(derive(spark, sf_dir, DECISIONS), "lcp", 20).select("polygon_uid", "event_id")


@query("flattest_pool", GRD + """
SELECT pixel, rn <= greatest(1, round_even(3e-1 * n, 0)) AS bland_pool FROM (SELECT pixel, row_number() OVER (PARTITION BY code ORDER BY value, pixel) AS rn, count(*) OVER (PARTITION BY code) AS n FROM p) q""")
def flattest_pool(spark, sf_dir):
    return S.flattest(derive(spark, sf_dir, GRID).select("pixel", "code", "value"), ["code"], "value", "pixel", 0.3).select("pixel", "bland_pool")


CANDIDATES = """SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'olivine' WHEN o_custkey % 4 = 1 THEN 'pyx' WHEN o_custkey % 4 = 2 THEN 'plagioclase' ELSE 'alteration' END AS mineral,
 CAST(o_orderkey % 6 AS INT) AS stratum, 'mc' || CAST(o_orderkey % 3 AS STRING) AS mc, o_totalprice / 5e5 AS band_depth, 'k' || CAST(o_orderkey AS STRING) AS cand_key FROM orders"""


def candidates(spark, sf_dir):
    return spark.sql(CANDIDATES.replace("FROM orders", "FROM {orders}"), orders=load(spark, sf_dir, "orders"))


def top_stratum_first(cells):
    strata = sorted({s for _, s in cells}, reverse=True)
    return [[(m, s) for m in ("olivine", "pyx", "plagioclase", "alteration")] for s in strata]


@query("review_sample")
def review_sample(spark, sf_dir):
    return S.sample_cells(candidates(spark, sf_dir), ["mineral", "stratum"], "mc", "cand_key", "band_depth", 600, 11,
                          top_stratum_first)


@query("review_sample_counts", f"""
WITH p AS ({CANDIDATES}), c AS (SELECT mineral, stratum, count(*) AS n FROM p GROUP BY mineral, stratum)
SELECT mineral, stratum, CAST(least(n, CAST(floor(600 / (SELECT count(*) FROM c)) AS BIGINT)) AS BIGINT) AS n FROM c""")
def review_sample_counts(spark, sf_dir):
    return review_sample(spark, sf_dir).groupBy("mineral", "stratum").agg(F.count(F.lit(1)).alias("n"))


@query("tier_by_threshold", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY t) AS BIGINT) AS confidence FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5e-1 WHEN '2-HIGH' THEN 85e-2 WHEN '3-MEDIUM' THEN 97e-2 ELSE 0e0 END AS t FROM orders) q WHERE t > 0""")
def tier_by_threshold(spark, sf_dir):
    t = L.lookup(F.col("o_orderpriority"), {"1-URGENT": 0.5, "2-HIGH": 0.85, "3-MEDIUM": 0.97}, 0.0)
    o = load(spark, sf_dir, "orders").select("o_orderkey", t.alias("threshold"))
    return S.with_tier_rank(o, "threshold").select("o_orderkey", "confidence")


@query("evenly_spread_rows", """
SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () - 1 AS last FROM orders) q
WHERE pos IN (SELECT CAST(floor(i * (SELECT CAST(count(*) - 1 AS DOUBLE) FROM orders) / 255e0) AS BIGINT) FROM range(256) t(i))""")
def evenly_spread_rows(spark, sf_dir):
    return S.evenly_spread(load(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 256)


@query("split_by_tile", PIX + f"""
, t AS (SELECT DISTINCT tile_id FROM p), r AS (SELECT tile_id, row_number() OVER (ORDER BY {h(42, 'tile_id')}, tile_id) - 1 AS pos, count(*) OVER () AS n FROM t)
SELECT tile_id, CASE WHEN pos < floor(n * 7e-1) THEN 'train' WHEN pos < floor(n * 7e-1) + floor(n * 15e-2) THEN 'val' ELSE 'test' END AS split FROM r""")
def split_by_tile(spark, sf_dir):
    return S.split_tiles(derive(spark, sf_dir, PIXELS), "tile_id", 42)


@query("split_by_row", PIX + f"""
SELECT {ROWS}, CASE WHEN {UNIT} < 7e-1 THEN 'train' WHEN {UNIT} < 7e-1 + 15e-2 THEN 'val' ELSE 'test' END AS split FROM p""")
def split_by_row(spark, sf_dir):
    return S.split_rows(derive(spark, sf_dir, PIXELS).select(*ROW), ROW, 7)


@query("sample_other_polygons", PIX + f"""
, o AS (SELECT DISTINCT tile_id, polygon_id FROM p WHERE other > 0 ORDER BY {h(5, 'tile_id', 'polygon_id')}, tile_id, polygon_id LIMIT 300)
SELECT {ROWS} FROM p WHERE other <= 0 UNION ALL SELECT {ROWS} FROM p WHERE other > 0 AND (tile_id, polygon_id) IN (SELECT tile_id, polygon_id FROM o)""")
def sample_other_polygons(spark, sf_dir):
    p = derive(spark, sf_dir, PIXELS).select(*ROW, "other")
    return S.sample_polygons(p, ["tile_id", "polygon_id"], F.col("other") > 0, 300, 5).select(*ROW)


@query("hold_out_polygons", PIX + f"""
, d AS (SELECT DISTINCT polygon_id FROM p), r AS (SELECT polygon_id, row_number() OVER (ORDER BY {h(9, 'polygon_id')}, polygon_id) AS rn, greatest(1, round_even(count(*) OVER () * 1e-1, 0)) AS n FROM d)
SELECT CASE WHEN rn <= n THEN 'val' WHEN rn <= 2 * n THEN 'test' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(pixel_row) AS BIGINT) AS row_sum FROM p JOIN r USING (polygon_id) GROUP BY 1""")
def hold_out_polygons(spark, sf_dir):
    out = S.hold_out_polygons(derive(spark, sf_dir, PIXELS), ["polygon_id"], 0.1, 9)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("pixel_row").alias("row_sum"))


@query("spatial_thinning", GRD.replace("WITH ", "WITH RECURSIVE ", 1) + f", c AS (SELECT tile_id, pixel_row, pixel_col, {h(13, 'tile_id', 'pixel_row', 'pixel_col')} AS k FROM p WHERE value > 3e-1)" + greedy_sql("c", 25, 30))
def spatial_thinning(spark, sf_dir):
    g = derive(spark, sf_dir, GRID).where(F.col("value") > 0.3).select("tile_id", "pixel_row", "pixel_col")
    return S.thin(g, "tile_id", "pixel_row", "pixel_col", 5, 30, 13).select("tile_id", "pixel_row", "pixel_col")


def draw_sql(role: str) -> str:
    text = f"md5(concat_ws('|', '21', CAST(vec_id AS STRING), '{role}', CAST(slot AS STRING)))"
    return f"CAST(('0x' || left({text}, 12)) AS BIGINT)"


@query("contrastive_triplets", f"""
WITH a AS (SELECT vec_id FROM embeddings WHERE label = 0), h AS (SELECT vec_id AS partner, row_number() OVER (ORDER BY vec_id) - 1 AS at FROM embeddings WHERE label = 1),
s AS (SELECT vec_id AS partner, row_number() OVER (ORDER BY vec_id) - 1 AS at FROM embeddings WHERE label > 1),
o AS (SELECT vec_id AS partner, row_number() OVER (ORDER BY vec_id) - 1 AS at FROM embeddings WHERE label = 0)
SELECT vec_id, 'positive' AS role, 0 AS slot, o2.partner FROM (SELECT vec_id, 0 AS slot FROM a) a JOIN o ON o.partner = a.vec_id JOIN o o2 ON o2.at = (o.at + 1 + {draw_sql('positive')} % ((SELECT count(*) FROM o) - 1)) % (SELECT count(*) FROM o)
UNION ALL SELECT vec_id, 'hard', slot, partner FROM (SELECT vec_id, CAST(unnest(range(3)) AS INT) AS slot FROM a) x JOIN h ON h.at = {draw_sql('hard')} % (SELECT count(*) FROM h)
UNION ALL SELECT vec_id, 'soft', slot, partner FROM (SELECT vec_id, CAST(unnest(range(2)) AS INT) AS slot FROM a) x JOIN s ON s.at = {draw_sql('soft')} % (SELECT count(*) FROM s)""")
def contrastive_triplets(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    own = e.where("label = 0")
    return S.triplets(own, own, e.where("label = 1"), e.where("label > 1"), "vec_id", 3, 2, 21)


@query("extra_positives", """
SELECT p_partkey, CAST(4 AS BIGINT) AS hot, 25e-1 AS weight FROM part WHERE p_type = 'PROMO'""")
def extra_positives(spark, sf_dir):
    p = load(spark, sf_dir, "part").where("p_type = 'PROMO'")
    out = S.extra_positives(p, "plagioclase", ["olivine", "lcp", "hcp", "plagioclase", "bland"], 2.5)
    return out.select("p_partkey", F.array_position("label", 1.0).alias("hot"), "weight")


@query("viz_subsample", SPEC + f"""
SELECT vec_id, class FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {h(4, 'vec_id')}, vec_id) AS r2 FROM
  (SELECT *, row_number() OVER (PARTITION BY class, tile_id, polygon_id ORDER BY {h(4, 'vec_id')}, vec_id) AS rn FROM p) q WHERE rn <= 1) z WHERE r2 <= 15""")
def viz_subsample(spark, sf_dir):
    p = derive(spark, sf_dir, SPECTRA).select("vec_id", "class", "tile_id", "polygon_id")
    return S.viz_subsample(p, ["vec_id"], 1, 15, 4).select("vec_id", "class")


@query("suspect_ranking", """
SELECT p_partkey, CAST(row_number() OVER (ORDER BY d DESC NULLS LAST, p_partkey) AS BIGINT) AS place FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 5e1 END AS d FROM part) q """)
def suspect_ranking(spark, sf_dir):
    from ..operators.ranking import numbered
    d = F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 50.0)
    p = load(spark, sf_dir, "part").select("p_partkey", d.alias("depth"))
    top = S.by_suspicion(p, "depth", "p_partkey")
    order = top.withColumn("__k", -F.coalesce("depth", F.lit(-1.0)))
    return numbered(order, ["__k", "p_partkey"], "place", 1).select("p_partkey", "place")


@query("review_queue", f"""
WITH r AS (SELECT o_orderkey AS original_idx, 'u' || CAST(o_custkey AS STRING) AS polygon_uid, CASE o_orderpriority WHEN '1-URGENT' THEN 99e-2 WHEN '2-HIGH' THEN 85e-2 ELSE 5e-1 END AS threshold, o_totalprice AS area_m2 FROM orders)
SELECT polygon_uid, original_idx, threshold, area_m2 FROM r WHERE polygon_uid NOT IN (SELECT 'u' || CAST(user_id AS STRING) FROM events)""")
def review_queue(spark, sf_dir):
    t = L.lookup(F.col("o_orderpriority"), {"1-URGENT": 0.99, "2-HIGH": 0.85}, 0.5)
    r = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("original_idx"),
                                             F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("polygon_uid"),
                                             t.alias("threshold"), F.col("o_totalprice").alias("area_m2"))
    return S.queue(r, derive(spark, sf_dir, DECISIONS)).select("polygon_uid", "original_idx", "threshold", "area_m2")


@query("hash_order_text", f"SELECT o_orderkey, {h(1, 'o_orderkey', 'o_orderstatus')} AS k FROM orders")
def hash_order_text(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", hash_text(1, "o_orderkey", "o_orderstatus").alias("k"))
