"""Scans, sinks, review tables and streams; tables are written below the shared folder first."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import aggregates as A, joins as J, review as R
from ..operators.sampling import latest
from ..operators.split import SPLITS
from ..schema import LABELS_RAW
from ..sources import log, scans as S, sinks as W
from ..streaming import ledger as D
from .grid_plans import centers, grid
from .labels_plans import AUDIT_SQL, defects
from .registry import query
from .sampling_plans import DEC, GRD, PIX
from .tables import DECISIONS, PIXELS, POLYGONS, SPECTRA, cte, derive, load


@cache
def written(spark, sf_dir: str, kind: str) -> str:
    """Derived table written once per session and data folder."""
    path = W.scratch(spark, kind)
    p = derive(spark, sf_dir, PIXELS)
    if kind == "pixels":
        for split in SPLITS:  # one folder at a time: rows are neither shuffled nor sorted
            p.where(F.col("split") == split).drop("split").write.parquet(f"{path}/split={split}")
    elif kind == "review":
        p.where("review_path LIKE 'review_7cls%'").write.parquet(f"{path}/review_7cls_v3/confirmed")
        p.where("review_path NOT LIKE 'review_7cls%'").drop("alteration", "confidence_weight").write.parquet(f"{path}/review/confirmed")
    return path


@query("scan_pixels", PIX + "SELECT 'mineral' AS kind, CAST(count(*) AS BIGINT) AS n, round(sum(m2), 3) AS m2 FROM p WHERE other <= 5e-1 AND (olivine_t1 > 5e-1 OR olivine_t2 > 5e-1 OR lcp > 5e-1 OR hcp > 5e-1 OR plagioclase > 5e-1) UNION ALL SELECT 'bland', count(*), round(sum(m2), 3) FROM p WHERE other > 5e-1")
def scan_pixels(spark, sf_dir):
    cols = ["tile_id", "polygon_id", "pixel_row", "pixel_col", "other", "olivine_t1", "olivine_t2", "lcp", "hcp", "plagioclase", "m2"]
    minerals, bland = S.pixel_scan(spark, written(spark, sf_dir, "pixels"), cols)
    one = lambda df, k: df.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"), F.round(F.sum("m2"), 3).alias("m2"))
    return one(minerals, "mineral").unionByName(one(bland, "bland"))


@query("scan_review_folders", PIX + "SELECT CASE WHEN review_path LIKE 'review_7cls%' THEN 'v3' ELSE 'legacy' END AS review_session, CAST(count(*) AS BIGINT) AS n, sum(CASE WHEN review_path LIKE 'review_7cls%' THEN alteration ELSE 0e0 END) AS alteration, sum(lcp) AS lcp FROM p GROUP BY 1")
def scan_review_folders(spark, sf_dir):
    root = written(spark, sf_dir, "review")
    df = S.review_scan(spark, [f"{root}/review_7cls_v3/confirmed", f"{root}/review/confirmed"], ["tile_id", "polygon_id", *LABELS_RAW])
    return df.groupBy("review_session").agg(F.count(F.lit(1)).alias("n"), F.sum("alteration").alias("alteration"), F.sum("lcp").alias("lcp"))


@query("scan_tags", PIX + "SELECT 'none' AS tag, CAST(count(*) AS BIGINT) AS n FROM p WHERE negative_of IS NULL OR negative_of = '' UNION ALL SELECT 'ambiguous', count(*) FROM p WHERE negative_of = 'ambiguous'")
def scan_tags(spark, sf_dir):
    path = written(spark, sf_dir, "pixels")
    one = lambda t, k: S.tag_scan(spark, path, t).agg(F.lit(k).alias("tag"), F.count(F.lit(1)).alias("n"))
    return one(None, "none").unionByName(one("ambiguous", "ambiguous"))


@query("scan_rejects", PIX + ", q AS (SELECT *, olivine_t1 > 5e-1 OR olivine_t2 > 5e-1 OR lcp > 5e-1 OR hcp > 5e-1 OR plagioclase > 5e-1 AS m FROM p WHERE negative_of IS NULL OR negative_of = '') SELECT 'mineral' AS kind, CAST(count(*) AS BIGINT) AS n FROM q WHERE m UNION ALL SELECT 'bland', count(*) FROM q WHERE NOT m AND other > 5e-1")
def scan_rejects(spark, sf_dir):
    path = written(spark, sf_dir, "pixels")
    one = lambda m, k: S.reject_scan(spark, path, m).agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
    return one(True, "mineral").unionByName(one(False, "bland"))


@query("scan_optional_session", PIX + "SELECT 'present' AS kind, CAST(count(*) AS BIGINT) AS n FROM p UNION ALL SELECT 'absent', 0")
def scan_optional_session(spark, sf_dir):
    path = written(spark, sf_dir, "pixels")
    schema = spark.read.parquet(path).schema
    one = lambda p, k: S.optional_scan(spark, p, schema).agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
    return one(path, "present").unionByName(one(path + "-missing", "absent"))


@query("scan_file_or_folder", "SELECT CAST((SELECT count(*) FROM orders) AS BIGINT) AS file_rows, CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS folder_rows")
def scan_file_or_folder(spark, sf_dir):
    folder = spark.read.parquet(written(spark, sf_dir, "pixels")).agg(F.count(F.lit(1)).alias("n"))
    return load(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("file_rows")).withColumn("folder_rows", folder.scalar())


@query("lookup_polygon", cte(p=SPECTRA) + "SELECT vec_id FROM p WHERE class = 'c2' AND source = 'hand' AND tile_id = 't3' AND polygon_id % 2 = 0")
def lookup_polygon(spark, sf_dir):
    s = derive(spark, sf_dir, SPECTRA).withColumn("polygon_id", F.col("polygon_id") % 2)
    return S.polygon_rows(s, "c2", "hand", "t3", 0).select("vec_id")


@query("tile_centre_lookup", PIX + ", c AS (SELECT 't' || CAST(s_suppkey AS STRING) AS tile_id, (s_suppkey % 20) * 5e0 - 475e-1 AS lat, CAST(floor(s_suppkey / 2e1) AS BIGINT) * 5e0 + 25e-1 AS lon FROM supplier) SELECT tile_id, lat AS center_lat, lon AS center_lon FROM c WHERE tile_id IN (SELECT tile_id FROM p)")
def tile_centre_lookup(spark, sf_dir):
    tiles = derive(spark, sf_dir, PIXELS).select("tile_id").distinct()
    return A.with_center(tiles, centers(spark, sf_dir)).select("tile_id", "center_lat", "center_lon")


FILES = """SELECT '/data/mc' || CAST(p_size % 4 AS STRING) || '/t' || CAST(p_partkey % 60 AS STRING) || CASE p_type WHEN 'PROMO' THEN '_mrral_' WHEN 'LARGE' THEN '_mrrsu_' ELSE '_other_' END || CAST(p_size AS STRING) || '.img' AS path FROM part
UNION ALL SELECT '/poly/' || CASE WHEN p_partkey % 9 = 0 THEN 'North_hellas_' ELSE 'T' END || CAST(p_partkey AS STRING) || '.gpkg' FROM part"""


def files(spark, sf_dir):
    return spark.sql(FILES.replace("FROM part", "FROM {part}"), part=load(spark, sf_dir, "part"))


TILE_RX = "regexp_extract(path, '(t\\d+)_(mrral|mrrsu|mrrde)_?[^/]*\\.img$', {})"


@query("pair_tile_files", f"WITH f AS ({FILES}), g AS (SELECT lower(regexp_replace(split_part(path, '/', 3), '\\.gpkg$', '')) AS tile_id, path AS polygons FROM f WHERE path LIKE '%.gpkg' AND NOT starts_with(lower(split_part(path, '/', 3)), 'north_hellas')), r AS (SELECT {TILE_RX.format(1)} AS tile_id, min(path) AS raster, count(*) AS n FROM f WHERE {TILE_RX.format(2)} = 'mrral' GROUP BY 1) SELECT tile_id, polygons, raster, CAST(n AS BIGINT) AS n_rasters FROM g JOIN r USING (tile_id)")
def pair_tile_files(spark, sf_dir):
    return S.tile_pairs(files(spark, sf_dir), "mrral")


@query("tile_product_map", f"WITH f AS ({FILES}), k AS (SELECT {TILE_RX.format(1)} AS tile_id, {TILE_RX.format(2)} AS product, path FROM f), w AS (SELECT tile_id, min(CASE WHEN product = 'mrral' THEN path END) AS mrral, min(CASE WHEN product = 'mrrsu' THEN path END) AS mrrsu FROM k WHERE product <> '' GROUP BY tile_id) SELECT *, replace(mrral, '_mrral_', '_mrrde_') AS mrrde FROM w WHERE mrral IS NOT NULL AND mrrsu IS NOT NULL")
def tile_product_map(spark, sf_dir):
    return S.tile_products(files(spark, sf_dir), ["mrral", "mrrsu"]).withColumn("mrrde", S.sibling_path("mrral", "mrral", "mrrde"))


OBS = "SELECT 'FRT' || printf('%05d', p_partkey % 400) || '_' || CASE p_type WHEN 'PROMO' THEN 'IF' WHEN 'LARGE' THEN 'SR' ELSE 'XX' END || CAST(p_size AS STRING) || '.img' AS path FROM part"


@query("observation_inventory", f"WITH o AS ({OBS}), k AS (SELECT lower(regexp_extract(path, '^(FRT\\d+)_(IF|SR)', 1)) AS obsid, lower(regexp_extract(path, '^(FRT\\d+)_(IF|SR)', 2)) AS kind, path FROM o), w AS (SELECT obsid, min(CASE WHEN kind = 'if' THEN path END) AS \"if\", min(CASE WHEN kind = 'sr' THEN path END) AS sr FROM k WHERE obsid <> '' GROUP BY obsid) SELECT * FROM w WHERE \"if\" IS NOT NULL AND sr IS NOT NULL")
def observation_inventory(spark, sf_dir):
    o = spark.sql(OBS.replace("FROM part", "FROM {part}").replace("printf", "format_string"), part=load(spark, sf_dir, "part"))
    return S.observation_pairs(o, r"^(FRT\d+)_(IF|SR)", ["if", "sr"])


ROI = """SELECT p_type AS sheet, p_partkey AS line, CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE '' END AS region, CASE WHEN p_partkey % 5 = 0 THEN 'FRT 00' || CAST(p_partkey % 90 AS STRING) END AS obsid,
 CASE WHEN p_size = 9 THEN 'n/a' ELSE CAST(p_size % 6 AS STRING) END AS x, CAST(p_partkey % 4 AS STRING) AS y, p_size = 30 AS excluded, CASE WHEN p_size % 11 = 0 THEN 'Low' ELSE 'High' END AS confidence FROM part"""


@query("roi_rows", f"WITH r AS ({ROI}), f AS (SELECT *, lower(replace(last_value(obsid IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY line ROWS UNBOUNDED PRECEDING), ' ', '')) AS obs FROM r) SELECT DISTINCT obs AS obsid, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM f WHERE obs IS NOT NULL AND x <> 'n/a' AND NOT excluded AND confidence <> 'Low'")
def roi_rows(spark, sf_dir):
    r = spark.sql(ROI.replace("FROM part", "FROM {part}"), part=load(spark, sf_dir, "part"))
    return S.roi_rows(r).select("obsid", "x", "y")


ATTRIBUTES = """SELECT vec_id, embedding, CASE label % 6 WHEN 0 THEN 'HCP + olivine (HIGH)' WHEN 1 THEN 'hcp + Olivine' WHEN 2 THEN 'LCP, Spinel (low)' WHEN 3 THEN 'plagiolcase (Moderate)'
 WHEN 4 THEN 'Other, altered (high)' ELSE 'other (vague)' END AS Category FROM embeddings"""


@query("polygon_attributes", f"""WITH a AS ({ATTRIBUTES}), k AS (SELECT *, lower(Category) AS c FROM a WHERE vec_id % 4 <> 0)
SELECT vec_id, CASE WHEN c LIKE 'other (%' THEN 'other' ELSE concat_ws('|', CASE WHEN c LIKE '%olivine%' THEN 'olivine' END, CASE WHEN c LIKE '%lcp%' THEN 'lcp' END,
 CASE WHEN c LIKE '%hcp%' THEN 'hcp' END, CASE WHEN c LIKE '%plagiolcase%' THEN 'plagioclase' END, CASE WHEN c LIKE '%spinel%' THEN 'spinel' END, CASE WHEN c LIKE '%alter%' THEN 'alteration' END) END AS minerals,
 CASE WHEN c LIKE '%(high)' THEN 'High' WHEN c LIKE '%(moderate)' THEN 'Moderate' WHEN c LIKE '%(low)' THEN 'Low' ELSE '' END AS confidence_tier,
 CAST(len(embedding[1:59]) AS BIGINT) AS n, CAST(list_sum([floor(CAST(x AS DOUBLE) * 1e4) for x in embedding[1:59]]) AS BIGINT) AS total,
 CAST(floor(CAST(embedding[59] AS DOUBLE) * 1e4) AS BIGINT) AS last_value FROM k""")
def polygon_attributes(spark, sf_dir):
    text = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: F.floor(x.cast("double") * 1e4).cast("string")), ", "), F.lit("]"))
    e = spark.sql(ATTRIBUTES.replace("FROM embeddings", "FROM {e}"), e=load(spark, sf_dir, "embeddings"))
    p = S.polygon_attributes(e.withColumn("spectrum_text", F.when(F.col("vec_id") % 4 == 0, "0.1, 0.2").otherwise(text)))
    total = F.aggregate("spectrum", F.lit(0.0), lambda t, x: t + x).cast("bigint")
    return p.select("vec_id", F.array_join("minerals", "|").alias("minerals"), "confidence_tier", F.size("spectrum").cast("bigint").alias("n"),
                    total.alias("total"), F.element_at("spectrum", 59).cast("bigint").alias("last_value"))


CAND = "SELECT o_orderkey AS region_id, 'mc' || CAST(o_custkey % 3 AS STRING) AS mc, 'olivine' AS mineral, 't' || CAST(o_custkey % 9 AS STRING) AS tile_id, CASE WHEN o_orderkey % 2 = 0 THEN 5e-1 ELSE 85e-2 END AS threshold, o_totalprice / 5e5 AS mean_prob FROM orders"


@query("candidate_regions", f"WITH c AS ({CAND}) SELECT region_id, CASE WHEN threshold = 5e-1 THEN 0 ELSE 1 END AS stratum, concat_ws('::', mc, mineral, tile_id, CAST(region_id AS STRING)) AS cand_key FROM c WHERE threshold = 5e-1 AND mean_prob >= 5e-1 AND mean_prob < 85e-2 OR threshold = 85e-2 AND mean_prob >= 85e-2 AND mean_prob < 97e-2")
def candidate_regions(spark, sf_dir):
    c = spark.sql(CAND.replace("FROM orders", "FROM {orders}"), orders=load(spark, sf_dir, "orders"))
    return S.candidate_scan(c).select("region_id", "stratum", "cand_key")


@query("score_table_round_trip", GRD + "SELECT tile_id, class, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN valid THEN 1 END) AS BIGINT) AS n_valid, round(sum(CASE WHEN valid THEN CASE class WHEN 'olivine' THEN value ELSE 1e0 - value END END), 2) AS total FROM p, (SELECT unnest(['olivine', 'bland']) AS class) c GROUP BY tile_id, class")
def score_table_round_trip(spark, sf_dir):
    names, path = ["olivine", "bland"], W.scratch(spark, "scores")
    g = grid(spark, sf_dir).select("tile_id", "pixel_row", "pixel_col", "valid", F.array("value", 1.0 - F.col("value")).alias("probs"))
    W.write_scores(g, path, names)
    layers = W.scratch(spark, "layers")
    W.write_layers(W.class_layers(S.score_scan(spark, path, names), names), layers, ["class"])
    out = spark.read.parquet(layers).groupBy("tile_id", "class").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_valid"), F.round(F.sum(F.col("value").cast("double")), 2).alias("total"))
    return out


@query("merge_tile_layers", cte(p=POLYGONS) + "SELECT tile_id, CAST(count(CASE WHEN p_size <= 25 THEN 1 END) AS BIGINT) AS low, CAST(count(CASE WHEN p_size > 25 THEN 1 END) AS BIGINT) AS high FROM p GROUP BY tile_id")
def merge_tile_layers(spark, sf_dir):
    p = derive(spark, sf_dir, POLYGONS)
    a = p.where("p_size <= 25").select("tile_id", "polygon_id", F.lit("low").alias("mineral"))
    b = p.where("p_size > 25").select(F.lit(None).cast("string").alias("tile_id"), F.concat(F.lit("/x/"), "tile_id", F.lit(".gpkg")).alias("source_file"), "polygon_id", F.lit("high").alias("mineral"))
    return A.count_table(S.merge_layers([a, b], ["tile_id", "mineral"]), "tile_id", "mineral", ["low", "high"])


@query("replace_rebuilt_tiles", PIX + "SELECT CASE WHEN CAST(substr(tile_id, 2) AS BIGINT) % 10 = 0 THEN 'train' ELSE split END AS split, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1")
def replace_rebuilt_tiles(spark, sf_dir):
    p = derive(spark, sf_dir, PIXELS)
    rebuilt = p.where("CAST(substring(tile_id, 2) AS BIGINT) % 10 = 0")
    return S.replace_tiles(p, rebuilt).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("minimal_label_rows", "SELECT vec_id, 1e0 AS plagioclase, 0e0 AS lcp, 75e-2 AS confidence_weight, 'Moderate' AS confidence_tier, 'library' AS provenance FROM embeddings WHERE label = 2")
def minimal_label_rows(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    out = S.minimal_label_rows(e.where("label = 2").select("vec_id"), e.select("vec_id", F.col("embedding").alias("spectrum")), "vec_id", "plagioclase", 0.75, "Moderate", "library")
    return out.select("vec_id", "plagioclase", "lcp", "confidence_weight", "confidence_tier", "provenance")


# ---------------------------------------------------------------- review tables

@query("ledger_migration", DEC + "SELECT predicted_class, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN layer = '' THEN 1 END) AS BIGINT) AS blank_layer, CAST(count(DISTINCT polygon_uid) AS BIGINT) AS n_uids FROM (SELECT predicted_class, polygon_uid, '' AS layer FROM p UNION ALL SELECT predicted_class, polygon_uid, 'new' FROM p WHERE decision = 'confirm') q GROUP BY predicted_class")
def ledger_migration(spark, sf_dir):
    d = derive(spark, sf_dir, DECISIONS)
    out = R.append_decisions(d.drop("event_id"), d.where("decision = 'confirm'").withColumn("layer", F.lit("new")))
    return out.groupBy("predicted_class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("layer") == "").alias("blank_layer"), F.countDistinct("polygon_uid").alias("n_uids"))


@query("ledger_uids", DEC + "SELECT DISTINCT polygon_uid FROM p")
def ledger_uids(spark, sf_dir):
    return R.uids_seen(derive(spark, sf_dir, DECISIONS))


UIDPIX = PIX + ", x AS (SELECT 'u' || CAST(polygon_id % 200 AS STRING) AS polygon_uid, tile_id, pixel_row, pixel_col FROM p), d AS (SELECT 'u' || CAST(user_id AS STRING) AS polygon_uid, event_id, ts, event_type, CASE WHEN event_id % 3 = 0 THEN 'High' WHEN event_id % 3 = 1 THEN 'Moderate' ELSE 'Low' END AS confidence, CASE WHEN user_id % 4 = 0 THEN 'olivine' WHEN user_id % 4 = 1 THEN 'lcp' WHEN user_id % 4 = 2 THEN 'hcp' ELSE 'plagioclase' END AS predicted_class, CASE event_type WHEN 'view' THEN 'hcp' WHEN 'signup' THEN 'alteration' END AS corrected_class FROM events), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY polygon_uid ORDER BY ts DESC, event_id DESC) AS rn FROM d) q WHERE rn = 1)\n"
WEIGHT = "CASE confidence WHEN 'High' THEN 1e0 WHEN 'Moderate' THEN 75e-2 ELSE 5e-1 END"


def uid_pixels(spark, sf_dir):
    return derive(spark, sf_dir, PIXELS).select(F.concat(F.lit("u"), (F.col("polygon_id") % 200).cast("string")).alias("polygon_uid"), "tile_id", "pixel_row", "pixel_col")


def last_decisions(spark, sf_dir):
    return latest(derive(spark, sf_dir, DECISIONS), "polygon_uid", ["ts", "event_id"])


@query("confirmed_pixels", UIDPIX + f"SELECT x.polygon_uid, CAST(('0x' || left(md5(x.polygon_uid), 8)) AS BIGINT) AS polygon_id, CAST(count(*) AS BIGINT) AS n, sum(CASE WHEN predicted_class = 'olivine' THEN 1e0 ELSE 0e0 END) AS olivine_t1, sum(1e0) AS hcp, sum({WEIGHT}) AS confidence_weight, max('Reviewed-' || confidence) AS confidence_tier FROM x JOIN l ON l.polygon_uid = x.polygon_uid WHERE event_type IN ('purchase', 'click') GROUP BY x.polygon_uid")
def confirmed_pixels(spark, sf_dir):
    d = last_decisions(spark, sf_dir).where("decision = 'confirm'").select("polygon_uid", "confidence", F.col("predicted_class").alias("label_class"), F.array(F.lit("hcp")).alias("extra_classes"))
    rows = R.confirmed_rows(uid_pixels(spark, sf_dir), d)
    return rows.groupBy("polygon_uid").agg(F.max("polygon_id").alias("polygon_id"), F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("olivine_t1", "hcp", "confidence_weight")], F.max("confidence_tier").alias("confidence_tier"))


@query("rejected_pixels", UIDPIX + f"SELECT x.polygon_uid, CASE WHEN corrected_class IS NULL THEN predicted_class WHEN corrected_class = 'hcp' THEN '' ELSE corrected_class END AS negative_of, CAST(count(*) AS BIGINT) AS n, sum(CASE WHEN corrected_class = 'hcp' THEN 1e0 ELSE 0e0 END) AS hcp, sum(0e0) AS alteration, sum(CASE WHEN corrected_class IS NULL THEN 1e0 ELSE {WEIGHT} END) AS confidence_weight, max(CASE WHEN corrected_class IS NULL THEN 'High' ELSE 'Reviewed-' || confidence END) AS confidence_tier FROM x JOIN l ON l.polygon_uid = x.polygon_uid WHERE event_type NOT IN ('purchase', 'click') GROUP BY 1, 2")
def rejected_pixels(spark, sf_dir):
    d = last_decisions(spark, sf_dir).where("decision <> 'confirm'").withColumn("extra_classes", F.lit(None).cast("array<string>"))
    rows = R.rejected_rows(uid_pixels(spark, sf_dir), d)
    return rows.groupBy("polygon_uid", "negative_of").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("hcp", "alteration", "confidence_weight")], F.max("confidence_tier").alias("confidence_tier"))


@query("upsert_polygons", PIX + "SELECT CASE WHEN polygon_id % 5 = 0 THEN 'new' ELSE 'old' END AS version, CAST(count(*) AS BIGINT) AS n FROM p WHERE polygon_id % 7 <> 3 GROUP BY 1")
def upsert_polygons(spark, sf_dir):
    p = derive(spark, sf_dir, PIXELS).select("polygon_id", "pixel_row", F.lit("old").alias("version"))
    merged = R.upsert(p, p.where("polygon_id % 5 = 0").withColumn("version", F.lit("new")))
    kept = R.drop_keys(merged, p.where("polygon_id % 7 = 3"))
    return kept.groupBy("version").agg(F.count(F.lit(1)).alias("n"))


@query("upsert_table", PIX + "SELECT CAST(polygon_id % 8 AS INT) AS bucket, CASE WHEN polygon_id % 16 = 1 THEN 'new' ELSE 'old' END AS version, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1, 2")
def upsert_table(spark, sf_dir):
    path = W.scratch(spark, "upsert")
    p = derive(spark, sf_dir, PIXELS).select("polygon_id", "pixel_row", F.lit("old").alias("version"), (F.col("polygon_id") % 8).cast("int").alias("bucket"))
    log.append(p, path, 0)
    log.append(p.where("polygon_id % 16 = 1").withColumn("version", F.lit("new")), path, 1)
    return log.read(spark, path, ["polygon_id"]).groupBy("bucket", "version").agg(F.count(F.lit(1)).alias("n"))


@query("publish_versions", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS version FROM orders WHERE o_orderstatus = 'O'")
def publish_versions(spark, sf_dir):
    path, o = W.scratch(spark, "versions"), load(spark, sf_dir, "orders")
    W.publish(o, path)
    W.publish(o.where("o_orderstatus = 'O'"), path)
    return W.current(spark, path).agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(W.latest_version(spark, path)).cast("bigint"))


@query("relabel_whole_polygons", cte(p=SPECTRA) + ", s AS (SELECT DISTINCT class, source, tile_id, polygon_id FROM p WHERE vec_id % 17 = 0), k AS (SELECT p.*, concat_ws('::', p.class, p.source, p.tile_id, CAST(p.polygon_id AS STRING)) AS uid FROM p JOIN s ON p.class = s.class AND p.source = s.source AND p.tile_id = s.tile_id AND p.polygon_id = s.polygon_id) SELECT uid AS polygon_uid, CAST(count(*) AS BIGINT) AS n_pixels, sum(1e0) AS lcp, sum(75e-2) AS confidence_weight FROM k GROUP BY uid")
def relabel_whole_polygons(spark, sf_dir):
    s = derive(spark, sf_dir, SPECTRA)
    decisions, rows = R.relabel_polygons(s.where("vec_id % 17 = 0"), s, "lcp", "Moderate")
    per = rows.groupBy("polygon_uid").agg(F.sum("lcp").alias("lcp"), F.sum("confidence_weight").alias("confidence_weight"))
    return decisions.select("polygon_uid", "n_pixels").join(per, "polygon_uid")


@query("review_manifest", f"WITH c AS ({CAND}), k AS (SELECT *, CAST(region_id % 6 AS INT) AS stratum, CAST(region_id AS STRING) AS source_uid FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY mineral, stratum ORDER BY tile_id, source_uid) - 1 AS pos FROM k) SELECT region_id, tile_id || '::thresh_' || t || '::' || CAST(pos AS STRING) AS review_uid, 'thresh_0' || CAST(6 - stratum AS STRING) || '_' || t AS layer FROM (SELECT *, CASE stratum WHEN 0 THEN '0.50' WHEN 1 THEN '0.85' WHEN 2 THEN '0.97' WHEN 3 THEN '0.99' WHEN 4 THEN '0.999' ELSE '0.9999' END AS t FROM r) q")
def review_manifest(spark, sf_dir):
    c = spark.sql(CAND.replace("FROM orders", "FROM {orders}"), orders=load(spark, sf_dir, "orders"))
    c = c.withColumns({"stratum": (F.col("region_id") % 6).cast("int"), "source_uid": F.col("region_id").cast("string")})
    return R.review_manifest(c, [a for a, _ in L.STRATA]).select("region_id", "review_uid", "layer")


@query("region_verdicts", "SELECT p_partkey AS poly_id, CASE WHEN p_size > 25 THEN 'agree' END AS verdict, CASE WHEN p_size > 25 THEN 'High' END AS confidence FROM part")
def region_verdicts(spark, sf_dir):
    p = load(spark, sf_dir, "part").withColumnRenamed("p_partkey", "poly_id")
    v = p.where("p_size > 25").select("poly_id", F.lit("agree").alias("verdict"), F.lit("High").alias("confidence"), F.lit("").alias("note"))
    return R.with_verdicts(p.select("poly_id"), v).select("poly_id", "verdict", "confidence")


@query("manual_relabel_upsert", "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'olivine' ELSE 'hcp' END AS new_label, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def manual_relabel_upsert(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("tile"), F.col("c_custkey").cast("string").alias("polygon"), F.lit("hcp").alias("new_label"))
    fresh = c.where("CAST(polygon AS BIGINT) % 3 = 0").withColumn("new_label", F.lit("olivine"))
    return J.supersede(c, fresh, ["tile", "polygon"]).groupBy("new_label").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------- streams

def event_stream(spark, sf_dir):
    schema = load(spark, sf_dir, "events").schema
    return D.read_table(spark, sf_dir, schema, "events.parquet").selectExpr(*DECISIONS[1])


def finished(query):
    query.awaitTermination()
    return query


@query("stream_progress", DEC + "SELECT predicted_class, CAST(count(*) AS BIGINT) AS n_decisions, CAST(count(CASE WHEN decision = 'confirm' THEN 1 END) AS BIGINT) AS n_confirm, CAST(sum(CASE WHEN decision = 'confirm' THEN n_pixels ELSE 0 END) AS BIGINT) AS pixels_confirmed FROM p GROUP BY predicted_class")
def stream_progress(spark, sf_dir):
    place = W.scratch(spark, "progress")
    finished(D.run_totals(D.progress(event_stream(spark, sf_dir)), f"{place}/table", f"{place}/checkpoint"))
    return log.read(spark, f"{place}/table", ["predicted_class"])


@query("stream_latest_decision", DEC + "SELECT polygon_uid, event_id, decision, n_pixels FROM (SELECT *, row_number() OVER (PARTITION BY polygon_uid ORDER BY ts DESC, event_id DESC) AS rn FROM p) q WHERE rn = 1")
def stream_latest_decision(spark, sf_dir):
    place = W.scratch(spark, "latest")
    write = D.merge_latest(f"{place}/table", ["ts", "event_id"])
    finished(D.run_batches(event_stream(spark, sf_dir), write, f"{place}/checkpoint"))
    return log.read(spark, f"{place}/table", ["polygon_uid"], ["ts", "event_id"]).select("polygon_uid", "event_id", "decision", "n_pixels")


@query("stream_csv_ledger", DEC + "SELECT predicted_class, CAST(count(*) AS BIGINT) AS n_decisions, CAST(sum(CASE WHEN decision = 'confirm' THEN n_pixels ELSE 0 END) AS BIGINT) AS pixels_confirmed FROM p GROUP BY predicted_class")
def stream_csv_ledger(spark, sf_dir):
    place = W.scratch(spark, "csv")
    d = derive(spark, sf_dir, DECISIONS).withColumn("ts", F.col("ts").cast("timestamp"))
    R.migrate_ledger(d).withColumn("area_m2", F.lit(0.0)).repartition(6).write.option("header", True).csv(f"{place}/ledger")
    finished(D.run_totals(D.progress(D.read_ledger(spark, f"{place}/ledger", files_per_batch=2)), f"{place}/table", f"{place}/checkpoint"))
    return log.read(spark, f"{place}/table", ["predicted_class"]).drop("n_confirm")


@query("stream_skip_decided", DEC + "SELECT polygon_uid, event_id FROM p WHERE polygon_uid NOT IN (SELECT 'u' || CAST(c_custkey AS STRING) FROM customer WHERE c_custkey % 2 = 0)")
def stream_skip_decided(spark, sf_dir):
    place = W.scratch(spark, "skip")
    decided = load(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("polygon_uid"))
    sink = lambda rows: rows.write.mode("append").parquet(f"{place}/table")
    finished(D.run_batches(event_stream(spark, sf_dir), D.skip_decided(decided, sink), f"{place}/checkpoint"))
    return spark.read.parquet(f"{place}/table").select("polygon_uid", "event_id")


@query("stream_first_seen", DEC + "SELECT DISTINCT polygon_uid FROM p")
def stream_first_seen(spark, sf_dir):
    place = W.scratch(spark, "first")
    rows = D.first_seen(event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "40 days").select("polygon_uid")
    q = rows.writeStream.format("parquet").outputMode("append").option("path", f"{place}/table").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    finished(q)
    return spark.read.parquet(f"{place}/table")


BAD_ROWS = "CASE WHEN zero_tail OR zero_run OR all_zero OR nodata OR nonfinite OR over_phys OR flat THEN 1 END"


@query("stream_audit", f"SELECT 't' || CAST(vec_id % 8 AS STRING) AS tile_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count({BAD_ROWS}) AS BIGINT) AS n_bad FROM ({AUDIT_SQL}) q GROUP BY 1")
def stream_audit(spark, sf_dir):
    place = W.scratch(spark, "audit")
    defects(spark, sf_dir).select("tile_id", "spectrum").repartition(4).write.parquet(f"{place}/in")
    schema = spark.read.parquet(f"{place}/in").schema
    finished(D.run_totals(D.audit_counts(D.read_table(spark, f"{place}/in", schema)), f"{place}/table", f"{place}/checkpoint"))
    return log.read(spark, f"{place}/table", ["tile_id"])


@query("stream_confirmed_upsert", UIDPIX + "SELECT x.polygon_uid, CAST(count(*) AS BIGINT) AS n, sum(CASE WHEN predicted_class = 'lcp' THEN 1e0 ELSE 0e0 END) AS lcp FROM x JOIN l ON l.polygon_uid = x.polygon_uid WHERE event_type IN ('purchase', 'click') GROUP BY x.polygon_uid")
def stream_confirmed_upsert(spark, sf_dir):
    place, order = W.scratch(spark, "confirmed"), ["ts", "event_id"]
    stream = event_stream(spark, sf_dir).withColumn("label_class", F.col("predicted_class")).withColumn("extra_classes", F.lit(None).cast("array<string>"))
    finished(D.run_batches(stream, D.upsert_confirmed(uid_pixels(spark, sf_dir), f"{place}/table", order), f"{place}/checkpoint"))
    return log.read(spark, f"{place}/table", ["polygon_uid"], order).groupBy("polygon_uid").agg(F.count(F.lit(1)).alias("n"), F.sum("lcp").alias("lcp"))
