"""Joins, source policies and corpus assembly on the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import curate as C, joins as J
from ..schema import CORPUS_CLASSES
from .registry import ORACLES, query
from .sampling_plans import PIX, ROW, ROWS, h
from .tables import DECISIONS, GRID, PIXELS, POLYGONS, SPECTRA, cte, derive, load

POLY, GRD, SPEC = cte(p=POLYGONS), cte(p=GRID), cte(p=SPECTRA)


def pixels(spark, sf_dir):
    return derive(spark, sf_dir, PIXELS)


@query("join_features", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount + l_tax + o_totalprice, 4) AS total, CAST(3 AS BIGINT) AS width FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def join_features(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", F.array("l_discount", "l_tax").alias("spectrum"))
    p = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.array("o_totalprice").alias("params"))
    f = s.join(p, "l_orderkey").withColumn("features", F.concat("spectrum", "params"))
    return f.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
                    F.size("features").cast("bigint").alias("width"))


@query("inherit_split", """
SELECT coalesce(o.split, 'train') AS split, CAST(count(*) AS BIGINT) AS n FROM lineitem l LEFT JOIN
 (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'val' ELSE 'test' END AS split FROM orders WHERE o_orderstatus <> 'P') o ON l.l_orderkey = o.o_orderkey GROUP BY 1""")
def inherit_split(spark, sf_dir):
    o = load(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("pixel_row"), F.when(F.col("o_orderstatus") == "O", "val").otherwise("test").alias("split"))
    return J.inherit_split(pixels(spark, sf_dir), o, ["pixel_row"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


TOUCHED = "touched AS (SELECT 't' || CAST(o_custkey % 100 AS STRING) AS tile_id, o_orderkey AS pixel_row, CAST(o_orderkey % 7 + 1 AS BIGINT) AS pixel_col FROM orders WHERE o_orderstatus = 'F')"


def touched(spark, sf_dir):
    return load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr(
        "'t' || CAST(o_custkey % 100 AS STRING) AS tile_id", "CAST(o_orderkey AS INT) AS pixel_row", "CAST(o_orderkey % 7 + 1 AS INT) AS pixel_col")


@query("suppress_pixels", PIX + f", {TOUCHED} SELECT {ROWS} FROM p WHERE (pixel_row, pixel_col) NOT IN (SELECT pixel_row, pixel_col FROM touched)")
def suppress_pixels(spark, sf_dir):
    return J.suppress(pixels(spark, sf_dir).select(*ROW), J.typed_keys(touched(spark, sf_dir)), ["pixel_row", "pixel_col"])


@query("drop_labelled_pixels", PIX + f""", {TOUCHED}
SELECT CAST(count(*) AS BIGINT) AS mined, CAST(count(CASE WHEN (pixel_row, pixel_col) IN (SELECT pixel_row, pixel_col FROM p) THEN 1 END) AS BIGINT) AS dropped FROM touched""")
def drop_labelled_pixels(spark, sf_dir):
    t = J.typed_keys(touched(spark, sf_dir))
    kept = J.suppress(t, pixels(spark, sf_dir), ["pixel_row", "pixel_col"])
    n = t.agg(F.count(F.lit(1)).alias("mined"))
    return n.withColumn("dropped", F.col("mined") - kept.agg(F.count(F.lit(1)).alias("k")).scalar())


@query("reviewed_row_wins", PIX + f""", r AS (SELECT * FROM p WHERE split = 'val' AND confidence_tier = 'High')
SELECT {ROWS}, src FROM (SELECT {ROWS}, 'base' AS src FROM p WHERE (pixel_row, pixel_col) NOT IN (SELECT pixel_row, pixel_col FROM r) UNION ALL SELECT {ROWS}, 'review' FROM r) q""")
def reviewed_row_wins(spark, sf_dir):
    p = pixels(spark, sf_dir)
    r = p.where("split = 'val' AND confidence_tier = 'High'").select(*ROW, F.lit("review").alias("src"))
    return J.supersede(p.select(*ROW, F.lit("base").alias("src")), r, ["pixel_row", "pixel_col"])


@query("stamp_label_sets", PIX + """, pure AS (SELECT p_partkey AS polygon_id FROM part WHERE p_type = 'PROMO'), mixed AS (SELECT p_partkey AS polygon_id FROM part WHERE p_type IN ('PROMO', 'SMALL'))
, k AS (SELECT p.*, polygon_id IN (SELECT polygon_id FROM pure) AS pu, polygon_id IN (SELECT polygon_id FROM mixed) AS mi FROM p)
SELECT split, sum(CASE WHEN pu OR mi THEN 1e0 ELSE 0e0 END) AS n_all, sum(CASE WHEN pu THEN 1e0 ELSE 0e0 END) AS n_pure, sum(CASE WHEN pu OR mi AND split <> 'train' THEN 1e0 ELSE 0e0 END) AS n_pure_train FROM k GROUP BY split""")
def stamp_label_sets(spark, sf_dir):
    part = load(spark, sf_dir, "part").withColumnRenamed("p_partkey", "polygon_id")
    pure, mixed = part.where("p_type = 'PROMO'"), part.where("p_type IN ('PROMO', 'SMALL')")
    p = pixels(spark, sf_dir).select("polygon_id", "split")
    for name, mode in (("n_all", "all"), ("n_pure", "pure_only"), ("n_pure_train", "pure_train_only")):
        p = J.stamp_sets(p, ["polygon_id"], pure, mixed, name, mode)
    return p.groupBy("split").agg(*[F.sum(c).alias(c) for c in ("n_all", "n_pure", "n_pure_train")])


@query("drop_listed_polygons", PIX + f"SELECT {ROWS} FROM p WHERE polygon_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def drop_listed_polygons(spark, sf_dir):
    listed = load(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("polygon_id"))
    return J.drop_listed(pixels(spark, sf_dir).select(*ROW), listed, ["polygon_id"])


RELABEL = "SELECT 'T' || CAST(user_id % 100 AS STRING) AS tile, CAST(user_id AS STRING) AS polygon, event_id, CASE event_type WHEN 'click' THEN 'hcp (Moderate)' WHEN 'view' THEN 'lcp' WHEN 'error' THEN 'olivine' ELSE 'lcp + hcp (Low)' END AS new_label FROM events"


@query("relabel_override", PIX + f""", r AS ({RELABEL}),
s AS (SELECT lower(tile) AS t, polygon, event_id, CASE WHEN contains(new_label, 'hcp') THEN CASE WHEN contains(new_label, 'Moderate') THEN 6e-1 WHEN contains(new_label, 'Low') THEN 3e-1 ELSE 1e0 END END AS hcp,
  CASE WHEN contains(new_label, 'lcp') THEN CASE WHEN contains(new_label, 'Low') THEN 3e-1 ELSE 1e0 END END AS lcp FROM r),
l AS (SELECT t, polygon, arg_max(hcp, event_id) FILTER (WHERE hcp IS NOT NULL) AS hcp, arg_max(lcp, event_id) FILTER (WHERE lcp IS NOT NULL) AS lcp FROM s GROUP BY t, polygon)
SELECT p.tile_id, p.polygon_id, p.pixel_row, p.pixel_col, coalesce(l.hcp, p.hcp) AS hcp, coalesce(l.lcp, p.lcp) AS lcp, l.hcp IS NOT NULL OR l.lcp IS NOT NULL AS relabelled
FROM p LEFT JOIN l ON lower(p.tile_id) = l.t AND CAST(p.polygon_id AS STRING) = l.polygon""")
def relabel_override(spark, sf_dir):
    r = spark.sql(RELABEL.replace("FROM events", "FROM {events}"), events=load(spark, sf_dir, "events"))
    r = r.withColumns(L.relabel_targets("new_label"))
    return J.override_labels(pixels(spark, sf_dir).select(*ROW, "hcp", "lcp"), r, ["hcp", "lcp"], "event_id")


@query("already_reviewed", cte(p=DECISIONS) + """SELECT c_custkey FROM customer WHERE 'u' || CAST(c_custkey AS STRING) NOT IN (SELECT polygon_uid FROM p WHERE decision <> 'skip')""")
def already_reviewed(spark, sf_dir):
    d = derive(spark, sf_dir, DECISIONS).where("decision <> 'skip'")
    c = load(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("polygon_uid"))
    return J.drop_listed(c, d, ["polygon_uid"]).select("c_custkey")


@query("annotated_queue", cte(p=DECISIONS) + """, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY polygon_uid ORDER BY ts DESC, event_id DESC) AS rn FROM p) q WHERE rn = 1)
SELECT c_custkey, l.decision, l.n_pixels FROM customer LEFT JOIN l ON 'u' || CAST(c_custkey AS STRING) = l.polygon_uid""")
def annotated_queue(spark, sf_dir):
    from ..operators.sampling import latest
    last = latest(derive(spark, sf_dir, DECISIONS), "polygon_uid", ["ts", "event_id"])
    c = load(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("polygon_uid"))
    return c.join(last, "polygon_uid", "left").select("c_custkey", "decision", "n_pixels")


GRID_AT = "'g' || CAST(CAST(floor(l_orderkey / 2.5e3) AS BIGINT) AS STRING) AS tile_id, CAST(floor((l_orderkey % 2500) / 5e1) AS BIGINT) AS pixel_row, CAST(l_orderkey % 50 + CASE WHEN l_linenumber = 7 THEN 50 ELSE 0 END AS BIGINT) AS pixel_col"


@query("parameter_lookup", GRD + f", l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {GRID_AT} FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, value FROM l LEFT JOIN p USING (tile_id, pixel_row, pixel_col)")
def parameter_lookup(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[f"{e} AS {n}" for e, n in (x.rsplit(" AS ", 1) for x in GRID_AT.split(", "))])
    return J.lookup_at(l, derive(spark, sf_dir, GRID), ["value"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "value")


@query("repair_from_source", GRD + f""", l AS (SELECT l_orderkey, l_extendedprice / 1e5 AS value, {GRID_AT} FROM lineitem),
j AS (SELECT l.*, p.value AS nv, p.valid AS ok, l.tile_id IN ('g0', 'g3') AS listed FROM l LEFT JOIN p USING (tile_id, pixel_row, pixel_col))
SELECT CASE WHEN NOT listed THEN 'kept' WHEN ok IS NULL THEN 'out_of_bounds' WHEN NOT ok THEN 'nodata' WHEN nv = value THEN 'same' ELSE 'changed' END AS repair, CAST(count(*) AS BIGINT) AS n, round(sum(CASE WHEN listed AND ok THEN nv ELSE value END), 4) AS total FROM j GROUP BY 1""")
def repair_from_source(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").selectExpr("l_extendedprice / 1e5 AS value", *GRID_AT.split(", "))
    tiles = derive(spark, sf_dir, GRID).where("tile_id IN ('g0', 'g3')").select("tile_id")
    out = J.repair(l, derive(spark, sf_dir, GRID), tiles, "value", F.col("valid"))
    return out.groupBy("repair").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("stale_extraction", SPEC + """
, s AS (SELECT vec_id, tile_id, pixel_row, pixel_col FROM p WHERE vec_id % 3 <> 0)
SELECT tile_id, CAST(count(*) AS BIGINT) AS n_sampled, CAST(count(CASE WHEN tile_id <> 't5' AND vec_id % 7 <> 0 THEN 1 END) AS BIGINT) AS n_checked,
  CAST(count(CASE WHEN tile_id <> 't5' AND vec_id % 7 <> 0 AND vec_id % 11 = 0 THEN 1 END) AS BIGINT) AS n_mismatched, CAST(count(CASE WHEN tile_id = 't5' THEN 1 END) AS BIGINT) AS n_unverifiable FROM s GROUP BY tile_id""")
def stale_extraction(spark, sf_dir):
    s = derive(spark, sf_dir, SPECTRA)
    source = s.where("tile_id <> 't5' AND vec_id % 7 <> 0").withColumn(
        "spectrum", F.when(F.col("vec_id") % 11 == 0, F.transform("spectrum", lambda x: x + F.lit(0.01))).otherwise(F.transform("spectrum", lambda x: x + F.lit(0.0))))
    return J.stale_tiles(s.where("vec_id % 3 <> 0"), source, "spectrum")


@query("reattach_attributes", "SELECT o_orderkey, o_custkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def reattach_attributes(spark, sf_dir):
    o = load(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "o_totalprice", "o_custkey AS checked")
    c = load(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey", "c_custkey AS checked", "c_name")
    return J.reattach(o, c, ["o_custkey"], ["checked"]).select("o_orderkey", "o_custkey", "o_totalprice", "c_name")


RINGS = "SELECT p_partkey AS polygon_id, 'g' || CAST(p_partkey % 6 AS STRING) AS tile_id, CAST(p_partkey % 40 AS DOUBLE) AS x, CAST(p_partkey % 37 AS DOUBLE) AS y, 2e0 + p_size % 7 AS w, 15e-1 + p_size % 5 AS t FROM part"


def rings(spark, sf_dir):
    r = spark.sql(RINGS.replace("FROM part", "FROM {part}"), part=load(spark, sf_dir, "part"))
    pt = lambda x, y: F.struct((F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"))
    return r.select("polygon_id", "tile_id", F.array(pt(F.lit(0.0), F.lit(0.0)), pt(F.col("w"), F.lit(0.25)), pt(F.col("w") / 2, F.col("t"))).alias("ring"))


@query("point_in_polygon", GRD + f""", r AS ({RINGS}), v AS (SELECT polygon_id, tile_id, x AS ax, y AS ay, x + w AS bx, y + 25e-2 AS b_y, x + w / 2 AS cx, y + t AS cy FROM r),
e AS (SELECT polygon_id, tile_id, ax AS x0, ay AS y0, bx AS x1, b_y AS y1 FROM v UNION ALL SELECT polygon_id, tile_id, bx, b_y, cx, cy FROM v UNION ALL SELECT polygon_id, tile_id, cx, cy, ax, ay FROM v),
hit AS (SELECT e.polygon_id, p.pixel, count(*) AS k FROM e JOIN p ON e.tile_id = p.tile_id AND (e.y0 <= p.pixel_row + 5e-1) <> (e.y1 <= p.pixel_row + 5e-1)
   AND e.x0 + (p.pixel_row + 5e-1 - e.y0) / (e.y1 - e.y0) * (e.x1 - e.x0) > p.pixel_col + 5e-1 GROUP BY e.polygon_id, p.pixel)
SELECT hit.polygon_id, CAST(count(*) AS BIGINT) AS n_px, round(avg(p.value), 4) AS mean_value FROM hit JOIN p USING (pixel) WHERE k % 2 = 1 GROUP BY hit.polygon_id""")
def point_in_polygon(spark, sf_dir):
    j = J.polygon_pixel_join(rings(spark, sf_dir), derive(spark, sf_dir, GRID))
    return j.groupBy("polygon_id").agg(F.count(F.lit(1)).alias("n_px"), F.round(F.avg("value"), 4).alias("mean_value"))


BOX_A = "SELECT s_suppkey AS a_id, s_acctbal / 1e2 AS a_x0, s_nationkey * 1e0 AS a_y0, s_acctbal / 1e2 + 3e0 AS a_x1, s_nationkey + 15e-1 AS a_y1 FROM supplier"
BOX_B = "SELECT c_custkey AS b_id, c_acctbal / 1e2 AS b_x0, c_nationkey * 1e0 AS b_y0, c_acctbal / 1e2 + 2e0 AS b_x1, c_nationkey + 5e-1 AS b_y1 FROM customer"


@query("footprint_overlap", f"WITH a AS ({BOX_A}), b AS ({BOX_B}) SELECT a_id, b_id FROM a JOIN b ON a_x0 < b_x1 AND b_x0 < a_x1 AND a_y0 < b_y1 AND b_y0 < a_y1")
def footprint_overlap(spark, sf_dir):
    a = spark.sql(BOX_A.replace("FROM supplier", "FROM {t}"), t=load(spark, sf_dir, "supplier"))
    b = spark.sql(BOX_B.replace("FROM customer", "FROM {t}"), t=load(spark, sf_dir, "customer"))
    return J.box_overlap(a, b, 4.0).select("a_id", "b_id")


@query("first_containing_box", f"""WITH b AS (SELECT a_id AS box, a_x0 AS x0, a_y0 AS y0, a_x1 AS x1, a_y1 AS y1 FROM ({BOX_A}) q), c AS (SELECT c_custkey, c_acctbal / 1e2 AS x, c_nationkey + 25e-2 AS y FROM customer)
SELECT c_custkey, min(box) AS box FROM c LEFT JOIN b ON x >= x0 AND x <= x1 AND y >= y0 AND y <= y1 GROUP BY c_custkey""")
def first_containing_box(spark, sf_dir):
    a = spark.sql(BOX_A.replace("FROM supplier", "FROM {t}"), t=load(spark, sf_dir, "supplier"))
    boxes = a.selectExpr("a_id AS box", "a_x0 AS x0", "a_y0 AS y0", "a_x1 AS x1", "a_y1 AS y1")
    c = load(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal / 1e2 AS x", "c_nationkey + 25e-2 AS y")
    return J.first_containing(c, boxes, "c_custkey", "box", 4.0).select("c_custkey", "box")


@query("scene_disjoint_rows", PIX + """
SELECT CASE WHEN polygon_id IN (SELECT polygon_id FROM p WHERE split = 'train') THEN 'shared' ELSE 'disjoint' END AS kind, CAST(count(*) AS BIGINT) AS n FROM p WHERE split = 'test' GROUP BY 1""")
def scene_disjoint_rows(spark, sf_dir):
    p = pixels(spark, sf_dir)
    test, train = p.where("split = 'test'"), p.where("split = 'train'")
    parts = [J.disjoint_rows(test, train, "polygon_id", s).select(F.lit(k).alias("kind")) for s, k in ((True, "shared"), (False, "disjoint"))]
    return parts[0].unionByName(parts[1]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------- policies

@query("stamp_seven_classes", PIX + """
SELECT split, sum(1e0) AS bland, sum(0e0) AS junk, sum(plagioclase) AS plagioclase, sum(alteration) AS alteration, sum(1e0) AS other FROM p GROUP BY split""")
def stamp_seven_classes(spark, sf_dir):
    s = C.stamp_classes(pixels(spark, sf_dir), bland=1.0, zero_plag=False)
    return s.groupBy("split").agg(*[F.sum(c).alias(c) for c in ("bland", "junk", "plagioclase", "alteration", "other")])


@query("hand_label_policy", PIX + """
SELECT 'plag_only' AS policy, CAST(count(*) AS BIGINT) AS n, coalesce(sum(0e0), 0e0) AS mafic FROM p WHERE plagioclase > 5e-1
UNION ALL SELECT 'all', count(*), sum(olivine_t1 + olivine_t2 + lcp + hcp) FROM p UNION ALL SELECT 'none', 0, 0e0""")
def hand_label_policy(spark, sf_dir):
    p, out = pixels(spark, sf_dir), None
    for policy in ("plag_only", "all", "none"):
        one = C.hand_policy(p, policy).agg(F.lit(policy).alias("policy"), F.count(F.lit(1)).alias("n"), F.coalesce(
            F.sum(F.col("olivine_t1") + F.col("olivine_t2") + F.col("lcp") + F.col("hcp")), F.lit(0.0)).alias("mafic"))
        out = one if out is None else out.unionByName(one)
    return out


REV = PIX + ", r AS (SELECT *, CASE WHEN regexp_matches(review_path, '_7cls_v\\d+') THEN 'v3' ELSE 'legacy' END AS review_session, CASE WHEN regexp_matches(review_path, '_7cls_v\\d+') THEN 'Reviewed-' || confidence_tier ELSE 'High' END AS tier FROM p)\n"


def reviewed(spark, sf_dir):
    p = pixels(spark, sf_dir).withColumn("review_session", L.session_of("review_path"))
    return p.withColumn("confidence_tier", F.when(F.col("review_session") == "v3", F.concat(F.lit("Reviewed-"), F.col("confidence_tier"))).otherwise("High"))


@query("review_grade_filter", REV + f"SELECT {ROWS}, review_session FROM r WHERE review_session <> 'v3' OR tier IN ('Reviewed-High', 'Reviewed-Moderate')")
def review_grade_filter(spark, sf_dir):
    return C.review_grades(reviewed(spark, sf_dir), ["High", "Moderate"]).select(*ROW, "review_session")


@query("legacy_admission", REV + f"""
SELECT CASE WHEN review_session = 'legacy' THEN 'Reviewed-Legacy' ELSE tier END AS confidence_tier, CAST(count(*) AS BIGINT) AS n, CAST(sum(pixel_row) AS BIGINT) AS row_sum
FROM (SELECT *, row_number() OVER (PARTITION BY review_session, tile_id, polygon_id ORDER BY {h(42, *ROW)}, {ROWS}) AS rn FROM r) q WHERE review_session <> 'legacy' OR rn <= 1 GROUP BY 1""")
def legacy_admission(spark, sf_dir):
    kept = C.legacy_policy(reviewed(spark, sf_dir), "lcp", ["lcp", "hcp"], 1, 42, ROW, is_confirm=True)
    return C.stamp_legacy_tier(kept).groupBy("confidence_tier").agg(F.count(F.lit(1)).alias("n"), F.sum("pixel_row").alias("row_sum"))


@query("legacy_excluded", REV + "SELECT tier AS confidence_tier, CAST(count(*) AS BIGINT) AS n FROM r WHERE review_session <> 'legacy' GROUP BY tier")
def legacy_excluded(spark, sf_dir):
    kept = C.legacy_policy(reviewed(spark, sf_dir), "olivine", ["lcp", "hcp"], 1, 42, ROW)
    return kept.groupBy("confidence_tier").agg(F.count(F.lit(1)).alias("n"))


@query("confidence_defaults", PIX + f"SELECT {ROWS}, coalesce(confidence_weight, 1e0) AS confidence_weight, coalesce(CASE WHEN split = 'val' THEN NULL ELSE confidence_tier END, 'High') AS confidence_tier FROM p")
def confidence_defaults(spark, sf_dir):
    p = pixels(spark, sf_dir).withColumn("confidence_tier", F.when(F.col("split") != "val", F.col("confidence_tier")))
    return L.confidence_defaults(p).select(*ROW, "confidence_weight", "confidence_tier")


MC = PIX.replace("'t' || CAST(l_suppkey AS STRING) AS tile_id", "'t' || CAST(l_suppkey + 1025 AS STRING) AS tile_id")
NOMIN = "NOT (olivine_t1 > 0 OR olivine_t2 > 0 OR lcp > 0 OR hcp > 0 OR plagioclase > 0)"


def far_tiles(spark, sf_dir):
    return pixels(spark, sf_dir).withColumn("tile_id", F.concat(F.lit("t"), (F.substr("tile_id", F.lit(2)).cast("bigint") + 1025).cast("string")))


@query("region_tile_filter", MC + f"SELECT {ROWS} FROM p WHERE CAST(substr(tile_id, 2) AS BIGINT) BETWEEN 1028 AND 1396")
def region_tile_filter(spark, sf_dir):
    return far_tiles(spark, sf_dir).where(L.in_mc13("tile_id")).select(*ROW)


@query("bland_review_loader", MC + f"""
, a AS (SELECT *, row_number() OVER (PARTITION BY tile_id, polygon_id ORDER BY {h(42, *ROW)}, {ROWS}) AS rn FROM p WHERE (negative_of IS NULL OR negative_of = '') AND CAST(substr(tile_id, 2) AS BIGINT) BETWEEN 1028 AND 1396 AND {NOMIN})
SELECT {ROWS}, 1e0 AS bland, 1e0 AS other, 0e0 AS alteration, coalesce(confidence_weight, 1e0) AS confidence_weight FROM a WHERE rn <= 1 ORDER BY {h(43, *ROW)}, {ROWS} LIMIT 1500""")
def bland_review_loader(spark, sf_dir):
    out = C.bland_review(far_tiles(spark, sf_dir), True, 1500, 42, ROW, per_polygon=1)
    return out.select(*ROW, "bland", "other", "alteration", "confidence_weight")


@query("tag_loaders", PIX + f"""
, t AS (SELECT 'reassigned' AS kind, * FROM p WHERE (negative_of IS NULL OR negative_of = '') AND NOT ({NOMIN}) UNION ALL SELECT 'ambiguous', * FROM p WHERE negative_of = 'ambiguous' UNION ALL SELECT 'alteration', * FROM p WHERE negative_of = 'alteration')
SELECT kind, CAST(count(*) AS BIGINT) AS n, CASE kind WHEN 'ambiguous' THEN sum(1e0) ELSE sum(0e0) END AS junk, CASE kind WHEN 'alteration' THEN sum(1e0) WHEN 'ambiguous' THEN sum(0e0) ELSE sum(alteration) END AS alteration,
 CASE kind WHEN 'reassigned' THEN sum(plagioclase) ELSE sum(0e0) END AS plagioclase FROM t GROUP BY kind""")
def tag_loaders(spark, sf_dir):
    p = pixels(spark, sf_dir)
    parts = [("reassigned", C.reassigned(p, ROW, 1)), ("ambiguous", C.ambiguous(p, ROW, 2)), ("alteration", C.altered(p))]
    out = None
    for kind, df in parts:
        one = df.groupBy(F.lit(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("junk", "alteration", "plagioclase")])
        out = one if out is None else out.unionByName(one)
    return out


def spectra_pixels(spark, sf_dir):
    return pixels(spark, sf_dir).withColumn("spectrum", F.array("m0", "m1", "m2", "m3"))


FLAGGED = "q AS (SELECT *, (CASE WHEN olivine_t1 > 5e-1 OR olivine_t2 > 5e-1 THEN 1 ELSE 0 END) AS c0, (CASE WHEN lcp > 5e-1 THEN 1 ELSE 0 END) AS c1, (CASE WHEN hcp > 5e-1 THEN 1 ELSE 0 END) AS c2, (CASE WHEN plagioclase > 5e-1 THEN 1 ELSE 0 END) AS c3, (CASE WHEN alteration > 5e-1 THEN 1 ELSE 0 END) AS c4 FROM {src})"


def exploded(src: str, name: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS class, '{name}' AS source, tile_id, polygon_id, pixel_row, pixel_col, coalesce(confidence_weight, 1e0) AS confidence_weight, c0 + c1 + c2 + c3 + c4 > 1 AS multi FROM {src} WHERE c{i} = 1"
                              for i, c in enumerate(CORPUS_CLASSES))


@query("explode_classes", PIX + ", " + FLAGGED.format(src="p") + " " + exploded("q", "hand"))
def explode_classes(spark, sf_dir):
    return C.explode_classes(spectra_pixels(spark, sf_dir), "hand").drop("spectrum")


@query("fixed_class_rows", PIX + f"SELECT {ROWS}, 'bland_dust' AS class, 1e0 AS confidence_weight, false AS multi FROM p WHERE other > 5e-1")
def fixed_class_rows(spark, sf_dir):
    return C.fixed_class(spectra_pixels(spark, sf_dir).where("other > 0.5"), "bland_dust", "hand", 1.0).select(*ROW, "class", "confidence_weight", "multi")


ANYM = "(c0 + c1 + c2 + c3 > 0)"
SESSION = PIX + ", " + FLAGGED.format(src="p") + f""", s AS (SELECT *, coalesce(negative_of, '') AS neg FROM q),
x AS ({exploded("(SELECT * FROM s WHERE neg = '' AND " + ANYM + ")", 'ndviz')} UNION ALL SELECT 'bland_reject', 'ndviz', tile_id, polygon_id, pixel_row, pixel_col, coalesce(confidence_weight, 1e0), false FROM s WHERE neg = '' AND NOT {ANYM} AND other > 5e-1
 UNION ALL SELECT 'alteration', 'ndviz', tile_id, polygon_id, pixel_row, pixel_col, coalesce(confidence_weight, 1e0), false FROM s WHERE neg = 'alteration'
 UNION ALL SELECT 'junk', 'ndviz', tile_id, polygon_id, pixel_row, pixel_col, coalesce(confidence_weight, 1e0), false FROM s WHERE neg = 'ambiguous')
"""


@query("session_positives", SESSION + "SELECT * FROM x")
def session_positives(spark, sf_dir):
    return C.relabel_positives(spectra_pixels(spark, sf_dir)).drop("spectrum")


def corpus_parts(spark, sf_dir):
    p = spectra_pixels(spark, sf_dir)
    return (p.where("split = 'train'"), p.where("split = 'val' AND confidence_tier = 'High'"),
            p.where("split = 'val' AND confidence_tier <> 'High'"), p.where("split = 'test'"))


@query("assemble_corpus", PIX + ", " + FLAGGED.format(src="p") + f""",
hand AS (SELECT * FROM q WHERE split = 'train'), conf AS (SELECT * FROM q WHERE split = 'val' AND confidence_tier = 'High'), rej AS (SELECT *, coalesce(negative_of, '') AS neg FROM q WHERE split = 'val' AND confidence_tier <> 'High'), nd AS (SELECT *, coalesce(negative_of, '') AS neg FROM q WHERE split = 'test'),
hm AS (SELECT * REPLACE (CAST(0 AS INT) AS c4, 1e0 AS confidence_weight) FROM hand WHERE other <= 5e-1 AND {ANYM}),
allx AS ({exploded('hm', 'hand')} UNION ALL SELECT 'bland_dust', 'hand', tile_id, polygon_id, pixel_row, pixel_col, 1e0, false FROM hand WHERE other > 5e-1
 UNION ALL {exploded('conf', 'confirmed')} UNION ALL {exploded("(SELECT * FROM rej WHERE neg = '' AND " + ANYM + ")", 'reassigned')}
 UNION ALL SELECT 'alteration', 'tag', tile_id, polygon_id, pixel_row, pixel_col, coalesce(confidence_weight, 1e0), false FROM rej WHERE neg = 'alteration' UNION ALL SELECT 'junk', 'tag', tile_id, polygon_id, pixel_row, pixel_col, coalesce(confidence_weight, 1e0), false FROM rej WHERE neg = 'ambiguous'
 UNION ALL SELECT 'bland_reject', 'reassigned', tile_id, polygon_id, pixel_row, pixel_col, coalesce(confidence_weight, 1e0), false FROM rej WHERE neg = '' AND NOT {ANYM} AND other > 5e-1),
kept AS (SELECT * FROM allx WHERE (tile_id, pixel_row, pixel_col) NOT IN (SELECT tile_id, pixel_row, pixel_col FROM nd)
 UNION ALL {exploded("(SELECT * FROM nd WHERE neg = '' AND " + ANYM + ")", 'ndviz')} UNION ALL SELECT 'bland_reject', 'ndviz', tile_id, polygon_id, pixel_row, pixel_col, coalesce(confidence_weight, 1e0), false FROM nd WHERE neg = '' AND NOT {ANYM} AND other > 5e-1
 UNION ALL SELECT 'alteration', 'ndviz', tile_id, polygon_id, pixel_row, pixel_col, coalesce(confidence_weight, 1e0), false FROM nd WHERE neg = 'alteration' UNION ALL SELECT 'junk', 'ndviz', tile_id, polygon_id, pixel_row, pixel_col, coalesce(confidence_weight, 1e0), false FROM nd WHERE neg = 'ambiguous'),
d AS (SELECT *, row_number() OVER (PARTITION BY tile_id, pixel_row, pixel_col, class ORDER BY CASE source WHEN 'ndviz' THEN 0 WHEN 'reassigned' THEN 1 WHEN 'tag' THEN 2 WHEN 'confirmed' THEN 3 ELSE 4 END, polygon_id, confidence_weight) AS rn FROM kept)
SELECT class, source, tile_id, polygon_id, pixel_row, pixel_col, confidence_weight, multi FROM d WHERE rn = 1""")
def assemble_corpus(spark, sf_dir):
    return C.assemble(*corpus_parts(spark, sf_dir)).drop("spectrum")


@query("corpus_class_by_source", ORACLES["assemble_corpus"].rsplit("SELECT class, source,", 1)[0] + "SELECT class, " + ", ".join(
    f"CAST(count(CASE WHEN source = '{s}' THEN 1 END) AS BIGINT) AS {s}" for s in ("hand", "confirmed", "reassigned", "tag", "ndviz")) + " FROM d WHERE rn = 1 GROUP BY class")
def corpus_class_by_source(spark, sf_dir):
    corpus = C.assemble(*corpus_parts(spark, sf_dir))
    return corpus.groupBy("class").pivot("source", ["hand", "confirmed", "reassigned", "tag", "ndviz"]).count().na.fill(0)


@query("union_drifting_sources", PIX + """
SELECT src, CAST(count(*) AS BIGINT) AS n, sum(a) AS alteration, sum(CASE WHEN t = '' THEN 1e0 ELSE 0e0 END) AS blank_tier FROM (SELECT 'base' AS src, alteration AS a, confidence_tier AS t FROM p WHERE split = 'train' UNION ALL SELECT 'old', 0e0, '' FROM p WHERE split = 'val') q GROUP BY src""")
def union_drifting_sources(spark, sf_dir):
    p = pixels(spark, sf_dir)
    base = p.where("split = 'train'").withColumn("src", F.lit("base"))
    old = p.where("split = 'val'").withColumn("src", F.lit("old")).drop("alteration", "confidence_tier").withColumn("extra", F.lit(1))
    return C.union_aligned(base, old).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("alteration").alias("alteration"),
                                                         F.sum(F.when(F.col("confidence_tier") == "", 1.0).otherwise(0.0)).alias("blank_tier"))


@query("seven_class_build", PIX + f""", hand AS (SELECT split, plagioclase, alteration, 0e0 AS bland FROM p WHERE other <= 0 AND plagioclase > 5e-1),
b AS (SELECT split, 0e0 AS plagioclase, 0e0 AS alteration, 1e0 AS bland FROM p WHERE other > 0 ORDER BY {h(42, *ROW)}, {ROWS} LIMIT 3000)
SELECT split, CAST(count(*) AS BIGINT) AS n, sum(plagioclase) AS plagioclase, sum(alteration) AS alteration, sum(bland) AS bland FROM (SELECT * FROM hand UNION ALL SELECT * FROM b) q GROUP BY split""")
def seven_class_build(spark, sf_dir):
    out = C.seven_class_base(pixels(spark, sf_dir), 3000, ROW, 42, "plag_only")
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("plagioclase", "alteration", "bland")])


@query("apply_relabel_session", PIX + """, s AS (SELECT *, coalesce(negative_of, '') AS neg, olivine_t1 > 5e-1 OR olivine_t2 > 5e-1 OR lcp > 5e-1 OR hcp > 5e-1 OR plagioclase > 5e-1 AS mi FROM p WHERE split = 'test')
, o AS (SELECT split, plagioclase, alteration, other FROM p WHERE (tile_id, pixel_row, pixel_col) NOT IN (SELECT tile_id, pixel_row, pixel_col FROM s)
 UNION ALL SELECT split, plagioclase, alteration, 0e0 FROM s WHERE neg = '' AND mi UNION ALL SELECT split, 0e0, 0e0, 1e0 FROM s WHERE neg = '' AND NOT mi AND other > 5e-1
 UNION ALL SELECT split, 0e0, 1e0, 0e0 FROM s WHERE neg = 'alteration' UNION ALL SELECT split, 0e0, 0e0, 0e0 FROM s WHERE neg = 'ambiguous')
SELECT split, CAST(count(*) AS BIGINT) AS n, sum(plagioclase) AS plagioclase, sum(alteration) AS alteration, sum(other) AS other FROM o GROUP BY split""")
def apply_relabel_session(spark, sf_dir):
    p = pixels(spark, sf_dir)
    out = C.apply_session(p, p.where("split = 'test'"))
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("plagioclase", "alteration", "other")])


@query("conform_mined_rows", PIX + """, t AS (SELECT tile_id, row_number() OVER (ORDER BY tile_id) - 1 + (SELECT max(polygon_id) + 1 FROM p) AS pid FROM (SELECT DISTINCT tile_id FROM p WHERE split = 'test') z)
SELECT tile_id, CAST(max(pid) AS BIGINT) AS polygon_id, CAST(count(*) AS BIGINT) AS n, sum(1e0) AS other, sum(0e0) AS lcp, round(sum(m3), 4) AS m3, max('High') AS confidence_tier FROM p JOIN t USING (tile_id) WHERE split = 'test' GROUP BY tile_id""")
def conform_mined_rows(spark, sf_dir):
    p = pixels(spark, sf_dir)
    mined = p.where("split = 'test'").selectExpr("tile_id", "pixel_row", "pixel_col", "m0 AS band_00", "m1 AS band_01", "m2 AS band_02", "m3 AS band_03", "m0 AS RBR")
    first = p.agg(F.max("polygon_id").alias("m")).first()["m"] + 1
    out = C.negatives_like(mined, p, "High", 1.0, first)
    return out.groupBy("tile_id").agg(F.max("polygon_id").alias("polygon_id"), F.count(F.lit(1)).alias("n"), F.sum("other").alias("other"),
                                      F.sum("lcp").alias("lcp"), F.round(F.sum("m3"), 4).alias("m3"), F.max("confidence_tier").alias("confidence_tier"))
