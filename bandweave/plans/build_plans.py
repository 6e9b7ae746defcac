"""Whole table builds, per-tile quotas and gates, pooled lookups and median endmembers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import aggregates as A, curate as C, fitting as M, grid as H, sampling as S
from .curate_plans import GRID_AT, MC, NOMIN, far_tiles
from .grid_plans import NEAR, grid
from .labels_plans import defects
from .registry import ORACLES, query
from .sampling_plans import GRD, PIX, ROW, ROWS, h
from .spectral_plans import VALS, total
from .tables import PIXELS, SPECTRA, derive, load

SUMS = ["plagioclase", "alteration", "bland", "junk", "other"]
MINERAL = "(olivine_t1 > 5e-1 OR olivine_t2 > 5e-1 OR lcp > 5e-1 OR hcp > 5e-1 OR plagioclase > 5e-1)"


def stamped(source: str, rows: str, tier: str, **values: str) -> str:
    """One source of the build as SQL: its name, pixel, tier and stamped sums."""
    named = ", ".join(f"{values.get(c, '0e0')} AS {c}" for c in SUMS)
    return f"SELECT '{source}' AS build_source, tile_id, pixel_row, pixel_col, {tier} AS confidence_tier, {named} FROM ({rows}) s_{source}"


GRADED = "(SELECT * FROM {} WHERE rs <> 'v3' OR tier IN ('Reviewed-High', 'Reviewed-Moderate'))"
LEGACY = "CASE WHEN rs = 'legacy' THEN 'Reviewed-Legacy' ELSE tier END"
REGION = "CAST(substr(tile_id, 2) AS BIGINT) BETWEEN 1028 AND 1396"


def bland_sql(name: str, region: str, seed: int) -> str:
    return f"{name} AS (SELECT * FROM rej WHERE neg = '' AND {region} AND {NOMIN} ORDER BY {h(seed, *ROW)}, {ROWS} LIMIT 200)"


@query("seven_class_table", MC + f""", x AS (SELECT *, coalesce(negative_of, '') AS neg, CASE WHEN regexp_matches(review_path, '_7cls_v\\d+') THEN 'v3' ELSE 'legacy' END AS rs,
 CASE WHEN regexp_matches(review_path, '_7cls_v\\d+') THEN 'Reviewed-' || confidence_tier ELSE 'High' END AS tier FROM p),
conf AS (SELECT *, row_number() OVER (PARTITION BY rs, tile_id, polygon_id ORDER BY {h(42, *ROW)}, {ROWS}) AS rn FROM x WHERE split = 'val' AND confidence_tier = 'High'),
rej AS (SELECT * FROM x WHERE split = 'val' AND confidence_tier <> 'High'), ses AS (SELECT * FROM x WHERE split = 'test'),
hb AS (SELECT * FROM x WHERE split = 'train' AND other > 0 ORDER BY {h(42, *ROW)}, {ROWS} LIMIT 200),
{bland_sql("b13", REGION, 53)}, {bland_sql("b11", "NOT (" + REGION + ")", 63)},
u AS ({stamped("base", "SELECT * FROM x WHERE split = 'train' AND other <= 0", "confidence_tier", plagioclase="plagioclase", alteration="alteration")}
 UNION ALL {stamped("base", "SELECT * FROM hb", "confidence_tier", bland="1e0", other="1e0")}
 UNION ALL {stamped("confirmed", "SELECT * FROM " + GRADED.format("conf") + " c1 WHERE rs = 'v3' OR rn <= 1", LEGACY, plagioclase="plagioclase", alteration="alteration")}
 UNION ALL {stamped("reassigned", "SELECT * FROM " + GRADED.format("rej") + f" r1 WHERE neg = '' AND NOT ({NOMIN})", LEGACY, plagioclase="plagioclase", alteration="alteration")}
 UNION ALL {stamped("mc13_bland", "SELECT * FROM " + GRADED.format("b13") + " g1", LEGACY, bland="1e0", other="1e0")}
 UNION ALL {stamped("mc11_bland", "SELECT * FROM " + GRADED.format("b11") + " g2", LEGACY, bland="1e0", other="1e0")}
 UNION ALL {stamped("junk", "SELECT * FROM " + GRADED.format("rej") + " r2 WHERE neg = 'ambiguous' AND rs = 'v3'", "tier", junk="1e0")}
 UNION ALL {stamped("alteration", "SELECT * FROM " + GRADED.format("rej") + " r3 WHERE neg = 'alteration' AND rs = 'v3'", "tier", alteration="1e0")}),
o AS (SELECT * FROM u WHERE (tile_id, pixel_row, pixel_col) NOT IN (SELECT tile_id, pixel_row, pixel_col FROM ses)
 UNION ALL {stamped("session", f"SELECT * FROM ses WHERE neg = '' AND {MINERAL}", "confidence_tier", plagioclase="plagioclase", alteration="alteration")}
 UNION ALL {stamped("session", f"SELECT * FROM ses WHERE neg = '' AND NOT {MINERAL} AND other > 5e-1", "confidence_tier", bland="1e0", other="1e0")}
 UNION ALL {stamped("session", "SELECT * FROM ses WHERE neg = 'alteration'", "confidence_tier", alteration="1e0")}
 UNION ALL {stamped("session", "SELECT * FROM ses WHERE neg = 'ambiguous'", "confidence_tier", junk="1e0")})
SELECT build_source, confidence_tier, CAST(count(*) AS BIGINT) AS n, {", ".join(f"sum({c}) AS {c}" for c in SUMS)} FROM o GROUP BY build_source, confidence_tier""")
def seven_class_table(spark, sf_dir):
    p = far_tiles(spark, sf_dir)
    r = p.withColumn("review_session", L.session_of("review_path"))
    r = r.where("split = 'val'").withColumn("high", F.col("confidence_tier") == "High").withColumn(
        "confidence_tier", F.when(F.col("review_session") == "v3", F.concat(F.lit("Reviewed-"), F.col("confidence_tier"))).otherwise("High"))
    out = C.seven_class_table(p.where("split = 'train'"), r.where("high").drop("high"), r.where("NOT high").drop("high"), p.where("split = 'test'"),
                              200, ROW, 42, ["High", "Moderate"], ["lcp", "bland"], 1)
    return out.groupBy("build_source", "confidence_tier").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in SUMS])


@query("review_augmented", PIX + f""", e AS (SELECT * FROM p WHERE split = 'train'), r AS (SELECT * FROM p WHERE split = 'val' OR (split = 'train' AND pixel_col = 5)), a AS (SELECT * FROM p WHERE split = 'test' AND negative_of = 'alteration'),
g AS (SELECT polygon_id, row_number() OVER (ORDER BY {h(3, "polygon_id")}, polygon_id) AS rn, greatest(1, CAST(round_even(count(*) OVER () * 1e-1, 0) AS BIGINT)) AS n FROM (SELECT DISTINCT polygon_id FROM a) d)
SELECT split, CAST(count(*) AS BIGINT) AS n, sum(alteration) AS alteration, round(sum(w), 4) AS weight, CAST(count(CASE WHEN tier = 'Reviewed' THEN 1 END) AS BIGINT) AS reviewed FROM (
 SELECT split, alteration, coalesce(confidence_weight, 0e0) AS w, confidence_tier AS tier FROM e WHERE (tile_id, pixel_row, pixel_col) NOT IN (SELECT tile_id, pixel_row, pixel_col FROM r)
 UNION ALL SELECT split, 0e0, coalesce(confidence_weight, 0e0), confidence_tier FROM r UNION ALL SELECT split, 0e0, coalesce(confidence_weight, 0e0), confidence_tier FROM p WHERE split = 'test' AND negative_of = 'ambiguous'
 UNION ALL SELECT CASE WHEN rn <= n THEN 'val' WHEN rn <= 2 * n THEN 'test' ELSE 'train' END, 1e0, 5e-1, 'Reviewed' FROM a JOIN g USING (polygon_id)) q GROUP BY split""")
def review_augmented(spark, sf_dir):
    p = derive(spark, sf_dir, PIXELS)
    review = p.where("split = 'val' OR (split = 'train' AND pixel_col = 5)").drop("alteration")
    test = p.where("split = 'test'")
    out = C.review_augmented(p.where("split = 'train'").withColumn("confidence_weight", F.coalesce("confidence_weight", F.lit(0.0))), review,
                             test.where("negative_of = 'ambiguous'").drop("alteration"), test.where("negative_of = 'alteration'"), 0.5, "Reviewed", 0.1, 3)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("alteration").alias("alteration"), F.round(F.sum("confidence_weight"), 4).alias("weight"),
                                    F.count_if(F.col("confidence_tier") == "Reviewed").alias("reviewed"))


BLAND_TILES = "SELECT 't' || CAST(s_suppkey AS STRING) AS tile_id FROM supplier WHERE s_nationkey < 8"


def bland_tiles(spark, sf_dir):
    return spark.sql(BLAND_TILES.replace("FROM supplier", "FROM {t}"), t=load(spark, sf_dir, "supplier"))


@query("bland_tile_quota", PIX + f", b AS ({BLAND_TILES}) SELECT {ROWS} FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY {h(9, *ROW)}, {ROWS}) AS rn FROM p) q WHERE rn <= 25 OR tile_id NOT IN (SELECT tile_id FROM b)")
def bland_tile_quota(spark, sf_dir):
    return S.quota_on_tiles(derive(spark, sf_dir, PIXELS).select(*ROW), bland_tiles(spark, sf_dir), ROW, 25, 9)


DRAW = f"(CAST(('0x' || left({h(11, *ROW)}, 8)) AS BIGINT) / 4294967296e0)"


@query("bland_tile_splits", PIX + f", b AS ({BLAND_TILES}) SELECT {ROWS}, CASE WHEN tile_id NOT IN (SELECT tile_id FROM b) THEN split WHEN {DRAW} < 7e-1 THEN 'train' WHEN {DRAW} < 85e-2 THEN 'val' ELSE 'test' END AS split FROM p")
def bland_tile_splits(spark, sf_dir):
    return S.split_on_tiles(derive(spark, sf_dir, PIXELS).select(*ROW, "split"), bland_tiles(spark, sf_dir), ROW, 11)


@query("other_tile_gate", PIX + f", b AS ({BLAND_TILES}) SELECT {ROWS} FROM p WHERE other <= 5e-1 OR tile_id IN (SELECT tile_id FROM b)")
def other_tile_gate(spark, sf_dir):
    p = derive(spark, sf_dir, PIXELS).select(*ROW, "other")
    return S.gate_on_tiles(p, bland_tiles(spark, sf_dir), F.col("other") > 0.5).select(*ROW)


@query("pooled_parameter_lookup", GRD + f""", k AS (SELECT a.tile_id, a.pixel_row, a.pixel_col, avg(CASE WHEN b.value BETWEEN 2e-1 AND 6e-1 THEN b.value END) AS pooled FROM p a {NEAR.format(h=3)} GROUP BY 1, 2, 3),
l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {GRID_AT} FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN pooled BETWEEN 2e-1 AND 6e-1 THEN pooled END, 4) AS pooled FROM l LEFT JOIN k USING (tile_id, pixel_row, pixel_col)""")
def pooled_parameter_lookup(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *GRID_AT.split(", "))
    out = H.pooled_at(rows, grid(spark, sf_dir), "value", "pooled", 0.2, 0.6)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("pooled", 4).alias("pooled"))


@query("median_endmembers", f"WITH {VALS}, m AS (SELECT label, i, median(CAST(v AS DOUBLE)) AS m FROM v GROUP BY label, i) SELECT 'c' || CAST(label AS STRING) AS class, round(sum(m), 5) AS total, round(sum(m * i), 4) AS moment, CAST(count(*) AS BIGINT) AS bands FROM m GROUP BY label")
def median_endmembers(spark, sf_dir):
    m = M.median_endmembers(derive(spark, sf_dir, SPECTRA), "spectrum")
    return m.select("class", F.round(total(F.col("spectrum")), 5).alias("total"), F.round(total(F.transform("spectrum", lambda x, i: x * (i + 1))), 4).alias("moment"),
                    F.size("spectrum").cast("bigint").alias("bands"))


@query("worst_tile_gate", f"SELECT arg_max(tile_id, (n_bad / n_rows, tile_id)) AS tile_id, round(max(n_bad / n_rows), 9) AS share, max(n_bad / n_rows) <= 5e-1 AS passed FROM ({ORACLES['spectrum_defect_rates']}) q")
def worst_tile_gate(spark, sf_dir):
    rates = A.audit_summary(defects(spark, sf_dir), "spectrum", ["tile_id"])
    return A.worst_tile_gate(rates, 0.5).withColumn("share", F.round("share", 9))
