"""Pixel, spectrum, grid, score and decision tables derived from the given tables.

Every derivation is a list of select expressions over one given table. Spark applies
them with ``selectExpr``; the check SQL uses the same text as a common table
expression, so both engines start from the same derived rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PIXELS = ("lineitem", [
    "'t' || CAST(l_suppkey AS STRING) AS tile_id",
    "l_partkey AS polygon_id",
    "l_orderkey AS pixel_row",
    "CAST(l_linenumber AS BIGINT) AS pixel_col",
    "CASE WHEN CAST(l_quantity AS BIGINT) % 5 = 0 THEN 1e0 WHEN CAST(l_quantity AS BIGINT) % 5 = 1 THEN 5e-1 ELSE 0e0 END AS olivine_t1",
    "CASE WHEN CAST(l_quantity AS BIGINT) % 7 = 0 THEN 1e0 WHEN CAST(l_quantity AS BIGINT) % 5 = 1 THEN 5e-1 ELSE 0e0 END AS olivine_t2",
    "CASE WHEN l_discount > 7.5e-2 THEN 1e0 ELSE 0e0 END AS lcp",
    "CASE WHEN l_tax > 6.5e-2 THEN 1e0 ELSE 0e0 END AS hcp",
    "CASE WHEN l_linenumber = 7 THEN 1e0 ELSE 0e0 END AS plagioclase",
    "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1e0 ELSE 0e0 END AS other",
    "CASE WHEN l_returnflag = 'N' AND l_linenumber = 2 THEN 1e0 ELSE 0e0 END AS alteration",
    "CASE l_returnflag WHEN 'A' THEN 'High' WHEN 'N' THEN 'Moderate' ELSE 'Low' END AS confidence_tier",
    "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity / 5e1 END AS confidence_weight",
    "CASE WHEN l_linenumber IN (3, 6) THEN '' WHEN l_linenumber = 1 THEN 'alteration' WHEN l_linenumber = 2 THEN 'ambiguous' WHEN l_linenumber = 4 THEN 'olivine' END AS negative_of",
    "CASE WHEN l_linestatus = 'O' THEN 'review_7cls_v3/' ELSE 'review/' END || l_returnflag AS review_path",
    "CASE WHEN l_orderkey % 20 < 14 THEN 'train' WHEN l_orderkey % 20 < 17 THEN 'val' ELSE 'test' END AS split",
    "l_discount AS m0", "l_tax AS m1", "l_quantity / 5e1 AS m2", "l_extendedprice / 1e5 AS m3",
])

SPECTRA = ("embeddings", [
    "vec_id",
    "'c' || CAST(label AS STRING) AS class",
    "CASE WHEN vec_id % 3 = 0 THEN 'hand' WHEN vec_id % 3 = 1 THEN 'confirmed' ELSE 'reassigned' END AS source",
    "'t' || CAST(vec_id % 8 AS STRING) AS tile_id",
    "CAST(floor(vec_id / 2e1) AS BIGINT) AS polygon_id",
    "CAST(floor(vec_id / 2.5e1) AS BIGINT) AS pixel_row",
    "CAST(vec_id % 25 AS BIGINT) AS pixel_col",
    "embedding AS spectrum",
])

GRID = ("orders", [
    "o_orderkey AS pixel",
    "'g' || CAST(CAST(floor(o_orderkey / 2.5e3) AS BIGINT) AS STRING) AS tile_id",
    "CAST(floor((o_orderkey % 2500) / 5e1) AS BIGINT) AS pixel_row",
    "CAST(o_orderkey % 50 AS BIGINT) AS pixel_col",
    "o_totalprice / 5e5 AS value",
    "o_custkey % 11 <> 0 AS valid",
    "CAST(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS BIGINT) AS code",
    "o_custkey AS covariate",
])

DECISIONS = ("events", [
    "event_id", "ts", "'u' || CAST(user_id AS STRING) AS polygon_uid",
    "'t' || CAST(user_id % 40 AS STRING) AS tile_id",
    "CASE WHEN user_id % 4 = 0 THEN 'olivine' WHEN user_id % 4 = 1 THEN 'lcp' WHEN user_id % 4 = 2 THEN 'hcp' ELSE 'plagioclase' END AS predicted_class",
    "CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'click' THEN 'confirm' WHEN 'error' THEN 'skip' ELSE 'reject' END AS decision",
    "CASE event_type WHEN 'view' THEN 'hcp' WHEN 'signup' THEN 'alteration' END AS corrected_class",
    "CAST(floor(value) AS BIGINT) AS n_pixels",
    "CASE WHEN event_id % 3 = 0 THEN 'High' WHEN event_id % 3 = 1 THEN 'Moderate' ELSE 'Low' END AS confidence",
])

CATEGORY_OF_PART = (
    "CASE p_type WHEN 'ECONOMY' THEN 'Type 1 olivine' WHEN 'SMALL' THEN 'hcp + olivine' WHEN 'PROMO' THEN 'lcp' "
    "WHEN 'LARGE' THEN 'plagioclase + alteration' WHEN 'MEDIUM' THEN 'Other' ELSE 'red slope' END || "
    "CASE WHEN p_size % 4 = 0 THEN ' (High)' WHEN p_size % 4 = 1 THEN ' (moderate)' WHEN p_size % 4 = 2 THEN ' (Low)' ELSE '' END AS Category")

POLYGONS = ("part", [
    "p_partkey AS polygon_id",
    "'t' || CAST(p_partkey % 37 AS STRING) AS tile_id",
    CATEGORY_OF_PART,
    "p_name", "p_size", "p_retailprice",
])

SCORES_SQL = """
  SELECT l.doc_id AS row_id, d.lang AS tier, 't' || CAST(d.doc_id % 8 AS STRING) AS tile_id,
         CAST(l.quality AS DOUBLE) AS y0, CAST(l.toxic AS DOUBLE) AS y1,
         CAST(CASE WHEN d.n_chars % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS y2,
         (d.n_chars % 997) / 9.97e2 AS s0, (d.doc_id * 37 % 101) / 1.01e2 AS s1, (d.n_chars % 64) / 6.4e1 AS s2
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, table: tuple[str, list[str]]) -> DataFrame:
    source, exprs = table
    return load(spark, sf_dir, source).selectExpr(*exprs)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and score columns for three classes, from the labelled documents."""
    return spark.sql(SCORES_SQL.replace("labels l", "{labels} l").replace("documents d", "{documents} d"),
                     labels=load(spark, sf_dir, "labels"), documents=load(spark, sf_dir, "documents"))


def cte(**tables) -> str:
    """WITH clause text for the check SQL."""
    parts = []
    for name, table in tables.items():
        body = table if isinstance(table, str) else f"SELECT {', '.join(table[1])} FROM {table[0]}"
        parts.append(f"{name} AS ({body})")
    return "WITH " + ", ".join(parts) + " "


def greedy_sql(points: str, limit: int, cap: int) -> str:
    """Common table expressions (needs WITH RECURSIVE) and query that walk ``points`` (tile_id, pixel_row,
    pixel_col, k) in the order of k and keep those no kept point is closer to than the root of ``limit``."""
    far = "(x.r - o.pixel_row) * (x.r - o.pixel_row) + (x.c - o.pixel_col) * (x.c - o.pixel_col)"
    return f""", o AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY k, pixel_row, pixel_col) AS n FROM {points}),
g AS (SELECT DISTINCT tile_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(r BIGINT, c BIGINT)[]) AS kept FROM o
  UNION ALL SELECT g.tile_id, o.n, CASE WHEN len([x for x in g.kept if {far} < {limit}]) = 0 THEN list_append(g.kept, {{'r': o.pixel_row, 'c': o.pixel_col}}) ELSE g.kept END
  FROM g JOIN o ON o.tile_id = g.tile_id AND o.n = g.n + 1),
z AS (SELECT tile_id, unnest(list_slice(arg_max(kept, n), 1, {cap})) AS x FROM g GROUP BY tile_id)
SELECT tile_id, x.r AS pixel_row, x.c AS pixel_col FROM z"""
