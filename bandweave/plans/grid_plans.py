"""Grid, region, component and split queries on the derived grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A, graph as G, grid as H, split as P
from .registry import query
from .sampling_plans import GRD, PIX
from .tables import GRID, PIXELS, SPECTRA, cte, derive, load

KEY = "tile_id, pixel_row, pixel_col"


def grid(spark, sf_dir):
    return derive(spark, sf_dir, GRID)


NEAR = "JOIN p b ON a.tile_id = b.tile_id AND abs(a.pixel_row - b.pixel_row) <= {h} AND abs(a.pixel_col - b.pixel_col) <= {h}"


@query("window_mean", GRD + f"SELECT a.pixel, round(avg(CASE WHEN b.valid THEN b.value END), 3) AS pooled FROM p a {NEAR.format(h=3)} GROUP BY a.pixel")
def window_mean(spark, sf_dir):
    g = grid(spark, sf_dir).withColumn("v", F.when(F.col("valid"), F.col("value")).otherwise(65535.0))
    return H.mean_pool(g, "v", "pooled").select("pixel", F.round("pooled", 3).alias("pooled"))


@query("window_mean_nearest_edge", GRD + """, d AS (SELECT tile_id, max(pixel_row) AS mr, max(pixel_col) AS mc FROM p GROUP BY tile_id), o AS (SELECT unnest(range(-3, 4)) AS o),
n AS (SELECT a.pixel, a.tile_id, least(greatest(a.pixel_row + r.o, 0), d.mr) AS pixel_row, least(greatest(a.pixel_col + c.o, 0), d.mc) AS pixel_col FROM p a JOIN d ON d.tile_id = a.tile_id, o r, o c)
SELECT n.pixel, round(sum(CASE WHEN p.valid THEN p.value END) / count(CASE WHEN p.valid THEN 1 END), 3) AS smooth FROM n JOIN p USING (tile_id, pixel_row, pixel_col) GROUP BY n.pixel""")
def window_mean_nearest_edge(spark, sf_dir):
    g = grid(spark, sf_dir).withColumn("v", F.when(F.col("valid"), F.col("value")))
    return H.smooth_mean(g, "v", "smooth").select("pixel", F.round("smooth", 3).alias("smooth"))


@query("median_filter", GRD + """, d AS (SELECT tile_id, max(pixel_row) AS mr, max(pixel_col) AS mc FROM p GROUP BY tile_id), o AS (SELECT unnest(range(-1, 2)) AS o),
n AS (SELECT a.pixel, a.tile_id, least(greatest(a.pixel_row + r.o, 0), d.mr) AS pixel_row, least(greatest(a.pixel_col + c.o, 0), d.mc) AS pixel_col FROM p a JOIN d ON d.tile_id = a.tile_id, o r, o c)
SELECT n.pixel, quantile_cont(p.value, 5e-1) AS value FROM n JOIN p USING (tile_id, pixel_row, pixel_col) GROUP BY n.pixel""")
def median_filter(spark, sf_dir):
    return H.median3(grid(spark, sf_dir), "value").select("pixel", "value")


SIZED = ", d AS (SELECT tile_id, max(pixel_row) + 1 AS hh, max(pixel_col) + 1 AS ww FROM p GROUP BY tile_id)"
INSIDE = "a.pixel_row >= {h} AND a.pixel_row < hh - {h} AND a.pixel_col >= {h} AND a.pixel_col < ww - {h}"


@query("whole_patch_valid", GRD + SIZED + f" SELECT a.pixel, count(CASE WHEN b.valid THEN 1 END) = 9 AND {INSIDE.format(h=1)} AS centre FROM p a JOIN d ON d.tile_id = a.tile_id {NEAR.format(h=1)} GROUP BY a.pixel, a.pixel_row, a.pixel_col, hh, ww")
def whole_patch_valid(spark, sf_dir):
    return H.patch_centres(grid(spark, sf_dir), "valid", 3).select("pixel", "centre")


@query("valid_centres", GRD + SIZED + f" SELECT a.pixel FROM p a JOIN d ON d.tile_id = a.tile_id {NEAR.format(h=3)} WHERE {INSIDE.format(h=3)} GROUP BY a.pixel HAVING count(CASE WHEN b.valid THEN 1 END) / 49e0 >= 8e-1")
def valid_centres(spark, sf_dir):
    return H.patch_centres(grid(spark, sf_dir), "valid", 7, 0.8).where("centre").select("pixel")


@query("edge_mask", GRD + "SELECT a.pixel, a.valid AND count(CASE WHEN NOT b.valid AND abs(a.pixel_row - b.pixel_row) + abs(a.pixel_col - b.pixel_col) <= 2 THEN 1 END) > 0 AS edge FROM p a " + NEAR.format(h=2) + " GROUP BY a.pixel, a.valid")
def edge_mask(spark, sf_dir):
    return H.edge_mask(grid(spark, sf_dir), "valid", 2).select("pixel", "edge")


SPEC = cte(p=SPECTRA).replace("'t' || CAST(vec_id % 8 AS STRING) AS tile_id", "'e' AS tile_id")


def spectrum_grid(spark, sf_dir):
    return derive(spark, sf_dir, SPECTRA).withColumn("tile_id", F.lit("e"))


@query("spectrum_patches", SPEC + ", v AS (SELECT pixel_row, pixel_col, unnest(spectrum) AS v, generate_subscripts(spectrum, 1) AS i FROM p) SELECT c.vec_id, round(sum(CAST(v.v AS DOUBLE) * ((v.pixel_row - c.pixel_row + 3) * 7 + v.pixel_col - c.pixel_col + 4)), 4) AS weighted, CAST(49 AS BIGINT) AS n FROM p c JOIN v ON abs(v.pixel_row - c.pixel_row) <= 3 AND abs(v.pixel_col - c.pixel_col) <= 3 GROUP BY c.vec_id")
def spectrum_patches(spark, sf_dir):
    g = spectrum_grid(spark, sf_dir)
    p = H.patches(g, g, "spectrum", 64).join(g.select("tile_id", "pixel_row", "pixel_col", "vec_id"), ["tile_id", "pixel_row", "pixel_col"])
    total = lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
    w = F.aggregate(F.transform("patch", lambda s, i: total(s) * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return p.select("vec_id", F.round(w, 4).alias("weighted"), F.size("patch").cast("bigint").alias("n"))


@query("block_average", GRD + "SELECT tile_id, CAST(floor(pixel_row / 4e0) AS BIGINT) AS block_row, CAST(floor(pixel_col / 4e0) AS BIGINT) AS block_col, round(avg(value), 6) AS value, bool_and(valid) AS valid FROM p GROUP BY 1, 2, 3 HAVING count(*) = 16")
def block_average(spark, sf_dir):
    return H.block_average(grid(spark, sf_dir), ["value"], "valid", 4).withColumn("value", F.round("value", 6))


FLOOD = """, c AS (SELECT tile_id, {k} AS k, pixel_row * 100000 + pixel_col AS cell, pixel_row AS r, pixel_col AS c FROM p WHERE {w}), e AS (SELECT a.tile_id, a.k, a.cell AS s, b.cell AS d FROM c a JOIN c b ON a.tile_id = b.tile_id AND a.k = b.k AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
f AS (SELECT tile_id, k, cell, cell AS root FROM c UNION SELECT e.tile_id, e.k, e.d, f.root FROM f JOIN e ON e.tile_id = f.tile_id AND e.k = f.k AND e.s = f.cell WHERE f.root < e.d),
g AS (SELECT tile_id, k, cell, min(root) AS root FROM f GROUP BY tile_id, k, cell)
"""


def flood(k: str, w: str) -> str:
    return GRD.replace("WITH ", "WITH RECURSIVE ") + FLOOD.format(k=k, w=w)


@query("connected_regions", flood("0", "valid AND value > 55e-2") + "SELECT tile_id, CAST(floor(root / 1e5) AS BIGINT) AS row0, CAST(count(*) AS BIGINT) AS count_px, CAST(max(floor(cell / 1e5)) AS BIGINT) AS row1, CAST(min(cell % 100000) AS BIGINT) AS col0, CAST(max(cell % 100000) AS BIGINT) AS col1 FROM g GROUP BY tile_id, root HAVING count(*) >= 4")
def connected_regions(spark, sf_dir):
    table, _ = H.regions(grid(spark, sf_dir).where("valid AND value > 0.55"), min_px=4)
    return table.select("tile_id", "row0", "count_px", "row1", "col0", "col1")


@query("category_regions", flood("code", "valid") + "SELECT tile_id, k AS code, CAST(count(*) AS BIGINT) AS count_px, CAST(max(floor(cell / 1e5)) AS BIGINT) AS row1, CAST(min(cell % 100000) AS BIGINT) AS col0 FROM g GROUP BY tile_id, k, root HAVING count(*) >= 9")
def category_regions(spark, sf_dir):
    table, _ = H.regions(grid(spark, sf_dir).where("valid"), ["code"], min_px=9)
    return table.select("tile_id", "code", "count_px", "row1", "col0")


@query("zonal_statistics", flood("0", "valid AND value > 55e-2") + ", z AS (SELECT g.tile_id, g.root, p.value FROM g JOIN p ON p.tile_id = g.tile_id AND p.pixel_row * 100000 + p.pixel_col = g.cell) SELECT tile_id, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 5) AS value_std, min(value) AS value_min, max(value) AS value_max, round(quantile_cont(value, 5e-1), 6) AS value_median FROM z GROUP BY tile_id, root HAVING count(*) >= 4")
def zonal_statistics(spark, sf_dir):
    g = grid(spark, sf_dir)
    table, pixels = H.regions(g.where("valid AND value > 0.55"), min_px=4)
    z = H.zonal(pixels, g, ["value"], "value").join(table.select("region_id", "tile_id"), "region_id")
    return z.select("tile_id", "n", F.round("value_mean", 6).alias("value_mean"), F.round("value_std", 5).alias("value_std"), "value_min", "value_max", F.round("value_median", 6).alias("value_median"))


@query("threshold_regions", GRD.replace("WITH ", "WITH RECURSIVE ") + ", t AS (SELECT unnest([5e-1, 7e-1]) AS t)" + FLOOD.format(k="CAST(t * 100 AS BIGINT)", w="value >= t").replace("FROM p WHERE", "FROM p, t WHERE") + ", s AS (SELECT tile_id, k, root, count(*) AS n FROM g GROUP BY tile_id, k, root) SELECT 'a' AS mineral, k / 1e2 AS threshold, CAST(count(*) AS BIGINT) AS n_regions, CAST(sum(n) AS BIGINT) AS n_px FROM s WHERE n >= 4 GROUP BY k")
def threshold_regions(spark, sf_dir):
    masks = H.at_thresholds(grid(spark, sf_dir), {"a": "value"}, [0.5, 0.7])
    table, _ = H.regions(masks, ["mineral", "threshold"], 4)
    return table.groupBy("mineral", "threshold").agg(F.count(F.lit(1)).alias("n_regions"), F.sum("count_px").alias("n_px"))


@query("region_coherence", flood("code", "value > 3e-1") + ", s AS (SELECT 'k' || CAST(k AS STRING) AS class, count(*) AS n FROM g GROUP BY tile_id, k, root) SELECT class, CAST(count(*) AS BIGINT) AS n_components, CAST(quantile_cont(n, 5e-1) AS DOUBLE) AS median_size, round(CAST(quantile_cont(n, 9e-1) AS DOUBLE), 6) AS p90_size, CAST(max(n) AS BIGINT) AS max_size FROM s GROUP BY class UNION ALL SELECT 'k9', 0, 0e0, 0e0, 0")
def region_coherence(spark, sf_dir):
    g = grid(spark, sf_dir).where("value > 0.3").withColumn("class", F.concat(F.lit("k"), F.col("code").cast("string")))
    table, _ = H.regions(g, ["class"])
    return H.size_summary(table, "class", ["k0", "k1", "k2", "k9"]).withColumn("p90_size", F.round("p90_size", 6))


SMOOTH = GRD.replace("p AS (", "p0 AS (", 1).replace("WITH ", "WITH RECURSIVE ", 1) + """, d AS (SELECT tile_id, max(pixel_row) AS mr, max(pixel_col) AS mc FROM p0 GROUP BY tile_id), o AS (SELECT unnest(range(-1, 2)) AS o),
n AS (SELECT a.pixel, a.tile_id, least(greatest(a.pixel_row + r.o, 0), d.mr) AS pixel_row, least(greatest(a.pixel_col + c.o, 0), d.mc) AS pixel_col FROM p0 a JOIN d ON d.tile_id = a.tile_id, o r, o c),
s AS (SELECT n.pixel, quantile_cont(p0.value, 5e-1) AS value FROM n JOIN p0 USING (tile_id, pixel_row, pixel_col) GROUP BY n.pixel),
p AS (SELECT p0.* REPLACE (s.value AS value), p0.value AS raw FROM p0 JOIN s USING (pixel))"""


@query("smoothed_region_means", SMOOTH + FLOOD.format(k="0", w="valid AND value > 5e-1") + """, z AS (SELECT g.tile_id, g.root, p.value FROM g JOIN p ON p.tile_id = g.tile_id AND p.pixel_row * 100000 + p.pixel_col = g.cell)
SELECT tile_id || '|' || lpad(CAST(CAST(floor(root / 1e5) AS BIGINT) AS STRING), 8, '0') || '|' || lpad(CAST(root % 100000 AS STRING), 8, '0') AS region_id, CAST(count(*) AS BIGINT) AS n_px, round(avg(value), 5) AS b0, round(avg(value * 2), 4) AS b1 FROM z GROUP BY tile_id, root HAVING count(*) >= 9""")
def smoothed_region_means(spark, sf_dir):
    g = H.median3(grid(spark, sf_dir), "value")
    _, pixels = H.regions(g.where("valid AND value > 0.5"), min_px=9)
    s = g.withColumn("spectrum", F.array("value", F.col("value") * 2))
    return H.region_spectra(pixels, s, "spectrum", 2).select("region_id", "n_px", F.round(F.col("spectrum")[0], 5).alias("b0"), F.round(F.col("spectrum")[1], 4).alias("b1"))


@query("mosaic", "WITH p AS (SELECT c_custkey, 't' || CAST(c_nationkey AS STRING) AS tile_id, c_acctbal / 1e2 AS x, c_nationkey * 17e-1 AS y, c_acctbal AS v, CAST(floor(c_acctbal) AS BIGINT) AS pixel_row, c_custkey AS pixel_col FROM customer), k AS (SELECT *, CAST(floor((x + 10) / 5e0) AS BIGINT) AS cell_col, CAST(floor((45 - y) / 5e0) AS BIGINT) AS cell_row FROM p) SELECT cell_row, cell_col, v FROM (SELECT *, row_number() OVER (PARTITION BY cell_row, cell_col ORDER BY tile_id, pixel_row, pixel_col) AS rn FROM k) q WHERE rn = 1")
def mosaic(spark, sf_dir):
    c = load(spark, sf_dir, "customer").selectExpr("'t' || CAST(c_nationkey AS STRING) AS tile_id", "c_acctbal / 1e2 AS x", "c_nationkey * 17e-1 AS y", "c_acctbal AS v", "CAST(floor(c_acctbal) AS BIGINT) AS pixel_row", "c_custkey AS pixel_col")
    return H.mosaic(c, "x", "y", "tile_id", ["v"], (-10.0, 45.0), 5.0)


# ---------------------------------------------------------- components, splits

POINTS = "SELECT p_partkey AS id, (p_partkey * 7919 % 1009) / 5e1 + 40 AS lat, (p_partkey * 104729 % 997) / 5e1 - 10 AS lon FROM part"


def points(spark, sf_dir):
    return spark.sql(POINTS.replace("FROM part", "FROM {part}"), part=load(spark, sf_dir, "part"))


CLOSE = "(a.lat - b.lat) * (a.lat - b.lat) + pow((a.lon - b.lon) * cos(radians((a.lat + b.lat) / 2e0)), 2) <= 625e-4"


@query("distance_components", f"WITH RECURSIVE p AS ({POINTS}), e AS (SELECT a.id AS s, b.id AS d FROM p a JOIN p b ON a.id <> b.id AND {CLOSE}), f AS (SELECT id, id AS root FROM p UNION SELECT e.d, f.root FROM f JOIN e ON e.s = f.id WHERE f.root < e.d) SELECT id, min(root) AS component FROM f GROUP BY id")
def distance_components(spark, sf_dir):
    p = points(spark, sf_dir)
    return G.connected_components(p, G.distance_links(p, "id", 0.25))


@query("leakage_pairs", f"WITH q AS ({POINTS}), p AS (SELECT *, 'c' || CAST(id % 3 AS STRING) AS class, id % 5 = 0 AS held FROM q) SELECT a.class, CAST(count(*) AS BIGINT) AS pairs FROM p a JOIN p b ON a.class = b.class AND a.held AND NOT b.held AND {CLOSE} GROUP BY a.class")
def leakage_pairs(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("class", F.concat(F.lit("c"), (F.col("id") % 3).cast("string")))
    return G.close_pair_counts(p.where("id % 5 = 0"), p.where("id % 5 <> 0"), "class", 0.25)


@query("shared_pixel_links", PIX + ", m AS (SELECT pixel_row, pixel_col, min(polygon_id) AS dst FROM p GROUP BY pixel_row, pixel_col) SELECT DISTINCT p.polygon_id AS src, m.dst FROM p JOIN m USING (pixel_row, pixel_col) WHERE p.polygon_id <> m.dst")
def shared_pixel_links(spark, sf_dir):
    return G.shared_links(derive(spark, sf_dir, PIXELS), ["pixel_row", "pixel_col"], "polygon_id")


CENTERS = "SELECT 't' || CAST(s_suppkey AS STRING) AS tile_id, (s_suppkey % 20) * 5e0 - 475e-1 AS lat, CAST(floor(s_suppkey / 2e1) AS BIGINT) * 5e0 + 25e-1 AS lon FROM supplier"


def centers(spark, sf_dir):
    return spark.sql(CENTERS.replace("FROM supplier", "FROM {supplier}"), supplier=load(spark, sf_dir, "supplier"))


def unit_pixels(spark, sf_dir):
    p = derive(spark, sf_dir, PIXELS)
    return p.withColumns({"pixel_row": F.col("pixel_row") % 1500, "pixel_col": F.col("polygon_id") * 37 % 1500 + F.col("pixel_col"),
                          "polygon_id": (F.col("polygon_id") / 100).cast("bigint")})


@query("polygon_centroids", f"WITH c AS ({CENTERS}), p AS (SELECT 't' || CAST(l_suppkey AS STRING) AS tile_id, CAST(floor(l_partkey / 1e2) AS BIGINT) AS polygon_id, l_orderkey % 1500 AS r, l_partkey * 37 % 1500 + l_linenumber AS k FROM lineitem), m AS (SELECT tile_id, polygon_id, avg(r) AS mean_row, avg(k) AS mean_col FROM p GROUP BY tile_id, polygon_id) SELECT tile_id, polygon_id, round(lat - 5e0 * (mean_row / 1500e0 - 5e-1), 3) AS lat, round(lon + 5e0 * (mean_col / 1500e0 - 5e-1), 3) AS lon FROM m JOIN c USING (tile_id)")
def polygon_centroids(spark, sf_dir):
    c = A.centroids(unit_pixels(spark, sf_dir), centers(spark, sf_dir), ["tile_id", "polygon_id"])
    return c.select("tile_id", "polygon_id", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"))


def unit_split(spark, sf_dir):
    p = unit_pixels(spark, sf_dir)
    return P.unit_balanced_split(p, A.centroids(p, centers(spark, sf_dir), ["tile_id", "polygon_id"]), ["lcp", "hcp", "plagioclase", "alteration"], 42)


@query("unit_balanced_split")
def unit_balanced_split(spark, sf_dir):
    s = unit_split(spark, sf_dir)
    return A.fractions(A.positive_counts(s, ["lcp", "hcp", "plagioclase", "alteration"], "split", ["train", "val", "test"]), ["train", "val", "test"])


@query("unit_split_leaks", PIX + "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS leaks FROM p")
def unit_split_leaks(spark, sf_dir):
    s = unit_split(spark, sf_dir)
    leaks = A.split_leaks(s, ["tile_id", "pixel_row", "pixel_col"]).agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("leaks", leaks.scalar())


@query("tile_balanced_split", PIX + "SELECT tile_id FROM p GROUP BY tile_id")
def tile_balanced_split(spark, sf_dir):
    counts = A.tile_positive_counts(derive(spark, sf_dir, PIXELS), list(P.RARE_CLASSES))
    return P.tile_balanced_split(counts, 42).where(F.col("split").isin(*P.SPLITS)).select("tile_id")
