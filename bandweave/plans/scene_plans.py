"""Scenes: stretched and coloured mosaics, regions of a targeted scene, listed pixels, footprints, whole-grid prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import endmembers as E, fitting as M, grid as H, harvest as V, joins as J, prepare as Q
from ..schema import slim
from .grid_plans import FLOOD, SMOOTH, grid
from .prepare_plans import LABELS, RATED, tall
from .registry import query
from .sampling_plans import h
from .spectral_plans import N, total
from .tables import SPECTRA, cte, derive, load

SCENE = ["'t' || CAST(c_nationkey AS STRING) AS tile_id", "c_acctbal / 1e2 AS x", "c_nationkey * 17e-1 AS y", "CAST(floor(c_acctbal) AS BIGINT) AS pixel_row", "c_custkey AS pixel_col",
         "CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal / 1e3 END AS red", "CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey * 7919 % 1009) / 1e2 END AS green", "(c_custkey * 31 % 257) / 1e1 AS blue",
         "c_custkey % 6 <> 0 AS valid"]
CHANNELS = ["red", "green", "blue"]
PLACED = cte(p=("customer", SCENE)) + ", k AS (SELECT *, CAST(floor((x + 10) / 5e0) AS BIGINT) AS cell_col, CAST(floor((45 - y) / 5e0) AS BIGINT) AS cell_row FROM p)"


def scene(spark, sf_dir):
    return load(spark, sf_dir, "customer").selectExpr(*SCENE)


def first_sql(c: str) -> str:
    return f"arg_min({c}, {{'a': tile_id, 'b': pixel_row, 'c': pixel_col}}) FILTER (WHERE {c} IS NOT NULL) AS {c}"


STRETCH = "CASE WHEN covered THEN round(least(greatest(({c} - lo_{c}) / greatest(1e-6, hi_{c} - lo_{c}), 0e0), 1e0), 6) ELSE 85e-2 END AS {c}"


@query("stretched_mosaic", PLACED + f", m AS (SELECT cell_row, cell_col, {', '.join(first_sql(c) for c in CHANNELS)} FROM k GROUP BY cell_row, cell_col), l AS (SELECT "
       + ", ".join(f"quantile_cont({c}, 2e-2) AS lo_{c}, quantile_cont({c}, 98e-2) AS hi_{c}" for c in CHANNELS) + " FROM m), v AS (SELECT m.*, l.*, red IS NOT NULL AND green IS NOT NULL AND blue IS NOT NULL AS covered FROM m, l) SELECT cell_row, cell_col, "
       + ", ".join(STRETCH.format(c=c) for c in CHANNELS) + ", covered FROM v")
def stretched_mosaic(spark, sf_dir):
    m = H.stretched_mosaic(scene(spark, sf_dir), "x", "y", "tile_id", CHANNELS, (-10.0, 45.0), 5.0)
    return m.select("cell_row", "cell_col", *[F.round(c, 6).alias(c) for c in CHANNELS], "covered")


COLOURS = {"red": (1.0, 0.25, 0.0), "green": (0.0, 0.75, 0.5), "blue": (0.5, 0.0, 1.0)}
LIMITS = {"red": 3.0, "green": 5.0, "blue": 15.0}
HITS = ", ".join(f"coalesce({c} >= {LIMITS[c]!r}e0, FALSE) AND valid AS h_{c}" for c in CHANNELS)
SHOWN = ", ".join("least(" + " + ".join(f"CASE WHEN h_{c} THEN {COLOURS[c][k]!r}e0 ELSE 0e0 END" for c in CHANNELS) + f", 1e0) AS c{k}" for k in range(3))


def coloured(spark, sf_dir):
    return H.class_colours(scene(spark, sf_dir), {c: c for c in CHANNELS}, LIMITS, COLOURS, "valid")


@query("class_mosaic", PLACED + f""", q AS (SELECT *, {HITS} FROM k), w AS (SELECT *, {SHOWN} FROM q),
u AS (SELECT *, CASE WHEN h_red OR h_green OR h_blue THEN [c0, c1, c2] ELSE [1e0, 1e0, 1e0] END AS rgb FROM w),
m AS (SELECT cell_row, cell_col, arg_min(rgb, {{'a': tile_id, 'b': pixel_row, 'c': pixel_col}}) FILTER (WHERE valid) AS rgb FROM u GROUP BY cell_row, cell_col)
SELECT cell_row, cell_col, coalesce(rgb[1], 85e-2) AS r, coalesce(rgb[2], 85e-2) AS g, coalesce(rgb[3], 85e-2) AS b, rgb IS NOT NULL AS covered FROM m""")
def class_mosaic(spark, sf_dir):
    m = H.class_mosaic(coloured(spark, sf_dir), "x", "y", "tile_id", (-10.0, 45.0), 5.0)
    return m.select("cell_row", "cell_col", *[F.col("rgb")[k].alias(n) for k, n in enumerate("rgb")], "covered")


@query("class_colour_statistics", PLACED + f", q AS (SELECT *, {HITS} FROM k) SELECT tile_id, CAST(count(*) FILTER (WHERE valid) AS BIGINT) AS n_valid, " + ", ".join(f"CAST(count(*) FILTER (WHERE h_{c}) AS BIGINT) AS {c}" for c in CHANNELS)
       + ", CAST(count(*) FILTER (WHERE valid AND NOT (h_red OR h_green OR h_blue)) AS BIGINT) AS unclassified FROM q GROUP BY tile_id")
def class_colour_statistics(spark, sf_dir):
    return H.colour_statistics(coloured(spark, sf_dir), CHANNELS, "valid")


@query("scene_regions", SMOOTH + ", t AS (SELECT unnest([5e-1, 6e-1]) AS t)" + FLOOD.format(k="CAST(t * 100 AS BIGINT)", w="valid AND value >= t").replace("FROM p WHERE", "FROM p, t WHERE")
       + ", z AS (SELECT g.tile_id, g.k, g.root, p.value, p.raw FROM g JOIN p ON p.tile_id = g.tile_id AND p.pixel_row * 100000 + p.pixel_col = g.cell) SELECT tile_id, 'olivine' AS mineral, k / 1e2 AS threshold, CAST(count(*) AS BIGINT) AS count_px, round(avg(value), 6) AS mean_prob, round(avg(raw), 5) AS b0, round(avg(raw * 2), 4) AS b1 FROM z GROUP BY tile_id, k, root HAVING count(*) >= 9")
def scene_regions(spark, sf_dir):
    g = grid(spark, sf_dir).withColumn("spectrum", F.array("value", F.col("value") * 2))
    out = H.scene_regions(g, "value", "valid", "spectrum", 2, "olivine", [0.5, 0.6], 9)
    return out.select("tile_id", "mineral", "threshold", "count_px", F.round("mean_prob", 6).alias("mean_prob"), *[F.round(F.col("spectrum")[k], 5 - k).alias(f"b{k}") for k in range(2)])


# ------------------------------------------------------ listed pixels, footprints

HOLED = "CASE WHEN vec_id % 7 = 0 AND i = 10 THEN 65535e0 ELSE CAST(v AS DOUBLE) END"
CUBES = cte(p=SPECTRA).replace("'t' || CAST(vec_id % 8 AS STRING) AS tile_id", "CASE WHEN vec_id < 250 THEN 'e0' ELSE 'e1' END AS tile_id") + f""",
x AS (SELECT vec_id, tile_id, pixel_row, pixel_col, unnest(spectrum) AS v, generate_subscripts(spectrum, 1) AS i FROM p),
w AS (SELECT vec_id, tile_id, pixel_row, pixel_col, i, {HOLED} AS v FROM x)"""
LISTED = ["p_partkey AS point", "CASE p_partkey % 5 WHEN 0 THEN 'E0' WHEN 1 THEN 'e0' WHEN 4 THEN 'zz' ELSE 'E1' END AS tile_id", "CAST(p_partkey % 23 AS BIGINT) AS pixel_row", "CAST(p_size % 27 AS BIGINT) AS pixel_col"]


def cubes(spark, sf_dir):
    holed = lambda x, i: F.when((F.col("vec_id") % 7 == 0) & (i == 9), F.lit(65535.0)).otherwise(x.cast("double"))
    return derive(spark, sf_dir, SPECTRA).withColumn("tile_id", F.when(F.col("vec_id") < 250, "e0").otherwise("e1")).withColumn("spectrum", F.transform("spectrum", holed))


@query("harvest_points", CUBES + f""", q AS (SELECT {', '.join(LISTED)} FROM part), l AS (SELECT * REPLACE (lower(tile_id) AS tile_id) FROM q QUALIFY row_number() OVER (PARTITION BY lower(tile_id) ORDER BY {h(4, 'point')}, point) <= 60),
c AS (SELECT l.*, p.vec_id FROM l JOIN p USING (tile_id, pixel_row, pixel_col) WHERE p.vec_id % 7 <> 0)
SELECT c.point, round(sum(CASE WHEN w.v >= 65535e0 THEN 0e0 ELSE least(greatest(w.v, 0e0), 5e-1) END * ((w.pixel_row - c.pixel_row + 3) * 7 + w.pixel_col - c.pixel_col + 1)), 4) AS weighted, CAST(49 AS BIGINT) AS n
FROM c JOIN w ON w.tile_id = c.tile_id AND abs(w.pixel_row - c.pixel_row) <= 3 AND abs(w.pixel_col - c.pixel_col) <= 3 GROUP BY c.point""")
def harvest_points(spark, sf_dir):
    points = load(spark, sf_dir, "part").selectExpr(*LISTED)
    made = V.harvest_points(points, cubes(spark, sf_dir), "spectrum", N, ["point"], 60, 4)
    weighted = F.aggregate(F.transform("patch", lambda s, k: total(s) * (F.floor(k / 7) * 7 + k % 7 - 2)), F.lit(0.0), lambda s, v: s + v)
    return made.select("point", F.round(weighted, 4).alias("weighted"), F.size("patch").cast("bigint").alias("n"))


TRIANGLES = "SELECT p_partkey AS polygon_id, CAST(p_partkey % 33 AS DOUBLE) + 137e-3 AS x, CAST(p_partkey % 21 AS DOUBLE) + 211e-3 AS y, 2e0 + p_size % 5 AS w, 15e-1 + p_size % 4 AS t FROM part"
BOXES = "SELECT unnest(['e0', 'e1']) AS tile_id, unnest([0e0, 2e1]) AS x0, unnest([5e0, 0e0]) AS y0, unnest([25e0, 45e0]) AS x1, unnest([15e0, 1e1]) AS y1, unnest([0e0, 1e1]) AS top"


@query("footprint_means", CUBES + f""", r AS ({TRIANGLES}), b AS ({BOXES}), c AS (SELECT *, x + w / 2 AS mx, y + (25e-2 + t) / 3e0 AS my FROM r),
f AS (SELECT polygon_id, min(tile_id) AS tile_id FROM c JOIN b ON mx >= x0 AND mx <= x1 AND my >= y0 AND my <= y1 GROUP BY polygon_id),
v AS (SELECT r.polygon_id, f.tile_id, r.x - b.x0 AS ax, b.y1 - r.y + top AS ay, r.x + w - b.x0 AS bx, b.y1 - r.y - 25e-2 + top AS b_y, r.x + w / 2 - b.x0 AS cx, b.y1 - r.y - t + top AS cy FROM r JOIN f USING (polygon_id) JOIN b ON b.tile_id = f.tile_id),
e AS (SELECT polygon_id, tile_id, ax AS x0, ay AS y0, bx AS x1, b_y AS y1 FROM v UNION ALL SELECT polygon_id, tile_id, bx, b_y, cx, cy FROM v UNION ALL SELECT polygon_id, tile_id, cx, cy, ax, ay FROM v),
hit AS (SELECT e.polygon_id, p.vec_id FROM e JOIN p ON e.tile_id = p.tile_id AND (e.y0 <= p.pixel_row + 5e-1) <> (e.y1 <= p.pixel_row + 5e-1) AND e.x0 + (p.pixel_row + 5e-1 - e.y0) / (e.y1 - e.y0) * (e.x1 - e.x0) > p.pixel_col + 5e-1 WHERE p.vec_id % 7 <> 0 GROUP BY e.polygon_id, p.vec_id HAVING count(*) % 2 = 1),
a AS (SELECT polygon_id, i, avg(v) AS m, count(*) AS n FROM hit JOIN w USING (vec_id) GROUP BY polygon_id, i)
SELECT r.polygon_id, f.tile_id, CAST(coalesce(max(a.n), 0) AS BIGINT) AS n_px, round(sum(a.m * a.i), 6) AS moment FROM r LEFT JOIN f USING (polygon_id) LEFT JOIN a USING (polygon_id) GROUP BY r.polygon_id, f.tile_id""")
def footprint_means(spark, sf_dir):
    t = spark.sql(TRIANGLES.replace("FROM part", "FROM {part}"), part=load(spark, sf_dir, "part"))
    pt = lambda x, y: F.struct((F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"))
    polygons = t.select("polygon_id", F.array(pt(F.lit(0.0), F.lit(0.0)), pt(F.col("w"), F.lit(0.25)), pt(F.col("w") / 2, F.col("t"))).alias("ring"))
    tiles = spark.createDataFrame([("e0", 0.0, 5.0, 25.0, 15.0, 10, 25), ("e1", 20.0, 0.0, 45.0, 10.0, 10, 25)], "tile_id string, x0 double, y0 double, x1 double, y1 double, height int, width int")
    cells = cubes(spark, sf_dir).withColumn("pixel_row", F.col("pixel_row") - F.when(F.col("tile_id") == "e1", 10).otherwise(0))
    out = V.footprint_means(polygons, tiles, cells, "polygon_id", "spectrum", N)
    moment = F.aggregate(F.transform("spectrum", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return out.select("polygon_id", "tile_id", "n_px", F.round(moment, 6).alias("moment"))


# ------------------------------------------------------ models, bands, angles

@query("whole_grid_prediction", cte(p=SPECTRA) + ", g AS (SELECT vec_id, vec_id % 6 = 0 AS bad, CASE WHEN vec_id % 5 = 0 THEN 0e0 ELSE CAST(spectrum[1] AS DOUBLE) END AS b FROM p) SELECT bad, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN bad THEN 1 END) AS BIGINT) AS n_unpredicted, CAST(0 AS BIGINT) AS n_beyond, 0e0 AS p_absent FROM g GROUP BY bad")
def whole_grid_prediction(spark, sf_dir):
    bands = [f"m{k}" for k in range(4)]
    missing = lambda c, k: F.when((F.col("vec_id") % 5 == 0) & F.lit(k == 0), F.lit(None)).when((F.col("vec_id") % 6 == 0) & F.lit(k == 1), 65535.0).otherwise(c.cast("double"))
    g = derive(spark, sf_dir, SPECTRA).select("vec_id", "tile_id", "pixel_row", "pixel_col", *[missing(F.col("spectrum")[k], k).alias(b) for k, b in enumerate(bands)],
                                              *[(F.col("class") == c).cast("double").alias(n) for n, c in (("olivine", "c1"), ("lcp", "c2"), ("absent", "none"))])
    clean = g.where("m0 IS NOT NULL AND m1 < 65535")
    models = M.fit_classes(clean, bands, ["olivine", "lcp", "absent"], "logistic", 42)
    out = M.predict_grid(g.drop("olivine", "lcp", "absent"), models, bands).withColumn("bad", F.col("vec_id") % 6 == 0)
    beyond = F.greatest("p_olivine", "p_lcp") > 1
    return out.groupBy("bad").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("best_class") == -1).alias("n_unpredicted"), F.count_if(beyond).alias("n_beyond"), F.max("p_absent").alias("p_absent"))


@query("embedding_centroid_angles", cte(p=RATED) + f""", t AS ({tall("confidence_tier = 'High' AND split = 'train' AND {} >= 7e-1")}),
k AS (SELECT class, spectrum FROM t QUALIFY row_number() OVER (PARTITION BY class ORDER BY {h(5, 'vec_id')}, vec_id) <= 5000),
v AS (SELECT class, unnest(spectrum) AS v, generate_subscripts(spectrum, 1) AS i FROM k), m AS (SELECT class, i, avg(CAST(v AS DOUBLE)) AS m FROM v GROUP BY class, i),
z AS (SELECT vec_id, unnest(spectrum) AS v, generate_subscripts(spectrum, 1) AS i FROM p), d AS (SELECT z.vec_id, m.class, acos(sum(CAST(z.v AS DOUBLE) * m) / sqrt(sum(CAST(z.v AS DOUBLE) * z.v) * sum(m * m))) AS a FROM z JOIN m USING (i) GROUP BY z.vec_id, m.class)
SELECT vec_id, round(max(CASE WHEN class = 'lcp' THEN a END), 5) AS angle_lcp, round(max(CASE WHEN class = 'olivine' THEN a END), 5) AS angle_olivine FROM d GROUP BY vec_id""")
def embedding_centroid_angles(spark, sf_dir):
    rated = derive(spark, sf_dir, RATED)
    c = Q.class_centroids(rated, LABELS, ["vec_id"], N, 5000, 5)
    out = E.centroid_angles(rated.select("vec_id", "spectrum"), c.select("class", "centroid"), "spectrum")
    return out.select("vec_id", F.round("angle_lcp", 5).alias("angle_lcp"), F.round("angle_olivine", 5).alias("angle_olivine"))


TARGETS = [410.0 + 37.5 * k for k in range(59)]


@query("nearest_band_map", "WITH o AS (SELECT l_suppkey AS obs, l_orderkey * 10 + l_linenumber AS band, l_extendedprice / 4e1 AS wl FROM lineitem), t AS (SELECT unnest(range(59)) AS target), d AS (SELECT obs, target, band, abs(wl - (41e1 + 375e-1 * target)) AS r FROM o, t) SELECT obs, CAST(target AS INTEGER) AS target, band, round(r, 6) AS residual FROM d QUALIFY row_number() OVER (PARTITION BY obs, target ORDER BY r, band) = 1")
def nearest_band_map(spark, sf_dir):
    o = load(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS obs", "l_orderkey * 10 + l_linenumber AS band", "l_extendedprice / 4e1 AS wl")
    return J.band_map(o, ["obs"], "band", "wl", TARGETS).withColumn("residual", F.round("residual", 6))


@query("slim_projection", cte(p=SPECTRA) + "SELECT vec_id, class, tile_id, CAST(6 AS BIGINT) AS n_columns FROM p")
def slim_projection(spark, sf_dir):
    wide = derive(spark, sf_dir, SPECTRA).select("vec_id", "class", "tile_id", *[F.col("spectrum")[k].alias(f"m{k}") for k in range(12)], F.lit(1).alias("m"), F.lit(2).alias("mx1"), F.lit(3).alias("label"))
    thin = slim(wide)
    return thin.select("vec_id", "class", "tile_id", F.lit(len(thin.columns)).cast("bigint").alias("n_columns"))
