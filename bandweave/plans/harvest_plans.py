"""Polygon masks and patch harvests: polygons to pixels, caps, patches and pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import polygon_pixels
from ..operators import evaluate as V, joins as J
from ..operators.grid import patches
from ..operators.sampling import cap_per_group
from ..sources import sinks as W
from .curate_plans import GRD, RINGS, rings
from .grid_plans import SPEC, grid, spectrum_grid
from .evaluate_plans import ap_sql
from .registry import query
from .sampling_plans import h
from .tables import POLYGONS, SCORES_SQL, load, scores

EDGES = f"""r AS ({RINGS}), v AS (SELECT polygon_id, tile_id, x AS ax, y AS ay, x + w AS bx, y + 25e-2 AS b_y, x + w / 2 AS cx, y + t AS cy FROM r),
e AS (SELECT polygon_id, tile_id, ax AS x0, ay AS y0, bx AS x1, b_y AS y1 FROM v UNION ALL SELECT polygon_id, tile_id, bx, b_y, cx, cy FROM v UNION ALL SELECT polygon_id, tile_id, cx, cy, ax, ay FROM v)"""
HIT = "hit AS (SELECT e.polygon_id, p.pixel, p.tile_id, p.pixel_row, p.pixel_col FROM e JOIN p ON e.tile_id = p.tile_id AND (e.y0 <= p.pixel_row + 5e-1) <> (e.y1 <= p.pixel_row + 5e-1) AND e.x0 + (p.pixel_row + 5e-1 - e.y0) / (e.y1 - e.y0) * (e.x1 - e.x0) > p.pixel_col + 5e-1 GROUP BY e.polygon_id, p.pixel, p.tile_id, p.pixel_row, p.pixel_col HAVING count(*) % 2 = 1)"


@query("polygon_window_pixels", GRD + f", {EDGES}, {HIT} SELECT pixel FROM hit WHERE polygon_id = 6")
def polygon_window_pixels(spark, sf_dir):
    one = rings(spark, sf_dir).where("polygon_id = 6")
    return J.polygon_pixel_join(one, grid(spark, sf_dir)).select("pixel")


@query("label_masks", GRD + f", {EDGES}, {HIT}, c AS (SELECT p_partkey AS polygon_id, {POLYGONS[1][2]} FROM part) SELECT DISTINCT k.mineral, hit.pixel FROM hit JOIN c USING (polygon_id), (SELECT unnest(['plagioclase', 'olivine']) AS mineral) k WHERE contains(lower(c.Category), k.mineral) AND NOT contains(lower(c.Category), '(low)')")
def label_masks(spark, sf_dir):
    category = load(spark, sf_dir, "part").selectExpr("p_partkey AS polygon_id", POLYGONS[1][2])
    text = F.lower("Category")
    named = F.array_compact(F.array(*[F.when(text.contains(m) & ~text.contains("(low)"), F.lit(m)) for m in ("plagioclase", "olivine")]))
    wanted = category.select("polygon_id", F.explode(named).alias("mineral"))
    hits = J.polygon_pixel_join(rings(spark, sf_dir).join(wanted, "polygon_id"), grid(spark, sf_dir))
    return hits.select("mineral", "pixel").distinct()


@query("capped_polygon_scores", GRD + f", {EDGES}, {HIT}, k AS (SELECT *, row_number() OVER (PARTITION BY polygon_id ORDER BY {h(8, 'pixel')}, pixel) AS rn FROM hit) SELECT r.polygon_id, CAST(count(k.pixel) AS BIGINT) AS n_pixels, round(avg(p.value), 4) AS mean_score FROM r LEFT JOIN k ON k.polygon_id = r.polygon_id AND k.rn <= 4 LEFT JOIN p ON p.pixel = k.pixel GROUP BY r.polygon_id")
def capped_polygon_scores(spark, sf_dir):
    polygons = rings(spark, sf_dir)
    capped = cap_per_group(J.polygon_pixel_join(polygons, grid(spark, sf_dir)).select("polygon_id", "pixel", "value"), ["polygon_id"], ["pixel"], 4, 8)
    mean = capped.groupBy("polygon_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    return polygons.select("polygon_id").join(mean, "polygon_id", "left").select(
        "polygon_id", F.coalesce("n", F.lit(0)).alias("n_pixels"), F.round("m", 4).alias("mean_score"))


@query("harvest_pool", SPEC + f", k AS (SELECT *, row_number() OVER (PARTITION BY polygon_id ORDER BY {h(6, 'vec_id')}, vec_id) AS rn, count(*) OVER (PARTITION BY polygon_id) AS n FROM p WHERE class IN ('c1', 'c2', 'c3')) SELECT 'hard' AS pool, polygon_id, CAST(count(*) AS BIGINT) AS n, CAST(49 AS BIGINT) AS cells FROM k WHERE n >= 4 AND rn <= 3 GROUP BY polygon_id")
def harvest_pool(spark, sf_dir):
    g = spectrum_grid(spark, sf_dir)
    rows = g.where("class IN ('c1', 'c2', 'c3')").select("tile_id", "polygon_id", "pixel_row", "pixel_col", "vec_id")
    big = rows.groupBy("polygon_id").count().where("count >= 4").select("polygon_id")
    centres = cap_per_group(rows.join(big, "polygon_id", "left_semi"), ["polygon_id"], ["vec_id"], 3, 6)
    made = patches(centres, g, "spectrum", 64).join(centres, ["tile_id", "pixel_row", "pixel_col"])
    path = W.scratch(spark, "pool")
    W.write_pool(made, path, "hard")
    return spark.read.parquet(path).groupBy("pool", "polygon_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("patch")).cast("bigint").alias("cells"))


@query("polygon_pixel_total", "SELECT CAST(sum(p_size * (p_partkey % 9 + 1)) AS BIGINT) AS n FROM part")
def polygon_pixel_total(spark, sf_dir):
    w, t = F.col("p_size").cast("double"), (F.col("p_partkey") % 9 + 1).cast("double")
    p = lambda x, y: F.struct((x + 0.25).alias("x"), (y + 0.25).alias("y"))
    z = F.lit(0.0)
    boxes = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("polygon_id"), F.lit("t").alias("tile_id"), F.array(p(z, z), p(w, z), p(w, t), p(z, t)).alias("ring"))
    return polygon_pixels(boxes).agg(F.count(F.lit(1)).alias("n"))


@query("corrected_label_ap", "WITH w AS (" + SCORES_SQL + "), t AS (SELECT 'quality' AS class, CASE WHEN row_id % 7 = 0 THEN 0e0 ELSE y0 END AS y, s0 AS score FROM w), " + ap_sql("class") + "SELECT class, n_pos, n, round(ap, 8) AS ap FROM ap")
def corrected_label_ap(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("y0", F.when(F.col("row_id") % 7 == 0, 0.0).otherwise(F.col("y0")))
    return V.average_precision(V.tall_scores(s, {"quality": ("y0", "s0")}, []), ["class"]).withColumn("ap", F.round("ap", 8))
