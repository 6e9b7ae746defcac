"""Aggregations, evaluation metrics and thresholds on the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import aggregates as A, evaluate as V
from ..operators.ranking import exact_percentiles, numbered, order_statistics
from .registry import query
from .sampling_plans import DEC, GRD, PIX
from .tables import DECISIONS, GRID, PIXELS, POLYGONS, SCORES_SQL, cte, derive, load, scores

CLASSES = {"quality": ("y0", "s0"), "toxic": ("y1", "s1"), "short": ("y2", "s2")}
TALL = f"WITH w AS ({SCORES_SQL}), t AS (SELECT row_id, tier, tile_id, 'quality' AS class, y0 AS y, s0 AS score FROM w UNION ALL SELECT row_id, tier, tile_id, 'toxic', y1, s1 FROM w UNION ALL SELECT row_id, tier, tile_id, 'short', y2, s2 FROM w)"


def tall(spark, sf_dir):
    return V.tall_scores(scores(spark, sf_dir), CLASSES, ["row_id", "tier", "tile_id"])


def ap_sql(keys: str, src: str = "t") -> str:
    return f"""g AS (SELECT {keys}, score, count(*) AS n, count(CASE WHEN y > 4e-1 THEN 1 END) AS p FROM {src} GROUP BY {keys}, score),
r AS (SELECT *, sum(n) OVER w1 AS cn, sum(p) OVER w1 AS cp, sum(p) OVER (PARTITION BY {keys}) AS np, sum(n) OVER (PARTITION BY {keys}) AS nn FROM g WINDOW w1 AS (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT {keys}, CAST(max(np) AS BIGINT) AS n_pos, CAST(max(nn) AS BIGINT) AS n, coalesce(sum(CASE WHEN np > 0 THEN p / np * cp / cn ELSE 0e0 END), 0e0) AS ap FROM r GROUP BY {keys})
"""


@query("average_precision", TALL + ", " + ap_sql("class") + "SELECT class, n_pos, n, round(ap, 8) AS ap FROM ap")
def average_precision(spark, sf_dir):
    return V.average_precision(tall(spark, sf_dir), ["class"]).select("class", "n_pos", "n", F.round("ap", 8).alias("ap"))


@query("mean_average_precision", TALL + ", " + ap_sql("class") + "SELECT round(avg(ap), 8) AS map_all, round(avg(CASE WHEN class <> 'short' THEN ap END), 8) AS map_core FROM ap WHERE n_pos > 0")
def mean_average_precision(spark, sf_dir):
    ap = V.average_precision(tall(spark, sf_dir), ["class"])
    core = V.mean_ap(ap, [], ["short"]).select("map").scalar()
    return V.mean_ap(ap, []).select(F.round("map", 8).alias("map_all"), F.round(core, 8).alias("map_core"))


@query("map_by_tier", TALL.replace("d.lang AS tier", "CASE d.lang WHEN 'en' THEN 'High' WHEN 'fr' THEN 'Moderate' ELSE 'Reviewed-High' END AS tier") + ", " + ap_sql("tier, class") +
       ", m AS (SELECT tier, round(avg(CASE WHEN n_pos > 0 THEN ap END), 8) AS map FROM ap GROUP BY tier) SELECT b.tier, m.map FROM (SELECT unnest(['High', 'Moderate', 'Low']) AS tier) b LEFT JOIN m USING (tier) UNION ALL SELECT tier, map FROM m WHERE tier NOT IN ('High', 'Moderate', 'Low')")
def map_by_tier(spark, sf_dir):
    t = tall(spark, sf_dir).withColumn("tier", F.when(F.col("tier") == "en", "High").when(F.col("tier") == "fr", "Moderate").otherwise("Reviewed-High"))
    return V.ap_by_tier(t).withColumn("map", F.round("map", 8))


@query("ap_per_tile", TALL + ", " + ap_sql("tile_id, class") + "SELECT tile_id, n_pos, n, round(ap, 8) AS ap FROM ap WHERE class = 'toxic'")
def ap_per_tile(spark, sf_dir):
    one = tall(spark, sf_dir).where("class = 'toxic'")
    return V.average_precision(one, ["tile_id", "class"]).select("tile_id", "n_pos", "n", F.round("ap", 8).alias("ap"))


@query("brier_score", TALL + "SELECT class, round(avg((score - CASE WHEN y > 4e-1 THEN 1e0 ELSE 0e0 END) * (score - CASE WHEN y > 4e-1 THEN 1e0 ELSE 0e0 END)), 8) AS brier FROM t GROUP BY class")
def brier_score(spark, sf_dir):
    return V.brier(tall(spark, sf_dir), ["class"]).withColumn("brier", F.round("brier", 8))


def bin_sql(n: int) -> str:
    return " + ".join(f"CASE WHEN score >= {i * (1.0 / n)!r}e0 THEN 1 ELSE 0 END" for i in range(1, n))


@query("calibration_error", TALL + f", b AS (SELECT class, {bin_sql(15)} AS bin, avg(score) AS p, avg(CASE WHEN y > 4e-1 THEN 1e0 ELSE 0e0 END) AS e, count(*) AS n FROM t GROUP BY 1, 2) SELECT class, round(sum(n * abs(p - e)) / sum(n), 8) AS ece FROM b GROUP BY class")
def calibration_error(spark, sf_dir):
    return V.calibration_error(tall(spark, sf_dir), ["class"]).withColumn("ece", F.round("ece", 8))


@query("reliability_bins", TALL + f", b AS (SELECT class, {bin_sql(10)} AS bin, avg(score) AS p, avg(CASE WHEN y > 4e-1 THEN 1e0 ELSE 0e0 END) AS e, count(*) AS n FROM t GROUP BY 1, 2), k AS (SELECT class, CAST(unnest(range(10)) AS INT) AS bin FROM (SELECT DISTINCT class FROM t) q) SELECT k.class, k.bin, (k.bin + 5e-1) / 1e1 AS bin_center, CAST(coalesce(n, 0) AS BIGINT) AS n, round(p, 8) AS predicted_mean, round(e, 8) AS empirical_rate FROM k LEFT JOIN b ON b.class = k.class AND b.bin = k.bin")
def reliability_bins(spark, sf_dir):
    r = V.reliability(tall(spark, sf_dir), ["class"], 10)
    return r.select("class", "bin", "bin_center", "n", F.round("predicted_mean", 8).alias("predicted_mean"), F.round("empirical_rate", 8).alias("empirical_rate"))


POOL = cte(p=("lineitem", ["l_discount * 1e1 AS p0", "l_tax * 12e0 AS p1", "l_extendedprice / 105e3 AS p2", "l_returnflag <> 'R' AS valid"])) + ", t AS (SELECT 'a' AS class, p0 AS score FROM p WHERE valid UNION ALL SELECT 'b', p1 FROM p WHERE valid UNION ALL SELECT 'c', p2 FROM p WHERE valid)"


def pooled(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    items = F.array(*[F.struct(F.lit(c).alias("class"), e.alias("score")) for c, e in
                      (("a", F.col("l_discount") * 10.0), ("b", F.col("l_tax") * 12.0), ("c", F.col("l_extendedprice") / 105e3))])
    return l.select(F.explode(items).alias("x")).select("x.*")


@query("pooled_percentiles", POOL + "SELECT class, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(score, 33e-2), 8) AS p33, round(quantile_cont(score, 67e-2), 8) AS p67, round(quantile_cont(score, 9e-1), 8) AS p90 FROM t GROUP BY class")
def pooled_percentiles(spark, sf_dir):
    out = V.class_percentiles(pooled(spark, sf_dir), {"p33": 0.33, "p67": 0.67, "p90": 0.90})
    return out.select("class", "n", *[F.round(c, 8).alias(c) for c in ("p33", "p67", "p90")])


@query("otsu_tiers", POOL + """, s AS (SELECT class, min(score) AS lo, max(score) AS hi FROM t GROUP BY class),
h AS (SELECT t.class, least(floor((score - lo) / ((hi - lo) / 256e0)), 255) AS b, lo + (hi - lo) / 256e0 * (least(floor((score - lo) / ((hi - lo) / 256e0)), 255) + 5e-1) AS m, count(*) AS c FROM t JOIN s ON s.class = t.class GROUP BY 1, 2, 3),
w AS (SELECT *, sum(c) OVER u AS w1, sum(c * m) OVER u AS s1, sum(c) OVER (PARTITION BY class) AS w, sum(c * m) OVER (PARTITION BY class) AS s FROM h WINDOW u AS (PARTITION BY class ORDER BY b ROWS UNBOUNDED PRECEDING)),
o AS (SELECT class, m AS otsu FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY CASE WHEN w > w1 THEN w1 * (w - w1) * (s1 / w1 - (s - s1) / (w - w1)) * (s1 / w1 - (s - s1) / (w - w1)) ELSE -1e0 END DESC, b) AS rn FROM w) q WHERE rn = 1)
SELECT t.class, CAST(count(*) AS BIGINT) AS n_signal, round(max(otsu), 6) AS otsu, round(quantile_cont(score, 5e-1), 6) AS p50, round(quantile_cont(score, 95e-2), 6) AS p95 FROM t JOIN o ON o.class = t.class WHERE score > otsu GROUP BY t.class""")
def otsu_tiers(spark, sf_dir):
    out = V.otsu_tiers(pooled(spark, sf_dir), {"p50": 0.5, "p95": 0.95})
    return out.select("class", "n_signal", *[F.round(c, 6).alias(c) for c in ("otsu", "p50", "p95")])


EDGES = ", ".join(f"quantile_cont(CAST(covariate AS DOUBLE), {i / 10}e0) AS e{i}" for i in range(11))


@query("detection_by_decile", GRD + f", v AS (SELECT * FROM p WHERE valid), e AS (SELECT {EDGES} FROM v), d AS (SELECT {' + '.join(f'CASE WHEN covariate >= e{i} THEN 1 ELSE 0 END' for i in range(1, 10))} + 1 AS decile, value, e.* FROM v, e) SELECT decile, round(max(CASE decile {' '.join(f'WHEN {i + 1} THEN e{i}' for i in range(10))} END), 6) AS lo, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN value >= 5e-1 THEN 1e0 ELSE 0e0 END), 8) AS rate FROM d GROUP BY decile")
def detection_by_decile(spark, sf_dir):
    g = derive(spark, sf_dir, GRID).where("valid")
    out = V.decile_rates(g, "covariate", F.col("value") >= 0.5)
    return out.select("decile", F.round("lo", 6).alias("lo"), "n", F.round("rate", 8).alias("rate"))


@query("group_percentiles", "SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(l_extendedprice, 2e-2), 6) AS p02, round(quantile_cont(l_extendedprice, 98e-2), 6) AS p98 FROM lineitem GROUP BY l_suppkey")
def group_percentiles(spark, sf_dir):
    out = exact_percentiles(load(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", {"p02": 0.02, "p98": 0.98})
    return out.select("l_suppkey", "n", F.round("p02", 6).alias("p02"), F.round("p98", 6).alias("p98"))


@query("percentile_stretch", "WITH q AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 2e-2) AS a, quantile_cont(l_extendedprice, 98e-2) AS b FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round(sum(least(greatest((l_extendedprice - a) / (b - a), 0e0), 1e0)), 5) AS total FROM lineitem JOIN q USING (l_suppkey) GROUP BY l_suppkey")
def percentile_stretch(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice")
    p = exact_percentiles(l, ["l_suppkey"], "l_extendedprice", {"a": 0.02, "b": 0.98}).drop("n")
    v = F.least(F.greatest((F.col("l_extendedprice") - F.col("a")) / (F.col("b") - F.col("a")), F.lit(0.0)), F.lit(1.0))
    return l.join(p, "l_suppkey").groupBy("l_suppkey").agg(F.round(F.sum(v), 5).alias("total"))


@query("order_statistics", "WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, max(CASE WHEN rn = ceil(9e-1 * n) THEN v END) AS kth_small, max(CASE WHEN rn = n - ceil(9e-1 * n) + 1 THEN v END) AS kth_large FROM r GROUP BY l_returnflag")
def order_stats(spark, sf_dir):
    k = F.ceil(F.lit(0.9) * F.col("n"))
    out = order_statistics(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"kth_small": k - 1, "kth_large": F.col("n") - k})
    return out.select("l_returnflag", "kth_small", "kth_large")


LAB = ["olivine_t1", "lcp", "hcp", "plagioclase", "other", "alteration"]


@query("class_split_counts", PIX + " " + " UNION ALL ".join(f"SELECT '{c}' AS class, CAST(count(CASE WHEN split = 'train' AND {c} > 5e-1 THEN 1 END) AS BIGINT) AS train, CAST(count(CASE WHEN split = 'val' AND {c} > 5e-1 THEN 1 END) AS BIGINT) AS val, CAST(count(CASE WHEN split = 'test' AND {c} > 5e-1 THEN 1 END) AS BIGINT) AS test FROM p" for c in LAB))
def class_split_counts(spark, sf_dir):
    return A.positive_counts(derive(spark, sf_dir, PIXELS), LAB, "split", ["train", "val", "test"])


@query("class_split_fractions", PIX + " " + " UNION ALL ".join(f"SELECT '{c}' AS class, round(count(CASE WHEN split = 'train' THEN 1 END) / count(*), 8) AS train, round(count(CASE WHEN split = 'val' THEN 1 END) / count(*), 8) AS val, round(count(CASE WHEN split = 'test' THEN 1 END) / count(*), 8) AS test FROM p WHERE {c} > 5e-1" for c in LAB))
def class_split_fractions(spark, sf_dir):
    s = ["train", "val", "test"]
    f = A.fractions(A.positive_counts(derive(spark, sf_dir, PIXELS), LAB, "split", s), s)
    return f.select("class", *[F.round(c, 8).alias(c) for c in s])


@query("tile_positive_counts", PIX + "SELECT tile_id, CAST(count(CASE WHEN hcp > 4e-1 THEN 1 END) AS BIGINT) AS hcp, CAST(count(CASE WHEN plagioclase > 4e-1 THEN 1 END) AS BIGINT) AS plagioclase, CAST(count(CASE WHEN lcp > 4e-1 THEN 1 END) AS BIGINT) AS lcp FROM p GROUP BY tile_id")
def tile_positive_counts(spark, sf_dir):
    return A.tile_positive_counts(derive(spark, sf_dir, PIXELS), ["hcp", "plagioclase", "lcp"])


@query("allocation_table", GRD + ", k AS (SELECT 'c' || CAST(code AS STRING) AS mineral, CASE WHEN value < 3e-1 THEN 0 WHEN value < 6e-1 THEN 1 ELSE 2 END AS stratum FROM p) SELECT CASE WHEN grouping(mineral) = 1 THEN 'TOTAL' ELSE mineral END AS mineral, CASE WHEN grouping(stratum) = 1 THEN 'TOTAL' ELSE CAST(stratum AS STRING) END AS stratum, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY CUBE (mineral, stratum)")
def allocation_table(spark, sf_dir):
    g = derive(spark, sf_dir, GRID).select(F.concat(F.lit("c"), F.col("code").cast("string")).alias("mineral"),
                                           F.when(F.col("value") < 0.3, 0).when(F.col("value") < 0.6, 1).otherwise(2).alias("stratum"))
    return A.allocation_table(g, "mineral", "stratum")


JUDGED = "j AS (SELECT o_orderkey, o_orderpriority AS region, o_orderstatus AS predicted, CASE o_custkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'F' ELSE 'P' END AS truth FROM orders)"


def judged(spark, sf_dir):
    return load(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderpriority AS region", "o_orderstatus AS predicted", "CASE o_custkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'F' ELSE 'P' END AS truth", "CASE o_custkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'F' ELSE 'P' END = o_orderstatus AS correct")


@query("accuracy_by_region", f"WITH {JUDGED} SELECT CASE WHEN grouping(region) = 1 THEN 'ALL' ELSE region END AS region, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN truth = predicted THEN 1 END) AS BIGINT) AS n_correct, round(avg(CASE WHEN truth = predicted THEN 1e0 ELSE 0e0 END), 8) AS accuracy FROM j GROUP BY ROLLUP (region)")
def accuracy_by_region(spark, sf_dir):
    return A.accuracy(judged(spark, sf_dir), "region", "correct", "ALL").withColumn("accuracy", F.round("accuracy", 8))


@query("accuracy_by_class", f"WITH {JUDGED} SELECT truth, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN truth = predicted THEN 1 END) AS BIGINT) AS n_correct, round(avg(CASE WHEN truth = predicted THEN 1e0 ELSE 0e0 END), 8) AS accuracy FROM j GROUP BY truth")
def accuracy_by_class(spark, sf_dir):
    return A.accuracy(judged(spark, sf_dir), "truth", "correct").withColumn("accuracy", F.round("accuracy", 8))


@query("confusion_counts", f"WITH {JUDGED} SELECT truth, CAST(count(CASE WHEN predicted = 'O' THEN 1 END) AS BIGINT) AS \"O\", CAST(count(CASE WHEN predicted = 'F' THEN 1 END) AS BIGINT) AS \"F\", CAST(count(CASE WHEN predicted = 'P' THEN 1 END) AS BIGINT) AS \"P\" FROM j GROUP BY truth")
def confusion_counts(spark, sf_dir):
    return V.confusion(judged(spark, sf_dir), "truth", "predicted", ["O", "F", "P"])


SOFT = PIX + ", s AS (SELECT *, greatest(lcp, hcp, plagioclase) AS top, greatest(m0 * 1e1, m1 * 12e0, m3) AS best FROM p)"


@query("soft_confusion", SOFT + " SELECT CASE WHEN lcp = top THEN 'lcp' WHEN hcp = top THEN 'hcp' ELSE 'plagioclase' END AS \"true\", CASE WHEN m0 * 1e1 = best THEN 'lcp' WHEN m1 * 12e0 = best THEN 'hcp' ELSE 'plagioclase' END AS predicted, CAST(count(*) AS BIGINT) AS n FROM s WHERE top >= 5e-1 GROUP BY 1, 2")
def soft_confusion(spark, sf_dir):
    p = derive(spark, sf_dir, PIXELS).select(F.array("lcp", "hcp", "plagioclase").alias("y"), F.array(F.col("m0") * 10.0, F.col("m1") * 12.0, F.col("m3")).alias("s"))
    return V.soft_confusion(p, "y", "s", ["lcp", "hcp", "plagioclase"], 0.5).groupBy("true", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query("confusion_shares", f"WITH {JUDGED} SELECT truth, round(avg(CASE WHEN predicted = 'O' THEN 1e0 ELSE 0e0 END), 8) AS \"O\", round(avg(CASE WHEN predicted = 'F' THEN 1e0 ELSE 0e0 END), 8) AS \"F\", round(avg(CASE WHEN predicted = 'P' THEN 1e0 ELSE 0e0 END), 8) AS \"P\" FROM j GROUP BY truth")
def confusion_shares(spark, sf_dir):
    c = V.confusion(judged(spark, sf_dir), "truth", "predicted", ["O", "F", "P"], share=True)
    return c.select("truth", *[F.round(v, 8).alias(v) for v in ("O", "F", "P")])


@query("polygon_report", cte(g=POLYGONS) + """, k AS (SELECT polygon_id, lower(Category) AS c FROM g), m AS (SELECT l_partkey AS polygon_id, avg(l_discount * 1e1) AS p0, avg(l_tax * 12e0) AS p1, avg(l_quantity / 5e1) AS p2, count(*) AS n FROM lineitem GROUP BY l_partkey),
x AS (SELECT k.*, m.n, CASE WHEN p0 IS NULL THEN 'NONE' WHEN p0 = greatest(p0, p1, p2) THEN 'olivine' WHEN p1 = greatest(p0, p1, p2) THEN 'lcp' ELSE 'hcp' END AS predicted_class FROM k LEFT JOIN m USING (polygon_id))
SELECT polygon_id, CAST(coalesce(n, 0) AS BIGINT) AS n_pixels, predicted_class, CASE WHEN predicted_class <> 'NONE' THEN contains(c, predicted_class) END AS correct FROM x""")
def polygon_report(spark, sf_dir):
    polygons = derive(spark, sf_dir, POLYGONS).select("polygon_id", L.keyword_minerals("Category").alias("minerals"))
    s = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("polygon_id"), F.array(F.col("l_discount") * 10.0, F.col("l_tax") * 12.0, F.col("l_quantity") / 50.0).alias("probs"),
                                                F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    out = V.polygon_report(polygons, s, "polygon_id", ["olivine", "lcp", "hcp"], "probs", "minerals", ["file", "row"])
    return out.select("polygon_id", "n_pixels", "predicted_class", "correct")


@query("ensemble_metrics", f"WITH w AS ({SCORES_SQL}), e AS (SELECT row_id, 'quality' AS class, y0 AS y, (s0 + s1 + s2) / 3e0 AS raw FROM w), t AS (SELECT row_id, class, y, round(raw, 9) AS score FROM e), " + ap_sql("class") + "SELECT class, n_pos, round(ap, 7) AS ap FROM ap")
def ensemble_metrics(spark, sf_dir):
    s = scores(spark, sf_dir)
    parts = [s.select("row_id", F.lit("quality").alias("class"), F.col("y0").alias("y"), F.col(c).alias("score")) for c in ("s0", "s1", "s2")]
    e = V.ensemble(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["row_id", "class"]).withColumn("score", F.round("score", 9))
    return V.average_precision(e, ["class"]).select("class", "n_pos", F.round("ap", 7).alias("ap"))


@query("compare_runs", f"WITH w AS ({SCORES_SQL}), t AS (SELECT 'base' AS run, 'quality' AS class, y0 AS y, s0 AS score FROM w UNION ALL SELECT 'base', 'toxic', y1, s1 FROM w UNION ALL SELECT 'new', 'quality', y0, s2 FROM w UNION ALL SELECT 'new', 'toxic', y1, s0 FROM w), " + ap_sql("run, class") + "SELECT class, round(max(CASE WHEN run = 'base' THEN ap END), 8) AS base, round(max(CASE WHEN run = 'new' THEN ap END), 8) AS new FROM ap GROUP BY class")
def compare_runs(spark, sf_dir):
    s = scores(spark, sf_dir)
    runs = [V.tall_scores(s, c, []).withColumn("run", F.lit(n)) for n, c in
            (("base", {"quality": ("y0", "s0"), "toxic": ("y1", "s1")}), ("new", {"quality": ("y0", "s2"), "toxic": ("y1", "s0")}))]
    out = V.compare_runs(V.average_precision(runs[0].unionByName(runs[1]), ["run", "class"]), ["base", "new"])
    return out.select("class", F.round("base", 8).alias("base"), F.round("new", 8).alias("new"))


@query("normalise_aux", PIX + ", v AS (SELECT *, CASE WHEN pixel_col = 3 THEN NULL ELSE m2 END AS a, m3 AS b FROM p), g AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, min(a) AS la, max(a) AS ha FROM v WHERE a IS NOT NULL), t AS (SELECT tile_id, count(a) AS n, avg(a) AS ta, stddev_pop(a) AS ts FROM v GROUP BY tile_id) SELECT v.tile_id, round(sum(coalesce((a - ma) / (sa + 1e-8), 0e0)), 3) AS z, round(sum(coalesce((a - la) / (ha - la), 0e0)), 4) AS mm, round(sum(coalesce(CASE WHEN n >= 520 THEN (a - ta) / (ts + 1e-8) ELSE (a - ma) / (sa + 1e-8) END, 0e0)) + 0e0, 3) AS tz FROM v JOIN t ON t.tile_id = v.tile_id, g GROUP BY v.tile_id")
def normalise_aux(spark, sf_dir):
    v = derive(spark, sf_dir, PIXELS).select("tile_id", F.when(F.col("pixel_col") != 3, F.col("m2")).alias("a"), F.col("m3").alias("b"))
    stats, out = A.normalisation_stats(v, ["a", "b"]), None
    for name, mode, digits in (("z", "zscore", 3), ("mm", "minmax", 4), ("tz", "pertile_zscore", 3)):
        one = A.normalise(v, ["a", "b"], mode, stats, 520).groupBy("tile_id").agg((F.round(F.sum("a"), digits) + 0.0).alias(name))
        out = one if out is None else out.join(one, "tile_id")
    return out


@query("bland_confidence", PIX + ", b AS (SELECT confidence_tier, confidence_weight FROM p WHERE other > 0), t AS (SELECT confidence_tier FROM b GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT (SELECT confidence_tier FROM t) AS confidence_tier, confidence_weight FROM b WHERE confidence_tier = (SELECT confidence_tier FROM t) AND confidence_weight IS NOT NULL GROUP BY confidence_weight ORDER BY count(*) DESC, confidence_weight LIMIT 1")
def bland_confidence(spark, sf_dir):
    return A.bland_confidence(derive(spark, sf_dir, PIXELS), "other")


@query("next_polygon_ids", PIX + "SELECT tile_id, CAST((SELECT max(polygon_id) + 1 FROM p) + row_number() OVER (ORDER BY tile_id) - 1 AS BIGINT) AS polygon_id FROM (SELECT DISTINCT tile_id FROM p) q")
def next_polygon_ids(spark, sf_dir):
    p = derive(spark, sf_dir, PIXELS)
    first = p.agg(F.max("polygon_id").alias("m")).first()["m"] + 1
    return numbered(p.select("tile_id").distinct(), ["tile_id"], "polygon_id", first)


@query("imbalance_weights", PIX + ", t AS (SELECT count(*) AS n, count(CASE WHEN lcp > 4e-1 THEN 1 END) AS a, count(CASE WHEN hcp > 4e-1 THEN 1 END) AS b, count(CASE WHEN plagioclase > 4e-1 THEN 1 END) AS c FROM p) SELECT pixel_col, split, round(sum(coalesce(greatest(CASE WHEN lcp > 4e-1 THEN (n - a) / a END, CASE WHEN hcp > 4e-1 THEN (n - b) / b END, CASE WHEN plagioclase > 4e-1 THEN (n - c) / c END), 1e0)), 4) AS total FROM p, t GROUP BY pixel_col, split")
def imbalance_weights(spark, sf_dir):
    w = A.imbalance_weights(derive(spark, sf_dir, PIXELS), ["lcp", "hcp", "plagioclase"])
    return w.groupBy("pixel_col", "split").agg(F.round(F.sum("sample_weight"), 4).alias("total"))


@query("pixel_split_leaks", PIX + ", q AS (SELECT *, CASE WHEN polygon_id % 10 < 8 THEN 'train' ELSE 'val' END AS s2 FROM p) SELECT pixel_row, pixel_col, string_agg(DISTINCT s2, '|' ORDER BY s2) AS splits FROM q GROUP BY pixel_row, pixel_col HAVING count(DISTINCT s2) > 1")
def pixel_split_leaks(spark, sf_dir):
    p = derive(spark, sf_dir, PIXELS).withColumn("split", F.when(F.col("polygon_id") % 10 < 8, "train").otherwise("val"))
    return A.split_leaks(p, ["pixel_row", "pixel_col"]).select("pixel_row", "pixel_col", F.array_join("splits", "|").alias("splits"))


LADDER = [0.1, 0.3, 0.5, 0.7, 0.9, 2.0]


@query("precision_ladder", PIX + " " + " UNION ALL ".join(f"SELECT {t}e0 AS threshold, CAST(count(CASE WHEN m2 >= {t}e0 AND other = 0 THEN 1 END) AS BIGINT) AS n, coalesce(round_even(avg(CASE WHEN m2 >= {t}e0 AND other = 0 THEN hcp END), 4), 0e0) AS precision FROM p" for t in LADDER))
def precision_ladder(spark, sf_dir):
    p = derive(spark, sf_dir, PIXELS).withColumn("ok", F.col("other") == 0)
    return A.precision_ladder(p, "m2", "hcp", LADDER, "ok")


@query("stripe_artifacts", GRD + ", r AS (SELECT tile_id, value, valid, avg(value) OVER (PARTITION BY tile_id, pixel_row) AS rm FROM p) SELECT tile_id, round(abs(corr(value, CASE WHEN valid THEN 1e0 ELSE 0e0 END)), 6) AS edge_corr, round(var_pop(rm) / (var_pop(value) + 1e-9), 6) AS stripe_share FROM r GROUP BY tile_id")
def stripe_artifacts(spark, sf_dir):
    s = A.stripe_scores(derive(spark, sf_dir, GRID), "value", "valid", "pixel_row")
    return s.select("tile_id", F.round("edge_corr", 6).alias("edge_corr"), F.round("stripe_share", 6).alias("stripe_share"))


@query("review_progress", DEC + ", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY polygon_uid ORDER BY ts DESC, event_id DESC) AS rn FROM p) q WHERE rn = 1) SELECT predicted_class, CAST(sum(CASE WHEN decision = 'confirm' THEN n_pixels ELSE 0 END) AS BIGINT) AS pixels_confirmed, CAST(count(CASE WHEN decision = 'confirm' THEN 1 END) AS BIGINT) AS n_confirm, CAST(count(CASE WHEN decision = 'reject' THEN 1 END) AS BIGINT) AS n_reject, CAST(count(CASE WHEN decision = 'skip' THEN 1 END) AS BIGINT) AS n_skip, sum(CASE WHEN decision = 'confirm' THEN n_pixels ELSE 0 END) >= 800 AS target_reached FROM l GROUP BY predicted_class")
def review_progress(spark, sf_dir):
    from ..operators.review import progress
    from ..operators.sampling import latest
    return progress(latest(derive(spark, sf_dir, DECISIONS), "polygon_uid", ["ts", "event_id"]), 800).drop("fraction")


@query("constant_provenance", "SELECT 'raw' AS smooth, CAST(count(*) AS BIGINT) AS n FROM orders")
def constant_provenance(spark, sf_dir):
    from ..schema import constant_of
    o = load(spark, sf_dir, "orders").withColumn("smooth", F.lit("raw"))
    return o.groupBy(F.lit(constant_of(o, "smooth")).alias("smooth")).agg(F.count(F.lit(1)).alias("n"))


@query("feature_vector_by_name", "SELECT o_orderkey, o_totalprice AS first, CAST(o_custkey AS DOUBLE) AS second FROM orders")
def feature_vector_by_name(spark, sf_dir):
    from ..schema import feature_array
    o = load(spark, sf_dir, "orders")
    v = o.select("o_orderkey", feature_array(o, ["o_totalprice", "o_custkey"]).alias("x"))
    return v.select("o_orderkey", F.col("x")[0].alias("first"), F.col("x")[1].alias("second"))
