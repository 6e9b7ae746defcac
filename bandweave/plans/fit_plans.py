"""Calibration, fits, mining and augmentation on the derived tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import augment as G, rules as R, spectral as S
from ..operators import aggregates as A, evaluate as V, fitting as M, mining as K, split as P
from ..operators.grid import patches
from ..operators.ranking import exact_percentiles
from ..session import cut_lineage
from .grid_plans import CENTERS, CLOSE, centers, spectrum_grid, unit_pixels
from .registry import query
from .sampling_plans import GRD, h
from .spectral_plans import PARAMS, RULES, vectors
from .tables import PIXELS, SPECTRA, cte, derive, load, greedy_sql

LABELLED = ["CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS y_olivine", "CASE WHEN l_discount > 5e-2 THEN 1 ELSE 0 END AS y_lcp", "CASE WHEN l_extendedprice > 6e4 THEN 1 ELSE 0 END AS y_plagioclase",
            "CASE WHEN l_tax > 5e-2 THEN 1 ELSE 0 END AS y_alteration"]


def labelled(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").selectExpr(*[e for e in PARAMS[1] if not e.startswith("l_orderkey") and e not in ("l_linenumber", "l_partkey", "l_suppkey")], *LABELLED)


@query("calibrate_rules")
def calibrate_rules(spark, sf_dir):
    config = M.calibrate(labelled(spark, sf_dir), ["olivine", "lcp", "plagioclase", "alteration"], ["olivine", "lcp", "plagioclase", "alteration", "bland", "junk"], 0.9)
    rows = [(c, float(t), float(p)) for c, rule in config["classes"].items() for t, p in (rule["ladder"] or [])]
    return spark.createDataFrame(rows, "class string, threshold double, precision double")


@query("veto_cut_points", """WITH v AS (SELECT greatest(l_quantity / 1e3, 0e0) AS a, l_tax AS b, greatest(l_extendedprice / 3e5, 0e0) AS c FROM lineitem WHERE l_quantity > 30 OR l_discount > 5e-2 OR l_extendedprice > 6e4 OR l_tax > 5e-2),
n AS (SELECT count(*) AS n FROM v), l AS (SELECT *, rank() OVER (ORDER BY a) - 1 AS ra, rank() OVER (ORDER BY b) - 1 AS rb, rank() OVER (ORDER BY c) - 1 AS rc FROM v), m AS (SELECT row_number() OVER (ORDER BY greatest(ra, rb, rc)) AS rn, greatest(ra, rb, rc) AS w FROM l),
k AS (SELECT greatest(CAST(ceil(9e-1 * n) AS BIGINT), (SELECT w + 1 FROM m WHERE rn = (SELECT CAST(ceil(9e-1 * n) AS BIGINT) FROM n))) AS k FROM n),
s AS (SELECT a, b, c, row_number() OVER (ORDER BY a) AS na, row_number() OVER (ORDER BY b) AS nb, row_number() OVER (ORDER BY c) AS nc FROM v)
SELECT 'icer_high' AS name, round(max(a), 4) AS cut FROM s, k WHERE na = k UNION ALL SELECT 'var_high', round(max(b), 4) FROM s, k WHERE nb = k UNION ALL SELECT 'r770_max', round(max(c), 4) FROM s, k WHERE nc = k""")
def veto_cut_points(spark, sf_dir):
    d = labelled(spark, sf_dir)
    cuts = M.fit_vetoes(d.where("y_olivine + y_lcp + y_plagioclase + y_alteration > 0"), set(d.columns), 0.9)
    return spark.createDataFrame([(n, c) for n, c in cuts.items() if c != float("inf")], "name string, cut double").select("name", F.round("cut", 4).alias("cut"))


@query("class_gate_cut_points", "SELECT 'olivine' AS class, (SELECT x FROM (SELECT l_quantity / 5e1 AS x, row_number() OVER (ORDER BY l_quantity DESC) AS rn, count(*) OVER () AS n FROM lineitem WHERE l_quantity > 30) q WHERE rn = CAST(ceil(9e-1 * n) AS BIGINT)) AS threshold")
def class_gate_cut_points(spark, sf_dir):
    d = labelled(spark, sf_dir)
    gates = M.fit_gates(d.where("y_olivine > 0"), set(d.columns), R.empty_rules(["olivine"])["classes"]["olivine"], 0.9)
    return spark.createDataFrame([("olivine", gates["threshold"])], "class string, threshold double")


@query("joint_gate_retention", "SELECT true AS floor_held")
def joint_gate_retention(spark, sf_dir):
    d = labelled(spark, sf_dir)
    columns, rule = set(d.columns), R.empty_rules(["plagioclase"])["classes"]["plagioclase"]
    mine = d.where("y_plagioclase > 0 AND RPEAK1 IS NOT NULL")
    gates = M.fit_gates(mine, columns, rule, 0.9)
    rule["primary"]["threshold"] = gates.pop("threshold")
    rule.update(gates)
    fires = R.class_gate(columns, rule, R.evidence(columns, ["BD1300"]))
    return mine.agg((F.avg(F.when(fires, 1.0).otherwise(0.0)) >= 0.9).alias("floor_held"))


FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def training(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")
    hard = (F.col("l_quantity") > 25) & (F.col("l_linenumber") != 3)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *FEATURES[:2], F.when(F.col("l_linenumber") != 4, F.col("l_tax")).alias("l_tax"), "l_extendedprice",
                    F.when(hard, 1.0).otherwise(0.0).alias("big"), F.when(F.col("l_discount") > 0.06, 1.0).otherwise(0.0).alias("cheap"), F.lit(0.0).alias("none"),
                    F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.5).alias("w"))


def ap_of(scored, labels):
    tall = V.tall_scores(scored.select(*labels, *[F.round(f"p_{c}", 9).alias(f"p_{c}") for c in labels]), {c: (c, f"p_{c}") for c in labels}, [])
    return V.average_precision(tall, ["class"])


def baselines(t, labels, kinds, weight=None):
    """Average precision of each kind and class on the held-out rows, which all models score in one pass."""
    fitted = M.fit_kinds(t.where("l_orderkey % 4 <> 0"), FEATURES, labels, kinds, weight=weight)
    models = {f"{kind}|{c}": model for kind, by in fitted.items() for c, model in by.items()}
    scored = M.predict_classes(t.where("l_orderkey % 4 = 0"), models)
    tall = V.tall_scores(scored.select(*labels, *[F.round(f"p_{m}", 9).alias(f"p_{m}") for m in models]), {m: (m.split("|")[1], f"p_{m}") for m in models}, [])
    kind = F.split("class", r"\|")
    return V.average_precision(tall, ["class"]).withColumn("model", kind[0]).withColumn("class", kind[1])


@query("forest_and_boosted_baselines")
def forest_and_boosted_baselines(spark, sf_dir):
    return baselines(training(spark, sf_dir), ["big", "cheap", "none"], {"forest": {"trees": 8, "depth": 4}, "boosted": {"rounds": 4, "depth": 3}})


@query("weighted_linear_baselines")
def weighted_linear_baselines(spark, sf_dir):
    options = {"max_iter": 10, "reg": 0.01}
    return baselines(training(spark, sf_dir), ["big", "cheap"], {"logistic": options, "svc": options}, weight="w")


@query("region_scorer")
def region_scorer(spark, sf_dir):
    s = derive(spark, sf_dir, SPECTRA).withColumn("target", F.col("class").isin("c1", "c4", "c7"))
    fit = M.region_scorer(s, "spectrum", "target", "polygon_id", 5)
    scored = s.select("vec_id", "target", S.logistic_score("spectrum", fit["center"], fit["scale"], fit["weights"], fit["intercept"]).alias("score"))
    return scored.select("vec_id", "target", "score", (F.col("score") >= fit["threshold"]).alias("kept"))


@query("linear_probe")
def linear_probe(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    s = derive(spark, sf_dir, SPECTRA).withColumns({"a": F.when(F.col("class") == "c1", 1.0).otherwise(0.0), "b": F.when(F.col("class") == "c2", 1.0).otherwise(0.0)})
    models, rows = M.linear_probe(s, "spectrum", ["a", "b"]), M.vectors(s, "spectrum")
    for c, model in models.items():
        rows = model.transform(rows).select(*[x for x in rows.columns], vector_to_array("probability")[1].alias(f"p_{c}"))
    return ap_of(rows, ["a", "b"])


@query("pca_whitening", "SELECT CAST(count(*) AS BIGINT) AS n, true AS unit_variance, true AS centred FROM embeddings")
def pca_whitening(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    p = M.fit_pca(e, "embedding", 0.6, 32)
    z = e.select(S.project("embedding", p["mean"], p["components"], p["variance"]).alias("z"))
    every = range(len(p["variance"]))
    unit, centred = ([f(F.col("z")[k]) for k in every] for f in (lambda c: F.abs(F.var_samp(c) - 1.0), lambda c: F.abs(F.avg(c))))
    whole = lambda tests: F.lit(True) if not tests else reduce(lambda a, b: a & b, [t < 1e-6 for t in tests])
    return z.agg(F.count(F.lit(1)).alias("n"), whole(unit).alias("unit_variance"), whole(centred).alias("centred"))


@query("embedding_clusters")
def embedding_clusters(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return M.embedding_clusters(e, "embedding", 8, [0, 1], 6, 3).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("class_endmember_set")
def class_endmember_set(spark, sf_dir):
    return M.class_endmembers(derive(spark, sf_dir, SPECTRA), "c5", "spectrum", "vec_id", 3, 1).select("class", "cluster", "vec_id")


@query("batch_scoring_hook", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm FROM embeddings")
def batch_scoring_hook(spark, sf_dir):
    import numpy as np
    out = M.score_with(load(spark, sf_dir, "embeddings"), "embedding", lambda x: np.linalg.norm(x, axis=1, keepdims=True))
    return out.select("vec_id", F.round(F.col("output")[0], 6).alias("norm"))


@query("baseline_tile_scores", cte(p=PARAMS) + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber <> 5 AND NOT (ICER1_2 >= 48e-3 OR R770 > 33e-2) THEN CASE WHEN OLINDEX3 >= 9e-1 THEN 9e-1 WHEN OLINDEX3 >= 7e-1 THEN 65e-2 WHEN OLINDEX3 >= 5e-1 THEN 4e-1 ELSE 0e0 END ELSE 0e0 END AS p_olivine FROM p")
def baseline_tile_scores(spark, sf_dir):
    p = derive(spark, sf_dir, PARAMS).withColumn("valid", F.col("l_linenumber") != 5)
    return M.gated_scores(p, R.rule_scores(p, RULES), "valid").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_olivine")


# ---------------------------------------------------------------------- mining

BANDS = ["o_totalprice / 5e5 AS \"OLINDEX3\"", "(o_custkey % 97) / 97e0 AS \"LCPINDEX2\"", "(o_orderkey * 31 % 89) / 89e0 AS \"HCPINDEX2\"", "(o_custkey * 17 % 83) / 83e0 AS \"BD1900_2\"", "1e-2 AS \"D2300\"", "(o_custkey * 7 % 71) / 71e0 AS \"BD2210_2\"",
         "(o_custkey * 3 % 67) / 67e0 AS \"RBR\"", "(o_custkey * 5 % 61) / 61e0 AS \"R770\"", "85e-2 + (o_orderkey % 10) / 50e0 AS best"]
DUST = GRD.replace(" FROM orders", ", " + ", ".join(BANDS) + " FROM orders")


def dust_grid(spark, sf_dir):
    from .tables import GRID
    return load(spark, sf_dir, "orders").selectExpr(*GRID[1], *[b.replace('"', "`") for b in BANDS])


DUST_SQL = DUST + ", q AS (SELECT tile_id, quantile_cont(OLINDEX3, 4e-1) AS a, quantile_cont(LCPINDEX2, 4e-1) AS b, quantile_cont(HCPINDEX2, 4e-1) AS c, quantile_cont(BD1900_2, 6e-1) AS d, quantile_cont(BD2210_2, 6e-1) AS e, quantile_cont(RBR, 6e-1) AS f, quantile_cont(R770, 6e-1) AS g FROM p WHERE valid GROUP BY tile_id), hit AS (SELECT p.* FROM p JOIN q ON q.tile_id = p.tile_id WHERE valid AND OLINDEX3 <= a AND LCPINDEX2 <= b AND HCPINDEX2 <= c AND BD1900_2 < d AND D2300 <= 5e-2 AND BD2210_2 < e AND RBR >= f AND R770 >= g AND best >= 9e-1)"


@query("dust_negatives", DUST_SQL + " SELECT tile_id, pixel_row, pixel_col FROM hit")
def dust_negatives(spark, sf_dir):
    return K.dust_negatives(dust_grid(spark, sf_dir), "valid", F.col("best")).select("tile_id", "pixel_row", "pixel_col")


@query("mined_dust_pixels", DUST_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f", c AS (SELECT tile_id, pixel_row, pixel_col, {h(13, 'tile_id', 'pixel_row', 'pixel_col')} AS k FROM hit WHERE tile_id <> 'g1')" + greedy_sql("c", 9, 500))
def mined_dust_pixels(spark, sf_dir):
    return K.mine(dust_grid(spark, sf_dir), "valid", F.col("best"), 3, 500, 13, ["g1"]).select("tile_id", "pixel_row", "pixel_col")


@query("mined_medians", DUST_SQL + " SELECT round(median(RBR), 8) AS \"RBR\", round(median(R770), 8) AS \"R770\" FROM hit")
def mined_medians(spark, sf_dir):
    from ..operators.ranking import with_scalars
    hit = K.dust_negatives(dust_grid(spark, sf_dir), "valid", F.col("best")).select("RBR", "R770")
    a, b = (exact_percentiles(hit, [], c, {c: 0.5}).select(F.round(c, 8).alias(c)) for c in ("RBR", "R770"))
    return with_scalars(a, b)


MERGE = cte(p=PIXELS) + ", m AS (SELECT 't' || CAST(o_custkey % 100 AS STRING) AS tile_id, o_orderkey AS pixel_row, CAST(o_orderkey % 7 + 1 AS BIGINT) AS pixel_col FROM orders WHERE o_orderstatus = 'F')"


@query("merge_hard_negatives", MERGE + ", f AS (SELECT * FROM m WHERE (tile_id, pixel_row, pixel_col) NOT IN (SELECT tile_id, pixel_row, pixel_col FROM p)) SELECT 'mined' AS kind, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT tile_id) AS BIGINT) AS polygons, sum(1e0) AS other FROM f UNION ALL SELECT 'base', count(*), count(DISTINCT polygon_id), sum(other) FROM p")
def merge_hard_negatives(spark, sf_dir):
    base = derive(spark, sf_dir, PIXELS)
    mined = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("'t' || CAST(o_custkey % 100 AS STRING) AS tile_id", "o_orderkey AS pixel_row", "CAST(o_orderkey % 7 + 1 AS BIGINT) AS pixel_col", *[f"o_totalprice / 5e5 AS band_{i:02d}" for i in range(4)])
    out = K.merge_negatives(base, mined, "other")
    return out.groupBy(F.when(F.col("split").isNull(), "mined").otherwise("base").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("polygon_id").alias("polygons"), F.sum("other").alias("other"))


RESPLIT = cte(p=PIXELS).replace(" AS (", " AS MATERIALIZED (", 1) + f""", c AS ({CENTERS}),
b AS (SELECT tile_id, CAST(floor(polygon_id / 1e2) AS BIGINT) AS polygon_id, pixel_row % 1500 AS r, polygon_id * 37 % 1500 + pixel_col AS k,
      CASE CAST(substr(tile_id, 2) AS BIGINT) % 10 WHEN 3 THEN 'val' WHEN 7 THEN 'test' ELSE 'train' END AS split FROM p),
m AS (SELECT 't' || CAST(o_custkey % 10 AS STRING) AS tile_id, o_orderkey % CASE WHEN o_custkey % 10 < 6 THEN 1500 ELSE 100 END AS r, o_custkey * 53 % 1500 AS k FROM orders WHERE o_orderstatus = 'F'),
f AS (SELECT * FROM m WHERE (tile_id, r, k) NOT IN (SELECT tile_id, r, k FROM b)),
u AS (SELECT tile_id, polygon_id, r, k, split FROM b UNION ALL SELECT tile_id, -1, r, k, NULL FROM f),
g AS (SELECT tile_id || '|' || CAST(polygon_id AS STRING) AS id, tile_id, polygon_id, avg(r) AS r, avg(k) AS k, max(split) AS split, count(*) AS n FROM u GROUP BY ALL),
q AS MATERIALIZED (SELECT id, polygon_id, split, n, lat - 5e0 * (r / 15e2 - 5e-1) AS lat, lon + 5e0 * (k / 15e2 - 5e-1) AS lon FROM g JOIN c USING (tile_id)),
w AS (SELECT tile_id, r, k, min(tile_id || '|' || CAST(polygon_id AS STRING)) AS low FROM u GROUP BY ALL),
s AS (SELECT DISTINCT u.tile_id || '|' || CAST(u.polygon_id AS STRING) AS x, w.low AS y FROM u JOIN w ON w.tile_id = u.tile_id AND w.r = u.r AND w.k = u.k),
e AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM q a JOIN q b ON a.id <> b.id AND {CLOSE} UNION SELECT x, y FROM s WHERE x <> y UNION SELECT y, x FROM s WHERE x <> y),
z AS (SELECT id, id AS root FROM q UNION SELECT e.y, z.root FROM z JOIN e ON e.x = z.id WHERE z.root < e.y),
o AS (SELECT id, min(root) AS root FROM z GROUP BY id),
h AS (SELECT root, min(split) AS low, max(split) AS high FROM o JOIN q USING (id) GROUP BY root)
SELECT CASE WHEN polygon_id >= 0 THEN 'base' ELSE 'mined' END AS kind, CASE WHEN polygon_id >= 0 THEN split WHEN low IS NULL THEN 'dealt' WHEN low = high THEN low ELSE 'unused' END AS split,
       CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS polygons FROM q JOIN o USING (id) JOIN h USING (root) GROUP BY 1, 2"""


@query("merge_and_resplit", "WITH RECURSIVE" + RESPLIT.removeprefix("WITH"))
def merge_and_resplit(spark, sf_dir):
    number = F.substring("tile_id", 2, 10).cast("long") % 10
    base = unit_pixels(spark, sf_dir).withColumn("split", F.when(number == 3, "val").when(number == 7, "test").otherwise("train"))
    mined = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("'t' || CAST(o_custkey % 10 AS STRING) AS tile_id", "o_orderkey % CASE WHEN o_custkey % 10 < 6 THEN 1500 ELSE 100 END AS pixel_row", "o_custkey * 53 % 1500 AS pixel_col", *[f"o_totalprice / 5e5 AS band_{i:02d}" for i in range(4)])
    labels, place = ["lcp", "hcp", "plagioclase", "other"], ["tile_id", "polygon_id"]
    merged = K.merge_negatives(base, mined, "other").withColumn("kind", F.when(F.col("split").isNull(), "mined").otherwise("base"))
    merged = cut_lineage(merged.select(*place, "pixel_row", "pixel_col", *labels, "split", "kind"))
    out = P.anchored_split(merged, A.centroids(merged, centers(spark, sf_dir), place), labels, 42)
    out = cut_lineage(out.groupBy("unit", "kind", "split", *place).agg(F.count(F.lit(1)).alias("n")))
    alone = out.groupBy("unit").agg(F.max(F.col("kind") == "base").alias("anchored"))
    shown = F.when((F.col("kind") == "mined") & ~F.col("anchored") & F.col("split").isin(*P.SPLITS), "dealt").otherwise(F.col("split"))
    return out.join(alone, "unit").groupBy("kind", shown.alias("split")).agg(F.sum("n").alias("n"), F.countDistinct("tile_id", "polygon_id").alias("polygons"))


# ---------------------------------------------------------------- augmentation

@query("augment_spectra")
def augment_spectra(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return e.select("vec_id", "copy", G.augmented("embedding", G.row_seed(1, "vec_id", "copy")).alias("spectrum"))


@query("sensor_noise_patches")
def sensor_noise_patches(spark, sf_dir):
    g = spectrum_grid(spark, sf_dir)
    p = patches(g, g, "spectrum", 64)
    return p.select("pixel_row", "pixel_col", G.sensor_noise("patch", G.row_seed(2, "pixel_row", "pixel_col"), 64).alias("patch"))


@query("synthetic_patches", "SELECT 'SYNTH_PLAG_c' || CAST(vec_id AS STRING) || '_' || CAST(c AS STRING) AS tile_id, 1e0 AS plagioclase, CAST(49 AS BIGINT) AS n, true AS clipped FROM embeddings, (SELECT unnest(range(3)) AS c) q WHERE label = 6")
def synthetic_patches(spark, sf_dir):
    lib = vectors(spark, sf_dir).where("label = 6").select(F.concat(F.lit("# c"), F.col("vec_id").cast("string")).alias("name"), F.col("abs").alias("spectrum"))
    rows = G.synthetic_rows(lib, "name", "spectrum", 3, 9, "High")
    flat = F.flatten("patch")
    return rows.select("tile_id", "plagioclase", F.size("patch").cast("bigint").alias("n"), ((F.array_min(flat) >= 0) & (F.array_max(flat) <= 0.5)).alias("clipped"))
