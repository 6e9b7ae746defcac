"""Rule calibration and spark.ml fits."""

from __future__ import annotations

import math
import struct
from functools import reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules as R, spectral as S
from ..functions.keys import hash_unit
from ..session import cut_lineage
from .aggregates import precision_ladder
from .evaluate import POSITIVE
from .ranking import exact_percentiles, null_safe_join, order_statistics, running_totals

REJECT_ALARM = 0.40  # fixed value: share of rows the vetoes may reject before a warning


# ---------------------------------------------------------------- cut points

def kth(n: int, retention: float) -> int:
    """How many of ``n`` values must survive."""
    return int(min(n, max(1, math.ceil(round(retention * n, 9)))))


def next_float32(x: float) -> float:
    """Smallest 32-bit float above ``x``."""
    bits = struct.unpack("<i", struct.pack("<f", x))[0]
    if x == 0.0:
        bits = 1
    elif bits > 0:
        bits += 1
    else:
        bits = bits - 1 if bits != -(2**31) else 1
    return struct.unpack("<f", struct.pack("<i", bits))[0]


def detect_cuts(positives: DataFrame, values: dict[str, Column], retention: float) -> dict[str, float | None]:
    """Per name the k-th largest finite value, all names in one pass."""
    items = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("v")) for n, v in values.items()])
    tall = positives.select(F.explode(items).alias("x")).select("x.name", "x.v").where(F.abs("v") != float("inf"))
    k = F.greatest(F.lit(1), F.ceil(F.round(F.lit(retention) * F.col("n"), 9)))
    rows = order_statistics(tall, ["name"], "v", {"x": F.col("n") - k}).collect()
    return {**dict.fromkeys(values), **{r["name"]: r["x"] for r in rows}}


def at_places(rows: DataFrame, wanted: dict[str, tuple[str, str, int]]) -> dict[str, float]:
    """Values at 0-based sorted positions of columns that already carry their places."""
    aggs = [F.max(F.when((F.col(f"{place}_lt") <= pos) & (F.col(f"{place}_le") > pos), F.col(value))).alias(name)
            for name, (value, place, pos) in wanted.items()]
    return rows.agg(*aggs).first().asDict()


def with_places(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds how many values are smaller (``name_lt``) and not larger (``name_le``); NULL for missing."""
    ok = F.col(value).isNotNull() & (F.abs(value) != float("inf"))
    counted = df.where(ok).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    run = running_totals(counted, [], [value], {f"{name}_le": F.col("__n")})
    places = run.select(value, f"{name}_le", (F.col(f"{name}_le") - F.col("__n")).alias(f"{name}_lt"))
    return null_safe_join(df, places, [value], "left")


def joint_level(rows: DataFrame, critical: Column, n: int, retention: float) -> float:
    """Smallest per-gate retention at which the gates together keep ``retention`` of the rows.

    A row passes all gates at levels above its critical value, so the answer is one
    order statistic instead of a search.
    """
    at = order_statistics(rows.select(critical.alias("__c")), [], "__c", {"x": F.lit(kth(n, retention) - 1)}).first()["x"]
    return 1.0 if at is None else float(at)


def level_count(n: int, retention: float, critical: float) -> int:
    """Order-statistic count at the joint level, never below the plain retention."""
    return int(min(n, max(kth(n, retention), math.floor(critical * n + 1e-9) + 1)))


def fit_vetoes(positives: DataFrame, columns: set[str], retention: float) -> dict:
    """Junk cut points that together keep ``retention`` of the protected rows."""
    active = {n: [p for p in ps if p in columns] for n, ps in R.VETO_PARAMS.items()}
    active = {n: ps for n, ps in active.items() if ps}
    cuts = dict.fromkeys(R.VETO_PARAMS, float("inf"))
    n = positives.count()
    if not n or not active:
        return cuts
    rows = positives.select(*[R.veto_value(ps).alias(f"v_{name}") for name, ps in active.items()])
    for name in active:
        rows = with_places(rows, f"v_{name}", name)
    rows = cut_lineage(rows)
    worst = [F.col(f"{name}_lt") / float(n) for name in active]
    critical = F.greatest(*worst) if len(worst) > 1 else worst[0]
    base = kth(n, retention)
    kept = rows.agg(F.count_if(critical * n < base - 1e-9).alias("k")).first()["k"]
    level = retention if kept >= retention * n else joint_level(rows, critical, n, retention)
    k = base if level == retention else level_count(n, retention, level)
    found = at_places(rows, {name: (f"v_{name}", name, k - 1) for name in active})
    return {**cuts, **{name: next_float32(v) for name, v in found.items()}}


def fit_gates(positives: DataFrame, columns: set[str], rule: dict, retention: float) -> dict:
    """A class's own cut points; several gates share one level so that together they keep the floor."""
    score = R.evidence(columns, R.as_list(rule["primary"]["param"]), rule["primary"].get("reduce", "max"))
    windowed = "rpeak1_window" in rule
    if not windowed:
        return {"threshold": detect_cuts(positives, {"s": score}, retention)["s"]}
    rows = positives.select(score.alias("s"), R.evidence(columns, ["RPEAK1"]).alias("w"), R.evidence(columns, ["BD1900R2"]).alias("h"))
    finite = lambda c: F.col(c) != float("-inf")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(finite(c)).alias(c) for c in rows.columns]).first()
    for c in ("s", "w", "h"):
        rows = with_places(rows, c, c)
    rows = cut_lineage(rows)
    ns, nw, nh = float(sizes["s"]), float(sizes["w"]), float(sizes["h"])
    if not min(ns, nw, nh):
        return {"threshold": None, "rpeak1_window": None, "hydration_veto": float("inf")}
    trim = F.least(2 * F.col("w_le") - 1, 2 * (nw - 1 - F.col("w_lt")))
    parts = [(ns - F.col("s_le")) / ns, (nw - trim - 1) / nw, F.col("h_lt") / nh]
    never = F.col("s_le").isNull() | F.col("w_le").isNull()
    critical = F.when(never, 2.0).otherwise(F.greatest(*[F.coalesce(p, F.lit(-1.0)) for p in parts]))
    level = joint_level(rows, critical, sizes["n"], retention)
    k = lambda n: level_count(int(n), retention, min(level, 1.0))
    drop = int(nw) - k(nw)
    v = at_places(rows, {"t": ("s", "s", int(ns) - k(ns)), "lo": ("w", "w", drop // 2),
                         "hi": ("w", "w", int(nw) - 1 - (drop - drop // 2)), "h": ("h", "h", k(nh) - 1)})
    return {"threshold": v["t"], "rpeak1_window": [v["lo"], v["hi"]], "hydration_veto": next_float32(v["h"])}


def rungs(fired: DataFrame, score: str, base: float) -> list[float]:
    """Ladder cut points: the firing threshold itself, then rounded-down quantiles above it."""
    probs = {f"q{i}": q for i, q in enumerate(R.LADDER_QUANTILES)}
    row = exact_percentiles(fired.where(F.abs(score) != float("inf")), [], score, probs).first()
    found = {base}
    if row is not None:
        found |= {math.floor(row[q] * 1e6) / 1e6 for q in probs if row[q] is not None and math.floor(row[q] * 1e6) / 1e6 > base}
    return sorted(found)


def calibrate(df: DataFrame, labels: list[str], vocab: list[str], retention: float = 0.90) -> dict:
    """Cut points and precision ladders of every rule from a labelled parameter table.

    ``df`` has the parameters and one 0/1 column ``y_<class>`` per label. Only cut
    points and counts come to the driver.
    """
    if not 0.0 < retention < 1.0:
        raise ValueError("retention must be between 0 and 1")
    params = [c for c in df.columns if not c.startswith("y_")]
    covered = F.coalesce(*[R.known(p) for p in params]).isNotNull()
    data = cut_lineage(df.where(covered))
    columns = set(params)
    config = R.empty_rules(vocab)
    audit: dict = {"retention": retention, "n_rows": data.count(), "classes": {}, "warnings": []}
    positive = lambda c: F.col(f"y_{c}") > 0
    protected = reduce(lambda a, b: a | b, [positive(c) for c in labels if c != "junk"])
    config["junk"] = fit_vetoes(data.where(protected), columns, retention)
    junk = R.junk_flag(columns, config["junk"])
    share = data.agg(F.avg(F.when(junk, 1.0).otherwise(0.0)).alias("j")).first()["j"] or 0.0
    audit["junk_rejects_frac"] = round(share, 4)
    if share > REJECT_ALARM:
        audit["warnings"].append("junk vetoes reject too many rows")
    for name, rule in config["classes"].items():
        n_pos = data.where(positive(name)).count() if name in labels else 0
        audit["classes"][name] = {"n_positives": n_pos}
        if not n_pos:
            audit["warnings"].append(f"{name}: no positives, left inert")
            continue
        mine = data.where(positive(name))
        if "groups" in rule:
            needed = sorted({p for g in rule["groups"] for p in g["requires"]})
            cuts = detect_cuts(mine, {p: R.evidence(columns, [p]) for p in needed}, retention)
            for g in rule["groups"]:
                g["thresholds"] = {p: cuts[p] for p in g["requires"]}
            fires, score = R.group_evidence(columns, rule["groups"], ~junk)
        else:
            gates = fit_gates(mine, columns, rule, retention)
            rule["primary"]["threshold"] = gates.pop("threshold")
            rule.update(gates)
            score = R.evidence(columns, R.as_list(rule["primary"]["param"]), rule["primary"].get("reduce", "max"))
            fires = ~junk & R.class_gate(columns, rule, score)
        scored = cut_lineage(data.select(score.alias("score"), fires.alias("fires"), F.col(f"y_{name}").cast("double").alias("y")))
        fired = scored.where("fires")
        low = fired.agg(F.min("score").alias("m")).first()["m"]
        base = (low if low is not None else 0.0) if "groups" in rule else (rule["primary"]["threshold"] or 0.0)
        ladder = precision_ladder(scored, "score", "y", rungs(fired, "score", float(base)), "fires").orderBy("threshold").collect()
        rule["ladder"] = [[r["threshold"], r["precision"]] for r in ladder]
        kept = scored.agg((F.count_if(F.col("fires") & (F.col("y") > 0)) / F.count_if(F.col("y") > 0)).alias("k")).first()["k"]
        audit["classes"][name]["retained_after_vetoes"] = round(kept, 4)
        precisions = [p for _, p in rule["ladder"]]
        if precisions != sorted(precisions):
            audit["warnings"].append(f"{name}: precision is not monotonic")
    config["calibration"] = audit
    return config


# ------------------------------------------------------------------ spark.ml

def vectors(df: DataFrame, features: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(features).cast("array<double>")))


def classifier(kind: str, label: str, seed: int, weight: str | None = None, **options):
    """One binary classifier over the column ``features``."""
    makers = {"logistic": lambda: LogisticRegression(maxIter=options.get("max_iter", 100), regParam=options.get("reg", 0.0)),
              "svc": lambda: LinearSVC(maxIter=options.get("max_iter", 50), regParam=options.get("reg", 0.0)),
              "forest": lambda: RandomForestClassifier(numTrees=options.get("trees", 50), maxDepth=options.get("depth", 8), seed=seed),
              "boosted": lambda: GBTClassifier(maxIter=options.get("rounds", 20), maxDepth=options.get("depth", 4), seed=seed)}
    if kind not in makers:
        raise ValueError(f"unknown model {kind!r}")
    model = makers[kind]().setLabelCol(label).setFeaturesCol("features").setPredictionCol("__prediction")
    return model.setWeightCol(weight) if weight else model


def fit_kinds(df: DataFrame, inputs: list[str], labels: list[str], kinds: dict[str, dict], seed: int = 0,
              weight: str | None = None) -> dict[str, dict[str, PipelineModel | None]]:
    """Per kind (with its options) one model per class; a class with a single value in the data is inert (None).

    ``df`` is read once; medians are taken once and shared by all models as one first stage, and rows are
    filled and assembled once, on disk, which leaves the memory to the points that trees keep.
    """
    data = cut_lineage(df)
    counts = data.agg(*[F.count_if(F.col(c) > POSITIVE).alias(c) for c in labels], F.count(F.lit(1)).alias("__n")).first()
    live = [c for c in labels if counts[c] not in (0, counts["__n"])]
    models: dict[str, dict[str, PipelineModel | None]] = {kind: dict.fromkeys(labels) for kind in kinds}
    if not live:
        return models
    filled = [f"{c}__f" for c in inputs]
    fill = Pipeline(stages=[Imputer(strategy="median", inputCols=inputs, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features")]).fit(data)
    ready = fill.transform(data).select(*dict.fromkeys([*live, *([weight] if weight else [])]), "features").persist(StorageLevel.DISK_ONLY)
    for kind, options in kinds.items():
        for c in live:
            flagged = ready.withColumn("__y", F.when(F.col(c) > POSITIVE, 1.0).otherwise(0.0))
            models[kind][c] = PipelineModel([fill, classifier(kind, "__y", seed, weight, **options).fit(flagged)])
    ready.unpersist()
    return models


def fit_classes(df: DataFrame, inputs: list[str], labels: list[str], kind: str, seed: int = 0, weight: str | None = None,
                **options) -> dict[str, PipelineModel | None]:
    """One model per class; a class with a single value in the data is inert (None)."""
    return fit_kinds(df, inputs, labels, {kind: options}, seed, weight)[kind]


def predict_classes(df: DataFrame, models: dict[str, PipelineModel | None]) -> DataFrame:
    """``p_<class>`` columns; an inert class scores 0, a margin model goes through the logistic curve.

    A first stage that neighbouring models share is applied once for them.
    """
    out, base, fill = df, df.columns, None
    for c, model in models.items():
        if model is None:
            out = out.withColumn(f"p_{c}", F.lit(0.0))
        else:
            if model.stages[0] is not fill:
                fill = model.stages[0]
                out = fill.transform(out.select(*base))
            scored = model.stages[1].transform(out)
            if "probability" in scored.columns:
                p = vector_to_array("probability")[1]
            else:
                p = F.lit(1.0) / (F.lit(1.0) + F.exp(-vector_to_array("rawPrediction")[1]))
            out = scored.select(*out.columns, p.alias(f"p_{c}"))
        base = [*base, f"p_{c}"]
    return out.select(*base)


def predict_grid(grid: DataFrame, models: dict[str, PipelineModel | None], bands: list[str], nodata: float = 65535.0) -> DataFrame:
    """``p_<class>`` of every pixel of a tile from fitted models, and ``best_class``, the number of the largest.

    A pixel with a band at or above ``nodata`` is not predicted: its scores are 0 and its best class is -1. Missing bands
    (null or NaN) count as 0. Ties go to the first class.
    """
    value = {c: F.col(c).cast("double") for c in bands}
    valid = ~reduce(lambda a, b: a | b, [F.coalesce(value[c] >= nodata, F.lit(False)) & ~F.isnan(value[c]) for c in bands])
    filled = grid.withColumn("__valid", valid).withColumns({c: F.coalesce(F.nanvl(value[c], F.lit(0.0)), F.lit(0.0)) for c in bands})
    out = predict_classes(filled, models)
    scores = [f"p_{c}" for c in models]
    out = out.withColumns({c: F.when(F.col("__valid"), F.col(c)).otherwise(0.0) for c in scores})
    held = F.array(*scores)
    best = F.when(F.col("__valid"), F.array_position(held, F.array_max(held)).cast("int") - 1).otherwise(-1)
    return out.withColumn("best_class", best).select(*[c for c in grid.columns if c not in bands], *scores, "best_class")


def linear_probe(df: DataFrame, features: str, labels: list[str], weight_decay: float = 1e-4, seed: int = 0) -> dict:
    """One logistic regression per class on frozen features."""
    rows = vectors(df, features)
    models = {}
    for c in labels:
        y = rows.withColumn("__y", F.when(F.col(c) > POSITIVE, 1.0).otherwise(0.0))
        models[c] = LogisticRegression(maxIter=100, regParam=weight_decay, labelCol="__y", featuresCol="features").fit(y)
    return models


def region_scorer(df: DataFrame, features: str, target: str, group: str, seed: int, test_share: float = 0.3,
                  min_precision: float = 0.70) -> dict:
    """Balanced logistic scorer on standardised region means, validated on held-out groups.

    The threshold is the one with the most recall among those at or above the wanted
    precision (the most precise one when none is).
    """
    rows = cut_lineage(vectors(df, features, "raw").withColumn("__test", hash_unit(seed, group) < test_share)
                       .withColumn("__y", F.when(F.col(target), 1.0).otherwise(0.0)))
    train, test = rows.where("NOT __test"), rows.where("__test")
    n = train.agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("p")).first()
    weight = F.when(F.col("__y") > 0, n["n"] / (2.0 * n["p"])).otherwise(n["n"] / (2.0 * (n["n"] - n["p"])))
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="features").fit(train)
    weighted = scaler.transform(train).withColumn("__w", weight)
    size = weighted.count()
    model = LogisticRegression(labelCol="__y", weightCol="__w", maxIter=200, regParam=1.0 / size).fit(weighted)
    scored = model.transform(scaler.transform(test)).select("__y", vector_to_array("probability")[1].alias("score"))
    curve = pr_curve(scored)
    good = curve.where(F.col("precision") >= min_precision)
    best = good.agg(F.max_by(F.struct("score", "precision", "recall"), F.struct("recall", "score")).alias("b")).first()["b"]
    if best is None:
        best = curve.agg(F.max_by(F.struct("score", "precision", "recall"), F.struct("precision", "score")).alias("b")).first()["b"]
    return {"center": list(scaler.mean), "scale": [s if s > 0 else 1.0 for s in scaler.std], "weights": list(model.coefficients), "intercept": model.intercept,
            "threshold": best["score"], "precision": best["precision"], "recall": best["recall"], "auc": auc(scored)}


def pr_curve(scored: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score."""
    steps = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("p"))
    run = running_totals(steps, [], ["score"], {"cn": F.col("n"), "cp": F.col("p")}, descending=True)
    total = steps.agg(F.sum("p").alias("t")).scalar()
    return run.select("score", (F.col("cp") / F.col("cn")).alias("precision"), (F.col("cp") / total).alias("recall"))


def auc(scored: DataFrame) -> float:
    steps = scored.groupBy("score").agg(F.sum("__y").alias("p"), F.sum(1.0 - F.col("__y")).alias("q"))
    run = running_totals(steps, [], ["score"], {"cq": F.col("q")})
    row = run.agg(F.sum(F.col("p") * (F.col("cq") - F.col("q") / 2.0)).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    return row["u"] / (row["p"] * row["q"]) if row["p"] and row["q"] else float("nan")


def fit_pca(df: DataFrame, features: str, share: float, most: int) -> dict:
    """Mean, components and variances of the leading components that reach the variance share."""
    rows = vectors(df, features)
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(rows)
    model = PCA(k=most, inputCol="centred", outputCol="pcs").fit(scaler.transform(rows))
    explained, keep, run = list(model.explainedVariance), 0, 0.0
    while keep < most and run < share:
        run += explained[keep]
        keep += 1
    matrix = model.pc.toArray()
    projected = model.transform(scaler.transform(rows)).select(vector_to_array("pcs").alias("z"))
    var = projected.agg(*[F.var_samp(F.col("z")[i]).alias(f"v{i}") for i in range(keep)]).first()
    return {"mean": list(scaler.mean), "components": [list(matrix[:, i]) for i in range(keep)], "variance": [var[f"v{i}"] for i in range(keep)]}


def embedding_clusters(df: DataFrame, features: str, n_components: int, drop: list[int], k: int, seed: int) -> DataFrame:
    """Clusters of the principal components that are left after dropping the named ones."""
    rows = vectors(df, features)
    scaled = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(rows).transform(rows)
    pcs = PCA(k=n_components, inputCol="centred", outputCol="pcs").fit(scaled).transform(scaled)
    keep = [i for i in range(n_components) if i not in drop]
    kept = pcs.withColumn("__z", array_to_vector(S.take_bands(vector_to_array("pcs"), keep)))
    model = KMeans(k=k, seed=seed, featuresCol="__z", predictionCol="cluster").fit(kept)
    return model.transform(kept).drop("features", "centred", "pcs", "__z")


def median_endmembers(df: DataFrame, spectrum: str) -> DataFrame:
    """Class and median spectrum; missing bands are left out band by band."""
    tall = df.select("class", F.posexplode(F.col(spectrum).cast("array<double>")).alias("i", "v"))
    med = exact_percentiles(tall, ["class", "i"], "v", {"m": 0.5})
    bands = F.array_sort(F.collect_list(F.struct("i", "m")))
    return med.groupBy("class").agg(bands.alias("b")).select("class", F.transform("b", lambda x: x["m"]).alias(spectrum))


def class_endmembers(df: DataFrame, cls: str, spectrum: str, key: str, k: int, seed: int) -> DataFrame:
    """``k`` endmembers of one class: cluster on the unit sphere, then the nearest real spectrum of each.

    One endmember, or a class of no more than ``k`` rows: the median of each band (no key).
    """
    mine = df.where(F.col("class") == cls)
    if k <= 1 or mine.limit(k + 1).count() <= k:
        return median_endmembers(mine, spectrum).select("class", F.lit(0).alias("cluster"), F.lit(None).cast(df.schema[key].dataType).alias(key), spectrum)
    rows = vectors(df.where(F.col("class") == cls).withColumn("__u", S.unit(spectrum)), "__u")
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    near = model.transform(rows).withColumn("__d", S.dot("__u", F.element_at(centres, F.col("cluster") + 1)))
    return near.groupBy("class", "cluster").agg(F.max_by(F.struct(key, spectrum), F.struct(F.col("__d"), F.col(key))).alias("r")).select("class", "cluster", f"r.{key}", f"r.{spectrum}")


def score_with(df: DataFrame, spectrum: str, fn, name: str = "output") -> DataFrame:
    """User-supplied scorer over Arrow batches: a float matrix in, a float matrix out."""
    @F.arrow_udf(returnType=S.DOUBLES)
    def kernel(column: pa.Array) -> pa.Array:
        x, present = S.matrix(column)
        return S.lists(fn(x) if x.size else x, present)
    return df.withColumn(name, kernel(F.col(spectrum)))


def gated_scores(df: DataFrame, scores: dict[str, Column], valid: str) -> DataFrame:
    """Baseline scores of a tile; invalid pixels score 0 in every class."""
    return df.select(*df.columns, *[F.when(F.col(valid), c).otherwise(0.0).alias(f"p_{n}") for n, c in scores.items()])
