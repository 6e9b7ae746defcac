"""Average precision, calibration, thresholds, confusion and polygon reports.

Inputs are tall: one row per (row, class) with a truth value ``y`` and a ``score``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .ranking import exact_percentiles, null_safe_join, running_totals, with_scalars

POSITIVE = 0.4  # fixed value: metric positives are above this
BASE_TIERS = ["High", "Moderate", "Low"]  # fixed value: always reported


def tall_scores(df: DataFrame, classes: dict[str, tuple[str, str]], carry: list[str]) -> DataFrame:
    """One row per class from wide truth/score columns, without a self-join."""
    items = F.array(*[F.struct(F.lit(c).alias("class"), F.col(y).cast("double").alias("y"), F.col(s).cast("double").alias("score"))
                      for c, (y, s) in classes.items()])
    return df.select(*carry, F.explode(items).alias("__x")).select(*carry, "__x.class", "__x.y", "__x.score")


def average_precision(df: DataFrame, keys: list[str]) -> DataFrame:
    """Step-sum average precision per key; keys without positives give 0.

    Ties share a step. Counts per distinct score come first, so the running totals
    run over distinct scores, no class is gathered in one task and the rows are read once.
    """
    pos = F.col("y") > POSITIVE
    steps = df.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("__n"), F.count_if(pos).alias("__p"))
    run = running_totals(steps, keys, ["score"], {"__cn": F.col("__n"), "__cp": F.col("__p")}, descending=True)
    sums = run.groupBy(*keys).agg(F.sum(F.col("__p") * F.col("__cp") / F.col("__cn")).alias("__gain"), F.max("__cp").alias("n_pos"), F.max("__cn").alias("n"))
    return sums.select(*keys, F.when(F.col("n_pos") > 0, F.col("__gain") / F.col("n_pos")).otherwise(0.0).alias("ap"), "n_pos", "n")


def mean_ap(ap: DataFrame, by: list[str], exclude: list[str] = ()) -> DataFrame:
    """Mean over classes with positives, minus the excluded ones; 0 when none is left."""
    counted = F.when((F.col("n_pos") > 0) & ~F.col("class").isin(list(exclude)), F.col("ap"))
    return ap.groupBy(*by).agg(F.coalesce(F.avg(counted), F.lit(0.0)).alias("map"))


def ap_by_tier(df: DataFrame) -> DataFrame:
    """mAP per tier: the base tiers always appear, NULL when absent; other tiers as found."""
    per = mean_ap(average_precision(df, ["tier", "class"]), ["tier"])
    base = df.sparkSession.createDataFrame([(t,) for t in BASE_TIERS], "tier string")
    return base.join(per, "tier", "left").unionByName(per.join(base, "tier", "left_anti"))


def brier(df: DataFrame, keys: list[str]) -> DataFrame:
    hit = F.when(F.col("y") > POSITIVE, 1.0).otherwise(0.0)
    return df.groupBy(*keys).agg(F.avg(F.pow(F.col("score") - hit, 2)).alias("brier"))


def equal_bin(score: Column, n: int) -> Column:
    """0-based bin among ``n`` equal-width bins of [0, 1], the last one closed."""
    edges = [i * (1.0 / n) for i in range(1, n)]
    return reduce(lambda a, b: a + b, [F.when(score >= F.lit(e), 1).otherwise(0) for e in edges])


def reliability(df: DataFrame, keys: list[str], n_bins: int = 10) -> DataFrame:
    """Mean score, positive rate and count per bin; empty bins are kept with NULL means."""
    hit = F.when(F.col("y") > POSITIVE, 1.0).otherwise(0.0)
    per = (df.withColumn("bin", equal_bin(F.col("score"), n_bins)).groupBy(*keys, "bin")
           .agg(F.avg("score").alias("predicted_mean"), F.avg(hit).alias("empirical_rate"), F.count(F.lit(1)).alias("n")))
    every = per.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return (every.join(per, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
            .withColumn("bin_center", (F.col("bin") + 0.5) / float(n_bins)))


def calibration_error(df: DataFrame, keys: list[str], n_bins: int = 15) -> DataFrame:
    bins = reliability(df, keys, n_bins)
    gap = F.col("n") * F.abs(F.col("predicted_mean") - F.col("empirical_rate"))
    return bins.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def class_percentiles(df: DataFrame, probs: dict[str, float], exact: bool = True) -> DataFrame:
    """Pooled percentiles per class; the approximate form needs no sort."""
    if exact:
        return exact_percentiles(df, ["class"], "score", probs)
    names = list(probs)
    out = df.groupBy("class").agg(F.count("score").alias("n"), F.percentile_approx("score", [probs[n] for n in names], 10000).alias("p"))
    return out.select("class", "n", *[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def otsu_split(df: DataFrame, keys: list[str], value: str, n_bins: int = 256) -> DataFrame:
    """Histogram threshold with the largest between-class variance per key.

    Only bin counts (``n_bins`` per key) reach the window. The bounds of the keys are written first, so their true size
    decides how rows meet them. ``any_above`` tells whether a value passes the threshold.
    """
    span = cut_lineage(df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")))
    width = (F.col("__hi") - F.col("__lo")) / float(n_bins)
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("__lo")) / width), F.lit(n_bins - 1))).otherwise(F.lit(0))
    hist = null_safe_join(df.select(*keys, value), span, keys).withColumn("__b", at).groupBy(*keys, "__b", "__lo", "__hi").agg(F.count(F.lit(1)).alias("c"))
    h = hist.withColumn("m", F.col("__lo") + width * (F.col("__b") + 0.5))
    up = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    w1, s1 = F.sum("c").over(up), F.sum(F.col("c") * F.col("m")).over(up)
    w, s = F.sum("c").over(whole), F.sum(F.col("c") * F.col("m")).over(whole)
    mean_gap = s1 / w1 - (s - s1) / (w - w1)
    var = F.when(w > w1, w1 * (w - w1) * mean_gap * mean_gap).otherwise(-1.0)
    scored = h.select(*keys, "m", var.alias("v"), "__b")
    best = scored.groupBy(*keys).agg(F.max_by("m", F.struct(F.col("v"), -F.col("__b"))).alias("otsu"))
    return null_safe_join(best, span, keys).select(*keys, "otsu", (F.col("__hi") > F.col("otsu")).alias("any_above"))


def otsu_tiers(df: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Percentiles of the values above the Otsu threshold (of all values when none is above)."""
    cut = cut_lineage(otsu_split(df, ["class"], "score"))
    signal = df.select("class", "score").join(cut, "class").where((F.col("score") > F.col("otsu")) | ~F.col("any_above")).select("class", "score")
    return exact_percentiles(signal, ["class"], "score", probs).withColumnRenamed("n", "n_signal").join(cut.drop("any_above"), "class")


def decile_rates(df: DataFrame, covariate: str, detected: Column, n: int = 10) -> DataFrame:
    """Detection rate by equal-population bin of a covariate; edges, not ranks, so ties stay together."""
    rows = df.where(F.col(covariate).isNotNull()).select(F.col(covariate).cast("double").alias("__x"), detected.alias("__d"))
    edges = exact_percentiles(rows, [], "__x", {f"e{i}": i / n for i in range(n + 1)}).drop("n")
    bound = with_scalars(rows, edges)
    at = reduce(lambda a, b: a + b, [F.when(F.col("__x") >= F.col(f"e{i}"), 1).otherwise(0) for i in range(1, n)])
    per = bound.groupBy((at + 1).alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("__d"), 1.0).otherwise(0.0)).alias("rate"))
    tall = edges.select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("decile"), F.col(f"e{i}").alias("lo"), F.col(f"e{i + 1}").alias("hi")) for i in range(n)])).alias("r")).select("r.*")
    return tall.join(per, "decile", "left").select("decile", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("rate", F.lit(0.0)).alias("rate"))


def confusion(df: DataFrame, truth: str, predicted: str, vocab: list[str], share: bool = False) -> DataFrame:
    """Counts per true class, one column per predicted class, optionally row-normalised."""
    out = df.groupBy(truth).pivot(predicted, vocab).count().na.fill(0)
    if not share:
        return out
    total = reduce(lambda a, b: a + b, [F.col(v) for v in vocab])
    return out.select(truth, *[(F.col(v) / total).alias(v) for v in vocab])


def argmax_name(values: Column, vocab: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in vocab]), F.array_position(values, F.array_max(values)).cast("int"))


def soft_confusion(df: DataFrame, truth: str, scores: str, vocab: list[str], min_label: float) -> DataFrame:
    """(true, predicted) argmax pairs, rows whose best soft label is under the limit left out."""
    kept = df.where(F.array_max(truth) >= min_label)
    return kept.select(argmax_name(F.col(truth), vocab).alias("true"), argmax_name(F.col(scores), vocab).alias("predicted"))


def steady_mean(x: Column) -> Column:
    """Mean that does not depend on the order of rows; the plain one where a value is no finite decimal."""
    exact = x.try_cast("decimal(26,12)")
    return F.when(F.count(exact) == F.count(x), F.sum(exact).cast("double") / F.nullif(F.count(x), F.lit(0))).otherwise(F.avg(x))


def polygon_report(polygons: DataFrame, scores: DataFrame, key: str, vocab: list[str], probs: str, minerals: str,
                   order: list[str] | None = None) -> DataFrame:
    """Mean scores per polygon, its argmax and whether it hits any named mineral.

    Means come from sums in decimals of 12 places, so classes with equal means tie in whatever order rows are added, and
    the first of ``vocab`` wins. With ``order`` (columns that number the rows) the rounding of doubles added in that order
    decides such ties, as in a plain sum over the table; only rows of tied polygons are sorted. Polygons without scored
    pixels stay, with no prediction.
    """
    mean = scores.groupBy(key).agg(F.array(*[steady_mean(F.col(probs)[i]) for i in range(len(vocab))]).alias("__m"), F.count(F.lit(1)).alias("n_pixels"))
    if order:
        mean = cut_lineage(mean)
        tied = cut_lineage(mean.where(F.size(F.filter("__m", lambda m: m == F.array_max("__m"))) > 1).select(key))
        rows = scores.join(tied, key, "left_semi").repartition(key).sortWithinPartitions(key, *order)
        added = rows.groupBy(key).agg(F.array(*[F.avg(F.col(probs)[i]) for i in range(len(vocab))]).alias("__added"))
        mean = mean.join(added, key, "left").withColumn("__m", F.coalesce("__added", "__m"))
    joined = polygons.join(mean, key, "left")
    predicted = F.when(F.col("__m").isNotNull(), argmax_name(F.col("__m"), vocab))
    return joined.select(*polygons.columns, F.coalesce("n_pixels", F.lit(0)).alias("n_pixels"), F.coalesce(predicted, F.lit("NONE")).alias("predicted_class"),
                         F.when(predicted.isNotNull(), F.array_contains(minerals, predicted)).alias("correct"))


def ensemble(df: DataFrame, row: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """Mean score of the members per row and class."""
    return df.groupBy(*row).agg(F.avg(score).alias("score"), F.max(y).alias("y"))


def compare_runs(ap: DataFrame, runs: list[str]) -> DataFrame:
    """One row per class, one column per run."""
    return ap.groupBy("class").pivot("run", runs).agg(F.first("ap"))
