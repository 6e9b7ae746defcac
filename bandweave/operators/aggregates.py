"""Means, counts and summary tables over pixels, polygons and tiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import masks as M, spectral as S
from ..functions.geo import pixel_lat, pixel_lon
from .ranking import exact_percentiles, null_safe_join, with_scalars


def known(x: Column) -> Column:
    """NaN as NULL, so averages skip it."""
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def mean_spectrum(spectrum: str, n: int) -> Column:
    """Element-wise mean; one generated aggregate per band, no row explosion."""
    return F.array(*[F.avg(known(F.col(spectrum)[i])) for i in range(n)])


def spread_spectrum(spectrum: str, n: int) -> Column:
    return F.array(*[F.stddev_pop(known(F.col(spectrum)[i])) for i in range(n)])


def polygon_means(df: DataFrame, keys: list[str], n: int, spectrum: str = "spectrum", weight: str | None = None) -> DataFrame:
    """One mean spectrum per key with its pixel count (and mean weight)."""
    extra = [F.avg(weight).alias(weight)] if weight else []
    return df.groupBy(*keys).agg(mean_spectrum(spectrum, n).alias(spectrum), F.count(F.lit(1)).alias("n_px"), *extra)


def target_means(df: DataFrame, keys: list[str], n: int, label: str, spectrum: str = "spectrum") -> DataFrame:
    """Mean spectrum and whether any pixel carries the target label."""
    return df.groupBy(*keys).agg(mean_spectrum(spectrum, n).alias(spectrum), (F.max(label) > 0).alias("target"))


def centroids(df: DataFrame, centers: DataFrame, keys: list[str]) -> DataFrame:
    """Mean pixel and geographic centroid per polygon; an unknown tile fails the job."""
    mean = df.groupBy(*keys).agg(F.avg("pixel_row").alias("mean_row"), F.avg("pixel_col").alias("mean_col"))
    return with_center(mean, centers).select(
        *keys, "mean_row", "mean_col", pixel_lat("center_lat", "mean_row").alias("lat"),
        pixel_lon("center_lon", "mean_col").alias("lon"))


def with_center(df: DataFrame, centers: DataFrame) -> DataFrame:
    named = centers.select("tile_id", F.col("lat").alias("center_lat"), F.col("lon").alias("center_lon"))
    joined = df.join(named, "tile_id", "left")
    found = F.assert_true(F.col("center_lat").isNotNull(), F.concat(F.lit("unknown tile "), F.col("tile_id")))
    return joined.where(found.isNull())


def endmember_library(df: DataFrame, classes: dict[str, Column], n: int, fallback: str, spectrum: str = "spectrum") -> DataFrame:
    """(class, spectrum) means by condition; a class whose mean is unusable takes the fallback's."""
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in classes.items()]))
    means = df.withColumn("class", F.explode(tags)).groupBy("class").agg(mean_spectrum(spectrum, n).alias(spectrum))
    backup = means.where(F.col("class") == fallback).select(F.col(spectrum)).scalar()
    usable = F.coalesce(M.rows_bounded(F.col(spectrum)) & (F.array_max(spectrum) > 0), F.lit(False))
    return means.select("class", F.when(usable, F.col(spectrum)).otherwise(backup).alias(spectrum))


def prototypes(df: DataFrame, by: str, embedding: str, n: int) -> DataFrame:
    """Normalise, average, normalise; a class with a vanishing mean fails the job."""
    mean = (df.withColumn("__u", S.unit(embedding)).groupBy(by)
            .agg(mean_spectrum("__u", n).alias("__m"), F.count(F.lit(1)).alias("n_pixels")))
    ok = F.assert_true(S.norm("__m") >= 1e-8, F.concat(F.lit("degenerate prototype "), F.col(by).cast("string")))
    return mean.where(ok.isNull()).select(by, S.unit("__m").alias("prototype"), "n_pixels")


def positive_counts(df: DataFrame, labels: list[str], by: str, values: list[str], above: float = 0.5) -> DataFrame:
    """Rows per class, positives per ``by`` value as columns."""
    per = df.groupBy(by).agg(*[F.count_if(F.col(c) > above).alias(c) for c in labels])
    tall = per.select(by, F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in labels]), F.array(*labels))).alias("class", "n"))
    return tall.groupBy("class").pivot(by, values).agg(F.sum("n")).na.fill(0)


def fractions(counts: DataFrame, values: list[str]) -> DataFrame:
    """Row shares of a count table; an empty class has share 0 everywhere."""
    total = reduce(lambda a, b: a + b, [F.col(v) for v in values])
    return counts.select("class", *[F.when(total > 0, F.col(v) / total).otherwise(0.0).alias(v) for v in values])


def tile_positive_counts(df: DataFrame, labels: list[str], above: float = 0.4) -> DataFrame:
    return df.groupBy("tile_id").agg(*[F.count_if(F.col(c) > above).alias(c) for c in labels])


def count_table(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    return df.groupBy(rows).pivot(columns, values).count().na.fill(0)


def allocation_table(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts per cell with totals both ways (``TOTAL`` rows and columns)."""
    cube = df.cube(rows, columns).agg(F.count(F.lit(1)).alias("n"), F.grouping(rows).alias("gr"), F.grouping(columns).alias("gc"))
    name = lambda c, g: F.when(F.col(g) == 1, "TOTAL").otherwise(F.col(c).cast("string"))
    return cube.select(name(rows, "gr").alias(rows), name(columns, "gc").alias(columns), "n")


def accuracy(df: DataFrame, by: str, correct: str, total: str | None = None) -> DataFrame:
    """Accuracy per value, with an overall row when ``total`` names it."""
    grouped = df.rollup(by) if total else df.groupBy(by)
    extra = [F.grouping(by).alias("__g")] if total else [F.lit(0).alias("__g")]
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(correct)).alias("n_correct"), *extra)
    label = F.when(F.col("__g") == 1, F.lit(total)).otherwise(F.col(by))
    return out.select(label.alias(by), "n", "n_correct", (F.col("n_correct") / F.col("n")).alias("accuracy"))


def audit_summary(df: DataFrame, spectrum: str, by: list[str]) -> DataFrame:
    """Counts of every defect check; any failing check marks a row bad."""
    flags = M.audit_flags(spectrum)
    marked = df.select(*by, *[c.alias(n) for n, c in flags.items()])
    bad = reduce(lambda a, b: a | b, [F.col(n) for n in M.AUDIT_FAIL])
    return marked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad"),
                                   *[F.count_if(F.col(n)).alias(n) for n in flags])


def worst_tile_gate(rates: DataFrame, threshold: float) -> DataFrame:
    """One row: the tile with the largest share of bad rows, that share, and whether it is within the threshold."""
    share = rates.withColumn("share", F.col("n_bad") / F.col("n_rows"))
    worst = share.agg(F.max_by(F.struct("tile_id", "share"), F.struct("share", "tile_id")).alias("w"))
    return worst.select("w.tile_id", "w.share", (F.col("w.share") <= threshold).alias("passed"))


def contamination(df: DataFrame, spectrum: str) -> DataFrame:
    """Per tile: pixels valid before the physical-range rule, of those dropped by it, share and maximum."""
    s = F.col(spectrum)
    before = ~F.exists(s, lambda x: x.isNull() | (x == 65535.0) | F.isnan(x))
    over = F.exists(s, lambda x: ~F.isnan(x) & (x > 1.0))
    top = F.array_max(F.filter(s, lambda x: ~F.isnan(x) & (x != 65535.0)))
    out = df.select("tile_id", before.alias("b"), (before & over).alias("o"), F.when(before, top).alias("t"))
    out = out.groupBy("tile_id").agg(F.count_if("b").alias("n_before"), F.count_if("o").alias("n_dropped"), F.max("t").alias("max_value"))
    return out.withColumn("percent", F.when(F.col("n_before") > 0, F.col("n_dropped") * 100.0 / F.col("n_before")).otherwise(0.0))


def normalisation_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean, deviation, minimum, maximum of the rows where all columns are present."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    v = lambda c: F.when(whole, F.col(c))
    return df.agg(*[f(v(c)).alias(f"{c}_{n}") for c in columns for n, f in
                    (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


def normalise(df: DataFrame, columns: list[str], mode: str, stats: DataFrame, min_valid: int = 1000) -> DataFrame:
    """'zscore', 'minmax' or 'pertile_zscore' (tiles with few valid rows use the global values); NULL becomes 0."""
    if mode not in ("zscore", "minmax", "pertile_zscore"):
        raise ValueError(f"unknown mode {mode!r}")
    named = stats.select(*[F.col(c).alias(f"__{c}") for c in stats.columns])
    out = with_scalars(df, named)
    if mode == "pertile_zscore":
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        tile = df.groupBy("tile_id").agg(F.count_if(whole).alias("__n"), *[
            f(F.when(whole, F.col(c))).alias(f"__t_{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
        out = null_safe_join(out, tile, ["tile_id"])
    new = {}
    for c in columns:
        mean, std = F.col(f"__{c}_mean"), F.col(f"__{c}_std") + 1e-8
        if mode == "pertile_zscore":
            enough = F.col("__n") >= min_valid
            mean = F.when(enough, F.col(f"__t_{c}_mean")).otherwise(mean)
            std = F.when(enough, F.col(f"__t_{c}_std") + 1e-8).otherwise(std)
        if mode == "minmax":
            low, span = F.col(f"__{c}_min"), F.col(f"__{c}_max") - F.col(f"__{c}_min")
            span = F.when(span < 1e-8, 1.0).otherwise(span)
            value = F.least(F.greatest((F.col(c) - low) / span, F.lit(0.0)), F.lit(1.0))
            value = F.when(F.col(c).isNotNull(), value)
        else:
            value = (F.col(c) - mean) / std
        new[c] = F.coalesce(value, F.lit(0.0))
    return out.withColumns(new).select(*df.columns)


def majority(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value, the smallest on a tie."""
    return df.groupBy(column).count().orderBy(F.desc("count"), F.asc(column)).limit(1).select(column)


def bland_confidence(df: DataFrame, bland: str) -> DataFrame:
    """Tier most bland rows carry, then the most frequent weight within that tier."""
    rows = df.where(F.col(bland) > 0)
    tier = majority(rows.where(F.col("confidence_tier").isNotNull()), "confidence_tier")
    same = rows.join(tier, "confidence_tier", "left_semi").where(F.col("confidence_weight").isNotNull())
    weight = majority(same, "confidence_weight")
    return tier.withColumn("confidence_weight", F.coalesce(weight.scalar(), F.lit(1.0)))


def table_summary(df: DataFrame, spectrum: str, keys: list[str] | None = None) -> DataFrame:
    """Median, mean, range, share at or above 0.9 and non-finite count of all values."""
    keys = keys or []
    values = df.select(*keys, F.explode(spectrum).alias("v"))
    v = F.col("v").cast("double")
    ok = v.isNotNull() & ~F.isnan(v)
    stats = values.groupBy(*keys).agg(F.avg(F.when(ok, v)).alias("mean"), F.min(F.when(ok, v)).alias("low"), F.max(F.when(ok, v)).alias("high"),
                                      (F.count_if(ok & (v >= 0.9)) / F.count_if(ok)).alias("share_high"), F.count_if(~ok).alias("n_nonfinite"))
    med = exact_percentiles(values, keys, "v", {"p50": 0.5}).drop("n")
    return null_safe_join(stats, med, keys)


def block_scales(df: DataFrame, blocks: dict[str, str], keep: list[int]) -> DataFrame:
    """Standard deviation and mean of all good-band values per block."""
    out = []
    for name, column in blocks.items():
        vals = df.select(F.explode(S.take_bands(column, keep)).alias("v"))
        out.append(vals.agg(F.lit(name).alias("block"), F.stddev_pop("v").alias("std"), F.avg("v").alias("mean")))
    return reduce(lambda a, b: a.unionByName(b), out)


def representation(df: DataFrame, spectrum: str, width: int, single: int = 59) -> DataFrame:
    """'dual' for twice the ``single`` width, 'raw' or 'hull' by the median level for it; other widths are refused."""
    if width == 2 * single:
        return df.sparkSession.range(1).select(F.lit("dual").alias("representation"))
    if width != single:
        raise ValueError(f"expected {single} or {2 * single} values, got {width}")
    values = df.select(F.explode(spectrum).alias("v"))
    med = exact_percentiles(values, [], "v", {"p50": 0.5})
    return med.select(F.when(F.col("p50") <= S.RAW_LEVEL_MAX, "raw").otherwise("hull").alias("representation"))


def imbalance_weights(df: DataFrame, labels: list[str], above: float = 0.4) -> DataFrame:
    """Row weight: the largest negatives-to-positives ratio among its positive classes, else 1."""
    totals = df.agg(F.count(F.lit(1)).alias("__n"), *[F.greatest(F.count_if(F.col(c) > above), F.lit(1)).alias(f"__{c}") for c in labels])
    ratio = [F.when(F.col(c) > above, (F.col("__n") - F.col(f"__{c}")) / F.col(f"__{c}")) for c in labels]
    return with_scalars(df, totals).withColumn("sample_weight", F.coalesce(F.greatest(*ratio), F.lit(1.0))).select(*df.columns, "sample_weight")


def split_leaks(df: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """Pixels whose rows span more than one split."""
    g = df.groupBy(*keys).agg(F.min(split).alias("__a"), F.max(split).alias("__b"), F.collect_set(split).alias("splits"))
    return g.where(F.col("__a") != F.col("__b")).select(*keys, F.array_sort("splits").alias("splits"))


def assert_no_leaks(df: DataFrame, keys: list[str]) -> None:
    rows = split_leaks(df, keys).limit(10).collect()
    if rows:
        raise AssertionError(f"pixels span several splits, e.g. {rows}")


def precision_ladder(df: DataFrame, score: str, y: str, thresholds: list[float], fires: str | None = None) -> DataFrame:
    """Precision among firing rows at or above each threshold; one pass for all thresholds."""
    on = F.col(fires) if fires else F.lit(True)
    aggs = []
    for i, t in enumerate(thresholds):
        hit = on & (F.col(score) >= F.lit(float(t)))
        aggs += [F.count_if(hit).alias(f"n{i}"), F.count_if(hit & (F.col(y) > 0)).alias(f"p{i}")]
    one = df.agg(*aggs)
    rung = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"p{i}").alias("p"))
                     for i, t in enumerate(thresholds)])
    out = one.select(F.explode(rung).alias("r")).select("r.*")
    return out.select("threshold", "n", F.when(F.col("n") > 0, F.bround(F.col("p") / F.col("n"), 4)).otherwise(0.0).alias("precision"))


def stripe_scores(df: DataFrame, value: str, edge: str, row: str, tile: str = "tile_id") -> DataFrame:
    """|correlation| with the edge mask and the share of variance held by row means."""
    rows = df.groupBy(tile, row).agg(F.avg(value).alias("__m"), F.count(F.lit(1)).alias("__n"))
    between = rows.groupBy(tile).agg(F.sum(F.col("__n") * F.col("__m")).alias("s"), F.sum(F.col("__n") * F.col("__m") * F.col("__m")).alias("q"), F.sum("__n").alias("n"))
    between = between.select(tile, (F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)).alias("__row_var"))
    total = df.groupBy(tile).agg(F.abs(F.corr(value, F.when(F.col(edge), 1.0).otherwise(0.0))).alias("edge_corr"), F.var_pop(value).alias("__var"))
    return total.join(between, tile).select(tile, F.coalesce("edge_corr", F.lit(0.0)).alias("edge_corr"),
                                            (F.col("__row_var") / (F.col("__var") + 1e-9)).alias("stripe_share"))


def shape_ratio(class_means: DataFrame, n: int, spectrum: str = "spectrum", neutral: str | None = None) -> DataFrame:
    """Each class mean over the grand mean (or the neutral class), and its mean-normalised shape."""
    base = class_means.where(F.col("class") == neutral) if neutral else class_means
    joined = with_scalars(class_means, base.agg(mean_spectrum(spectrum, n).alias("__ref")))
    ratio = F.zip_with(spectrum, "__ref", lambda a, b: F.when(b != 0, a / b))
    level = S.mean_at(spectrum, range(n))
    return joined.select("class", ratio.alias("ratio"), F.transform(spectrum, lambda x: x / level).alias("shape"))
