"""Neighbourhood, patch and region operators on grid tables.

A grid table holds every pixel of a tile, invalid ones included. Square windows run
as two one-dimensional range windows, along rows and then along columns, so the work
is split by (tile, row) and (tile, column) and a huge tile still spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .graph import connected_components
from .ranking import exact_percentiles, with_scalars

T, R, C = "tile_id", "pixel_row", "pixel_col"
BLOCK, PATCHES_A_BATCH = 64, 256


def _along_row(lo=None, hi=None):
    w = Window.partitionBy(T, R).orderBy(C)
    return w if lo is None else w.rangeBetween(lo, hi)


def _along_col(lo=None, hi=None):
    w = Window.partitionBy(T, C).orderBy(R)
    return w if lo is None else w.rangeBetween(lo, hi)


def box_sums(df: DataFrame, columns: dict[str, Column], size: int) -> DataFrame:
    """Sums over a size x size window clipped at the tile border."""
    h = size // 2
    first = df.withColumns({f"__{n}": c for n, c in columns.items()})
    rows = first.withColumns({f"__{n}": F.sum(f"__{n}").over(_along_row(-h, h)) for n in columns})
    out = rows.withColumns({n: F.sum(f"__{n}").over(_along_col(-h, h)) for n in columns})
    return out.drop(*[f"__{n}" for n in columns])


def mean_pool(df: DataFrame, value: str, name: str, size: int = 7, nodata: float = 65535.0) -> DataFrame:
    """Window mean over the valid pixels; NULL when none is valid, outside counts nothing."""
    v = F.col(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (v != nodata)
    s = box_sums(df, {"__sum": F.when(ok, v).otherwise(0.0), "__cnt": F.when(ok, 1).otherwise(0)}, size)
    return s.withColumn(name, F.when(F.col("__cnt") > 0, F.col("__sum") / F.col("__cnt"))).drop("__sum", "__cnt")


def pooled_at(rows: DataFrame, grid: DataFrame, value: str, name: str, low: float, high: float, size: int = 7) -> DataFrame:
    """Window mean at each row's pixel, NULL for synthetic rows, unknown pixels and means out of [low, high].

    Values out of range are missing before the mean is taken, so they do not touch their neighbours.
    """
    v = F.col(value).cast("double")
    pooled = mean_pool(grid.select(T, R, C, F.when(v.between(low, high), v).alias("__v")), "__v", name, size)
    known = pooled.select(T, R, C, F.when(F.col(name).between(low, high), F.col(name)).alias(name))
    return rows.join(known.where(~F.col(T).startswith("SYNTH_")), [T, R, C], "left")


def smooth_mean(df: DataFrame, value: str, name: str, size: int = 7) -> DataFrame:
    """Window mean over known pixels with the border pixel repeated outwards."""
    h = size // 2
    v = F.col(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v)

    def spread(d, along, pos):
        whole = along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        new = {}
        for c in ("__sum", "__cnt"):
            first, last = F.first(c).over(whole), F.last(c).over(whole)
            before = F.greatest(F.lit(h) - (F.col(pos) - F.first(pos).over(whole)), F.lit(0))
            after = F.greatest(F.lit(h) - (F.last(pos).over(whole) - F.col(pos)), F.lit(0))
            new[f"{c}2"] = F.sum(c).over(along(-h, h)) + before * first + after * last
        return d.withColumns(new).drop("__sum", "__cnt").withColumnsRenamed({"__sum2": "__sum", "__cnt2": "__cnt"})

    start = df.withColumns({"__sum": F.when(ok, v).otherwise(0.0), "__cnt": F.when(ok, 1.0).otherwise(0.0)})
    out = spread(spread(start, _along_row, C), _along_col, R)
    return out.withColumn(name, F.when(F.col("__cnt") > 0, F.col("__sum") / F.col("__cnt"))).drop("__sum", "__cnt")


def median3(df: DataFrame, value: str, iterations: int = 1) -> DataFrame:
    """3 x 3 median with mirrored borders, repeated."""
    for _ in range(iterations):
        v, row, col = F.col(value), _along_row(), _along_col()
        three = df.withColumn("__t", F.array(F.coalesce(F.lag(v).over(row), v), v, F.coalesce(F.lead(v).over(row), v)))
        t = F.col("__t")
        nine = F.concat(F.coalesce(F.lag(t).over(col), t), t, F.coalesce(F.lead(t).over(col), t))
        df = three.withColumn("__n", nine).withColumn(value, F.array_sort("__n")[4]).drop("__t", "__n")
    return df


def with_extent(df: DataFrame) -> DataFrame:
    """Height and width of each tile (aggregated on the map side, joined back)."""
    size = df.groupBy(T).agg((F.max(R) + 1).alias("height"), (F.max(C) + 1).alias("width"))
    return df.join(size, T)


def inside(size: int) -> Column:
    h = size // 2
    return ((F.col(R) >= h) & (F.col(R) < F.col("height") - h) & (F.col(C) >= h) & (F.col(C) < F.col("width") - h))


def patch_centres(df: DataFrame, valid: str, size: int = 7, min_share: float = 1.0, name: str = "centre") -> DataFrame:
    """Pixels whose whole window lies in the tile and holds enough valid pixels."""
    s = with_extent(box_sums(df, {"__ok": F.when(F.col(valid), 1).otherwise(0)}, size))
    return s.withColumn(name, inside(size) & (F.col("__ok") / float(size * size) >= min_share)).drop("__ok", "height", "width")


def edge_mask(df: DataFrame, valid: str, distance: int, name: str = "edge") -> DataFrame:
    """Valid pixels within ``distance`` steps (up, down, left, right) of an invalid one."""
    far = F.lit(1 << 30)
    gap = F.when(~F.col(valid), F.col(C))
    back, ahead = _along_row().rowsBetween(Window.unboundedPreceding, 0), _along_row().rowsBetween(0, Window.unboundedFollowing)
    d = F.least(F.coalesce(F.col(C) - F.max(gap).over(back), far), F.coalesce(F.min(gap).over(ahead) - F.col(C), far))
    rows = df.withColumn("__d", d)
    up, down = _along_col().rowsBetween(Window.unboundedPreceding, 0), _along_col().rowsBetween(0, Window.unboundedFollowing)
    steps = F.least(F.min(F.col("__d") - F.col(R)).over(up) + F.col(R), F.min(F.col("__d") + F.col(R)).over(down) - F.col(R))
    return rows.withColumn(name, F.col(valid) & (steps <= distance)).drop("__d")


def patches(centres: DataFrame, grid: DataFrame, spectrum: str, bands: int, size: int = 7, outside: float = 0.0) -> DataFrame:
    """size x size spectra around each centre in row-major order, ``outside`` beyond the tile.

    The grid is dealt in blocks of BLOCK x BLOCK cells with a rim of size // 2, so a spectrum travels once, or a few
    times near a border, and not once for every patch that shows it. Only blocks with centres are dealt. Each block
    becomes one array from which its patches are sliced. A null spectrum counts as ``outside``.
    """
    h = size // 2
    side = BLOCK + 2 * h
    block = [T, "__br", "__bc"]
    types = dict(grid.dtypes)

    def reach(at: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(at) - h) / BLOCK), F.floor((F.col(at) + h) / BLOCK)))

    key = centres.select(T, R, C, F.floor(F.col(R) / BLOCK).alias("__br"), F.floor(F.col(C) / BLOCK).alias("__bc"))
    cells = grid.select(T, R, C, F.col(spectrum).cast("array<double>").alias("__s")).select("*", reach(R).alias("__br")).select("*", reach(C).alias("__bc"))
    cells = cells.join(key.select(*block).distinct(), block, "left_semi")
    both = cells.withColumn("__centre", F.lit(False)).unionByName(key.withColumns({"__s": F.lit(None).cast("array<double>"), "__centre": F.lit(True)}))

    def cut(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, missing = np.full((side, side, bands), outside), np.zeros((side, side, bands), bool)
        top, left = (k.as_py() * BLOCK - h for k in keys[1:])
        wanted = []
        for batch in batches:
            is_centre = batch.column("__centre").to_numpy(zero_copy_only=False)
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (R, C)]) - [[top], [left]]
            wanted.append(place[:, is_centre])
            known = batch.column("__s").is_valid().to_numpy(zero_copy_only=False)
            flat = batch.column("__s").flatten()
            values[tuple(place[:, known])] = flat.to_numpy(zero_copy_only=False).reshape(-1, bands)
            missing[tuple(place[:, known])] = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, bands)
        row, col = np.concatenate(wanted, axis=1)
        shown, holes = (np.lib.stride_tricks.sliding_window_view(a, (size, size), axis=(0, 1)) for a in (values, missing))
        for start in range(0, len(row), PATCHES_A_BATCH):
            r, c = row[start:start + PATCHES_A_BATCH], col[start:start + PATCHES_A_BATCH]
            some, hole = (np.ascontiguousarray(a[r - h, c - h].transpose(0, 2, 3, 1)) for a in (shown, holes))
            spectra = pa.ListArray.from_arrays(pa.array(np.arange(0, some.size + 1, bands), pa.int32()), pa.array(some.ravel(), pa.float64(), mask=hole.ravel()))
            patch = pa.ListArray.from_arrays(pa.array(np.arange(0, len(spectra) + 1, size * size), pa.int32()), spectra)
            yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()] * len(r), keys[0].type), pa.array(r + top), pa.array(c + left), patch], names=[T, R, C, "patch"])

    out = both.groupBy(*block).applyInArrow(cut, f"{T} {types[T]}, {R} bigint, {C} bigint, patch array<array<double>>")
    return out.select(T, F.col(R).cast(types[R]).alias(R), F.col(C).cast(types[C]).alias(C), "patch")


def block_average(df: DataFrame, values: list[str], valid: str, factor: int) -> DataFrame:
    """Mean per full block, valid only when every pixel is; partial blocks are cropped."""
    out = df.groupBy(T, F.floor(F.col(R) / factor).alias("block_row"), F.floor(F.col(C) / factor).alias("block_col")).agg(
        *[F.avg(v).alias(v) for v in values], F.every(F.col(valid)).alias(valid), F.count(F.lit(1)).alias("__n"))
    return out.where(F.col("__n") == factor * factor).drop("__n")


# -------------------------------------------------------------------- regions

def runs(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of neighbouring columns per row: (keys, tile, row, c0, c1, n)."""
    part = [*keys, T, R]
    at = F.row_number().over(Window.partitionBy(*part).orderBy(C))
    return (mask.withColumn("__g", F.col(C) - at).groupBy(*part, "__g")
            .agg(F.min(C).alias("c0"), F.max(C).alias("c1"), F.count(F.lit(1)).alias("n")).drop("__g"))


def regions(mask: DataFrame, keys: list[str] | None = None, min_px: int = 1) -> tuple[DataFrame, DataFrame]:
    """4-connected regions of the mask rows, separately per ``keys``.

    Returns (regions, pixels): one row per region with its size and box, and the
    region of every mask pixel. Regions below ``min_px`` are dropped. Work is done
    on row runs, which are far fewer than pixels.
    """
    keys = keys or []
    parts = [*keys, T]
    r = runs(mask, keys)
    r = cut_lineage(r.withColumn("id", F.concat_ws("|", *[F.col(k).cast("string") for k in parts], F.format_string("%08d|%08d", R, "c0"))))
    below = r.select(*parts, (F.col(R) - 1).alias(R), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("id").alias("dst"))
    touch = (F.col("c0") <= F.col("d1")) & (F.col("d0") <= F.col("c1"))
    links = r.join(below, [*parts, R]).where(touch).select(F.col("id").alias("src"), "dst")
    comp = connected_components(r, links)
    named = r.join(comp, "id").withColumnRenamed("component", "region_id")
    table = named.groupBy("region_id", *parts).agg(F.sum("n").alias("count_px"), F.min(R).alias("row0"), F.max(R).alias("row1"),
                                                   F.min("c0").alias("col0"), F.max("c1").alias("col1")).where(F.col("count_px") >= min_px)
    kept = named.join(table.select("region_id"), "region_id", "left_semi")
    pixels = kept.select("region_id", *parts, R, F.explode(F.sequence("c0", "c1")).alias(C))
    return table, pixels


def zonal(pixels: DataFrame, grid: DataFrame, values: list[str], with_median: str | None = None) -> DataFrame:
    """Mean, deviation, minimum and maximum per region (and the exact median of one value)."""
    j = pixels.select("region_id", T, R, C).join(grid.select(T, R, C, *values), [T, R, C])
    out = j.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), *[f(v).alias(f"{v}_{s}") for v in values for s, f in
                                     (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])
    if with_median:
        med = exact_percentiles(j, ["region_id"], with_median, {f"{with_median}_median": 0.5}).drop("n")
        out = out.join(med, "region_id")
    return out


def region_spectra(pixels: DataFrame, grid: DataFrame, spectrum: str, bands: int) -> DataFrame:
    from .aggregates import polygon_means
    j = pixels.select("region_id", T, R, C).join(grid.select(T, R, C, spectrum), [T, R, C])
    return polygon_means(j, ["region_id"], bands, spectrum)


def at_thresholds(grid: DataFrame, scores: dict[str, str], thresholds: list[float]) -> DataFrame:
    """One mask row per (pixel, mineral, threshold) it passes."""
    tests = F.array(*[F.when(F.col(c) >= t, F.struct(F.lit(m).alias("mineral"), F.lit(float(t)).alias("threshold")))
                      for m, c in scores.items() for t in thresholds])
    return grid.select(T, R, C, F.explode(F.array_compact(tests)).alias("__k")).select(T, R, C, "__k.mineral", "__k.threshold")


def size_summary(regions_table: DataFrame, by: str, classes: list[str]) -> DataFrame:
    """Region count and median, 90th percentile and largest size per class; absent classes give 0."""
    pct = exact_percentiles(regions_table, [by], "count_px", {"median_size": 0.5, "p90_size": 0.9})
    top = regions_table.groupBy(by).agg(F.max("count_px").alias("max_size"))
    every = regions_table.sparkSession.createDataFrame([(c,) for c in classes], f"{by} string")
    out = every.join(pct.join(top, by), by, "left")
    return out.select(by, F.coalesce("n", F.lit(0)).alias("n_components"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("median_size", "p90_size", "max_size")])


def mosaic(df: DataFrame, x: str, y: str, order: str, values: list[str], origin: tuple[float, float], step: float) -> DataFrame:
    """First tile (by order) wins each target cell; combines on the map side."""
    cell = {"cell_col": F.floor((F.col(x) - origin[0]) / step), "cell_row": F.floor((F.lit(origin[1]) - F.col(y)) / step)}
    placed = df.withColumns(cell)
    return placed.groupBy("cell_row", "cell_col").agg(F.min_by(F.struct(*values), F.struct(order, R, C)).alias("v")).select("cell_row", "cell_col", "v.*")


def stretched_mosaic(df: DataFrame, x: str, y: str, order: str, channels: list[str], origin: tuple[float, float], step: float,
                     low: float = 0.02, high: float = 0.98, missing: float = 0.85) -> DataFrame:
    """Channels of the mosaic stretched to [0, 1] between the pooled percentiles of all its cells; ``missing`` where any channel is.

    Each channel takes the first tile (by order) whose value there is finite, so channels of a cell may come from
    different tiles. ``covered`` tells whether all are known.
    """
    cell = {"cell_col": F.floor((F.col(x) - origin[0]) / step), "cell_row": F.floor((F.lit(origin[1]) - F.col(y)) / step)}
    placed = df.withColumns(cell)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    first = lambda c: F.min(F.when(finite(c), F.struct(order, R, C, F.col(c).cast("double").alias("v"))))["v"]
    cells = cut_lineage(placed.groupBy("cell_row", "cell_col").agg(*[first(c).alias(c) for c in channels]))
    tall = cells.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in channels])).alias("t")).select("t.*")
    limits = exact_percentiles(tall, ["channel"], "v", {"lo": low, "hi": high})
    row = limits.agg(*[f(F.when(F.col("channel") == c, F.col(k))).alias(f"{k}_{c}") for c in channels for k, f in (("lo", F.max), ("hi", F.max))])
    out = with_scalars(cells, row)
    covered = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in channels])
    scaled = lambda c: F.least(F.greatest((F.col(c) - F.col(f"lo_{c}")) / F.greatest(F.lit(1e-6), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0)), F.lit(1.0))
    return out.select("cell_row", "cell_col", *[F.when(covered, scaled(c)).otherwise(F.lit(missing)).alias(c) for c in channels], covered.alias("covered"))


def class_colours(df: DataFrame, scores: dict[str, str], thresholds: dict[str, float], colours: dict[str, tuple[float, float, float]], valid: str) -> DataFrame:
    """``rgb`` of each pixel: the colours of all classes that reach their threshold, added and held to 1; white where a valid pixel
    reaches none, NULL where it is not valid. ``passed`` lists the classes."""
    hit = {c: F.coalesce(F.col(s) >= thresholds[c], F.lit(False)) & F.col(valid) for c, s in scores.items()}
    passed = F.array_compact(F.array(*[F.when(h, F.lit(c)) for c, h in hit.items()]))
    parts = [F.least(reduce(lambda a, b: a + b, [F.when(h, F.lit(float(colours[c][k]))).otherwise(0.0) for c, h in hit.items()]), F.lit(1.0)) for k in range(3)]
    held = df.withColumns({"passed": passed, "__rgb": F.array(*parts)})
    rgb = F.when(F.col(valid), F.when(F.size("passed") > 0, F.col("__rgb")).otherwise(F.array(*[F.lit(1.0)] * 3)))
    return held.withColumn("rgb", rgb).drop("__rgb")


def class_mosaic(df: DataFrame, x: str, y: str, order: str, origin: tuple[float, float], step: float, missing: float = 0.85) -> DataFrame:
    """``rgb`` (see ``class_colours``) of the first tile with a valid pixel in each cell; ``missing`` grey where none has."""
    cell = {"cell_col": F.floor((F.col(x) - origin[0]) / step), "cell_row": F.floor((F.lit(origin[1]) - F.col(y)) / step)}
    first = F.min(F.when(F.col("rgb").isNotNull(), F.struct(order, R, C, "rgb")))["rgb"]
    out = df.withColumns(cell).groupBy("cell_row", "cell_col").agg(first.alias("rgb"))
    return out.select("cell_row", "cell_col", F.coalesce("rgb", F.array(*[F.lit(missing)] * 3)).alias("rgb"), F.col("rgb").isNotNull().alias("covered"))


def colour_statistics(df: DataFrame, classes: list[str], valid: str) -> DataFrame:
    """Valid pixels, pixels of each class and pixels of none, per tile."""
    return df.groupBy(T).agg(F.count_if(F.col(valid)).alias("n_valid"), *[F.count_if(F.array_contains("passed", c)).alias(c) for c in classes],
                             F.count_if(F.col(valid) & (F.size("passed") == 0)).alias("unclassified"))


def scene_regions(grid: DataFrame, score: str, valid: str, spectrum: str, bands: int, mineral: str, thresholds: list[float], min_px: int, smoothing: int = 1) -> DataFrame:
    """4-connected regions of one mineral of a targeted scene at every threshold, on the median-smoothed score.

    Each has its pixels, mean smoothed score and mean spectrum; the grid must hold every pixel of its scenes.
    """
    smooth = cut_lineage(median3(grid.select(T, R, C, valid, F.col(score).alias("score"), spectrum), "score", smoothing))
    masks = at_thresholds(smooth.where(valid), {mineral: "score"}, thresholds)
    table, pixels = regions(masks, ["mineral", "threshold"], min_px)
    stats = zonal(pixels, smooth, ["score"]).select("region_id", F.col("score_mean").alias("mean_prob"))
    means = region_spectra(pixels, smooth, spectrum, bands).drop("n_px")
    return table.select("region_id", T, "mineral", "threshold", "count_px").join(stats, "region_id").join(means, "region_id")
