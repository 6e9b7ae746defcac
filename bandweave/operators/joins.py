"""Suppression, overrides, lookups, repairs and containment joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import polygon_pixels
from ..schema import PIXEL_KEY
from .sampling import keep_best

CELL_ROWS = 512  # rows of a cell that one group compares
BOX_ROWS = 1_024  # rows of equal boxes that travel together

def inherit_split(df: DataFrame, splits: DataFrame, keys: list[str]) -> DataFrame:
    """Split of the matching row, 'train' when there is none."""
    joined = df.drop("split").join(splits.select(*keys, "split"), keys, "left")
    return joined.withColumn("split", F.coalesce("split", F.lit("train")))


def typed_keys(df: DataFrame, keys=PIXEL_KEY) -> DataFrame:
    """Pixel keys in one type on both sides of a join."""
    return df.withColumns({k: F.col(k).cast("string" if k == "tile_id" else "bigint") for k in keys})


def suppress(df: DataFrame, touched: DataFrame, keys=PIXEL_KEY) -> DataFrame:
    """Drop every row whose pixel is touched by the other table."""
    return df.join(touched.select(*keys).distinct(), list(keys), "left_anti")


def supersede(df: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``newer`` replace all rows with the same key."""
    return suppress(df, newer, keys).unionByName(newer, allowMissingColumns=True)


def drop_listed(df: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(listed.select(*keys).distinct(), keys, "left_anti")


def stamp_sets(df: DataFrame, keys: list[str], pure: DataFrame, mixed: DataFrame, label: str, mode: str = "all") -> DataFrame:
    """Label 1 on rows of the pure set and, by mode, of the mixed set.

    Modes: 'all', 'pure_only', 'pure_train_only' (mixed rows count outside train).
    """
    if mode not in ("all", "pure_only", "pure_train_only"):
        raise ValueError(f"unknown mode {mode!r}")
    kinds = pure.select(*keys, F.lit(1).alias("__kind")).unionByName(mixed.select(*keys, F.lit(2).alias("__kind")))
    kinds = kinds.groupBy(*keys).agg(F.min("__kind").alias("__kind"))
    joined = df.join(kinds, keys, "left")
    hit = F.col("__kind") == 1
    if mode == "all":
        hit = hit | (F.col("__kind") == 2)
    elif mode == "pure_train_only":
        hit = hit | ((F.col("__kind") == 2) & (F.col("split") != "train"))
    return joined.withColumn(label, F.when(hit, 1.0).otherwise(0.0)).drop("__kind")


def override_labels(df: DataFrame, relabels: DataFrame, targets: list[str], order: str) -> DataFrame:
    """Soft targets by (lower tile, polygon text); the last row per key wins per target."""
    latest = relabels.groupBy(F.lower("tile").alias("__t"), F.col("polygon").cast("string").alias("__p")).agg(
        *[F.max_by(t, F.when(F.col(t).isNotNull(), F.col(order))).alias(f"__{t}") for t in targets])
    on = (F.lower(df["tile_id"]) == F.col("__t")) & (df["polygon_id"].cast("string") == F.col("__p"))
    joined = df.join(latest, on, "left")
    changed = reduce(lambda a, b: a | b, [F.col(f"__{t}").isNotNull() for t in targets])
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in targets else F.col(c) for c in df.columns],
                         F.coalesce(changed, F.lit(False)).alias("relabelled"))


def lookup_at(df: DataFrame, grid: DataFrame, columns: list[str], keys=PIXEL_KEY) -> DataFrame:
    """Grid columns at each row's pixel, NULL out of bounds; the row count is kept."""
    one = grid.select(*keys, *columns)
    return df.join(one, list(keys), "left")


def repair(df: DataFrame, source: DataFrame, tiles: DataFrame, value: str, usable: Column) -> DataFrame:
    """Replace ``value`` on listed tiles by the source value when it is usable.

    Adds ``repair``: changed / same / nodata / out_of_bounds / kept.
    """
    listed = tiles.select("tile_id").distinct().withColumn("__listed", F.lit(True))
    src = source.select(*PIXEL_KEY, F.col(value).alias("__new"), usable.alias("__ok"))
    joined = df.join(listed, "tile_id", "left").join(src, list(PIXEL_KEY), "left")
    state = (F.when(F.col("__listed").isNull(), "kept").when(F.col("__ok").isNull(), "out_of_bounds")
             .when(~F.col("__ok"), "nodata").when(F.col("__new") == F.col(value), "same").otherwise("changed"))
    new = F.when(F.col("__listed") & F.col("__ok"), F.col("__new")).otherwise(F.col(value))
    return joined.withColumns({"repair": state, value: new}).drop("__listed", "__new", "__ok")


def stale_tiles(sample: DataFrame, source: DataFrame, spectrum: str, tolerance: float = 1e-4) -> DataFrame:
    """Per tile: sampled rows, rows that differ from the source, rows that cannot be checked."""
    src = source.select(*PIXEL_KEY, F.col(spectrum).alias("__src"))
    known = source.select("tile_id").distinct().withColumn("__tile", F.lit(True))
    joined = sample.join(src, list(PIXEL_KEY), "left").join(known, "tile_id", "left")
    off = F.exists(F.zip_with(spectrum, "__src", lambda a, b: F.abs(a - b) > tolerance + 1e-5 * F.abs(b)), lambda x: x)
    return joined.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("n_sampled"),
        F.count_if(F.col("__src").isNotNull()).alias("n_checked"),
        F.count_if(F.col("__src").isNotNull() & off).alias("n_mismatched"),
        F.count_if(F.col("__tile").isNull()).alias("n_unverifiable"))


def reattach(selected: DataFrame, source: DataFrame, key: list[str], check: list[str]) -> DataFrame:
    """Attach attributes by a stable key and fail when the checked columns drifted."""
    src = source.select(*key, *[F.col(c).alias(f"__{c}") for c in check], *[c for c in source.columns if c not in key + check])
    joined = selected.join(src, key, "left")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in check])
    checked = F.assert_true(same, F.lit("source rows drifted from the selection"))
    return joined.where(checked.isNull()).drop(*[f"__{c}" for c in check])


def polygon_pixel_join(polygons: DataFrame, grid: DataFrame) -> DataFrame:
    """One row per (polygon, pixel) with the grid's columns.

    The planner knows the size of the polygons' files, not how many pixels they become, and would broadcast them all.
    """
    return polygon_pixels(polygons).hint("merge").join(grid, list(PIXEL_KEY))


def met_in_cells(left: DataFrame, right: DataFrame, cells: list[str], spread: list[str]) -> DataFrame:
    """Inner join on ``cells``, whose left rows are dealt by ``spread`` into chunks of about CELL_ROWS, each a group of its own.

    The tasks are given by number, because few bytes make many pairs.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = left.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("__chunks"))
    dealt = left.join(chunks, cells).withColumn("__chunk", F.pmod(F.xxhash64(*spread), "__chunks")).drop("__chunks")
    copied = right.join(chunks, cells).withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__chunks") - 1))).drop("__chunks")
    keys = [*cells, "__chunk"]
    return dealt.repartition(tasks, *keys).join(copied.repartition(tasks, *keys).hint("merge"), keys).drop("__chunk")


def box_overlap(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs whose boxes (x0, y0, x1, y1) overlap, through shared grid buckets.

    A pair is reported in the one bucket that holds the lower corner of its
    intersection, so pairs sharing several buckets come once. Equal boxes are compared once and carry their rows along,
    at most about BOX_ROWS of them, so the comparisons follow the different boxes and the rest is the output itself.
    """
    corners = ("x0", "y0", "x1", "y1")

    def cells(df, p):
        box = [f"{p}{c}" for c in corners]
        rest = [c for c in df.columns if c not in box] or box[:1]
        chunks = df.groupBy(*box).agg(F.ceil(F.count(F.lit(1)) / BOX_ROWS).alias("__n"))
        held = df.join(chunks, box).groupBy(*box, F.pmod(F.xxhash64(*rest), "__n").alias(f"{p}part")).agg(F.collect_list(F.struct(*rest)).alias(f"{p}rows"))
        span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
        return (held.withColumn("__i", F.explode(span(f"{p}x0", f"{p}x1"))).withColumn("__j", F.explode(span(f"{p}y0", f"{p}y1"))))
    spread = [*[f"a_{c}" for c in corners], "a_part"]
    pairs = met_in_cells(cells(left, "a_"), cells(right, "b_"), ["__i", "__j"], spread)
    hit = ((F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1"))
           & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1")))
    own = ((F.floor(F.greatest("a_x0", "b_x0") / size) == F.col("__i"))
           & (F.floor(F.greatest("a_y0", "b_y0") / size) == F.col("__j")))
    out = pairs.where(hit & own).withColumn("__a", F.explode("a_rows")).withColumn("__b", F.explode("b_rows"))
    back = lambda df, p: [F.col(c) if c in [f"{p}{k}" for k in corners] else F.col(f"__{p[0]}")[c].alias(c) for c in df.columns]
    return out.select(*back(left, "a_"), *back(right, "b_"))


def first_containing(points: DataFrame, boxes: DataFrame, key: str, order: str, size: float) -> DataFrame:
    """First box (by ``order``) that contains each point; points without a box are kept.

    Of equal boxes only the first is compared, and equal points are compared once.
    """
    corners = ["x0", "y0", "x1", "y1"]
    b = (boxes.groupBy(*corners).agg(F.min(order).alias(order))
         .withColumn("__i", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size))))
         .withColumn("__j", F.explode(F.sequence(F.floor(F.col("y0") / size), F.floor(F.col("y1") / size)))))
    p = points.select("x", "y").distinct().withColumns({"__i": F.floor(F.col("x") / size), "__j": F.floor(F.col("y") / size)})
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    hits = met_in_cells(p, b, ["__i", "__j"], ["x", "y"]).where(inside).groupBy("x", "y").agg(F.min(order).alias(order))
    best = points.select(key, "x", "y").join(hits, ["x", "y"]).groupBy(key).agg(F.min(order).alias(order))
    return points.join(best, key, "left")


def nearest_bands(target: list[float], source: list[float]) -> list[tuple[int, int, float]]:
    """(target band, nearest source band, residual); the first band wins a tie.

    Both axes are instrument constants of under a few hundred values.
    """
    out = []
    for i, w in enumerate(target):
        j = min(range(len(source)), key=lambda k: (abs(source[k] - w), k))
        out.append((i, j, abs(source[j] - w)))
    return out


def band_map(observed: DataFrame, key: list[str], band: str, wavelength: str, targets: list[float]) -> DataFrame:
    """(key, target, band, residual): the band nearest to each target wavelength in every observation, the first one on a tie.

    ``targets`` is an instrument's constant list of bands; all are found in one pass over the rows.
    """
    near = [F.min(F.struct(F.abs(F.col(wavelength) - t).alias("residual"), F.col(band).alias(band))) for t in targets]
    wide = observed.where(F.col(wavelength).isNotNull()).groupBy(*key).agg(F.array(*near).alias("__near"))
    return wide.select(*key, F.posexplode("__near").alias("target", "__n")).select(*key, "target", F.col("__n")[band].alias(band), "__n.residual")


def disjoint_rows(df: DataFrame, train: DataFrame, key: str = "tile_id", shared: bool = False) -> DataFrame:
    """Rows whose scene does (shared) or does not occur in train."""
    return df.join(train.select(key).distinct(), key, "left_semi" if shared else "left_anti")


def precedence_dedupe(df: DataFrame, keys: list[str], rank: Column, tie: list[str]) -> DataFrame:
    return keep_best(df, keys, [rank, *[F.col(c) for c in tie]])
