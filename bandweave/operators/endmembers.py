"""Medoids, purity, prototypes and nearest-endmember maps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import spectral as S
from ..session import collect_bounded, cut_lineage
from .ranking import exact_percentiles, first_per_group, null_safe_join

MAX_LIBRARY = 4096  # endmembers come from the class vocabulary
BLOCK = 1024
REPACKED = 16
BOUND_SLACK = 1e-7  # radians; rounding of angles near 0
ROUNDING = 1e-11  # of squared chords from summed moments


def library(df: DataFrame, name: str = "class", spectrum: str = "spectrum") -> tuple[list[str], list[list[float]]]:
    """Endmember names and spectra in name order; the size is checked."""
    rows = collect_bounded(df.select(name, spectrum), MAX_LIBRARY, "endmember library")
    rows = sorted(rows, key=lambda r: r[name])
    return [r[name] for r in rows], [[float("nan") if x is None else float(x) for x in r[spectrum]] for r in rows]


def nearest_map(df: DataFrame, names: list[str], spectra: list[list[float]], spectrum: str = "spectrum") -> DataFrame:
    """Angles to every endmember, the nearest one and its angle in degrees; NULL where no angle is known."""
    out = df.withColumn("angles", S.angles_to(spectrum, spectra))
    at = S.nearest("angles")
    least = F.array_min("angles")
    known = ~F.isnan(least)
    return out.withColumns({"nearest": F.when(known, F.element_at(F.array(*[F.lit(n) for n in names]), at + 1)),
                            "angle_deg": F.when(known, least)})


def centroid_angles(df: DataFrame, centroids: DataFrame, embedding: str = "embedding") -> DataFrame:
    """``df`` with ``angle_<class>``, the angle in radians to each class centroid (class, centroid); NULL for a vector of length 0."""
    names, spectra = library(centroids, "class", "centroid")
    out = df.withColumn("__a", S.angles_to(embedding, spectra, degrees=False, zero_norm=None))
    return out.select(*df.columns, *[F.nanvl(F.col("__a")[k], F.lit(None)).alias(f"angle_{n}") for k, n in enumerate(names)])


def mean_angles(df: DataFrame, group: list[str], key: str, spectrum: str = "spectrum") -> DataFrame:
    """Mean angle (radians) of each row to the other rows of its group; 0 for a lone row.

    All pairs must be measured, but none is emitted: rows are packed in blocks of
    about a thousand, block meets block, and each meeting returns one partial sum per
    row. A hot group becomes many blocks, hence many tasks. Rows with a missing or
    non-finite band are left out, as one of them would spoil every mean of its group.
    """
    blocks = _packed(_finite(df, spectrum).select(*group, key, spectrum), group, key, spectrum)
    return _met(blocks, blocks, group, key)


def _finite(df: DataFrame, spectrum: str) -> DataFrame:
    return df.where(F.forall(spectrum, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _packed(rows: DataFrame, group: list[str], key: str, spectrum: str) -> DataFrame:
    """Blocks of about BLOCK rows of each group: number __b of __nb, rows of the group __n, and __rows."""
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    tagged = null_safe_join(rows, sizes, group).withColumn("__nb", F.ceil(F.col("__n") / BLOCK).cast("int"))
    tagged = tagged.withColumn("__b", F.pmod(F.xxhash64(key), F.col("__nb")).cast("int"))
    return tagged.groupBy(*group, "__b").agg(F.max("__nb").alias("__nb"), F.max("__n").alias("__n"), F.collect_list(F.struct(key, spectrum)).alias("__rows"))


def _repacked(rows: DataFrame, group: list[str], key: str, spectrum: str) -> DataFrame:
    """Some rows of blocks (with the __nb of their group) in new blocks, one for REPACKED old ones."""
    dealt = F.pmod(F.xxhash64(key), F.ceil(F.col("__nb") / REPACKED))
    return rows.groupBy(*group, dealt.alias("__b")).agg(F.max("__nb").alias("__nb"), F.collect_list(F.struct(key, spectrum)).alias("__rows"))


def _met(some: DataFrame, blocks: DataFrame, group: list[str], key: str) -> DataFrame:
    """Mean angle of each row of the blocks ``some`` to the other rows of its group, whose whole blocks are ``blocks``."""
    left = some.select(*group, F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)).alias("__b"), F.col("__rows").alias("__mine"))
    met = null_safe_join(left, blocks.select(*group, "__b", "__n", F.col("__rows").alias("__theirs")), [*group, "__b"])

    @F.arrow_udf(returnType=T.ArrayType(T.DoubleType()))
    def sums(mine: pa.Array, theirs: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(mine, theirs):
            u, v = _units(a.values), _units(b.values)
            parts = [np.arccos(np.clip(u[at:at + BLOCK] @ v.T, -1.0, 1.0)).sum(axis=1) for at in range(0, len(u), BLOCK)]
            out.append(np.concatenate(parts))
        return pa.array(out, type=pa.list_(pa.float64()))

    part = met.select(*group, "__n", F.transform("__mine", lambda r: r[key]).alias("__keys"), sums("__mine", "__theirs").alias("__sums"))
    tall = part.select(*group, "__n", F.explode(F.arrays_zip("__keys", "__sums")).alias("z"))
    total = tall.groupBy(*group, F.col("z.__keys").alias(key)).agg(F.sum("z.__sums").alias("__s"), F.max("__n").alias("__n"))
    return total.select(*group, key, F.when(F.col("__n") > 1, F.col("__s") / (F.col("__n") - 1)).otherwise(0.0).alias("mean_angle"))


def _units(rows: pa.StructArray) -> np.ndarray:
    values = rows.field(1)
    x = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(n == 0, 1.0, n)
    return unit


def _moments(blocks: DataFrame, group: list[str]) -> DataFrame:
    """Per group the sums of the unit vectors u and of their products u u', as one array __m (d + d d values)."""

    @F.arrow_udf(returnType=T.ArrayType(T.DoubleType()))
    def summed(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows:
            u = _units(r.values)
            out.append(np.concatenate([u.sum(axis=0), (u.T @ u).ravel()]))
        return pa.array(out, type=pa.list_(pa.float64()))

    tall = blocks.select(*group, F.posexplode(summed("__rows")).alias("__i", "__v")).groupBy(*group, "__i").agg(F.sum("__v").alias("__v"))
    held = tall.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__i", "__v"))).alias("__m"))
    return held.withColumn("__m", F.transform("__m", lambda x: x["__v"]))


def angle_bounds(unit: np.ndarray, n: int, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the mean angle of each row of ``unit`` to the other rows of its group of ``n``, from the group's moments.

    With x the cosine to another row, its mean and the mean of its square follow from the moments. As |arcsin x - x| is at
    most (pi/2 - 1) x^2, they bound the mean angle when rows are far apart. For rows close together the chord c, with
    c^2 = 2 - 2x, is no longer than the angle, and E c >= (E c^2)^1.5 / (E c^4)^0.5; an angle is at most pi/2 chords.
    """
    own = (unit * unit).sum(axis=1)
    others = max(n - 1, 1)
    x = np.clip((unit @ first - own) / others, -1.0, 1.0)
    xx = np.clip((np.einsum("ij,ij->i", unit @ second, unit) - own * own) / others, x * x, 1.0)
    bend = (np.pi / 2 - 1) * xx
    cc, cccc = 2 - 2 * x, np.maximum(4 - 8 * x + 4 * xx, 0)
    chord = np.maximum(cc - ROUNDING, 0) ** 1.5 / np.sqrt(cccc + ROUNDING)
    lower = np.maximum(np.pi / 2 - x - bend, chord)
    upper = np.minimum(np.pi / 2 - x + bend, np.pi / 2 * np.sqrt(cc + ROUNDING))
    itself = np.where(own > 0.5, 0.0, np.pi / 2) / others  # the angle of a zero vector to itself counts as a right one
    return (lower + itself, upper + itself) if n > 1 else (np.zeros(len(unit)), np.zeros(len(unit)))


def medoid_candidates(blocks: DataFrame, group: list[str], key: str, spectrum: str, count: int) -> DataFrame:
    """The rows that may be among the ``count`` of least mean angle.

    The ``count`` rows of least upper bound are measured; a row whose lower bound is beyond the largest of their means has no place.
    """

    @F.arrow_udf(returnType="array<struct<lower double, upper double>>")
    def bounds(rows: pa.Array, n: pa.Array, moments: pa.Array) -> pa.Array:
        out = []
        for r, size, m in zip(rows, n.to_pylist(), moments):
            unit, m = _units(r.values), m.values.to_numpy(zero_copy_only=False)
            d = unit.shape[1]
            low, high = angle_bounds(unit, size, m[:d], m[d:].reshape(d, d))
            out.append([{"lower": a, "upper": b} for a, b in zip(low.tolist(), high.tolist())])
        return pa.array(out, type=pa.list_(pa.struct([("lower", pa.float64()), ("upper", pa.float64())])))

    known = null_safe_join(blocks, _moments(blocks, group), group).withColumn("__bounds", bounds("__rows", "__n", "__m"))
    rows = known.select(*group, "__nb", F.explode(F.arrays_zip("__rows", "__bounds")).alias("z")).select(
        *group, "__nb", F.col(f"z.__rows.{key}").alias(key), F.col(f"z.__rows.{spectrum}").alias(spectrum), "z.__bounds.lower", "z.__bounds.upper")
    least = first_per_group(rows, group, [F.asc("upper")], count)
    bar = _met(_repacked(least, group, key, spectrum), blocks, group, key).groupBy(*group).agg(F.max("mean_angle").alias("__bar"))
    return null_safe_join(rows, bar, group).where(F.col("lower") <= F.col("__bar") + BOUND_SLACK).select(*group, "__nb", key, spectrum)


def medoids(polygons: DataFrame, group: list[str], key: str, count: int = 1, spectrum: str = "spectrum") -> DataFrame:
    """The ``count`` rows of each group with the smallest mean angle; ``kind`` names the place. ``key`` is unique in a group.

    The moments of a group, one pass with map-side sums, bound the mean angle of every row; only rows whose bound leaves
    them a place are measured against all others. Rows are left out as in ``mean_angles``, and the result is that of
    ranking all means.
    """
    rows = _finite(polygons, spectrum).select(*group, key, spectrum)
    blocks = cut_lineage(_packed(rows, group, key, spectrum))
    some = _repacked(medoid_candidates(blocks, group, key, spectrum, count), group, key, spectrum)
    angles = _met(some, blocks, group, key).withColumn("__a", F.round("mean_angle", 12))
    ranked = first_per_group(angles, group, [F.asc("__a"), F.asc(key)], count)
    place = F.row_number().over(Window.partitionBy(*group).orderBy("__a", key))  # at most `count` rows per group
    kind = F.when(place == 1, "medoid").otherwise(F.concat(F.lit("candidate"), place.cast("string")))
    return ranked.withColumn("kind", kind).join(polygons.select(key, spectrum), key).select(*group, key, "kind", "mean_angle", spectrum)


def discriminative(polygons: DataFrame, key: str, medoid_rows: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """Per class the row with the largest (smallest angle to another medoid - own mean angle)."""
    names, spectra = library(medoid_rows.where("kind = 'medoid'"), "class", spectrum)
    own = mean_angles(polygons, ["class"], key, spectrum)
    rows = polygons.withColumn("__angles", S.angles_to(spectrum, spectra, degrees=False))
    other = F.array_min(F.filter(F.transform("__angles", lambda a, i: F.struct(a.alias("a"), i.alias("i"))),
                                 lambda p: F.element_at(F.array(*[F.lit(n) for n in names]), p["i"] + 1) != F.col("class")))
    scored = rows.select("class", key, other["a"].alias("__o")).join(own, ["class", key])
    scored = scored.select("class", key, F.round(F.col("__o") - F.col("mean_angle"), 12).alias("score"))
    return first_per_group(scored, ["class"], [F.desc("score"), F.asc(key)], 1)


def angle_matrix(names: list[str], spectra: list[list[float]], spark) -> DataFrame:
    """Angle in degrees between every two endmembers of the (bounded) library."""
    rows = spark.createDataFrame([(n, [float(x) for x in s]) for n, s in zip(names, spectra)], "class string, spectrum array<double>")
    out = rows.withColumn("angles", S.angles_to("spectrum", spectra))
    return out.select("class", F.posexplode("angles").alias("i", "angle_deg")).select(
        "class", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1).alias("other"), "angle_deg")


def purity(polygons: DataFrame, names: list[str], spectra: list[list[float]], min_px: int, spectrum: str = "spectrum") -> DataFrame:
    """Own angle, nearest other class, margin and flags of every polygon with a known class."""
    vocab = F.array(*[F.lit(n) for n in names])
    rows = polygons.where(F.col("class").isin(names)).withColumn("__angles", S.angles_to(spectrum, spectra))
    at = F.array_position(vocab, F.col("class")).cast("int")
    others = F.filter(F.transform("__angles", lambda a, i: F.struct(a.alias("a"), i.alias("i"))), lambda p: p["i"] + 1 != at)
    best = F.array_min(others)
    out = rows.withColumns({"own_angle_deg": F.element_at("__angles", at), "__best": best})
    margin = F.col("__best.a") - F.col("own_angle_deg")
    return out.withColumns({"nearest_other_class": F.element_at(vocab, F.col("__best.i") + 1), "nearest_other_angle_deg": F.col("__best.a"),
                            "margin_deg": margin, "suspect": F.coalesce(margin < 0, F.lit(False)),
                            "degenerate": F.col("n_px") < min_px}).drop("__angles", "__best", spectrum)


def per_source(pure: DataFrame) -> DataFrame:
    """Median own angle and share of suspects per class and source."""
    med = exact_percentiles(pure, ["class", "source"], "own_angle_deg", {"median_own_angle_deg": 0.5})
    bad = pure.groupBy("class", "source").agg((F.count_if("suspect") * 100.0 / F.count(F.lit(1))).alias("pct_suspect"))
    return med.withColumnRenamed("n", "n_polygons").join(bad, ["class", "source"])


def intra_spread(polygons: DataFrame, names: list[str], spectra: list[list[float]], spectrum: str = "spectrum") -> DataFrame:
    """Mean, median and 90th percentile of the angle to the own class medoid."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("class")).cast("int")
    rows = polygons.where(F.col("class").isin(names)).select("class", F.element_at(S.angles_to(spectrum, spectra), at).alias("angle_deg"))
    mean = rows.groupBy("class").agg(F.avg("angle_deg").alias("mean_deg"))
    return exact_percentiles(rows, ["class"], "angle_deg", {"p50_deg": 0.5, "p90_deg": 0.9}).join(mean, "class")


def cross_source(polygons: DataFrame, key: str, spectrum: str = "spectrum") -> DataFrame:
    """Angle between the medoids of every two sources of a class (sources are a fixed few)."""
    med = medoids(polygons, ["class", "source"], key, 1, spectrum).select("class", "source", spectrum)
    n = polygons.groupBy("class", "source").agg(F.count(F.lit(1)).alias("n"))
    m = med.join(n, ["class", "source"])
    a = m.select("class", F.col("source").alias("source_a"), F.col("n").alias("n_a"), F.col(spectrum).alias("__a"))
    b = m.select("class", F.col("source").alias("source_b"), F.col("n").alias("n_b"), F.col(spectrum).alias("__b"))
    pairs = a.join(b, "class").where(F.col("source_a") < F.col("source_b"))
    return pairs.select("class", "source_a", "source_b", "n_a", "n_b", S.angle("__a", "__b", degrees=True).alias("angle_deg"))


def map_summary(mapped: DataFrame) -> DataFrame:
    """Assigned pixels, 10th percentile and median angle per endmember."""
    return exact_percentiles(mapped, ["nearest"], "angle_deg", {"p10_deg": 0.1, "p50_deg": 0.5})


def half_of(df: DataFrame, key: str, seed: int):
    from ..functions.keys import hash_unit
    return df.withColumn("fit_half", hash_unit(seed, key) < 0.5)


def held_out_confusion(df: DataFrame, key: str, n: int, seed: int, spectrum: str = "spectrum") -> DataFrame:
    """Half the rows give per-class medians, the other half is matched: counts and mean angles."""
    halves = half_of(df, key, seed)
    tall = halves.where("fit_half").select("class", F.posexplode(spectrum).alias("i", "v"))
    med = exact_percentiles(tall, ["class", "i"], "v", {"m": 0.5})
    ends = med.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("__s")).select(
        "class", F.transform("__s", lambda x: x["m"]).alias(spectrum))
    names, spectra = library(ends, "class", spectrum)
    test = nearest_map(halves.where(~F.col("fit_half")), names, spectra, spectrum)
    return test.groupBy("class", "nearest").agg(F.count(F.lit(1)).alias("n"), F.avg("angle_deg").alias("mean_angle_deg"))


def confident_agreement(scored: DataFrame, prob: str, own: str, thresholds: list[float], per: int, key: str, seed: int,
                        names: list[str], spectra: list[list[float]], spectrum: str = "spectrum") -> DataFrame:
    """At each threshold: share of sampled confident rows whose nearest endmember is the own class."""
    from functools import reduce
    from .sampling import subsample
    parts = [subsample(scored.where(F.col(prob) >= t), [key], per, seed).withColumn("threshold", F.lit(float(t))) for t in thresholds]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    mapped = nearest_map(rows, names, spectra, spectrum)
    return mapped.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("nearest") == own, 1.0).otherwise(0.0)).alias("share_own"),
                                           F.avg("angle_deg").alias("mean_angle_deg"))


def disagreement(df: DataFrame, angle: str, predicted: str, labelled: str) -> DataFrame:
    """Threshold = median + deviation of the labelled angles (of the predicted ones when ten or fewer),
    and the predicted rows beyond it."""
    from .ranking import with_scalars
    tall = (df.where(F.col(labelled)).select(F.lit("labelled").alias("kind"), F.col(angle))
            .unionByName(df.where(F.col(predicted)).select(F.lit("predicted").alias("kind"), F.col(angle))))
    med = exact_percentiles(tall, ["kind"], angle, {"median": 0.5})
    dev = tall.groupBy("kind").agg(F.stddev_pop(angle).alias("dev"))
    both = med.join(dev, "kind").groupBy().agg(
        F.max(F.when((F.col("kind") == "labelled") & (F.col("n") > 10), F.col("median") + F.col("dev"))).alias("a"),
        F.max(F.when(F.col("kind") == "predicted", F.col("median") + F.col("dev"))).alias("b"))
    cut = both.select(F.coalesce("a", "b").alias("threshold"))
    return with_scalars(df, cut).where(F.col(predicted) & (F.col(angle) > F.col("threshold")))


def cohens_d(df: DataFrame, by: str, value: str, a: str, b: str) -> DataFrame:
    """Standardised mean difference of two flagged populations per group (sample variances)."""
    va, vb = F.when(F.col(a), F.col(value)), F.when(F.col(b), F.col(value))
    g = df.groupBy(by).agg(F.avg(va).alias("ma"), F.avg(vb).alias("mb"), F.var_samp(va).alias("sa"), F.var_samp(vb).alias("sb"),
                           F.count(va).alias("na"), F.count(vb).alias("nb"))
    pooled = F.sqrt((F.col("sa") + F.col("sb")) / 2.0)
    ok = (F.col("na") >= 2) & (F.col("nb") >= 2) & (pooled >= 1e-9)
    return g.select(by, F.when(ok, (F.col("mb") - F.col("ma")) / pooled).alias("d"))
