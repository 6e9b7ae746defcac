"""Spectral functions: column expressions where cheap, Arrow batches for the rest."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from ..schema import NODATA, WAVELENGTHS_NM, good_bands

# ---- fixed values: must equal the reference's for right results ----
LINEAR_CLIP = (0.0, 2.0)
HULL_STD = 0.07054129987955093
LINEAR_STD = 0.17212197184562683
RAW_LEVEL_MAX = 0.5
FLAT_LEVEL = 1e-6
MAX_ANGLE_DEG = 89.0
# ---- end of fixed values ----

DOUBLES = T.ArrayType(T.DoubleType())


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------ Arrow batches

def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-width list column as a float matrix plus the mask of present rows."""
    present = np.asarray(column.is_valid())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    rows = int(present.sum())
    return flat.reshape(rows, -1) if rows else np.empty((0, 0)), present


def lists(values: np.ndarray, present: np.ndarray) -> pa.Array:
    """Matrix rows back to a list column; absent rows stay NULL, NaN becomes NULL."""
    width = values.shape[1] if values.size else 0
    lengths = np.where(present, width, 0)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    flat = np.ascontiguousarray(values, dtype=np.float64).ravel()
    items = pa.array(flat, mask=np.isnan(flat))
    missing = pa.array(~present) if not present.all() else None
    return pa.ListArray.from_arrays(pa.array(offsets), items, mask=missing)


def upper_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper convex hull of every row of ``y`` on the grid ``x``, sampled on ``x``.

    The steepest chord from the current vertex reaches the next one; all rows of
    the batch step together until each reaches the last band.
    """
    rows, width = y.shape
    out = y.copy()
    at = np.zeros(rows, dtype=np.int64)
    who = np.arange(rows)
    for _ in range(width - 1):
        who = who[at[who] < width - 1]
        if not who.size:
            break
        here = at[who]
        step = x[None, :] - x[here][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(step > 0, (y[who] - y[who, here][:, None]) / step, -np.inf)
        nxt = width - 1 - np.argmax(slope[:, ::-1], axis=1)
        best = slope[np.arange(who.size), nxt]
        span = (np.arange(width)[None, :] >= here[:, None]) & (np.arange(width)[None, :] <= nxt[:, None])
        line = y[who, here][:, None] + best[:, None] * np.where(span, step, 0.0)
        out[who] = np.where(span, line, out[who])
        out[who, nxt] = y[who, nxt]
        at[who] = nxt
    return out


def _hull_ratio(y: np.ndarray, x: np.ndarray, keep: list[int], floor: float | None = FLAT_LEVEL) -> np.ndarray:
    out = np.ones_like(y)
    part = y[:, keep]
    usable = np.isfinite(part).all(axis=1)
    if floor is not None:
        usable &= np.where(np.isfinite(part), part, -np.inf).max(axis=1, initial=-np.inf) > floor
    if usable.any():
        good = part[usable]
        hull = upper_hull(x[keep], good)
        if floor is not None:
            hull = np.where(hull <= floor, 1.0, hull)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = good / hull
        block = out[usable]
        block[:, keep] = np.clip(np.where(np.isnan(ratio), 1.0, ratio), 0.0, 1.0)
        out[usable] = block
    return out


def hull_removed(spectrum, wavelengths=None, keep=None, floor: float | None = FLAT_LEVEL) -> Column:
    """Spectrum over its upper hull in [0, 1]; left-out bands and flat spectra give 1.

    A hull at or below ``floor`` counts as 1, as in the reference, so a faint end band becomes a deep one. None divides by
    every hull, however low, and a band that is zero like its hull gives 1.
    """
    x = np.asarray(wavelengths if wavelengths is not None else WAVELENGTHS_NM, dtype=float)
    bands = list(keep) if keep is not None else (good_bands() if wavelengths is None else list(range(len(x))))

    @F.arrow_udf(returnType=DOUBLES)
    def kernel(column: pa.Array) -> pa.Array:
        values, present = matrix(column)
        return lists(_hull_ratio(values, x, bands, floor) if values.size else values, present)

    return kernel(_col(spectrum))


def band_depth_mean(spectrum, wavelengths=None, keep=None, floor: float | None = FLAT_LEVEL) -> Column:
    """1 - mean hull-removed value over the good bands, the first band left out of the fit."""
    bands = list(keep) if keep is not None else good_bands()
    fit = [b for b in bands if b != 0]
    cr = hull_removed(spectrum, wavelengths, fit, floor)
    return F.lit(1.0) - mean_at(cr, bands)


def resampled(values, source_nm, target_nm: list[float]) -> Column:
    """Linear resampling of (values, source_nm) arrays onto fixed wavelengths.

    Invalid samples are dropped, the ends are held, fewer than two valid samples fail.
    """
    target = np.asarray(target_nm, dtype=float)

    @F.arrow_udf(returnType=DOUBLES)
    def kernel(v: pa.Array, w: pa.Array) -> pa.Array:
        y, present = matrix(v)
        x, _ = matrix(w)
        out = np.empty((y.shape[0], target.size))
        for i in range(y.shape[0]):
            ok = np.isfinite(y[i]) & np.isfinite(x[i]) & (x[i] < NODATA)
            if ok.sum() < 2:
                raise ValueError("fewer than two valid samples to resample")
            order = np.argsort(x[i][ok])
            out[i] = np.interp(target, x[i][ok][order], y[i][ok][order])
        return lists(out, present)

    return kernel(_col(values), _col(source_nm))


def bridged(spectrum, wavelengths: list[float], bad: list[tuple[float, float]]) -> Column:
    """Bands inside the bad ranges replaced by interpolation over the rest."""
    x = np.asarray(wavelengths, dtype=float)
    off = reduce(np.logical_or, [(x >= a) & (x <= b) for a, b in bad])

    @F.arrow_udf(returnType=DOUBLES)
    def kernel(column: pa.Array) -> pa.Array:
        values, present = matrix(column)
        y = values.copy()
        for i in range(y.shape[0]):
            use = ~off & np.isfinite(y[i])
            if use.sum() >= 2:
                y[i, off] = np.interp(x[off], x[use], y[i, use])
        return lists(y, present)

    return kernel(_col(spectrum).cast(DOUBLES))


def angles_to(spectrum, library: list[list[float]], degrees: bool = True, zero_norm: float | None = 90.0) -> Column:
    """Angles from each spectrum to a fixed endmember list (a few matrix products per batch).

    Bands missing on either side are skipped for that pair; NaN below two common bands. A pair with a
    zero norm over its common bands gets ``zero_norm``.
    """
    e = np.asarray(library, dtype=float)
    e_has = np.isfinite(e)
    e = np.where(e_has, e, 0.0)

    @F.arrow_udf(returnType=DOUBLES)
    def kernel(column: pa.Array) -> pa.Array:
        s, present = matrix(column)
        if not s.size:
            return lists(s, present)
        s_has = np.isfinite(s)
        s = np.where(s_has, s, 0.0)
        common = s_has.astype(float) @ e_has.T
        norms = np.sqrt((s * s) @ e_has.T) * np.sqrt(s_has @ (e * e).T)
        cosine = np.divide(s @ e.T, norms, out=np.zeros((s.shape[0], e.shape[0])), where=norms > 0)
        angle = np.arccos(np.clip(cosine, -1.0, 1.0))
        if degrees:
            angle = np.degrees(angle)
        fill = np.nan if zero_norm is None else zero_norm
        return lists(np.where(common < 2, np.nan, np.where(norms > 0, angle, fill)), present)

    return kernel(_col(spectrum))


# ---------------------------------------------------------- column builders

def sum_at(values, positions) -> Column:
    v = _col(values)
    return reduce(lambda a, b: a + b, [v[i].cast("double") for i in positions])


def mean_at(values, positions) -> Column:
    positions = list(positions)
    return sum_at(values, positions) / F.lit(float(len(positions)))


def brightness(spectrum, keep=None) -> Column:
    """Mean good-band value before continuum removal."""
    return mean_at(spectrum, keep if keep is not None else good_bands())


def take_bands(spectrum, keep: list[int]) -> Column:
    s = _col(spectrum)
    return F.array(*[s[i] for i in keep])


def linear_removed(spectrum, wavelengths=None, keep=None, floor: float | None = FLAT_LEVEL) -> Column:
    """Spectrum over its least-squares straight line, clipped to [0, 2].

    Flat spectra give 1 and a line nearer to zero than ``floor`` counts as 1, as in the reference. None divides by every line.
    """
    x = list(wavelengths if wavelengths is not None else WAVELENGTHS_NM)
    bands = list(keep) if keep is not None else (good_bands() if wavelengths is None else list(range(len(x))))
    n, mean_x = float(len(bands)), sum(x[i] for i in bands) / len(bands)
    sxx = sum((x[i] - mean_x) ** 2 for i in bands)
    s = _col(spectrum)
    mean_y = sum_at(s, bands) / F.lit(n)
    slope = reduce(lambda a, b: a + b, [s[i].cast("double") * F.lit(x[i] - mean_x) for i in bands]) / F.lit(sxx)
    peak = F.greatest(*[F.abs(s[i].cast("double")) for i in bands])
    finite = reduce(lambda a, b: a & b, [s[i].isNotNull() & ~F.isnan(s[i]) for i in bands])
    usable = finite if floor is None else finite & (peak > floor)
    fit = F.struct(mean_y.alias("m"), slope.alias("b"), usable.alias("ok"))
    offsets = F.array(*[F.lit(float(x[i] - mean_x)) if i in set(bands) else F.lit(None).cast("double") for i in range(len(x))])

    def one(f):
        def band(y, dx):
            line = f["m"] + f["b"] * dx
            if floor is None:
                ratio = F.coalesce(y.cast("double") / F.nullif(line, F.lit(0.0)), F.when(y < 0, LINEAR_CLIP[0]).otherwise(LINEAR_CLIP[1]))
            else:
                ratio = y.cast("double") / F.when(F.abs(line) < floor, 1.0).otherwise(line)
            ratio = F.least(F.greatest(ratio, F.lit(LINEAR_CLIP[0])), F.lit(LINEAR_CLIP[1]))
            return F.when(dx.isNull() | ~F.coalesce(f["ok"], F.lit(False)), 1.0).otherwise(ratio)
        return F.zip_with(s, offsets, band)

    return F.element_at(F.transform(F.array(fit), one), 1)


def dual_removed(hull, linear, standardize: bool = True) -> Column:
    """Hull block then linear block, each over its own standard deviation."""
    h, l = _col(hull), _col(linear)
    if standardize:
        h = F.transform(h, lambda v: v / F.lit(HULL_STD))
        l = F.transform(l, lambda v: v / F.lit(LINEAR_STD))
    return F.concat(h, l)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, v: s + v)


def _pair(a, b) -> Column:
    def present(x):
        return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), x.cast("double"))
    return F.filter(F.zip_with(_col(a), _col(b), lambda x, y: F.struct(present(x).alias("x"), present(y).alias("y"))),
                    lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def angle(a, b, zero_norm: float | None = None, min_bands: int = 2, degrees: bool = False) -> Column:
    """Spectral angle of two arrays over the bands both have.

    Too few common bands gives NULL; a zero norm gives ``zero_norm`` (NULL by default).
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb"))

    def step(acc, p):
        return F.struct((acc["n"] + 1).alias("n"), (acc["ab"] + p["x"] * p["y"]).alias("ab"),
                        (acc["aa"] + p["x"] * p["x"]).alias("aa"), (acc["bb"] + p["y"] * p["y"]).alias("bb"))

    def finish(acc):
        norms = F.sqrt(acc["aa"]) * F.sqrt(acc["bb"])
        rad = F.acos(F.least(F.greatest(acc["ab"] / norms, F.lit(-1.0)), F.lit(1.0)))
        rad = F.degrees(rad) if degrees else rad
        return (F.when(acc["n"] < min_bands, F.lit(None).cast("double"))
                .when(norms == 0, F.lit(zero_norm).cast("double")).otherwise(rad))

    return F.aggregate(_pair(a, b), start, step, finish)


def norm(values) -> Column:
    v = _col(values)
    return F.sqrt(dot(v, v))


def unit(values) -> Column:
    """L2-normalised array; NULL for a zero vector."""
    v = _col(values)
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.when(
        n > 0, F.transform(v, lambda x: x.cast("double") / n))), 1)


def cosine_scores(embedding, prototypes: list[list[float]]) -> Column:
    """Cosine similarity to each prototype clipped to [0, 1]; a zero vector scores 0."""
    cos = F.transform(angles_to(embedding, prototypes, degrees=False, zero_norm=None),
                      lambda a: F.coalesce(F.cos(a), F.lit(0.0)))
    return F.transform(cos, lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def reject_weak(scores, limit) -> Column:
    """Every score of a row becomes 0 when its best score is under the limit."""
    s, t = _col(scores), limit if isinstance(limit, Column) else F.lit(limit)
    return F.when(F.array_max(s) < t, F.transform(s, lambda _: F.lit(0.0))).otherwise(s)


def project(values, mean: list[float], components: list[list[float]], variance: list[float]) -> Column:
    """Whitened PCA projection with stored parameters."""
    m, c, scale = np.asarray(mean), np.asarray(components), np.sqrt(np.asarray(variance))

    @F.arrow_udf(returnType=DOUBLES)
    def kernel(column: pa.Array) -> pa.Array:
        x, present = matrix(column)
        return lists(((x - m) @ c.T) / scale if x.size else x, present)

    return kernel(_col(values))


def nearest(angles) -> Column:
    """0-based position of the smallest angle (first one wins a tie)."""
    a = _col(angles)
    return F.array_position(a, F.array_min(a)).cast("int") - 1


def within_angle(angles, index: int, limit: float, valid=None) -> Column:
    """Nearest endmember is ``index`` and lies within the limit."""
    hit = (nearest(angles) == index) & (F.array_min(_col(angles)) <= limit)
    return hit if valid is None else _col(valid) & hit


def nearest_band(nm: float, wavelengths) -> int:
    return min(range(len(wavelengths)), key=lambda i: abs(wavelengths[i] - nm))


def band_depth(spectrum, center: int, left: int, right: int, wavelengths=WAVELENGTHS_NM) -> Column:
    """1 - value over the straight line between two positive shoulders, else NULL."""
    s = _col(spectrum)
    share = (wavelengths[center] - wavelengths[left]) / (wavelengths[right] - wavelengths[left])
    line = s[left] + F.lit(share) * (s[right] - s[left])
    return F.when((s[left] > 0) & (s[right] > 0) & (line > 0), F.lit(1.0) - s[center] / line)


def shoulder_depth(spectrum, center: int, left: int, right: int) -> Column:
    """1 - value over the mean of two shoulders."""
    s = _col(spectrum)
    return F.lit(1.0) - s[center] / ((s[left] + s[right]) / 2.0)


def air_mass(incidence, emission) -> Column:
    """Two-way path 1/cos i + 1/cos e with angles clamped to [0, 89] degrees."""
    def path(d):
        return F.lit(1.0) / F.cos(F.radians(F.least(F.greatest(_col(d).cast("double"), F.lit(0.0)), F.lit(MAX_ANGLE_DEG))))
    return path(incidence) + path(emission)


def logistic_score(values, center: list[float], scale: list[float], weights: list[float], intercept: float) -> Column:
    """Standardise, weigh, squash."""
    v = _col(values)
    z = reduce(lambda a, b: a + b, [(v[i].cast("double") - F.lit(c)) / F.lit(s) * F.lit(w)
                                   for i, (c, s, w) in enumerate(zip(center, scale, weights))]) + F.lit(intercept)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def gated_probabilities(logits, gate, mineral: list[int], rest: list[int]) -> Column:
    """Class probability times gate (minerals) or one minus gate (rest), in log space."""
    l, g = _col(logits), _col(gate).cast("double")

    def log_sigmoid(z):
        return F.when(z >= 0, -F.log1p(F.exp(-z))).otherwise(z - F.log1p(F.exp(z)))

    parts = []
    for i in sorted([*mineral, *rest]):
        side = log_sigmoid(g) if i in mineral else log_sigmoid(-g)
        parts.append(F.exp(log_sigmoid(l[i].cast("double")) + side))
    return F.array(*parts)


def class_partition(names: list[str], non_mineral=("bland", "junk", "other")) -> tuple[list[int], list[int]]:
    minerals = [i for i, n in enumerate(names) if n not in non_mineral]
    rest = [i for i, n in enumerate(names) if n in non_mineral]
    if not minerals or not rest:
        raise ValueError("both a mineral and a non-mineral class are needed")
    return minerals, rest


def zscore_array(values) -> Column:
    """Array minus its mean over its deviation; a deviation under 1e-6 counts as 1."""
    v = _col(values)
    n = F.size(v).cast("double")
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    stats = F.struct((total / n).alias("m"), n.alias("n"))

    def scale(st):
        var = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - st["m"]) * (x - st["m"])) / st["n"]
        dev = F.when(F.sqrt(var) < 1e-6, 1.0).otherwise(F.sqrt(var))
        return F.element_at(F.transform(F.array(dev), lambda d: F.transform(v, lambda x: (x - st["m"]) / d)), 1)

    return F.element_at(F.transform(F.array(stats), scale), 1)


def to_nanometres(wavelength, unit=None, largest=None) -> Column:
    """Micrometres to nanometres when the unit says so or no value reaches 50."""
    w = _col(wavelength)
    micro = F.lit(False)
    if unit is not None:
        micro = micro | F.coalesce(F.lower(_col(unit)).isin("micrometers", "um", "μm", "micron"), F.lit(False))
    if largest is not None:
        micro = micro | (_col(largest) < 50)
    return F.when(micro, w * 1000.0).otherwise(w)
