"""Missing-value rules over spectrum arrays.

The nodata rules differ by use and stay separate options: see ``sanitize``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import CLIP_MAX, NODATA, PHYS_MAX

INF = float("inf")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _finite(x: Column) -> Column:
    return ~(F.isnan(x) | x.isin(INF, -INF))


def is_bad(x: Column, phys_max: float | None = PHYS_MAX, below_zero: bool = False) -> Column:
    x = x.cast("double")
    bad = x.isNull() | (x == NODATA) | ~_finite(x)
    if phys_max is not None:
        bad = bad | (x > phys_max)
    if below_zero:
        bad = bad | (x < 0)
    return bad


def sanitize(spectrum, phys_max: float | None = PHYS_MAX, clip: float | None = CLIP_MAX,
             below_zero: bool = False, fill: float | None = 0.0) -> Column:
    """Nodata bands -> ``fill`` (NULL when None); other values clipped to [0, clip]."""
    empty = F.lit(fill).cast("double")

    def one(x):
        value = x.cast("double")
        if clip is not None:
            value = F.least(F.greatest(value, F.lit(0.0)), F.lit(clip))
        return F.when(is_bad(x, phys_max, below_zero), empty).otherwise(value)

    return F.transform(_col(spectrum), one)


def bad_count(spectrum, phys_max: float | None = PHYS_MAX, below_zero: bool = False) -> Column:
    return F.size(F.filter(_col(spectrum), lambda x: is_bad(x, phys_max, below_zero)))


def positive_only(spectrum) -> Column:
    """Values <= 0 or >= the sentinel become NULL."""
    return F.transform(_col(spectrum), lambda x: F.when(
        (x.cast("double") > 0) & (x.cast("double") < NODATA), x.cast("double")))


def has_sentinel(spectrum) -> Column:
    """True when a band is at or above the sentinel (the extraction rule)."""
    return F.exists(_col(spectrum), lambda x: ~F.isnan(x) & (x >= NODATA))


def nan_to_zero(spectrum) -> Column:
    return F.transform(_col(spectrum), lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x.cast("double")))


def tile_valid(spectrum) -> Column:
    """No sentinel, all finite, not all zero."""
    s = _col(spectrum)
    return (~F.exists(s, lambda x: x.isNull() | (x == NODATA) | ~_finite(x.cast("double")))
            & F.exists(s, lambda x: x != 0))


def rows_bounded(spectrum, limit: float = 1e4) -> Column:
    return F.forall(_col(spectrum), lambda x: x.isNotNull() & _finite(x.cast("double")) & (F.abs(x) < limit))


# fixed values: physical range of the auxiliary bands
BAND_RANGES = {"RPEAK1": (0.5, 1.0), "BD1300": (-0.5, 0.5)}


def physical(value, band: str) -> Column:
    """Value inside the band's physical range, else NULL."""
    low, high = BAND_RANGES[band]
    v = _col(value).cast("double")
    return F.when(~F.isnan(v) & (v != NODATA) & v.between(low, high), v)


def longest_zero_run(spectrum) -> Column:
    start = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("best"))

    def step(acc, x):
        cur = F.when(x == 0, acc["cur"] + 1).otherwise(0)
        return F.struct(cur.alias("cur"), F.greatest(acc["best"], cur).alias("best"))

    return F.aggregate(_col(spectrum), start, step, lambda acc: acc["best"])


def zero_tail(spectrum) -> Column:
    """Length of the trailing run of zeros."""
    flags = F.transform(F.reverse(_col(spectrum)), lambda x: F.coalesce(x != 0, F.lit(True)))
    first = F.array_position(flags, F.lit(True))
    return F.when(first == 0, F.size(flags)).otherwise(first - 1).cast("int")


AUDIT_FAIL = ["zero_tail", "zero_run", "all_zero", "nodata", "nonfinite", "over_phys", "flat"]
AUDIT_INFO = ["blue_edge"]


def audit_flags(spectrum, min_run: int = 5, min_tail: int = 3) -> dict[str, Column]:
    """One boolean per defect check; ``blue_edge`` is information, not a defect."""
    s = _col(spectrum)
    known = F.filter(s, lambda x: x.isNotNull() & ~F.isnan(x))
    return {
        "zero_tail": zero_tail(s) >= min_tail,
        "zero_run": longest_zero_run(s) >= min_run,
        "all_zero": F.coalesce(F.forall(s, lambda x: x == 0), F.lit(False)),
        "nodata": F.coalesce(F.exists(s, lambda x: x == NODATA), F.lit(False)),
        "nonfinite": F.exists(s, lambda x: x.isNull() | ~_finite(x.cast("double"))),
        "over_phys": F.size(F.filter(s, lambda x, i: (i > 0) & ~F.isnan(x) & (x > PHYS_MAX))) > 0,
        "flat": (F.size(known) > 0) & (F.array_max(known) == F.array_min(known)),
        "blue_edge": F.coalesce(~F.isnan(s[0]) & (s[0] > PHYS_MAX), F.lit(False)),
    }
