"""Deterministic ids, hash orders and threshold names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LAYER_PATTERN = r"^thresh_(?:\d+_)?(\d+(?:\.\d+)?)$"  # fixed value: layer name format


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_text(seed: int, *cols) -> Column:
    """Seeded order key: the same rows come first on any engine and any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_col(c).cast("string") for c in cols]))


def hash_unit(seed: int, *cols) -> Column:
    """Deterministic uniform number in [0, 1)."""
    return F.conv(F.substring(hash_text(seed, *cols), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def id_from_uid(uid) -> Column:
    """Stable 32-bit polygon id of a uid."""
    return F.conv(F.substring(F.md5(_col(uid)), 1, 8), 16, 10).cast("bigint")


def uid(*parts) -> Column:
    return F.concat_ws("::", *[_col(p).cast("string") for p in parts])


def threshold_text(value) -> Column:
    """Shortest decimal text that reads back to the value; at least two decimals."""
    value = _col(value)
    text = F.format_string("%.6f", value)
    for digits in (4, 3, 2):
        short = F.format_string(f"%.{digits}f", value)
        text = F.when(F.abs(short.cast("double") - value) < 1e-12, short).otherwise(text)
    return text


def layer_threshold(name) -> Column:
    found = F.regexp_extract(_col(name), LAYER_PATTERN, 1)
    return F.when(found != "", found.cast("double"))


def canonical_layer(value) -> Column:
    return F.concat(F.lit("thresh_"), threshold_text(value))
