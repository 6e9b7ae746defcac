"""Vocabularies, band columns and table contracts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

# ---- fixed values: must equal the reference's for right results ----
NODATA = 65535.0
PHYS_MAX = 1.0
CLIP_MAX = 0.5
N_BANDS = 59
LABELS_RAW = ["olivine_t1", "olivine_t2", "lcp", "hcp", "plagioclase", "other", "alteration"]
LABELS_5 = ["olivine", "lcp", "hcp", "plagioclase", "other"]
LABELS_6 = ["olivine", "lcp", "hcp", "plagioclase", "other", "alteration"]
LABELS_7 = ["olivine", "lcp", "hcp", "plagioclase", "bland", "alteration", "junk"]
LABELS_PYX = ["olivine", "pyx", "plagioclase", "bland", "alteration", "junk"]
LABELS_PYX_HAND = ["olivine", "pyx", "plagioclase", "other", "alteration"]
MINERALS_RAW = ["olivine_t1", "olivine_t2", "lcp", "hcp", "plagioclase"]
CORPUS_CLASSES = ["olivine", "lcp", "hcp", "plagioclase", "alteration"]
SOURCE_RANK = {"ndviz": 0, "reassigned": 1, "tag": 2, "confirmed": 3, "hand": 4}
PIXEL_KEY = ["tile_id", "pixel_row", "pixel_col"]
POLYGON_KEY = ["tile_id", "polygon_id"]
WAVELENGTHS_NM = [
    410.12, 442.63, 533.74, 598.86, 650.99, 683.59, 709.68, 742.3, 774.92, 801.04,
    833.68, 859.81, 892.48, 925.16, 951.31, 984.01, 1021.0, 1023.27, 1047.2, 1055.99,
    1079.96, 1152.06, 1211.09, 1250.45, 1257.01, 1263.57, 1276.7, 1329.21, 1368.61, 1394.89,
    1427.73, 1467.16, 1500.03, 1506.61, 1559.21, 1625.0, 1657.91, 1690.82, 1750.09, 1809.39,
    1875.3, 1928.06, 1974.24, 1980.84, 2007.23, 2066.64, 2119.48, 2139.3, 2165.72, 2205.38,
    2231.82, 2251.65, 2291.33, 2317.79, 2331.02, 2350.87, 2390.58, 2430.3, 2456.79,
]
EXCLUDED_NM = (1000.0, 1065.0)
DECISION_COLUMNS = [
    "ts", "source_gpkg", "layer", "polygon_uid", "tile_id", "predicted_class", "decision",
    "corrected_class", "n_pixels", "area_m2", "co_occurring_classes", "confidence",
]
REVIEW_WEIGHTS = {"High": 1.0, "Moderate": 0.75, "Low": 0.5}
# ---- end of fixed values ----

DECISION_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("source_gpkg", T.StringType()),
    T.StructField("layer", T.StringType()),
    T.StructField("polygon_uid", T.StringType()),
    T.StructField("tile_id", T.StringType()),
    T.StructField("predicted_class", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("corrected_class", T.StringType()),
    T.StructField("n_pixels", T.LongType()),
    T.StructField("area_m2", T.DoubleType()),
    T.StructField("co_occurring_classes", T.StringType()),
    T.StructField("confidence", T.StringType()),
])

BAND_STYLES = (re.compile(r"m(\d+)"), re.compile(r"band_(\d+)"))


def good_bands(wavelengths=WAVELENGTHS_NM, window=EXCLUDED_NM) -> list[int]:
    """Positions of the bands outside the detector overlap window."""
    low, high = window
    return [i for i, w in enumerate(wavelengths) if not low <= w <= high]


def band_columns(columns) -> list[str]:
    """Band columns in band order; one naming style, indices 0..N-1 without gaps."""
    found = []
    for style in BAND_STYLES:
        by_index = {int(m[1]): c for c in columns if (m := style.fullmatch(c))}
        if by_index:
            found.append(by_index)
    if len(found) != 1:
        raise ValueError(f"expected exactly one band naming style, found {len(found)}")
    names = found[0]
    if set(names) != set(range(len(names))):
        raise ValueError("band indices have gaps")
    return [names[i] for i in range(len(names))]


def rename_bands(source, target) -> dict[str, str]:
    """Map target band column -> source band column by band index."""
    src, dst = band_columns(source), band_columns(target)
    if len(src) < len(dst):
        raise ValueError(f"source has {len(src)} bands, target needs {len(dst)}")
    return dict(zip(dst, src))


def is_band(column: str) -> bool:
    return any(style.fullmatch(column) for style in BAND_STYLES)


def bland_column(columns) -> str:
    for name in ("bland", "other"):
        if name in columns:
            return name
    raise ValueError("no bland column")


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df


def pack_bands(df: DataFrame, name: str = "spectrum") -> DataFrame:
    """Replace the band columns by one array column."""
    bands = band_columns(df.columns)
    rest = [c for c in df.columns if c not in set(bands)]
    return df.select(*rest, F.array(*bands).alias(name))


def unpack_bands(df: DataFrame, n: int, name: str = "spectrum", prefix: str = "m") -> DataFrame:
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, *[F.col(name)[i].alias(f"{prefix}{i}") for i in range(n)])


def slim(df: DataFrame) -> DataFrame:
    """Every column that is not a band."""
    return df.select(*[c for c in df.columns if not is_band(c)])


def feature_array(df: DataFrame, fitted: list[str]) -> Column:
    """Features by name in the order they were fitted; a missing one is fatal."""
    require(df, *fitted)
    return F.array(*[F.col(c).cast("double") for c in fitted])


def check_channels(found, expected) -> None:
    """Channel order is part of a score table: even a permutation is refused."""
    if list(found) != list(expected):
        raise ValueError(f"channels {list(found)} differ from expected {list(expected)}")


def constant_of(df: DataFrame, column: str):
    """Value of a provenance column that must hold a single value."""
    row = df.agg(F.min(column).alias("low"), F.max(column).alias("high"),
                 F.count(F.when(F.col(column).isNull(), 1)).alias("missing")).first()
    if row.low != row.high or row.missing:
        raise ValueError(f"{column} is not constant")
    return row.low


def resolve_smoothing(recorded, requested):
    """The recorded smoothing wins; an explicit contradiction is refused."""
    if requested is not None and recorded is not None and bool(requested) != bool(recorded):
        raise ValueError(f"artifact was built with smooth={recorded}, asked for {requested}")
    return bool(recorded if recorded is not None else requested)
