"""Seeded spectral noise: every draw depends on the row key only, so a lost task repeats it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schema import CLIP_MAX, LABELS_RAW
from .spectral import DOUBLES, HULL_STD, lists, matrix

# ---- fixed values: must equal the reference's for right results ----
NOISE_STD, BAND_DROPOUT, SHIFT_STD = 0.005, 0.10, 0.005
SIGMA_GAUSS, SIGMA_SPIKE, SIGMA_COLUMN = 0.0087, 0.0058, 0.0049
SEAM_BAND, SEAM_FWHM, SEAM_RANGE, FWHM_PER_SIGMA = 15, 3.0, (13, 17), 2.355
SYNTH_NOISE, SYNTH_JITTER, SYNTH_SCALE = 0.005, 0.003, (0.97, 1.03)
BLOCK = 59
# ---- end of fixed values ----

PATCHES = T.ArrayType(DOUBLES)
ROWS_A_BATCH = 256  # patches that leave Python together


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_seed(seed: int, *cols) -> Column:
    return F.abs(F.xxhash64(F.lit(seed), *[_col(c) for c in cols]) % F.lit(2**62))


def augmented(spectrum, seed: Column, noise: float = NOISE_STD, dropout: float = BAND_DROPOUT, shift: float = SHIFT_STD) -> Column:
    """Gaussian noise, then random band dropout, then one common offset."""
    @F.arrow_udf(returnType=DOUBLES)
    def kernel(column: pa.Array, seeds: pa.Array) -> pa.Array:
        x, present = matrix(column)
        out = np.empty_like(x)
        for i, s in enumerate(np.asarray(seeds)[present]):
            rng = np.random.default_rng(int(s))
            kept = (x[i] + rng.normal(0.0, noise, x.shape[1])) * (rng.random(x.shape[1]) >= dropout)
            out[i] = kept + rng.normal(0.0, shift)
        return lists(out, present)
    return kernel(_col(spectrum), seed)


def seam_profile(bands: int) -> np.ndarray:
    """Bump of height 1 at the detector seam, repeated in the second block of a dual spectrum."""
    at = np.arange(bands, dtype=float)
    starts = (0, BLOCK) if bands == 2 * BLOCK else (0,)
    out = np.zeros(bands)
    for start in starts:
        bump = np.exp(-0.5 * ((at - SEAM_BAND - start) / (SEAM_FWHM / FWHM_PER_SIGMA)) ** 2)
        inside = (at >= SEAM_RANGE[0] + start) & (at <= SEAM_RANGE[1] + start)
        out = np.maximum(out, np.where(inside, bump, 0.0))
    return out


def _patch_list(patches: np.ndarray, present: np.ndarray | None = None) -> pa.Array:
    """(present rows, cells, bands) as a list column without passing through Python numbers; absent rows are NULL."""
    count, cells, bands = patches.shape
    spectra = pa.ListArray.from_arrays(pa.array(np.arange(count * cells + 1) * bands, pa.int32()), pa.array(patches.reshape(-1)))
    lengths = np.full(count, cells) if present is None else np.where(present, cells, 0)
    missing = None if present is None or present.all() else pa.array(~present)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), spectra, mask=missing)


def sensor_noise(patch, seed: Column, bands: int, size: int = 7) -> Column:
    """Gaussian noise, a detector-seam spike per patch and a bias per patch column."""
    profile, scale = seam_profile(bands), 1.0 / HULL_STD if bands == 2 * BLOCK else 1.0

    @F.arrow_udf(returnType=PATCHES)
    def kernel(column: pa.Array, seeds: pa.Array) -> pa.Array:
        out = np.empty((len(column), size * size, bands))
        for at, s in enumerate(np.asarray(seeds)):
            rng = np.random.default_rng(int(s))
            x = column[at].values.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(size, size, bands)
            x = x + rng.normal(0.0, SIGMA_GAUSS * scale, x.shape) + rng.normal(0.0, SIGMA_SPIKE * scale) * profile
            out[at] = (x + rng.normal(0.0, SIGMA_COLUMN * scale, (1, size, bands))).reshape(size * size, bands)
        return _patch_list(out)
    return kernel(_col(patch), seed)


def with_synthetic_patch(rows: DataFrame, spectrum: str, seed: Column, size: int = 7) -> DataFrame:
    """``rows`` with ``patch``: the spectrum tiled to size x size with a common scale, band jitter and pixel noise, clipped.

    A patch is size^2 times its spectrum, so patches leave Python ROWS_A_BATCH at a time.
    """
    seeded = rows.withColumn("__seed", seed)
    names = rows.columns
    at, last = names.index(spectrum), len(names)

    def kernel(column: pa.Array, seeds: pa.Array) -> pa.Array:
        x, present = matrix(column)
        out = np.empty((len(x), size * size, x.shape[1]))
        for i, s in enumerate(np.asarray(seeds)[present]):
            rng = np.random.default_rng(int(s))
            base = x[i] * rng.uniform(*SYNTH_SCALE) + rng.normal(0.0, SYNTH_JITTER, x.shape[1])
            out[i] = np.clip(base + rng.normal(0.0, SYNTH_NOISE, out.shape[1:]), 0.0, CLIP_MAX)
        return _patch_list(out) if present.all() else _patch_list(out, present)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_A_BATCH):
                part = batch.slice(start, ROWS_A_BATCH)
                yield pa.RecordBatch.from_arrays([*part.columns[:last], kernel(part.column(at), part.column(last))], names=[*names, "patch"])

    return seeded.mapInArrow(made, T.StructType([*rows.schema.fields, T.StructField("patch", PATCHES)]))


def synthetic_rows(library: DataFrame, name: str, spectrum: str, n: int, seed: int, tier: str) -> DataFrame:
    """``n`` synthetic plagioclase rows per library spectrum with their patches."""
    rows = library.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    tile = F.concat(F.lit("SYNTH_PLAG_"), F.regexp_replace(F.col(name), "[# ]", ""), F.lit("_"), F.col("copy").cast("string"))
    made = rows.select(tile.alias("tile_id"), F.lit(-1).cast("bigint").alias("polygon_id"), F.lit(-1).alias("pixel_row"), F.lit(-1).alias("pixel_col"),
                       F.col(spectrum), *[F.lit(1.0 if c == "plagioclase" else 0.0).alias(c) for c in LABELS_RAW],
                       F.lit(tier).alias("confidence_tier"), F.lit("train").alias("split"), F.col(name).alias("__name"), "copy")
    return with_synthetic_patch(made, spectrum, row_seed(seed, "__name", "copy")).drop("__name", "copy")
