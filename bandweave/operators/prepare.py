"""Composed preparations: row filters by split and tier, spectrum pools, centroids, spectra ready for angles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import masks as M, spectral as S
from .aggregates import mean_spectrum
from .grid import patches
from .sampling import cap_per_group

# ---- fixed values: must equal the reference's for right results ----
POOL_LABEL = 0.4
POOL_TIERS = ("High", "Moderate")
CENTROID_LABEL = 0.7
# ---- end of fixed values ----


def by_split_and_tier(df: DataFrame, splits: list[str], tiers: list[str]) -> DataFrame:
    """Rows of the splits and tiers, with ``olivine`` as the larger of its two types."""
    return df.where(F.col("split").isin(*splits) & F.col("confidence_tier").isin(*tiers)).withColumn(
        "olivine", F.greatest("olivine_t1", "olivine_t2"))


def positives(df: DataFrame, labels: list[str], above: float, tiers: tuple[str, ...], strict: bool = True) -> DataFrame:
    """One row per positive label of each row of the tiers, its name as ``class``."""
    hit = [F.when(F.col(c) > above if strict else F.col(c) >= above, F.lit(c)) for c in labels]
    return df.where(F.col("confidence_tier").isin(*tiers)).withColumn("class", F.explode(F.array_compact(F.array(*hit))))


def spectrum_pool(df: DataFrame, labels: list[str], source: str, row_key: list[str], n: int | None, seed: int,
                  tiers: tuple[str, ...] = POOL_TIERS) -> DataFrame:
    """Positive spectra per class and source, at most ``n`` of each in hash order; None takes all."""
    return cap_per_group(positives(df, labels, POOL_LABEL, tiers), ["class", source], row_key, n, seed)


def class_centroids(df: DataFrame, labels: list[str], row_key: list[str], bands: int, per_class: int, seed: int,
                    embedding: str = "spectrum", splits: tuple[str, ...] = ("train",), tier: str = "High") -> DataFrame:
    """(class, centroid, n_pixels): mean embedding of sure positives; a class without any is absent."""
    sure = positives(df.where(F.col("split").isin(*splits)), labels, CENTROID_LABEL, (tier,), strict=False)
    taken = cap_per_group(sure, ["class"], row_key, per_class, seed)
    return taken.groupBy("class").agg(mean_spectrum(embedding, bands).alias("centroid"), F.count(F.lit(1)).alias("n_pixels"))


def ready_for_angles(df: DataFrame, spectrum: str, wavelengths: list[float] | None = None, keep: list[int] | None = None,
                     floor: float | None = S.FLAT_LEVEL) -> DataFrame:
    """Complete spectra only: nodata masked, hull removed, good bands kept. Values are never clipped: clipping bends a spectrum."""
    clean = df.withColumn(spectrum, M.sanitize(spectrum, phys_max=None, clip=None, fill=None)).where(~F.exists(spectrum, lambda x: x.isNull()))
    removed = clean.withColumn(spectrum, S.hull_removed(spectrum, wavelengths, keep, floor))
    return removed.withColumn(spectrum, S.take_bands(spectrum, keep if keep is not None else S.good_bands()))


def continuum_patches(centres: DataFrame, grid: DataFrame, spectrum: str, bands: int, size: int = 7,
                      wavelengths: list[float] | None = None, keep: list[int] | None = None, floor: float | None = S.FLAT_LEVEL) -> DataFrame:
    """Patches of hull-removed spectra and the ``brightness`` of their centre.

    Every grid cell meets its hull once, before the patches are cut, not once for each patch that
    holds it. Cells outside the tile are flat and therefore 1.
    """
    place = ["tile_id", "pixel_row", "pixel_col"]
    removed = grid.select(*place, S.hull_removed(spectrum, wavelengths, keep, floor).alias("__cr"))
    bright = grid.select(*place, S.brightness(spectrum, keep).alias("brightness"))
    return patches(centres, removed, "__cr", bands, size, outside=1.0).join(bright, place, "left")
