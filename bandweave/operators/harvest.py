"""Patches at listed pixels and mean spectra of polygons found by their footprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import masks as M
from ..functions.geo import polygon_pixels, ring_centroid
from .aggregates import polygon_means
from .grid import C, R, T, patches
from .joins import first_containing
from .sampling import cap_per_group


def harvest_points(points: DataFrame, grid: DataFrame, spectrum: str, bands: int, row_key: list[str], per_tile: int | None, seed: int, size: int = 7) -> DataFrame:
    """Listed pixels with the ``patch`` of clipped spectra around each; nodata and what lies beyond the tile are 0.

    Tile names meet in lower case. At most ``per_tile`` points of a tile, in hash order of ``row_key``, are tried;
    those without a tile, out of its bounds or with a missing band at the centre are left out afterwards, so they use up
    places. A pixel that is listed twice is harvested twice.
    """
    listed = cap_per_group(points.withColumn(T, F.lower(T)), [T], row_key, per_tile, seed)
    cells = grid.withColumn(T, F.lower(T))
    whole = cells.where(F.col(spectrum).isNotNull() & ~F.exists(M.sanitize(spectrum, clip=None, fill=None), lambda x: x.isNull()))
    centres = whole.join(listed.select(T, R, C).distinct(), [T, R, C], "left_semi").select(T, R, C)
    made = patches(centres, cells.withColumn(spectrum, M.sanitize(spectrum, fill=0.0)), spectrum, bands, size)
    return listed.join(made, [T, R, C])


def footprint_means(polygons: DataFrame, tiles: DataFrame, grid: DataFrame, key: str, spectrum: str, bands: int, order: str = T, size: float = 5.0) -> DataFrame:
    """Mean spectrum of each polygon (``ring`` in degrees, x east and y north) over the valid pixels of the tile that holds it.

    The tile is the first by ``order`` whose box (x0, y0, x1, y1) contains the polygon's centroid; ``height`` and
    ``width`` are its pixels. Pixels count whose centre is inside and whose bands are all known. Polygons without a tile
    have none, those without such pixels have a tile and no spectrum.
    """
    centre = ring_centroid("ring")
    placed = first_containing(polygons.select(key, "ring", centre["x"].alias("x"), centre["y"].alias("y")), tiles.select(order, "x0", "y0", "x1", "y1"), key, order, size)
    held = placed.select(key, "ring", order).join(tiles, order)
    pixel = F.transform("ring", lambda p: F.struct(((p["x"] - F.col("x0")) / (F.col("x1") - F.col("x0")) * F.col("width")).alias("x"),
                                                   ((F.col("y1") - p["y"]) / (F.col("y1") - F.col("y0")) * F.col("height")).alias("y")))
    inside = polygon_pixels(held.select(key, T, pixel.alias("ring")))
    known = grid.where(F.col(spectrum).isNotNull() & ~F.exists(M.sanitize(spectrum, clip=None, fill=None), lambda x: x.isNull()))
    mean = polygon_means(inside.join(known.select(T, R, C, spectrum), [T, R, C]), [key], bands, spectrum)
    return placed.select(key, order).join(mean, key, "left").withColumn("n_px", F.coalesce("n_px", F.lit(0)))
