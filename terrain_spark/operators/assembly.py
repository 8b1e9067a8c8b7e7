"""Labels of georeferenced maps: mosaics of source tiles, sampled at a map's pixels, and joined to land cover and topography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classes
from . import raster


def mosaic(tiles: DataFrame, pixels: DataFrame, value: str, nodata: float | None = None) -> DataFrame:
    """map_id, x, y and value of the tiles' pixels on one grid; where tiles overlap, the first one by tile_id that has a value counts.

    ``tiles``: map_id, tile_id, left, top; ``pixels``: tile_id, x, y, value. Null, NaN and ``nodata`` are no values; a pixel that has none in any
    tile is null. Overlaps are resolved by an aggregate with partial results, so no tile is gathered in a task.
    """
    placed = pixels.join(tiles, "tile_id").select("map_id", (F.col("left") + F.col("x")).cast("int").alias("x"), (F.col("top") + F.col("y")).cast("int").alias("y"), "tile_id", F.col(value))
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    if nodata is not None:
        known = known & (F.col(value) != nodata)
    return placed.groupBy("map_id", "x", "y").agg(F.min_by(F.when(known, F.col(value)), F.when(known, F.col("tile_id"))).alias(value))


def filled(pixels: DataFrame, value: str, fill: float = 0.0) -> DataFrame:
    """Heights without NaN and infinities."""
    v = F.col(value)
    return pixels.withColumn(value, F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), fill).otherwise(v))


def georeferenced_labels(target: DataFrame, cover: DataFrame, heights: DataFrame, spacing: float) -> DataFrame:
    """map_id, x, y, lc and topo of a map's pixels.

    ``target``: map_id, x, y and source coordinates sx, sy; ``cover``: a mosaic of cover codes (``code``), read at the nearest
    pixel; ``heights``: a mosaic of heights (``z``), read bilinearly, from which slopes are made. Water and unknown cover have no topography.
    """
    code = raster.nearest(target, cover, "code").select("map_id", "x", "y", classes.from_world_cover(F.col("code")).alias("lc"))
    z = raster.bilinear(target, filled(heights, "z"), "z").select("map_id", "x", "y", "z")
    sloped = raster.slope_classes(z, ["map_id"], "z", spacing)
    both = code.join(sloped, ["map_id", "x", "y"], "left")
    unknown = F.col("lc") == classes.NODATA
    return raster.masked_water(both).select("map_id", "x", "y", "lc", F.when(unknown, classes.NODATA).otherwise(F.col("topo")).alias("topo"))


def world(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column, px: Column, py: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a pixel."""
    return a * px + b * py + c, d * px + e * py + f


def pixel(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column, lng: Column, lat: Column) -> tuple[Column, Column]:
    """The pixel of a longitude and latitude; null where the affine has no inverse."""
    det = a * e - b * d
    return F.try_divide(e * (lng - c) - b * (lat - f), det), F.try_divide(a * (lat - f) - d * (lng - c), det)


__all__ = ["filled", "georeferenced_labels", "mosaic", "pixel", "world"]
