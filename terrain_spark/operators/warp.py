"""Labels of georeferenced maps by a true warp.

A map's pixels go through its affine and the inverse of its projection to degrees. Cover codes are read there from the world's mosaic of tiles, at the
nearest pixel. Heights are read bilinearly at the pixels of a grid in metres around the map's centre (Lambert equal-area), so that slopes
are those of the ground; the classes of that grid are read back at the map's pixels. Source tiles that no map touches are left out before any pixel is
shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classes, geo
from . import assembly, raster
from .blocks import sampled
from .spread import spread

#: EPSG codes of the projections that maps may have.
GEOGRAPHIC, MERCATOR = 4326, 3857
AFFINE = ["a", "b", "c", "d", "e", "f"]


@dataclass(frozen=True)
class Grid:
    """Tiles of ``step`` degrees named by their south-west corner, each with ``n`` by ``n`` pixels, the first row in the north."""

    step: int
    n: int

    @property
    def size(self) -> float:
        return self.step / self.n

    def place(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Where a place lies on the world's pixels, whose edges are at whole numbers."""
        return (lon + 180.0) / self.size, (90.0 - lat) / self.size

    def of_tile(self, lat_sw: Column, lon_sw: Column, x: Column, y: Column) -> tuple[Column, Column]:
        """The world's pixel of a tile's."""
        return (lon_sw + 180) / self.step * self.n + x, (90 - self.step - lat_sw) / self.step * self.n + y


def degrees(epsg: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a place in a map's own system; null in one that is not known."""
    lon, lat = geo.mercator_degrees(x, y)
    known = lambda a, b: F.when(epsg == GEOGRAPHIC, a).when(epsg == MERCATOR, b)
    return known(x, lon), known(y, lat)


def _grid_pixels(maps: DataFrame, width: str, height: str) -> DataFrame:
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    return maps.where((F.col(width) > 0) & (F.col(height) > 0)).select("*", steps(height).alias("y")).select("*", steps(width).alias("x"))


def map_pixels(maps: DataFrame) -> DataFrame:
    """map_id, x, y, lon and lat of the centres of each map's pixels. ``maps``: map_id, epsg, width, height, affine a to f."""
    px, py = F.col("x") + 0.5, F.col("y") + 0.5
    u, v = assembly.world(*[F.col(c) for c in AFFINE], px, py)
    rows = _grid_pixels(maps, "width", "height").select("map_id", "x", "y", "epsg", u.alias("_u"), v.alias("_v"))
    lon, lat = degrees(F.col("epsg"), F.col("_u"), F.col("_v"))
    return rows.select("map_id", "x", "y", lon.alias("lon"), lat.alias("lat"))


def bounds(maps: DataFrame, points: int = 21) -> DataFrame:
    """map_id, west, south, east and north, from points along the edges, and a ``reject_reason`` where tiles between them can't be listed."""
    share = F.sequence(F.lit(0), F.lit(points + 1))
    at = lambda px, py: F.struct(px.cast("double").alias("px"), py.cast("double").alias("py"))
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    edge = F.flatten(F.transform(share, lambda i: F.array(at(w * i / (points + 1), F.lit(0.0)), at(w * i / (points + 1), h), at(F.lit(0.0), h * i / (points + 1)), at(w, h * i / (points + 1)))))
    rows = maps.select("map_id", "epsg", *AFFINE, F.explode(edge).alias("p"))
    u, v = assembly.world(*[F.col(c) for c in AFFINE], F.col("p.px"), F.col("p.py"))
    lon, lat = degrees(F.col("epsg"), u, v)
    box = rows.groupBy("map_id").agg(F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"))
    return box.withColumn("reject_reason", F.when(F.col("west").isNull() | F.col("south").isNull(), "projection").when((F.col("west") < -180) | (F.col("east") > 180), "antimeridian").when((F.col("south") < -90) | (F.col("north") > 90), "latitude"))


def tile_list(boxes: DataFrame, grid: Grid) -> DataFrame:
    """lat_sw and lon_sw of the tiles that any box touches, with one around each for the pixels beside its edge."""
    span = lambda low, high: geo.tiles_between(F.col(low) - grid.size, F.col(high) + grid.size, grid.step)
    return boxes.select(F.explode(span("south", "north")).alias("lat_sw"), "west", "east").select("lat_sw", F.explode(span("west", "east")).alias("lon_sw")).distinct()


def world_mosaic(pixels: DataFrame, grid: Grid, needed: DataFrame, value: str, nodata: float | None = None) -> DataFrame:
    """x, y and value of the world's pixels from those of the needed tiles (lat_sw, lon_sw, x, y, value); where files of a tile repeat, the first by ``tile_id``."""
    some = pixels.join(needed, ["lat_sw", "lon_sw"], "left_semi")
    x, y = grid.of_tile(F.col("lat_sw"), F.col("lon_sw"), F.col("x"), F.col("y"))
    placed = some.select("tile_id", x.cast("int").alias("x"), y.cast("int").alias("y"), F.col(value))
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    if nodata is not None:
        known = known & (F.col(value) != nodata)
    return placed.where(known).groupBy("x", "y").agg(F.min_by(value, "tile_id").alias(value))


def metric_grids(boxes: DataFrame, spacing: float, points: int = 21) -> DataFrame:
    """For each box of degrees a grid in metres around its centre: lon0, lat0, left, top (metres), and its width and height in pixels."""
    centred = boxes.withColumn("lon0", (F.col("west") + F.col("east")) / 2).withColumn("lat0", (F.col("south") + F.col("north")) / 2)
    share = F.sequence(F.lit(0), F.lit(points + 1))
    part = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * i / (points + 1)
    at = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    edge = F.flatten(F.transform(share, lambda i: F.array(at(part("west", "east", i), F.col("south")), at(part("west", "east", i), F.col("north")), at(F.col("west"), part("south", "north", i)), at(F.col("east"), part("south", "north", i)))))
    rows = centred.select("map_id", "lon0", "lat0", F.explode(edge).alias("p"))
    x, y = geo.laea(F.col("p.lon"), F.col("p.lat"), F.col("lon0"), F.col("lat0"))
    size = rows.groupBy("map_id", "lon0", "lat0").agg(F.min(x).alias("left"), F.max(x).alias("_right"), F.max(y).alias("top"), F.min(y).alias("_bottom"))
    cells = lambda a, b: (F.floor((F.col(a) - F.col(b)) / spacing) + 1).cast("int")
    return size.select("map_id", "lon0", "lat0", "left", "top", cells("_right", "left").alias("m_width"), cells("top", "_bottom").alias("m_height"))


def labels(maps: DataFrame, cover: DataFrame, cover_grid: Grid, heights: DataFrame, height_grid: Grid, spacing: float) -> DataFrame:
    """map_id, x, y, lc and topo of every pixel of the maps that can be placed (see ``bounds``).

    ``cover``: tile_id, lat_sw, lon_sw, x, y, code, 0 being none; ``heights``: the same with z. ``spacing``: metres of a pixel of the grid on which slopes
    are taken. Water, unknown cover and ground without heights have no topography.
    """
    maps = spread(maps, "map_id")
    boxes = bounds(maps).where("reject_reason IS NULL")
    pixels = map_pixels(maps.join(boxes.select("map_id"), "map_id", "left_semi"))
    gx, gy = cover_grid.place(F.col("lon"), F.col("lat"))
    codes = world_mosaic(cover, cover_grid, tile_list(boxes, cover_grid), "code", 0)
    coded = sampled(pixels.withColumns({"sx": gx, "sy": gy}), codes, [], "code", nearest=True)
    coded = coded.select("map_id", "x", "y", "lon", "lat", classes.from_world_cover(F.col("code").cast("int")).alias("lc"))

    grids = metric_grids(boxes, spacing)
    ground = _grid_pixels(spread(grids, "map_id"), "m_width", "m_height")
    lon, lat = geo.laea_degrees(F.col("left") + (F.col("x") + 0.5) * spacing, F.col("top") - (F.col("y") + 0.5) * spacing, F.col("lon0"), F.col("lat0"))
    hx, hy = height_grid.place(lon, lat)
    z = world_mosaic(heights, height_grid, tile_list(boxes, height_grid), "z")
    raised = sampled(ground.select("map_id", "x", "y", (hx - 0.5).alias("sx"), (hy - 0.5).alias("sy")), z, [], "z")
    slopes = raster.slope_classes(raised.select("map_id", "x", "y", "z"), ["map_id"], "z", spacing).select("map_id", "x", "y", "topo")

    mx, my = geo.laea(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"))
    on_ground = coded.join(grids.select("map_id", "lon0", "lat0", "left", "top"), "map_id").withColumns({"sx": (mx - F.col("left")) / spacing, "sy": (F.col("top") - my) / spacing})
    both = sampled(on_ground.select("map_id", "x", "y", "lc", "sx", "sy"), slopes, ["map_id"], "topo", nearest=True)
    topo = F.when(F.col("lc").isin(0, classes.NODATA), classes.NODATA).otherwise(F.coalesce(F.col("topo").cast("int"), F.lit(classes.NODATA)))
    return both.select("map_id", "x", "y", "lc", topo.alias("topo"))
