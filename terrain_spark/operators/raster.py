"""Rasters as tables of pixels: slopes, stretches, warps, polygons, colours, montages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classes
from ..functions.taxonomy import BACKGROUNDS, NODATA
from .blocks import blurred, edges, gradient, sampled

#: Sides of the largest canvas, and pixels of the largest raster.
MOST_SIDE, MOST_PIXELS = 20_000, 2_000_000_000


def slope_classes(pixels: DataFrame, key: list[str], z: str = "z", spacing: float = 1.0, water: Column | None = None) -> DataFrame:
    out = gradient(pixels, key, z, spacing).withColumn("slope", classes.slope_degrees(F.col("dx"), F.col("dy")))
    return out.withColumn("topo", classes.slope_class(F.col("slope"), F.lit(False) if water is None else water)).drop("dx", "dy")


def stretch(pixels: DataFrame, key: list[str], v: str) -> DataFrame:
    """Adds ``byte``: each band from its least to its greatest value. The bounds are an aggregate that is joined, so no band is gathered in one task."""
    rows = pixels.withColumn("_v", classes.finite(F.col(v)))
    bounds = rows.groupBy(*key).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    return rows.join(bounds, key).withColumn("byte", classes.stretched(F.col("_v"), F.col("_low"), F.col("_high"))).drop("_v", "_low", "_high")


def three_bands(pixels: DataFrame) -> DataFrame:
    """Rows of map_id, x, y, bands (array) as r, g, b: one band is repeated, of two the second stands for blue too."""
    n = F.size("bands")
    get = lambda i: F.get("bands", F.lit(i))
    return pixels.select("map_id", "x", "y", get(0).alias("r"), F.when(n == 1, get(0)).otherwise(get(1)).alias("g"), F.when(n == 1, get(0)).when(n == 2, get(1)).otherwise(get(2)).alias("b"))


def nearest(target: DataFrame, source: DataFrame, value: str) -> DataFrame:
    """Values of the source pixels that target pixels (with source coordinates sx, sy) fall on; NODATA where there is none."""
    found = sampled(target, source, ["map_id"], value, nearest=True)
    return found.withColumn(value, F.coalesce(F.col(value).cast(source.schema[value].dataType), F.lit(NODATA)))


def bilinear(target: DataFrame, source: DataFrame, value: str) -> DataFrame:
    """Weighted means of the four source pixels around target places (sx, sy, centres at whole numbers).

    Beside a source's edge, or a hole in it, the pixels that are there share the weight; where there is none the value is null.
    """
    return sampled(target, source, ["map_id"], value)


def resize_places(size_from: int, size_to: int, x: str = "x") -> Column:
    """Where the centre of a target pixel lies in the source, with pixels as areas."""
    return (F.col(x) + 0.5) * (size_from / size_to) - 0.5


def rings_of(kind: Column, polygon: Column, multi: Column) -> Column:
    """Rings of a Polygon, or of all parts of a MultiPolygon; none of other kinds."""
    none = F.array().cast("array<array<array<double>>>")
    return F.when(kind == "Polygon", F.coalesce(polygon, none)).when(kind == "MultiPolygon", F.coalesce(F.flatten(multi), none)).otherwise(none)


def points_of(ring: Column) -> Column:
    """Points of a ring with two coordinates at least; others go."""
    xy = F.transform(ring, lambda p: F.when(F.size(p) >= 2, F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    return F.filter(xy, lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull())


def ring_problem(pts: Column) -> Column:
    """Why a ring is not drawn: too few points, or a side beyond the largest canvas; null where it is."""
    span = lambda c: F.array_max(F.transform(pts, lambda p: p[c])) - F.array_min(F.transform(pts, lambda p: p[c]))
    return F.when(F.coalesce(F.size(pts), F.lit(0)) < 3, "points").when((span("x") >= MOST_SIDE) | (span("y") >= MOST_SIDE), "canvas")


def undrawn(rings: DataFrame) -> DataFrame:
    """Rings (map_id, ord, pts) that ``rasterise`` leaves out, with the reason."""
    return rings.select("map_id", "ord", ring_problem(F.col("pts")).alias("reject_reason")).where("reject_reason IS NOT NULL")


def spans(rings: DataFrame, value: str) -> DataFrame:
    """Runs of pixels that rings fill: map_id, ord, value, y, first and last.

    Each edge is asked for the rows whose centres it passes and where it crosses them; the crossings of a ring and row, in order, are the
    ends of its runs. So the cost is that of edges and rows, not of boxes and vertices.
    """
    drawn = rings.where(ring_problem(F.col("pts")).isNull())
    edge = F.posexplode("pts").alias("_i", "p")
    ring = F.xxhash64("pts").alias("_ring")
    sides = drawn.select("map_id", "ord", value, "pts", ring, edge).withColumn("q", F.get("pts", F.pmod(F.col("_i") + 1, F.size("pts"))))
    row = lambda v: F.ceil(v - 0.5).cast("int")  # noqa: E731  the first row whose centre is not before v
    low, high = F.least("p.y", "q.y"), F.greatest("p.y", "q.y")
    crossed = sides.where(row(high) > row(low)).select("map_id", "ord", value, "_ring", "_i", "p", "q", F.explode(F.sequence(row(low), row(high) - 1)).alias("y"))
    p, q = F.col("p"), F.col("q")
    x = (q["x"] - p["x"]) * (F.col("y") + 0.5 - p["y"]) / (q["y"] - p["y"]) + p["x"]
    # a ring that comes twice crosses at the same places of the same edges
    places = F.array_sort(F.transform(F.collect_set(F.struct("_i", "_x")), lambda e: e["_x"]))
    ends = crossed.select("map_id", "ord", value, "_ring", "_i", "y", x.alias("_x")).groupBy("map_id", "ord", "_ring", "y").agg(F.any_value(value).alias(value), places.alias("_c"))
    pair = F.transform(F.sequence(F.lit(0), (F.size("_c") / 2).cast("int") - 1), lambda i: F.struct(row(F.get("_c", i * 2)).alias("first"), (row(F.get("_c", i * 2 + 1)) - 1).alias("last")))
    return ends.select("map_id", "ord", value, "y", F.inline(pair)).where("last >= first")


def rasterise(rings: DataFrame, value: str, side: int = 256) -> DataFrame:
    """Pixels of filled rings: map_id, x, y and the value of the last feature that covers the pixel's centre.

    ``rings``: map_id, ord, value, pts (array of struct x, y) in pixels. Holes are filled like other rings. A
    pixel is inside if a ray from its centre crosses the ring an odd number of times. Runs are cut at the edges of blocks, and each block is
    painted in the order of the features. ``undrawn`` gives the rings that are left out.
    """
    runs = spans(rings, value)
    at = lambda c: F.floor(F.col(c) / side).cast("int")
    cut = runs.select("map_id", "ord", value, "y", "first", "last", at("y").alias("_by"), F.explode(F.sequence(at("first"), at("last"))).alias("_bx"))
    schema = T.StructType([cut.schema["map_id"], T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), cut.schema[value]])

    def paint(table: pa.Table) -> pa.Table:
        left, top = table.column("_bx")[0].as_py() * side, table.column("_by")[0].as_py() * side
        turn = np.argsort(table.column("ord").to_numpy(), kind="stable")
        y = table.column("y").to_numpy() - top
        first, last = np.maximum(table.column("first").to_numpy() - left, 0), np.minimum(table.column("last").to_numpy() - left, side - 1)
        shown = np.full((side, side), -1)
        for i, r, a, b in zip(turn.tolist(), y[turn].tolist(), first[turn].tolist(), last[turn].tolist(), strict=True):
            shown[r, a : b + 1] = i
        py, px = np.nonzero(shown >= 0)
        which = pa.array(shown[py, px])
        return pa.table([table.column("map_id").take(which), pa.array((px + left).astype(np.int32)), pa.array((py + top).astype(np.int32)), table.column(value).take(which)], names=schema.names)

    return cut.groupBy("map_id", "_bx", "_by").applyInArrow(paint, schema)


def canvas_ok(width: Column, height: Column) -> Column:
    return width.between(1, MOST_SIDE) & height.between(1, MOST_SIDE)


def raster_ok(width: Column, height: Column) -> Column:
    return width.cast("bigint") * height <= MOST_PIXELS


def colourised(pixels: DataFrame, palette: DataFrame, label: str = "lc") -> DataFrame:
    """r, g, b of each pixel's class; black for others."""
    look = palette.select(F.col("lc").alias("_lc"), "r", "g", "b")
    return pixels.join(F.broadcast(look), F.col(label) == F.col("_lc"), "left").drop("_lc").withColumns({c: F.coalesce(c, F.lit(0)) for c in "rgb"})


def montage(images: DataFrame, rows: int, cols: int, tile: int, padding: int) -> DataFrame:
    """Places of grid cells: cell, image (in turn), left, top. ``images``: one row with n."""
    cells = images.select("*", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))).alias("cell"))
    return cells.where("n > 0").select(*images.columns, "cell", F.pmod(F.col("cell"), F.col("n")).alias("image"), (F.pmod(F.col("cell"), F.lit(cols)) * (tile + padding) + padding).alias("left"), (F.floor(F.col("cell") / cols).cast("int") * (tile + padding) + padding).alias("top"))


def masked_water(pixels: DataFrame) -> DataFrame:
    """Topography of water is unknown."""
    return pixels.withColumn("topo", F.when(F.col("lc") == 0, NODATA).otherwise(F.coalesce("topo", F.lit(NODATA))))


def aged(pixels: DataFrame, seed: int = 42, deviation: float = 6.0, radius: float = 0.6) -> DataFrame:
    """Images (map_id, x, y, r, g, b) as on parchment: sepia, tint, seeded noise, blur."""
    noise = classes.gaussian(seed, F.col("map_id"), F.col("x"), F.col("y")) * deviation
    tinted = classes.parchment(F.col("r"), F.col("g"), F.col("b"), noise)
    toned = pixels.select("map_id", "x", "y", *[v.cast("double").alias(c) for v, c in zip(tinted, "rgb", strict=True)])
    return blurred(toned, radius, ["r", "g", "b"])


def bordered(pixels: DataFrame, feature: str, colour: tuple[int, int, int] | None, width: int = 1) -> DataFrame:
    """The outermost ``width`` pixels of each feature, inside it, take the border's colour."""
    if colour is None or width < 1:
        return pixels
    return edges(pixels, feature, width).withColumns({c: F.when(F.col("edge"), v).otherwise(F.col(c)) for c, v in zip("rgb", colour, strict=True)}).drop("edge")


def on_background(pixels: DataFrame, canvas: DataFrame, style: str) -> DataFrame:
    """Every pixel of the canvases (map_id, min_x, min_y, width, height) with its colour, that of the style's background where nothing is drawn."""
    steps = lambda low, n: F.explode(F.sequence(F.col(low).cast("int"), (F.col(low) + F.col(n)).cast("int") - 1))
    every = canvas.select("map_id", "min_x", "width", steps("min_y", "height").alias("y")).select("map_id", steps("min_x", "width").alias("x"), "y")
    joined = every.join(pixels.select("map_id", "x", "y", "r", "g", "b"), ["map_id", "x", "y"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zip("rgb", BACKGROUNDS[style], strict=True)})


def covered(pixels: DataFrame, coverage: DataFrame, value: list[str]) -> DataFrame:
    """Values of pixels that the source covers, NODATA of others, and ``valid``."""
    marks = coverage.select("map_id", "x", "y", F.lit(True).alias("_c")).distinct()
    joined = pixels.join(marks, ["map_id", "x", "y"], "left").withColumn("valid", F.coalesce("_c", F.lit(False))).drop("_c")
    return joined.withColumns({v: F.when(F.col("valid"), F.col(v)).otherwise(NODATA) for v in value})


def decimated_counts(pixels: DataFrame, step: int, label: str, n: int = 9, flipped: bool = False) -> DataFrame:
    """Class counts of the nine 1° cells of each 3° tile (lat_sw, lon_sw) from every ``step``-th pixel (x, y in 0..3*step*step).

    The first row of a tile is its northern edge; ``flipped`` counts bands from the south as if it were not.
    """
    side = step * step
    some = pixels.where((F.col("x") % step == 0) & (F.col("y") % step == 0))
    band, col = F.floor(F.col("y") / side).cast("int"), F.floor(F.col("x") / side).cast("int")
    cells = some.select((F.col("lat_sw") + (band if flipped else 2 - band)).alias("lat"), (F.col("lon_sw") + col).alias("lon"), label)
    counts = F.array(*[F.count_if(F.col(label) == i) for i in range(n)])
    return cells.groupBy("lat", "lon").agg(counts.alias("counts")).where(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x) > 0)


def canvas(rings: DataFrame) -> DataFrame:
    """Bounds and size of each map's canvas over all points of its rings (map_id, pts), and why it can't be drawn."""
    points = rings.select("map_id", F.explode("pts").alias("p"))
    box = points.groupBy("map_id").agg(F.min("p.x").alias("min_x"), F.min("p.y").alias("min_y"), F.max("p.x").alias("max_x"), F.max("p.y").alias("max_y"))
    sized = box.withColumn("width", (F.col("max_x") - F.col("min_x")).cast("int") + 1).withColumn("height", (F.col("max_y") - F.col("min_y")).cast("int") + 1)
    return sized.withColumn("reject_reason", F.when(~canvas_ok(F.col("width"), F.col("height")), "canvas"))


def densified_bounds(boxes: DataFrame, project, points: int = 21) -> DataFrame:  # noqa: ANN001
    """Bounds in degrees of projected boxes (left, bottom, right, top) from points along their edges.

    ``project`` gives longitude and latitude columns for x and y columns. Bounds that cross the antimeridian are
    marked, as tiles between them can't be listed.
    """
    share = F.sequence(F.lit(0), F.lit(points + 1))
    along = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * i / (points + 1)
    edge = F.flatten(F.transform(share, lambda i: F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((along("left", "right", i), F.col("bottom")), (along("left", "right", i), F.col("top")), (F.col("left"), along("bottom", "top", i)), (F.col("right"), along("bottom", "top", i)))])))
    rows = boxes.select("*", F.explode(edge).alias("_p"))
    lon, lat = project(F.col("_p.x"), F.col("_p.y"))
    out = rows.groupBy(*boxes.columns).agg(F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"))
    return out.withColumn("reject_reason", F.when(F.col("west") > F.col("east"), "antimeridian"))
