"""Rasters by block against numpy over whole arrays, scanlines, warps, and the cases that once gave wrong rows."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrain_spark.functions import geo
from terrain_spark.functions.taxonomy import BACKGROUNDS, LAND_COVER, PALETTES, source_weights, values
from terrain_spark.operators import assembly, blocks, metrics, pyramid, raster, samples, warp
from terrain_spark.plans import catalogue, lifecycles

SF = "/root/testdata/sf0.001"
RING = "map_id string, ord int, lc int, pts array<struct<x: double, y: double>>"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_slopes_take_one_shuffle(spark):
    assert exchanges(catalogue.slope_classes(spark, SF)) == 1


@pytest.mark.parametrize("radius", [0.6, 1.5])
def test_blur_over_block_edges(spark, radius):
    image = np.random.default_rng(1).uniform(0, 255, (15, 19))
    there = np.random.default_rng(2).uniform(size=image.shape) > 0.15
    px = spark.createDataFrame([(1, int(x), int(y), float(image[y, x])) for y, x in zip(*np.nonzero(there), strict=True)], "map_id int, x int, y int, r double")
    out = blocks.blurred(px, radius, ["r"], 8)
    assert exchanges(out) == 1
    reach = math.ceil(3 * radius)
    for r in out.collect():
        total = weight = 0.0
        for i in range(-reach, reach + 1):
            for j in range(-reach, reach + 1):
                x, y = r.x + i, r.y + j
                if 0 <= x < 19 and 0 <= y < 15 and there[y, x]:
                    w = math.exp(-(i * i + j * j) / (2 * radius * radius))
                    total, weight = total + w * image[y, x], weight + w
        assert r.r == pytest.approx(total / weight)


@pytest.mark.parametrize("width", [1, 2, 3])
def test_borders_grow_inwards(spark, width):
    """A feature of 12 x 12 pixels, another that touches it, and one alone, over blocks of 8."""
    rows = [(1, x, y, 1) for x in range(12) for y in range(12)] + [(1, x, y, 2) for x in range(12, 15) for y in range(12)] + [(1, 30, 30, 1)]
    df = spark.createDataFrame(rows, "map_id int, x int, y int, lc int")
    got = {(r.x, r.y): r.edge for r in blocks.edges(df, "lc", width, 8).collect()}
    for _, x, y, lc in rows:
        inside = min(x, y, 11 - x, 11 - y) if lc == 1 and x < 12 else min(x - 12, 14 - x, y, 11 - y)
        assert got[x, y] == (x == 30 or inside < width)


def test_a_ring_of_ten_thousand_vertices(spark):
    """A comb as wide as a canvas may be: the cost is that of its edges and rows."""
    n, wide, high = 10_000, 19_999.0, 12.0
    comb = [(wide * i / n, high if i % 2 else 3.0) for i in range(n + 1)] + [(wide, 0.0), (0.0, 0.0)]
    df = spark.createDataFrame([("m", 0, 5, comb)], RING)
    began = time.time()
    got = np.array(raster.rasterise(df, "lc").select("x", "y").toPandas())
    assert time.time() - began < 30
    x, y = np.meshgrid(np.arange(19_999), np.arange(12))
    tooth = wide / n
    at = (x + 0.5) % (2 * tooth)
    top = np.where(at < tooth, 3 + (high - 3) * at / tooth, 3 + (high - 3) * (2 - at / tooth))
    inside = y + 0.5 < top
    assert abs(len(got) - inside.sum()) <= 2 * 12 and len(np.unique(got, axis=0)) == len(got)


def test_rings_that_are_not_drawn_have_a_reason(spark):
    rows = [("m", 0, 1, [(0.0, 0.0), (30_000.0, 0.0), (0.0, 5.0)]), ("m", 1, 2, [(0.0, 0.0), (1.0, 1.0)]), ("m", 2, 3, None), ("m", 3, 4, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])]
    df = spark.createDataFrame(rows, RING)
    assert {(r.ord, r.reject_reason) for r in raster.undrawn(df).collect()} == {(0, "canvas"), (1, "points"), (2, "points")}
    assert {(r.x, r.y, r.lc) for r in raster.rasterise(df, "lc").collect()} == {(x, y, 4) for x in range(4) for y in range(4)}


def test_fills_equal_the_crossing_rule(spark):
    """Stars that cross themselves, far apart and negative places, a ring that comes twice, over block edges."""
    rng = np.random.default_rng(5)
    rows = [("m", k, k, [(float(x), float(y)) for x, y in rng.uniform(-20, 300, (9, 2))]) for k in range(4)]
    rows += [("m", 9, 9, [(250.0, 250.0), (270.0, 250.0), (270.0, 262.0), (250.0, 262.0)])] * 2
    got = {(r.x, r.y): r.lc for r in raster.rasterise(spark.createDataFrame(rows, RING), "lc").collect()}
    want = {}
    gx, gy = np.meshgrid(np.arange(-25, 305) + 0.5, np.arange(-25, 305) + 0.5)
    for _, k, lc, pts in rows:
        odd = np.zeros(gx.shape, bool)
        for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1], strict=True):
            if ay != by:
                odd ^= ((ay > gy) != (by > gy)) & (gx < (bx - ax) * (gy - ay) / (by - ay) + ax)
        want |= {(int(x), int(y)): lc for x, y in zip(np.floor(gx[odd]), np.floor(gy[odd]), strict=True)}
    assert got == want


def test_styles(spark):
    px = spark.createDataFrame([("m", x, y, 3) for x in range(8) for y in range(8)], "map_id string, x int, y int, lc int")
    canvas = spark.createDataFrame([("m", -1.0, 0.0, 10, 8)], "map_id string, min_x double, min_y double, width int, height int")
    got = {(r.x, r.y): (r.r, r.g, r.b) for r in lifecycles.rendered(px, "illustrated", canvas).collect()}
    fill = PALETTES["illustrated"][3]
    assert len(got) == 80 and got[-1, 0] == BACKGROUNDS["illustrated"] and got[1, 4] == (80, 65, 45) and got[2, 4] == tuple(fill)
    assert lifecycles.rendered(px, "satellite").count() == 64
    with pytest.raises(ValueError, match="no style ink"):
        lifecycles.rendered(px, "ink")


def test_mosaic_takes_the_first_value_that_is_one(spark):
    tiles = values(spark, "map_id, tile_id, left, top", [(1, 1, 0, 0), (1, 2, 0, 0), (1, 3, 0, 0)])
    px = spark.createDataFrame([(1, 0, 0, None), (2, 0, 0, 7.0), (3, 0, 0, 9.0), (1, 1, 0, float("nan")), (2, 1, 0, 8.0), (1, 2, 0, 0.0), (3, 2, 0, 5.0), (2, 3, 0, None)], "tile_id int, x int, y int, z double")
    assert {r.x: r.z for r in assembly.mosaic(tiles, px, "z").collect()} == {0: 7.0, 1: 8.0, 2: 0.0, 3: None}
    assert {r.x: r.z for r in assembly.mosaic(tiles, px, "z", 0).collect()} == {0: 7.0, 1: 8.0, 2: 5.0, 3: None}


def test_places_between_pixels(spark):
    """Means of what is there; null off the source and in holes; one source block asked by very many pixels of a map."""
    source = values(spark, "k, x, y, z", [(1, x, y, 10.0 * x + y) for x in range(70) for y in range(3) if (x, y) != (5, 1)])
    places = [(1, 1, 0, 0, 63.5, 1.0), (1, 1, 1, 0, -0.25, 0.0), (1, 1, 2, 0, -5.0, 0.0), (1, 1, 3, 0, 5.0, 1.0), (1, 1, 4, 0, 4.5, 1.0), (1, 1, 5, 0, None, 1.0), (2, 1, 6, 0, 1.0, 1.0)]
    target = spark.createDataFrame(places, "k int, map_id int, x int, y int, sx double, sy double")
    got = {r.x: r.z for r in blocks.sampled(target, source, ["k"], "z").collect()}
    assert got == {0: 636.0, 1: 0.0, 2: None, 3: None, 4: 41.0, 5: None, 6: None}
    fine = spark.range(300).selectExpr("1 AS k", "1 AS map_id", "cast(id AS int) AS x").crossJoin(spark.range(200).selectExpr("cast(id AS int) AS y")).selectExpr("*", "x / 300.0D AS sx", "y / 200.0D AS sy")
    assert fine.count() == blocks.sampled(fine, source, ["k"], "z").where("abs(z - 10 * sx - sy) < 1e-9").count()


def test_equal_area_and_back(spark):
    rows = spark.createDataFrame([(lon, lat, 12.0, 47.0) for lon in (-20.0, 12.0, 13.5, 40.0) for lat in (-5.0, 47.0, 47.3, 80.0)], "lon double, lat double, lon0 double, lat0 double")
    x, y = geo.laea(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"))
    back = geo.laea_degrees(F.col("px"), F.col("py"), F.col("lon0"), F.col("lat0"))
    for r in rows.withColumns({"px": x, "py": y}).select("lon", "lat", back[0].alias("a"), back[1].alias("b")).collect():
        assert (r.a, r.b) == pytest.approx((r.lon, r.lat), abs=1e-6)


def test_warped_labels_hold_every_class_of_slope(spark):
    out = catalogue.warped_labels(spark, "/root/testdata/sf0.01")
    assert {r.topo for r in out.select("topo").distinct().collect()} == {0, 1, 255} | ({2} if out.where("topo = 2").count() else set())
    assert out.select("lc").distinct().count() > 8
    known = out.select("map_id").distinct().count()
    assert known == catalogue._warped_maps(spark, "/root/testdata/sf0.01").where("epsg <> 32633").count()


def test_maps_that_cannot_be_placed(spark):
    cols = "map_id int, epsg int, width int, height int, a double, b double, c double, d double, e double, f double"
    maps = spark.createDataFrame([(1, 4326, 4, 4, 1.0, 0.0, 178.0, 0.0, -1.0, 10.0), (2, 32633, 4, 4, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0), (3, 4326, 4, 4, 1.0, 0.0, 10.0, 0.0, -1.0, 91.0), (4, 4326, 2, 2, 0.5, 0.1, 10.0, 0.1, -0.5, 41.0)], cols)
    got = {r.map_id: r for r in warp.bounds(maps).collect()}
    assert {k: r.reject_reason for k, r in got.items()} == {1: "antimeridian", 2: "projection", 3: "latitude", 4: None}
    assert (got[4].west, got[4].east, got[4].south, got[4].north) == pytest.approx((10.0, 11.2, 40.0, 41.2))
    assert {(r.lat_sw, r.lon_sw) for r in warp.tile_list(warp.bounds(maps).where("map_id = 4"), warp.Grid(1, 10)).collect()} == {(a, b) for a in (39, 40, 41) for b in (9, 10, 11)}


def test_answers_of_classes_without_a_description(spark):
    tiles = values(spark, "id, lc, topo", [(1, 2, 2), (2, 3, 0), (3, 4, None)])
    got = {(r.id, r.prompt_idx): r.answer for r in samples.tuning_samples(tiles, ["original"], False).collect()}
    assert got[1, 0] == f"{LAND_COVER[2]} (mountainous)" and got[3, 1] == LAND_COVER[4] and got[2, 0] == "grassland (flat)"


def test_samples_without_labels_do_not_count(spark):
    even = [0.0] * 12
    px = spark.createDataFrame([("synthetic", "b", 1, 0, 0, even), ("synthetic", "b", 2, 255, 255, even), ("synthetic", "c", 3, 255, 9, even)], "source string, batch string, sample int, lc int, topo int, logits array<double>")
    got = {r.batch: (r.n_samples, r.loss) for r in metrics.batch_ce(px, source_weights(spark), ["sample"], ["batch"]).collect()}
    assert got["b"] == (1, pytest.approx(math.log(9) + math.log(3))) and got["c"] == (0, None)


def test_a_leak_stops_the_training_index(spark):
    found = spark.createDataFrame([(1, "p", "data/train/p", 0, 0), (2, "p", "data/test/p", 0, 0)], "map_id int, pyramid_id string, path string, ox int, oy int")
    weights = found.select("map_id", "pyramid_id")
    assert pyramid.training_index(found.where("map_id = 1"), weights).count() == 21
    with pytest.raises(Exception, match="data/test/p"):
        pyramid.training_index(found, weights.where("map_id = 1")).collect()


def test_a_class_of_all_tiles_is_a_ring_over_many_tasks(spark):
    tiles = spark.range(5000).select(F.col("id"), F.lit(1).alias("lc"), F.lit(None).cast("int").alias("topo"))
    got = samples.peers(tiles, "id")
    assert got.count() == 20_000 and got.where("tile = peer").count() == 0 and got.select("tile", "peer").distinct().count() == 20_000


def test_small_rasters_take_small_blocks(spark):
    """What is computed for a block is as large as its pixels and their edge, not as a whole block."""
    pixels = spark.range(12).select(F.lit(1).alias("map_id"), (F.col("id") % 4).cast("int").alias("x"), (300 + F.floor(F.col("id") / 4)).cast("int").alias("y"))

    def compute(table, at, shape):
        return [np.full(shape, shape[0] * 1000.0 + shape[1])]

    got = blocks.on_blocks(pixels, ["map_id"], 2, {"area": T.DoubleType()}, compute).collect()
    assert len(got) == 12 and {r.area for r in got} == {7008.0}
