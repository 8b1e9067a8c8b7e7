"""Invariants of the operators on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrain_spark.functions import classes, geo, idents
from terrain_spark.functions.taxonomy import LAND_COVER, TILE_PREFIXES, WEIGHTS, tile_prefixes, values, weight_map
from terrain_spark.operators import datasets, metrics, pyramid, ranking, raster, samples
from terrain_spark.plans import catalogue, lifecycles


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("h,topo", [(19, None), (20, 0), (36, 0), (37, 1), (64, 1), (65, 2), (100, 2)])
def test_topography_cuts(spark, h, topo):
    assert one(spark, classes.topography(F.lit(h))) == topo
    if topo is not None:  # the rounded share of the land range, as it is defined
        share = round((h - 20) / 80 * 100, 6)
        assert topo == (0 if share <= 20 else 1 if share <= 55 else 2)


def test_land_cover_defaults(spark):
    assert one(spark, classes.land_cover(F.lit(5), F.lit(1))) == 0
    assert one(spark, classes.land_cover(F.lit(50), F.lit(None).cast("int"))) == 6


@pytest.mark.parametrize("n,k", [(1, 1), (10, 2), (17, 3), (24, 4), (30, 4), (50, 8)])
def test_quota(spark, n, k):
    assert one(spark, datasets.quota(F.lit(n), 0.15)) == k == min(n, max(1, round(n * 0.15)))


def test_split_is_deterministic_and_disjoint(spark):
    rows = [(f"map_{i}", f"t{i % 3}") for i in range(60)]
    a = datasets.stratified_split(spark.createDataFrame(rows, "src_id string, template string"))
    b = datasets.stratified_split(spark.createDataFrame(rows[::-1], "src_id string, template string"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.where("subset = 'test'").count() == 9


def test_singleton_strata_go_to_test(spark):
    out = datasets.stratified_split(spark.createDataFrame([("a", "x")], "src_id string, template string")).first()
    assert out.subset == "test"


@pytest.mark.parametrize("w,h,n", [(1792, 1792, 15), (896, 896, 3), (448, 448, 0), (634, 634, 1), (633, 634, 0), (4096, 4096, 80), (0, 900, 0)])
def test_origins(spark, w, h, n):
    maps = spark.createDataFrame([("m", w, h)], "map_id string, width int, height int")
    assert pyramid.origins(maps).count() == n


def test_tiles_nest(spark):
    maps = spark.createDataFrame([("m", 896, 896)], "map_id string, width int, height int")
    tiles = pyramid.tiles(pyramid.origins(maps)).where("pyramid_id = 'py_r000_c000'").collect()
    assert len(tiles) == 21
    by = {t.tile_id: t for t in tiles}
    for level in (0, 1, 2):
        assert sum(t["size"] ** 2 for t in tiles if t.level == level) == 896**2
    for t in tiles:
        if t.parent_id:
            p = by[t.parent_id]
            assert p.x <= t.x and t.x + t["size"] <= p.x + p["size"] and p.y <= t.y and t.y + t["size"] <= p.y + p["size"]


def test_uniform_prediction_loses_ln9_plus_ln3(spark):
    px = spark.createDataFrame([(i % 9, i % 3, [0.0] * 12) for i in range(27)], "lc int, topo int, logits array<double>")
    assert metrics.joint_nll(px).first().joint_nll == pytest.approx(math.log(9) + math.log(3))


def test_invalid_labels_give_nan(spark):
    px = spark.createDataFrame([(9, 3, [0.0] * 12)], "lc int, topo int, logits array<double>")
    out = metrics.joint_nll(px).first()
    assert out.n_valid == 0 and math.isnan(out.joint_nll)


def test_entropy_of_random_counts(spark):
    rng = random.Random(1)
    rows = [([rng.choice([0, 0, 1, 5, 40]) for _ in range(9)],) for _ in range(40)] + [([0] * 9,), ([3] * 9,)]
    got = spark.createDataFrame(rows, "counts array<bigint>").select("counts", ranking.entropy(F.col("counts")).alias("e"), ranking.diversity(F.col("counts")).alias("d")).collect()
    for r in got:
        t = sum(r.counts)
        e = -sum(c / t * math.log(c / t) for c in r.counts if c) if t else 0.0
        assert r.e == pytest.approx(e, abs=1e-12)
        assert r.d == pytest.approx(e * 1.5 ** sum(r.counts[i] > 0 for i in (4, 5, 7)), abs=1e-12)


def test_plane_has_constant_slope(spark):
    rows = [(0, x, y, 2.0 * x + 1.0 * y) for x in range(6) for y in range(5)]
    out = raster.slope_classes(spark.createDataFrame(rows, "map_id int, x int, y int, z double"), ["map_id"], "z", 10.0)
    assert {round(r.slope, 9) for r in out.collect()} == {round(math.degrees(math.atan(math.hypot(0.2, 0.1))), 9)}


def test_nan_heights_have_no_topography(spark):
    rows = [(0, 0, 0, float("nan")), (0, 1, 0, 1.0), (0, 2, 0, 2.0)]
    out = raster.slope_classes(spark.createDataFrame(rows, "map_id int, x int, y int, z double"), ["map_id"])
    assert [r.topo for r in out.orderBy("x").collect()][0] == 255


def test_stretch_keeps_constant_bands_at_zero(spark):
    rows = [("a", 5.0), ("a", 5.0), ("b", 0.0), ("b", 1.0), ("b", float("nan")), ("b", float("inf"))]
    out = raster.stretch(spark.createDataFrame(rows, "band string, v double"), ["band"], "v").collect()
    assert sorted((r.band, r.byte) for r in out) == [("a", 0), ("a", 0), ("b", 0), ("b", 0), ("b", 0), ("b", 255)]


def test_affine_fit_recovers_coefficients(spark):
    rows = [("k", float(x), float(y), 2.0 + 0.5 * x - 0.25 * y, 40 - 0.1 * x + 0.3 * y) for x, y in [(0, 0), (10, 3), (4, 9), (7, 7), (2, 5)]]
    r = ranking.affine_fit(spark.createDataFrame(rows, "k string, px double, py double, lng double, lat double"), "k").first()
    assert [r.a, r.b, r.c, r.d, r.e, r.f] == pytest.approx([0.5, -0.25, 2.0, -0.1, 0.3, 40.0])


def test_collinear_points_have_no_fit(spark):
    rows = [("k", float(i), float(i), float(i), float(i)) for i in range(4)]
    assert ranking.affine_fit(spark.createDataFrame(rows, "k string, px double, py double, lng double, lat double"), "k").first().a is None


def test_last_feature_wins_and_holes_are_filled(spark):
    box = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    rows = [("m", 0, 1, box(0.0, 6.0)), ("m", 0, 1, box(2.0, 4.0)), ("m", 1, 2, box(5.0, 7.0)), ("m", 2, 3, [(0.0, 0.0), (1.0, 1.0)])]
    out = raster.rasterise(spark.createDataFrame(rows, "map_id string, ord int, lc int, pts array<struct<x: double, y: double>>"), "lc")
    got = {(r.x, r.y): r.lc for r in out.collect()}
    assert len(got) == 36 + 4 - 1 and got[3, 3] == 1 and got[5, 5] == 2 and got[6, 6] == 2


def test_crop_outside_the_map_is_padded(spark):
    box = values(spark, "map_id, tile_id, x, y, size", [(0, "t", -1, 0, 3)])
    px = values(spark, "map_id, x, y, v", [(0, x, y, 10 * x + y) for x in range(2) for y in range(3)])
    got = {(r.tx, r.ty): r.v for r in pyramid.tile_pixels(box, px, ["map_id"], ["v"]).collect()}
    assert got[0, 0] == 255 and got[1, 2] == 2 and got[2, 1] == 11


def test_water_forces_unknown_topography(spark):
    out = raster.masked_water(values(spark, "lc, topo", [(0, 1), (1, 2), (3, None)])).collect()
    assert sorted((r.lc, r.topo) for r in out) == [(0, 255), (1, 2), (3, 255)]


def test_manifest_errors(spark):
    files = values(spark, "filename", [("ok_01.geojson",), ("Bad_02.geojson",), ("new_03.geojson",), ("east_asia_04.geojson",)])
    entries = values(spark, "filename, template", [("ok_01.geojson", "ok"), ("Bad_02.geojson", "Bad"), ("gone_05.geojson", "gone"), ("east_asia_04.geojson", "east")])
    got = sorted(map(tuple, datasets.reconcile(files, entries).collect()))
    assert got == [("Bad_02.geojson", "bad_name"), ("east_asia_04.geojson", "template_mismatch"), ("gone_05.geojson", "phantom"), ("new_03.geojson", "unlisted")]
    with pytest.raises(ValueError, match="manifest"):
        lifecycles.synthetic_sources(files, entries)


def test_identifiers(spark):
    assert one(spark, idents.sanitised(F.lit("é a/b-1"))) == "é_a_b-1"
    assert one(spark, idents.sanitised(F.lit(None).cast("string"), "unknown")) == "unknown"
    assert one(spark, idents.template_key(F.lit("East_Asia_07"))) == "east_asia"
    assert one(spark, idents.template_key(F.lit("Plain"))) == "plain"
    assert one(spark, idents.signed_id(F.lit(5), F.lit(-7))) == "wc_+05_-007"
    assert one(spark, idents.hemisphere_id(F.lit(-3), F.lit(60))) == "S03E060"
    assert one(spark, idents.is_traversal(F.lit("a/../b")))
    assert one(spark, idents.without_scheme(F.lit("gs://gsbucket/x"))) == "gsbucket/x"
    assert one(spark, idents.checkpoint_step(idents.checkpoint_name(F.lit(42)))) == 42
    assert one(spark, idents.pyramid_id(F.lit(448), F.lit(896))) == "py_r002_c001"


def test_seasons_and_grids(spark):
    assert one(spark, geo.season(F.lit(23.5))) == "2023-01-01/2023-12-31"
    assert one(spark, geo.season(F.lit(-30.0), 2024)) == "2023-12-01/2024-02-29"
    assert one(spark, geo.tiles_between(F.lit(-4.0), F.lit(0.0), 3)) == [-6, -3]
    assert one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111.1949, abs=1e-3)
    assert one(spark, geo.window_start(F.lit(100), 4096)) == 0


def test_records_pass_without_type_or_year(spark):
    rows = values(spark, "t, d", [(None, "n.d."), ("", "1650"), ("Map", "1800"), ("Text Page", "1650")])
    got = rows.where(ranking.type_allowed(F.col("t")) & ranking.year_allowed(F.col("d"), 1500, 1700)).collect()
    assert len(got) == 2


def test_scenes_without_cloud_count_as_100(spark):
    regions = values(spark, "r", [("a",), ("b",), ("c",)])
    scenes = values(spark, "r, scene_id, cloud", [("a", 1, None), ("a", 2, 5.0), ("a", 3, 5.0), ("b", 4, 10.0), ("c", 5, None)])
    assert {r.r: r.scene_id for r in ranking.lowest_cloud(regions, scenes, "r").collect()} == {"a": 2, "b": None, "c": 5}


def test_status_precedence(spark):
    rows = values(spark, "k, status", [(1, "download_failed"), (1, "ok"), (2, "gcps_insufficient"), (2, "out_of_scale"), (3, None)])
    assert {r.k: r.status for r in ranking.best_status(rows, "k").collect()} == {1: "ok", 2: "out_of_scale", 3: "not_in_allmaps"}


def test_longest_prefix_on_all_rules(spark):
    names = [p + "_01" for p, _, _ in TILE_PREFIXES] + ["hex_river"]
    got = {r.name: (r.lc, r.topo) for r in samples.longest_prefix(values(spark, "name", [(n,) for n in names]), tile_prefixes(spark)).collect()}
    for n in names:
        best = max((r for r in TILE_PREFIXES if n.startswith(r[0])), key=lambda r: len(r[0]), default=None)
        assert got.get(n) == (best[1:] if best else None)


def test_peers_never_hold_the_tile_itself(spark):
    tiles = values(spark, "id, lc, topo", [(i, i % 2, None if i % 2 else 0) for i in range(9)] + [(99, 5, 5)])
    got = samples.peers(tiles, "id").collect()
    assert all(r.tile != r.peer and r.tile % 2 == r.peer % 2 for r in got)
    assert len({(r.tile, r.peer) for r in got}) == len(got) == 5 * 4 + 4 * 3


def test_weights_in_class_order(spark):
    for s, w in WEIGHTS.items():
        assert one(spark, metrics.weight_vector(weight_map(s))) == w
    assert one(spark, metrics.missing_weights(F.create_map(F.lit("water"), F.lit(1.0)))) == LAND_COVER[1:]


def test_recursive_prediction_adds_up(spark):
    out = catalogue.recursive_prediction(spark, "/root/testdata/sf0.001").collect()
    for r in out:
        level = {"896": 0, "448": 1, "224": 2}[r.tile_id.split("_")[0]]
        assert r.p == [float(sum([896, 448, 224][: level + 1]))]


def test_blur_keeps_constant_images(spark):
    px = values(spark, "map_id, x, y, r", [(0, x, y, 7.0) for x in range(5) for y in range(4)])
    out = raster.blurred(px, 0.6, ["r"]).collect()
    assert len(out) == 20 and all(abs(r.r - 7) < 1e-9 for r in out)


def test_label_pixels_of_features(spark):
    box = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    feats = spark.createDataFrame([("m", 0, 1, 50, box), ("m", 1, 1, 10, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])], "map_id string, ord int, biome int, height int, pts array<struct<x: double, y: double>>")
    got = {(r.x, r.y): (r.lc, r.topo) for r in lifecycles.label_pixels(feats).collect()}
    assert got[0, 0] == (0, 255) and got[3, 3] == (3, 1) and len(got) == 16


def test_row_split_sizes(spark):
    out = datasets.row_split(spark.range(103).withColumnRenamed("id", "k"), "k")
    assert out.where("part = 'val'").count() == 20


def test_bilinear_against_numpy(spark):
    rng = np.random.default_rng(0)
    z = rng.random((5, 6))
    src = spark.createDataFrame([(0, x, y, float(z[y, x])) for x in range(6) for y in range(5)], "map_id int, x int, y int, z double")
    tgt = spark.createDataFrame([(0, i, float(rng.random() * 7 - 1), float(rng.random() * 6 - 1)) for i in range(30)], "map_id int, i int, sx double, sy double")
    for r in raster.bilinear(tgt, src, "z").collect():
        sx, sy = min(max(r.sx, 0), 5), min(max(r.sy, 0), 4)
        x, y = int(sx), int(sy)
        x1, y1, fx, fy = min(x + 1, 5), min(y + 1, 4), sx - x, sy - y
        want = z[y, x] * (1 - fx) * (1 - fy) + z[y, x1] * fx * (1 - fy) + z[y1, x] * (1 - fx) * fy + z[y1, x1] * fx * fy
        assert r.z == pytest.approx(want)


def test_parchment_noise_is_seeded_and_normal(spark):
    pixels = spark.range(10_000).select(F.lit("m").alias("map_id"), (F.col("id") % 100).cast("int").alias("x"), F.floor(F.col("id") / 100).cast("int").alias("y"))
    values = [r.v for r in pixels.select(classes.gaussian(3, F.col("map_id"), F.col("x"), F.col("y")).alias("v")).collect()]
    mean = sum(values) / len(values)
    assert abs(mean) < 0.04 and abs((sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5 - 1) < 0.04
    images = pixels.where("x < 12 AND y < 12").select("*", F.lit(100).alias("r"), F.lit(120).alias("g"), F.lit(90).alias("b"))
    out = {(r.x, r.y): (r.r, r.g, r.b) for r in raster.aged(images).collect()}
    again = {(r.x, r.y): (r.r, r.g, r.b) for r in raster.aged(images.repartition(7)).collect()}
    assert len(out) == 144 and all(abs(a - b) < 1e-6 for k in out for a, b in zip(out[k], again[k]))
    assert len({v[0] for v in out.values()}) > 50


def test_lowest_digests_takes_exactly_what_is_wanted(spark):
    import hashlib

    rows = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    order = sorted((hashlib.md5(f"5:{i}".encode()).hexdigest(), str(i)) for i in range(3000))
    for n in (0, 1, 777, 2999, 3000):
        got = {r.k for r in datasets.lowest_digests(rows, "k", 5, lambda _, n=n: F.lit(n), "inside").where("inside").collect()}
        assert got == {k for _, k in order[:n]}
    assert ranking.sampled(rows.limit(3), "k").count() == 1 and ranking.sampled(rows.limit(0), "k").count() == 0
