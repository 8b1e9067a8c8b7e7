"""Readers, writers, images, replayed services and arrivals."""

import io
import json
import os
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrain_spark.operators import datasets
from terrain_spark.plans import lifecycles
from terrain_spark.sources import files, png, records, replay
from terrain_spark.streaming import arrivals


@pytest.mark.parametrize("shape", [(3, 5), (4, 4, 3), (2, 7, 4)])
def test_png_round_trip(shape):
    px = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (png.decode(png.encode(px)).reshape(shape) == px).all()


def test_png_filters():
    import zlib

    px = np.random.default_rng(2).integers(0, 256, (5, 6, 3)).astype(np.int64)
    raw = b""
    for y in range(5):
        line = px[y].reshape(-1)
        up = px[y - 1].reshape(-1) if y else np.zeros(18, np.int64)
        left = np.concatenate((np.zeros(3, np.int64), line[:-3]))
        corner = np.concatenate((np.zeros(3, np.int64), up[:-3]))
        paeth = [min((a, b, c), key=lambda v: abs(a + b - c - v)) for a, b, c in zip(left, up, corner, strict=True)]
        guess = [0 * line, left, up, (left + up) // 2, np.array(paeth)][y]
        raw += bytes([y]) + bytes(((line - guess) & 255).tolist())
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (png.decode(data) == px).all()


def test_png_columns(spark):
    px = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    row = spark.createDataFrame([(png.encode(px),)], "content binary").select(png.decoded("content").alias("i")).select("i.*")
    got = row.withColumn("again", png.encoded("pixels", "width", "height", "bands")).first()
    assert (got.width, got.height, got.bands) == (2, 2, 3) and (png.decode(bytes(got.again)) == px).all()


def test_manifest_and_listing(spark, tmp_path):
    (tmp_path / "a_01.geojson").write_text("{}")
    (tmp_path / "notes.txt").write_text("x")
    assert [r.filename for r in files.listing(spark, str(tmp_path), "*.geojson").collect()] == ["a_01.geojson"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/manifest.json").write_text(json.dumps({"version": "1", "entries": {"a_01.geojson": {"template": "a"}}}))
    entries = files.manifest_entries(spark, str(tmp_path / "m/manifest.json"))
    assert datasets.reconcile(files.listing(spark, str(tmp_path), "*.geojson"), entries).count() == 0


def test_features_survive_malformed_geometry(spark, tmp_path):
    ring = [[0, 0, 9], [4, 0], [4, 4], "x", [], [0, "y"], [0, 4]]
    feats = [
        {"properties": {"biome": 1, "height": 50}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"properties": {"biome": "?", "height": None}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]]]}},
        {"properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        7,
    ]
    (tmp_path / "m_01.geojson").write_text(json.dumps({"features": feats}))
    got = files.features(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.map_id, r.ord, len(r.pts)) for r in got] == [("m_01", 0, 4), ("m_01", 1, 3)]
    assert got[1].biome is None


def test_frozen_split_is_written_once(spark, tmp_path):
    path, df = str(tmp_path / "split"), spark.range(2)
    files.write_frozen(df, path)
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_frozen(df, path)
    files.write_frozen(spark.range(5), path, refreeze=True)
    assert spark.read.parquet(path).count() == 5


def test_completed_maps_are_skipped(spark, tmp_path):
    maps = spark.createDataFrame([("a", 896, 896), ("b", 896, 896)], "map_id string, width int, height int")
    files.mark_complete(maps.where("map_id = 'a'"), str(tmp_path / "state"))
    plan = lifecycles.tile_plan(maps, files.completed(spark, str(tmp_path / "state")))
    assert [r.map_id for r in plan.select("map_id").distinct().collect()] == ["b"]


def test_checkpoints(spark, tmp_path):
    """Archives as they are saved; those that are empty, cut off, spoiled or none at all are not loadable."""
    def archive(n, comment=b""):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for i in range(n):
                z.writestr(f"data/{i}", b"weights" * (300 if n < 10 else 0))
            z.comment = comment
        return out.getvalue()

    whole = archive(3)
    bodies = {10: whole, 20: b"", 30: whole[:-30], 40: whole[: len(whole) // 2], 50: b"no archive", 60: whole[:2000] + whole[2100:], 70: whole + b"more", 15: archive(2, b"a comment " * 900), 16: archive(66_000)}
    for step, body in bodies.items():
        (tmp_path / f"step_{step:07d}.pt").write_bytes(body)
    (tmp_path / "step_x.pt").write_bytes(whole)
    got = files.checkpoints(spark, str(tmp_path)).where("step IS NOT NULL")
    assert {r.step for r in got.where("valid").collect()} == {10, 15, 16} and got.count() == len(bodies) - 1  # Spark lists no empty files
    assert got.where("valid").agg(F.max("step")).first()[0] == 16


def test_the_end_of_an_archive_is_all_that_is_read():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("big", os.urandom(3_000_000))
    data, asked = out.getvalue(), []
    assert files.whole_archive(len(data), lambda at, n: asked.append(n) or data[at : at + n]) and sum(asked) < 70_000


def test_completion_marks_are_written_once(spark, tmp_path):
    maps = spark.createDataFrame([("a",), ("b",), ("b",)], "map_id string")
    for _ in range(2):
        files.mark_complete(maps, str(tmp_path / "state"))
    assert sorted(r.map_id for r in files.completed(spark, str(tmp_path / "state")).collect()) == ["a", "b"]


def test_tiles_with_a_rule_alone_are_read(spark, tmp_path):
    from terrain_spark.functions.taxonomy import TILE_PREFIXES, tile_prefixes

    (tmp_path / "sub").mkdir()
    rng = np.random.default_rng(0)
    images = {f"{p}_{i}.png": rng.integers(0, 255, (4, 6, 3), dtype=np.uint8) for i, (p, _, _) in enumerate(TILE_PREFIXES)}
    for i, (name, image) in enumerate(images.items()):
        (tmp_path / ("sub" if i % 2 else ".") / name).write_bytes(png.encode(image))
    for name in ("hex_path_1.png", "hex_river_2.png", "other.png"):
        (tmp_path / name).write_bytes(b"no image")  # would fail if it was decoded
    got = {r.name: r for r in files.hex_tiles(spark, str(tmp_path), tile_prefixes(spark)).collect()}
    assert set(got) == set(images)
    for name, image in images.items():
        best = max((r for r in TILE_PREFIXES if name.startswith(r[0])), key=lambda r: len(r[0]))
        assert (got[name].lc, got[name].topo) == best[1:] and bytes(got[name].pixels) == image.tobytes() and (got[name].width, got[name].height) == (6, 4)


def _tiled(image, side):
    """A deflated file of tiles, with differences along lines."""
    h, w, bands = image.shape
    wide = np.zeros((-(-h // side) * side, -(-w // side) * side, bands), np.uint8)
    wide[:h, :w] = image
    blocks = []
    for y in range(0, h, side):
        for x in range(0, w, side):
            b = wide[y : y + side, x : x + side].copy()
            b[:, 1:] -= wide[y : y + side, x : x + side - 1]
            blocks.append(zlib.compress(b.tobytes()))
    starts = (8 + np.cumsum([0, *[len(b) for b in blocks[:-1]]])).tolist()
    body = b"".join(blocks)
    body += b"\0" * (len(body) % 2)
    fields = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (8,) * bands), (259, 3, (8,)), (262, 3, (2,)), (277, 3, (bands,)), (284, 3, (1,)), (317, 3, (2,)), (322, 4, (side,)), (323, 4, (side,)), (324, 4, tuple(starts)), (325, 4, tuple(map(len, blocks)))]
    at, entries, extra = 8 + len(body), b"", b""
    after = at + 2 + 12 * len(fields) + 4
    for tag, kind, items in fields:
        data = struct.pack(f"<{len(items)}{'H' if kind == 3 else 'I'}", *items)
        entries += struct.pack("<HHI", tag, kind, len(items)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", after + len(extra)))
        extra += data if len(data) > 4 else b""
    return struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + extra


def test_windows_read_what_they_touch(spark, tmp_path):
    """Plain and deflated strips, both sizes of the format, tiles: the same pixels, and no more bytes than header and window."""
    from terrain_spark.sources import tiff

    image = np.random.default_rng(4).integers(0, 255, (300, 200, 3), dtype=np.uint8)
    for name, how in {"plain": {"rows": 7}, "one": {}, "flat": {"rows": 10, "deflate": True}, "big": {"rows": 7, "big": True}}.items():
        (tmp_path / f"{name}.tif").write_bytes(tiff.encode(image.tobytes(), 200, 300, (1.0, 2.0, 0.1, 0.1), 0, 3, **how))
    (tmp_path / "tiles.tif").write_bytes(_tiled(image, 64))
    whole = image.tobytes()
    for window, only, want in ((0, "y >= 0", image), (50, "y >= 0", image[125:175, 75:125]), (50, "y >= 140 AND y < 150", image[140:150, 75:125]), (0, "y = 299", image[299:300])):
        rows = tiff.lines(spark, str(tmp_path), window).where(only).orderBy("path", "y").collect()
        for name in ("plain", "one", "flat", "big", "tiles"):
            own = [r for r in rows if r.path.endswith(f"{name}.tif")]
            got = np.array([np.frombuffer(bytes(r.line), np.uint8).reshape(-1, 3) for r in own])
            assert (got == want).all() and got.shape == want.shape
            if name in ("plain", "one", "big"):
                assert own[-1].n_read <= 2000 + want.shape[0] * 600
            elif window:
                assert own[-1].n_read < len(whole) / 2
    heads = {r.filename: (r.epsg, r.width, r.height, r.n_read < 1500) for r in tiff.probed(spark, str(tmp_path)).collect()}
    assert heads["big.tif"] == heads["one.tif"] == (4326, 200, 300, True) and heads["tiles.tif"] == (None, 200, 300, True)


def test_replayed_scenes_filter_at_the_source(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"region_id": "a", "scene_id": "s1", "visual_href": "h", "cloud": 3.0}, {"region_id": "a", "scene_id": "s2", "visual_href": "h", "cloud": 30.0}]))
    replay.register(spark)
    df = spark.read.format("replay").option("path", str(tmp_path)).option("kind", "scenes").load()
    assert [r.scene_id for r in df.where("cloud < 10").collect()] == ["s1"]


def test_retries_busy_answers_only():
    waits, answers = [], [(429, None), (503, None), (200, "ok")]
    assert replay.retried(lambda: answers.pop(0), waits.append) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(ValueError):
        replay.retried(lambda: (404, None), waits.append)
    assert replay.retried(lambda: (429, None), lambda s: None) is None


def test_arriving_maps_are_tiled_once(spark, tmp_path):
    rows = [("a", 896, 896, "2024-01-01 00:00:00"), ("a", 896, 896, "2024-01-01 00:10:00")]
    df = spark.createDataFrame(rows, "map_id string, width int, height int, arrived string").withColumn("arrived", F.col("arrived").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    q = arrivals.arriving_tiles(arrivals.arriving_maps(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("tiles").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tiles").count() == 3 * 21


def test_local_output_is_refused():
    assert lifecycles.require_remote("gs://x/y") == "gs://x/y"
    with pytest.raises(ValueError):
        lifecycles.require_remote("/tmp/x")


def test_geotiff_round_trip_and_probe(spark, tmp_path):
    from terrain_spark.sources import tiff

    rows = [("m1", x, y, x * 10, y * 10, 7) for x in range(5) for y in range(3)] + [("m2", 0, 0, 1, 2, 3)]
    affines = [("m1", 5, 3, 2.5, 48.0, 0.01, 0.02), ("m2", 2, 2, -3.0, 1.0, 0.5, 0.5)]
    files = tiff.encoded(spark.createDataFrame(rows, "map_id string, x int, y int, r int, g int, b int"), spark.createDataFrame(affines, "map_id string, width int, height int, west double, north double, dx double, dy double"), ["r", "g", "b"], nodata=0).collect()
    for f in files:
        (tmp_path / f"{f.map_id}.tif").write_bytes(f.content)
    (tmp_path / "broken.tif").write_bytes(b"II*\0nonsense")
    (tmp_path / "plain.tif").write_bytes(b"no image")
    got = {r.filename: (r.epsg, r.width, r.height) for r in tiff.probed(spark, str(tmp_path)).collect()}
    assert got == {"m1.tif": (4326, 5, 3), "m2.tif": (4326, 2, 2), "broken.tif": (None, None, None), "plain.tif": (None, None, None)}
    assert tiff.valid(tiff.probed(spark, str(tmp_path))).count() == 2
    one = next(bytes(f.content) for f in files if f.map_id == "m1")
    assert one[8 : 8 + 45] == bytes(v for y in range(3) for x in range(5) for v in (x * 10, y * 10, 7))
    with pytest.raises(ValueError):
        tiff.encode(b"abc", 2, 2, (0, 0, 1, 1))
    assert tiff.probe(b"MM\0*\0\0\0\x08\0\x01\x01\0\0\x03\0\0\0\x01\0\x09\0\0\0\0\0\0") == (None, 9, None)


@pytest.mark.parametrize("classic", [1 << 31, 0])
def test_rasters_written_by_strips(spark, tmp_path, classic):
    """Files equal those written whole, in both sizes of the format, with odd rows among pixels and maps."""
    from terrain_spark.sources import tiff

    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (23, 11, 2), dtype=np.uint8)
    image[8:12] = 9  # a strip without pixels
    rows = [("m", x, y, int(image[y, x, 0]), int(image[y, x, 1])) for y in range(23) for x in range(11) if not 8 <= y < 12]
    rows += [("m", 11, 0, 1, 1), ("m", -1, 0, 1, 1), ("m", 0, 23, 1, 1), ("m", None, 3, 1, 1), ("m", 2, None, 1, 1), (None, 1, 1, 1, 1), ("none", 0, 0, 1, 1), ("n", 0, 0, None, 5)]
    pixels = spark.createDataFrame(rows, "map_id string, x int, y int, a int, b int")
    affines = spark.createDataFrame([("m", 11, 23, 2.5, 48.0, 0.1, 0.2), ("n", 1, 2, 0.0, 0.0, 1.0, 1.0), ("empty", 0, 5, 0.0, 0.0, 1.0, 1.0), ("lost", 2, 2, None, 0.0, 1.0, 1.0)], "map_id string, width int, height int, west double, north double, dx double, dy double")
    got = tiff.write(pixels, affines, ["a", "b"], f"file://{tmp_path}", nodata=9, rows=4, classic=classic).collect()
    assert sorted((r.name, r.bytes) for r in got) == sorted((p.name, p.stat().st_size) for p in tmp_path.glob("*.tif")) and len(got) == 2
    assert (tmp_path / "m.tif").read_bytes() == tiff.encode(image.tobytes(), 11, 23, (2.5, 48.0, 0.1, 0.2), 9, 2, 4, True, classic == 0)
    head = tiff.Header(lambda at, n: (tmp_path / "n.tif").read_bytes()[at : at + n]).parse()
    assert head.window(0, 0, 1, 2).tolist() == [[[9, 5]], [[9, 9]]]
    assert tiff.write(pixels.limit(0), affines.limit(0), ["a", "b"], f"file://{tmp_path}/none").count() == 0


def test_a_frozen_split_stays(spark, tmp_path):
    path = str(tmp_path / "split")
    assert files.frozen(spark.range(3), path).count() == 3
    assert files.frozen(spark.range(9), path).count() == 3
    assert files.frozen(spark.range(9), path, refreeze=True).count() == 9
    with pytest.raises(Exception, match="nowhere"):
        files.frozen(spark.range(9).select(F.expr("raise_error('nowhere')").alias("id")), str(tmp_path / "other"))


def test_rasters_are_listed_once_and_in_order(spark, tmp_path):
    from terrain_spark.sources import files

    for name in ("b/2.tif", "a.tif", "b/1.tif", "b/c/3.tif", "x.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    assert [r.filename for r in files.rasters(spark, f"{tmp_path}/b", str(tmp_path)).collect()] == ["1.tif", "2.tif", "3.tif", "a.tif"]


def test_labels_are_written_by_map(spark, tmp_path):
    from terrain_spark.sources import files

    files.write_labels(spark.createDataFrame([("m", 1, 2, 3, 1), ("n", 1, 2, 4, 255)], "map_id string, x int, y int, lc int, topo int"), str(tmp_path / "labels"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "labels")).select("map_id", "lc", "topo").collect())) == [("m", 3, 1), ("n", 4, 255)]


def test_sidecars_round_trip(spark, tmp_path):
    """Scenes, coverage, splits, pyramids: written as JSON or tables and read by their schemas."""
    import json

    from terrain_spark.functions import taxonomy
    from terrain_spark.sources import files, records

    scenes = spark.createDataFrame([("r2", [1.0, 2.0, 3.0, 4.0], "d", "http://x", 3.5), ("r1", [0.0, 0.0, 1.0, 1.0], "d", None, None)], "region_id string, bbox array<double>, datetime_range string, visual_href string, eo_cloud_cover double")
    written = records.scene_manifest(scenes, 1).orderBy("name").collect()
    assert [(r.name, json.loads(r.content)["scenes"][0]["region_id"]) for r in written] == [("resolved_scenes_0000000.json", "r1"), ("resolved_scenes_0000001.json", "r2")]
    (tmp_path / "scenes.json").write_text(records.scene_manifest(scenes).first().content)
    assert [r.region_id for r in files.resolved_scenes(spark, str(tmp_path / "scenes.json")).collect()] == ["r1", "r2"]
    assert records.scene_manifest(scenes.limit(0)).count() == 0
    (tmp_path / "cells.json").write_text(records.coverage_summary(spark.createDataFrame([(3, -4, [0, 5])], "lat int, lon int, counts array<bigint>")).first().content)
    assert tuple(files.coverage_cells(spark, str(tmp_path / "cells.json")).first()) == (3, -4, [0, 5])
    (tmp_path / "coverage.json").write_text(json.dumps({"cells": [{"lat": 3, "lon": -4, "counts": [0, 5] + [0] * 7}]}))
    assert tuple(files.coverage_cells(spark, str(tmp_path / "coverage.json")).first()) == (3, -4, [0, 5, 0, 0, 0, 0, 0, 0, 0])
    (tmp_path / "split.json").write_text(json.dumps({"seed": 42, "test_fraction": 0.15, "test": ["a", "b"], "train": ["c"]}))
    assert [r.src_id for r in files.split_ids(spark, str(tmp_path / "split.json")).collect()] == ["a", "b"]
    pyramid = {"pyramid_id": "py_r000_c000", "origin": [0, 0], "source_map": "m", "source_size": [896, 896], "scales": [896, 448, 224], "stride": 448, "tiles": [{"id": "896", "x": 0, "y": 0, "size": 896, "children": ["448_0"], "image": "a.png", "land_cover": "b.png", "topography": "c.png"}]}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "pyramid.json").write_text(json.dumps(pyramid))
    row = files.pyramid_tiles(spark, str(tmp_path / "p")).first()
    assert (row.pyramid_id, row.id, row.children, row.image) == ("py_r000_c000", "896", ["448_0"], "a.png")
    tiles = spark.createDataFrame([("m", "896"), ("n", "896")], "map_id string, tile_id string")
    files.write_tiles(tiles, str(tmp_path / "tiles"))
    files.write_tiles(tiles.limit(1), str(tmp_path / "tiles"))
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == 1
    files.write_json(tiles, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert [r.name for r in taxonomy.land_cover_classes(spark).orderBy("idx").collect()] == taxonomy.LAND_COVER
    assert [r.name for r in taxonomy.topography_classes(spark).orderBy("idx").collect()] == taxonomy.TOPOGRAPHY
    assert {(r.code, r.lc) for r in taxonomy.world_cover(spark).collect()} == set(map(tuple, taxonomy.WORLD_COVER))


def test_arrivals_by_hour(spark):
    import datetime as dt

    rows = [(f"m{i}", dt.datetime(2024, 1, 1, i // 4, i)) for i in range(10)]
    got = arrivals.arrivals_by_hour(spark.createDataFrame(rows, "map_id string, arrived timestamp")).collect()
    assert sorted((r.window.start.hour, r.n) for r in got) == [(0, 4), (1, 4), (2, 2)]


def test_walked_folder_in_one_task(spark, tmp_path):
    """Files of a folder and those below it, without hidden ones, and without a task for every few of them."""
    for name in ("a.tif", "b.png", ".c.tif", "_d.tif", "x/e.tif", "x/y/f.tif", "_x/g.tif"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12")
    want = sorted((f"file://{tmp_path}/{n}", n.rsplit("/", 1)[-1], 2) for n in ("a.tif", "x/e.tif", "x/y/f.tif"))
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        assert sorted(map(tuple, files.walked(spark, root, "*.tif").collect())) == want
    for i in range(200):
        (tmp_path / f"x/t{i}.tif").write_bytes(b"1")
    assert files.walked(spark, str(tmp_path), "*.tif").rdd.getNumPartitions() == 1 and files.rasters(spark, str(tmp_path)).count() == 203


def test_annotations_are_read_once(spark):
    """A path of the text stands in the plan once, however many columns come from it."""
    text = '{"id":"a","body":{"features":[]},"target":{"source":{"width":"7","height":3}}}'
    plan = records.parsed_annotations(spark.createDataFrame([(1, text)], "k int, annotation string"))._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(path) == 1 for path in ("$.body.features", "$.target.source.width", "$.target.source.height", "$.properties.resourceCoords[0]"))


def test_put_takes_few_contents_at_a_time(spark, tmp_path):
    """Files of 120 MB by one task, and none."""
    rows = spark.range(0, 120, 1, 1).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.repeat(F.lit("x"), 1_000_000).alias("content"))
    assert files.put(rows, f"file://{tmp_path}/p") == 120 and sum(f.stat().st_size for f in (tmp_path / "p").iterdir()) == 120_000_000
    assert files.put(rows.limit(0), f"file://{tmp_path}/q") == 0
