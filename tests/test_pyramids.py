"""Pyramids as files: all or nothing, whatever happens to tasks, and what is in them."""

import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from terrain_spark.operators import blocks, pyramid
from terrain_spark.sources import files as sidecars
from terrain_spark.sources import png, pyramids

SCALES, STRIDE = [32, 16, 8], 16


def built(spark, width=50, height=40, map_id="m1"):
    maps = spark.createDataFrame([(map_id, width, height)], "map_id string, width int, height int")
    pixels = maps.select("map_id", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    v = F.col("x") + 100 * (F.col("y") % 2)
    pixels = pixels.select("*", v.alias("r"), F.lit(7).alias("g"), F.col("y").alias("b"), (F.col("x") % 9).alias("lc"), (F.col("y") % 3).alias("topo"))
    weights = maps.select("map_id", F.lit('{"source": "synthetic"}').alias("weights"))
    return maps, pixels, weights, pyramid.origins(maps, SCALES[0], STRIDE)


def test_files_of_each_pyramid(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    maps, pixels, weights, origins = built(spark)
    pyramids.write(pyramid.artifact_files(origins, pixels, weights, SCALES, STRIDE), root)
    want = {(r.map_id, r.pyramid_id): r for r in origins.collect()}
    got = pyramids.committed(spark, root).collect()
    assert {(r.map_id, r.pyramid_id) for r in got} == set(want) and len(want) == 5 and {r.n_files for r in got} == {65}
    assert all(r.sound for r in pyramids.checked(spark, root).collect())
    found = {(r.pyramid_id, r.name): bytes(r.content) for r in pyramids.read(spark, root).collect()}
    for (_, pid), o in want.items():
        assert found[pid, "sample_weights.json"] == b'{"source": "synthetic"}'
        index = json.loads(found[pid, "pyramid.json"])
        assert [t["size"] for t in index["tiles"]].count(8) == 16 and index["origin"] == [o.ox, o.oy] and index["source_size"] == [50, 40]
        assert index["tiles"][0]["children"] == ["16_0", "16_1", "16_2", "16_3"]
        for t in index["tiles"]:
            image, lc, topo = (png.decode(found[pid, t[k]]) for k in ("image", "land_cover", "topography"))
            y, x = np.mgrid[t["y"] : t["y"] + t["size"], t["x"] : t["x"] + t["size"]]
            on = (x < 50) & (y < 40)
            assert (image[..., 0] == np.where(on, x + 100 * (y % 2), 0)).all() and (image[..., 2] == np.where(on, y, 0)).all()
            assert (lc[..., 0] == np.where(on, x % 9, 255)).all() and (topo[..., 0] == np.where(on, y % 3, 255)).all()
    listed = sidecars.pyramid_tiles(spark, f"{root}/data")
    assert listed.count() == 21 * 5 and listed.select("pyramid_id").distinct().count() == 5
    assert [r.map_id for r in pyramids.completed_maps(spark, root, origins).collect()] == ["m1"]


def test_a_job_run_again_adds_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    _, pixels, weights, origins = built(spark)
    make = lambda: pyramids.write(pyramid.artifact_files(pyramids.to_do(origins, root), pixels, weights, SCALES, STRIDE), root)
    make()
    before = sorted(map(tuple, pyramids.committed(spark, root).collect()))
    make()
    assert sorted(map(tuple, pyramids.committed(spark, root).collect())) == before and len(os.listdir(tmp_path / "p/commits")) == 1
    pyramids.write(pyramid.artifact_files(origins, pixels, weights, SCALES, STRIDE), root)  # without asking: the last commit counts, the rows are the same
    again = pyramids.committed(spark, root)
    assert again.count() == len(before) and {r.digest for r in again.collect()} == {r[4] for r in before}


@pytest.mark.parametrize("end", ["killed", "raises", "lacks a file"])
def test_a_task_that_ends_half_way_leaves_no_pyramid(spark, tmp_path, end):
    root = f"file://{tmp_path}/p"
    _, pixels, weights, origins = built(spark)
    every = pyramid.artifact_files(origins, pixels, weights, SCALES, STRIDE)

    def spoil(batches):
        for i, batch in enumerate(batches):
            yield batch if end != "lacks a file" else batch.slice(0, batch.num_rows - 1)
            if end == "killed":
                os.kill(os.getpid(), 9)
            if end == "raises":
                raise ValueError("half way")

    with pytest.raises(Exception):  # noqa: B017
        pyramids.write(every.coalesce(1).mapInArrow(spoil, every.schema), root)
    assert pyramids.committed(spark, root).collect() == []
    assert pyramids.completed_maps(spark, root, origins).collect() == [] and not glob.glob(f"{tmp_path}/p/commits/*")
    pyramids.write(every, root)
    assert pyramids.completed_maps(spark, root, origins).count() == 1


def test_a_file_that_changes_later_is_found(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    _, pixels, weights, origins = built(spark)
    pyramids.write(pyramid.artifact_files(origins, pixels, weights, SCALES, STRIDE), root)
    one = sorted(glob.glob(f"{tmp_path}/p/data/*/m1/py_r000_c001/32_image.png"))[0]
    with open(one, "ab") as f:
        f.write(b"x")
    assert {r.pyramid_id: r.sound for r in pyramids.checked(spark, root).collect()}["py_r000_c001"] is False


def test_pixels_are_shuffled_once_into_cells(spark):
    """The plan has one exchange of pixels; what is joined and gathered after it are blocks."""
    _, pixels, _, origins = built(spark)
    boxes = origins.select("map_id", F.col("pyramid_id").alias("tile_id"), F.col("ox").alias("x"), F.col("oy").alias("y"), F.lit(32).alias("size"))
    out = blocks.cut(boxes, pixels, ["map_id"], {"lc": "u1"}, 8, {"lc": 255})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(sequence(0, 31" not in plan
    got = {r.tile_id: np.frombuffer(bytes(r.lc), np.uint8).reshape(32, 32) for r in out.collect()}
    y, x = np.mgrid[16:48, 16:48]
    assert (got["py_r001_c001"] == np.where((x < 50) & (y < 40), x % 9, 255)).all() and len(got) == 5


def test_odd_boxes_and_values(spark):
    """Nulls, boxes off the map, negative places, sides that are no multiple of the cell, values that are arrays."""
    rows = [("a", x, y, None if x == y else float(x * y), [1.0 * x, 2.0 * y]) for x in range(10) for y in range(7)]
    px = spark.createDataFrame(rows, "map_id string, x int, y int, v double, p array<double>")
    box = spark.createDataFrame([("a", "t", -3, -2, 9), ("a", "off", 50, 50, 4), ("b", "none", 0, 0, 3)], "map_id string, tile_id string, x int, y int, size int")
    got = {(r.map_id, r.tile_id, r.tx, r.ty): r.v for r in pyramid.tile_pixels(box, px, ["map_id"], ["v"], -1, side=4).collect()}
    assert len(got) == 81 + 16 + 9
    for (m, t, tx, ty), v in got.items():
        x, y = tx - 3, ty - 2
        assert v == (x * y if (m, t) == ("a", "t") and 0 <= x < 10 and 0 <= y < 7 and x != y else -1)
    p = {(r.tx, r.ty): r.p for r in blocks.unpacked(pyramid.prior_tiles(box.where("tile_id = 't'"), px, ["map_id"], 2, side=4), ["tile_id"], {"p": "2f8"}).collect()}
    assert p[3, 2] == [0.0, 0.0] and p[8, 7] == [5.0, 10.0] and p[0, 0] == [0.0, 0.0]


def test_slopes_across_block_edges(spark):
    """Blocks of four pixels against the plain gradient of the whole array, with a hole and a null."""
    z = np.random.default_rng(3).normal(0, 10, (11, 13))
    rows = [(1, x, y, None if (x, y) == (6, 5) else float(z[y, x])) for x in range(13) for y in range(11) if (x, y) != (2, 2)]
    df = spark.createDataFrame(rows, "map_id int, x int, y int, z double")
    got = {(r.x, r.y): (r.dx, r.dy) for r in blocks.gradient(df, ["map_id"], "z", 2.0, 4).collect()}
    assert len(got) == len(rows)
    there = {(x, y): v for _, x, y, v in rows}

    def along(x, y, i, j):
        a, m, b = there.get((x - i, y - j), "none"), there[x, y], there.get((x + i, y + j), "none")
        if a == b == "none":
            return 0.0
        pair = (m, b, 2.0) if a == "none" else (a, m, 2.0) if b == "none" else (a, b, 4.0)
        return None if None in pair[:2] else (pair[1] - pair[0]) / pair[2]

    for (x, y), (dx, dy) in got.items():
        assert dx == pytest.approx(along(x, y, 1, 0)) and dy == pytest.approx(along(x, y, 0, 1))


def _walked(spark, tiles, clustered):
    def model(batches):
        for b in batches:
            b["p"] = [np.arange(s, s + (s // 8) ** 2, dtype=float) + (0 if p is None else p) for s, p in zip(b["size"], b["prior"], strict=True)]
            yield b[["map_id", "pyramid_id", "tile_id", "p"]]

    out = pyramid.recursive_predict(tiles, model, "map_id bigint, pyramid_id string, tile_id string, p array<double>", 8, clustered)
    return {(r.map_id, r.pyramid_id, r.tile_id): r.p for r in out.collect()}, out._jdf.queryExecution().executedPlan().toString()


def test_prediction_without_joins_whatever_the_batches(spark):
    """A parent's prediction meets its children in its own task: nothing is broadcast, and pyramids may lie across batches, or anywhere."""
    maps = spark.range(3).select(F.col("id").alias("map_id"), F.lit(70).alias("width"), F.lit(60).alias("height"))
    tiles = pyramid.tiles(pyramid.origins(maps, SCALES[0], STRIDE), SCALES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        (got, plan), (same, _) = _walked(spark, tiles, True), _walked(spark, tiles.orderBy(F.md5(F.concat("tile_id", "pyramid_id"))), False)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Join" not in plan and got == same and len(got) == tiles.count() > 3 * 21 * 4
    for key in {k[:2] for k in got}:
        whole = np.array(got[*key, "32"]).reshape(4, 4)
        assert (whole.reshape(-1) == 32 + np.arange(16)).all()
        for q, (x, y) in enumerate([(0, 0), (2, 0), (0, 2), (2, 2)]):
            part = np.array(got[*key, f"16_{q}"]).reshape(2, 2)
            assert (part == whole[y : y + 2, x : x + 2] + 16 + np.arange(4).reshape(2, 2)).all()
            assert [got[*key, f"8_{q}_{r}"] for r in range(4)] == [[8 + part[r // 2, r % 2]] for r in range(4)]


def test_maps_of_a_small_table_are_spread_once(spark):
    """One partition of maps becomes as many as the session's shuffles have, and what is counted by map or pyramid is not shuffled again."""
    maps = spark.range(40, numPartitions=1).select(F.col("id").alias("map_id"), F.lit(1000).alias("width"), F.lit(900).alias("height"))
    tiles = pyramid.tiles(pyramid.origins(maps))
    assert tiles.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for counted in (tiles.select("map_id", "pyramid_id").distinct(), pyramid.children(tiles, ["map_id", "pyramid_id"])):
        assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_images_of_pyramids_are_counted_where_maps_are_spread(spark, tmp_path):
    """The query counts by map and pyramid and names pyramids afterwards, so that tiles' maps are shuffled and no counts."""
    from terrain_spark.plans import catalogue

    spark.range(1, 60).selectExpr("id AS p_partkey", "int(id % 50 + 1) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    found = catalogue.QUERIES["pyramid_complete"](spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {r.pyramid_id: r.n_png for r in found.collect()}
    assert got and all(k.count("/") == 1 and int(k.split("/")[0]) % 2 and n < 60 for k, n in got.items())


def test_training_index_is_not_broadcast(spark):
    maps = spark.range(9).select(F.col("id").alias("map_id"), F.lit(1000).alias("width"), F.lit(900).alias("height"))
    found = pyramid.origins(maps).withColumn("path", F.lit("data/train/a"))
    index = pyramid.training_index(found, found.where("map_id % 3 > 0").select("map_id", "pyramid_id"))
    assert "Broadcast" not in index._jdf.queryExecution().executedPlan().toString() and index.count() == 21 * found.where("map_id % 3 > 0").count()


def test_list_grows_as_pyramids_are_written(tmp_path):
    """A task's list is a stream to its file, so what a task holds does not grow with its pyramids."""
    seen = []

    def rows():
        for i in range(3):
            seen.append(len(glob.glob(f"{tmp_path}/tasks/*.json")))
            yield Row(map_id="m", pyramid_id=str(i), name="a", content=b"1")

    assert pyramids._Writer(f"file://{tmp_path}", 1).write(rows()).pyramids == 3 and seen[-1] == 1
    assert len(open(glob.glob(f"{tmp_path}/tasks/*.json")[0]).readlines()) == 3
