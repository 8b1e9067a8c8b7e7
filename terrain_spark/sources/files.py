"""Readers and writers of files: listings, JSON sidecars, GeoJSON, pyramids, checkpoints."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import idents
from ..operators import samples
from ..operators.spread import spread
from . import png

MANIFEST = "version string, entries map<string, struct<template: string>>"
SPLIT = "seed int, test_fraction double, test array<string>"
WEIGHTS = "land_cover_weights map<string, double>, topography_weight double, source string, map_file string"
COVERAGE = "cells array<struct<lat: int, lon: int, counts: array<bigint>>>"
SCENES = "scenes array<struct<region_id: string, bbox: array<double>, datetime_range: string, visual_href: string, eo_cloud_cover: double>>"
PYRAMID = "pyramid_id string, origin array<int>, source_map string, source_size array<int>, scales array<int>, stride int, tiles array<struct<id: string, x: int, y: int, size: int, children: array<string>, image: string, land_cover: string, topography: string>>"


def listing(spark: SparkSession, path: str, pattern: str, recursive: bool = False) -> DataFrame:
    """path, filename and bytes of the files that match, without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select("path", idents.basename(F.col("path")).alias("filename"), F.col("length").alias("bytes")).orderBy("path")


def walked(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, filename and bytes of the files below a folder whose names match, for folders of very many small files.

    One task walks the folder and gives rows as it goes. Spark's own reader holds every file on the driver, and makes a task of some 30 of them.
    As there, names that begin with ``.`` or ``_`` are not seen. The path is one that ``pyarrow.fs`` knows.
    """
    def walk(batches):
        import fnmatch
        import os

        from pyarrow import fs

        def below(system, folder):  # noqa: ANN001, ANN202
            if isinstance(system, fs.LocalFileSystem):
                with os.scandir(folder) as entries:  # not as a list
                    for e in entries:
                        yield e.path, e.name, e.is_dir(), 0 if e.is_dir() else e.stat().st_size
            else:
                for i in system.get_file_info(fs.FileSelector(folder)):
                    yield i.path, i.base_name, i.type == fs.FileType.Directory, i.size

        def rows(root):  # noqa: ANN001, ANN202
            system, first = fs.FileSystem.from_uri(root)
            head = "file://" if isinstance(system, fs.LocalFileSystem) else root[: len(root.rstrip("/")) - len(first.rstrip("/"))]
            todo = [system.normalize_path(first).rstrip("/")]
            while todo:
                for place, name, is_folder, size in below(system, todo.pop()):
                    if name[0] == "." or (name[0] == "_" and "=" not in name):
                        continue
                    if is_folder:
                        todo.append(place)
                    elif fnmatch.fnmatchcase(name, pattern):
                        yield head + place, name, size

        for batch in batches:
            for root in batch.column(0).to_pylist():
                every = rows(root)
                while some := list(itertools.islice(every, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["path", "filename", "bytes"])

    return spark.range(0, 1, 1, 1).select(F.lit(path).alias("path")).mapInArrow(walk, "path string, filename string, bytes long")


def rasters(spark: SparkSession, *paths: str) -> DataFrame:
    """All ``*.tif`` below and in the folders, each once, in the order of the folder that finds it first and of its path."""
    found = None
    for i, path in enumerate(paths):
        one = walked(spark, path, "*.tif").withColumn("_i", F.lit(i))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("path", "filename", "bytes").agg(F.min("_i").alias("_i")).orderBy("_i", "path").drop("_i")


def sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file of a known schema, a row each, with its path."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("path", F.input_file_name())


def manifest_entries(spark: SparkSession, path: str) -> DataFrame:
    return sidecar(spark, path, MANIFEST).select(F.explode("entries").alias("filename", "entry")).select("filename", "entry.template")


def coverage_cells(spark: SparkSession, path: str) -> DataFrame:
    return sidecar(spark, path, COVERAGE).select(F.inline("cells"))


def resolved_scenes(spark: SparkSession, path: str) -> DataFrame:
    return sidecar(spark, path, SCENES).select(F.inline("scenes"))


def split_ids(spark: SparkSession, path: str) -> DataFrame:
    return sidecar(spark, path, SPLIT).select(F.explode("test").alias("src_id"))


def pyramid_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of all pyramid files below a folder with their folder's name."""
    return sidecar(spark, path, PYRAMID).select("pyramid_id", "source_map", F.inline("tiles"), "path")


def features(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features in order: map_id, ord, biome, height, kind, rings of points.

    Numbers that are not numbers and points without two coordinates become null, not errors.
    """
    text = spark.read.text(path, wholetext=True).select(idents.stem(F.input_file_name()).alias("map_id"), "value")
    rows = text.select("map_id", F.posexplode(F.from_json("value", "features array<string>")["features"]).alias("ord", "f"))
    typed = rows.select("map_id", "ord", F.get_json_object("f", "$.properties.biome").try_cast("int").alias("biome"), F.get_json_object("f", "$.properties.height").try_cast("int").alias("height"), F.get_json_object("f", "$.geometry.type").alias("kind"), F.get_json_object("f", "$.geometry.coordinates").alias("c"))
    point = lambda p: F.from_json(p, "array<string>")
    polygon = F.from_json("c", "array<array<string>>")
    multi = F.flatten(F.from_json("c", "array<array<array<string>>>"))
    rings = F.when(F.col("kind") == "Polygon", polygon).when(F.col("kind") == "MultiPolygon", multi)
    number = lambda p, i: F.get(point(p), F.lit(i)).try_cast("double")
    pts = F.filter(F.transform("ring", lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return typed.select("map_id", "ord", "biome", "height", F.explode(rings).alias("ring")).select("map_id", "ord", "biome", "height", pts.alias("pts"))


#: Bytes at a file's end that hold the end record of an archive, whatever its comment.
TAIL = 22 + 65_535


def whole_archive(size: int, read_at: Callable[[int, int], bytes]) -> bool:
    """Whether a file is a zip archive with its end: the end record stands where the directory it names ends, and the directory begins as one."""
    first = max(0, size - TAIL)
    tail = read_at(first, size - first)
    at = tail.rfind(b"PK\5\6")
    if at < 0 or len(tail) < at + 22:
        return False
    n, length, start, comment = struct.unpack_from("<HIIH", tail, at + 10)
    if first + at + 22 + comment != size:
        return False
    if start == 0xFFFFFFFF or length == 0xFFFFFFFF or n == 0xFFFF:  # beyond 4 GB another record before it has the numbers
        locator = tail.rfind(b"PK\6\7", 0, at)
        if locator < 0:
            return False
        record = read_at(struct.unpack_from("<Q", tail, locator + 8)[0], 56)
        if record[:4] != b"PK\6\6":
            return False
        length, start = struct.unpack_from("<QQ", record, 40)
        return start + length <= first + locator and (n == 0 or read_at(start, 4) == b"PK\1\2")
    return start + length == first + at and (n == 0 or read_at(start, 4) == b"PK\1\2")


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """step, name and whether the file is a whole archive, for which its end alone is read."""
    found = listing(spark, path, "step_*.pt")
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("valid", T.BooleanType())])

    def look(batches):
        from pyarrow import fs

        for batch in batches:
            valid = []
            for uri in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(uri)
                with system.open_input_file(place) as f:
                    valid.append(whole_archive(f.size(), lambda at, n, f=f: f.read_at(n, at)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(valid, pa.bool_())], names=schema.names)

    return found.select("path", "filename").mapInArrow(look, schema).select(idents.checkpoint_step(F.col("name")).alias("step"), "name", "valid")


def hex_tiles(spark: SparkSession, path: str, rules: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """name, lc, topo, width, height, bands and pixels of the ``hex_*.png`` below a folder whose name begins as a rule (prefix, lc, topo) says.

    Names are listed and joined first; the content is read and decoded for those that have a rule alone.
    """
    found = spread(walked(spark, path, "hex_*.png"), "path").select("path", F.col("filename").alias("name"))
    kept = samples.longest_prefix(found, rules, "name", lengths).select("path", "name", "lc", "topo")

    def look(batches):
        from pyarrow import fs

        for batch in batches:
            for i, uri in enumerate(batch.column("path").to_pylist()):
                system, place = fs.FileSystem.from_uri(uri)
                with system.open_input_stream(place) as f:
                    image = png.decode(f.read())
                sizes = [pa.array([n], pa.int32()) for n in (image.shape[1], image.shape[0], image.shape[2])]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, 1) for c in ("name", "lc", "topo")], *sizes, pa.array([image.tobytes()], pa.binary())], names=out.names)

    out = T.StructType([*[kept.schema[c] for c in ("name", "lc", "topo")], *[T.StructField(c, T.IntegerType()) for c in ("width", "height", "bands")], T.StructField("pixels", T.BinaryType())])
    return kept.mapInArrow(look, out)


def put(content: DataFrame, root: str) -> int:
    """Writes each row (``name``, ``content``) as a file below a folder and gives their number; a task that is tried again writes the same files.

    Rows come to Python in batches of bounded bytes, not of so many rows as in Arrow: a content may be large, and a task has many.
    """
    def write(rows):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(root)
        made, n = None, 0
        for name, data in rows:
            parent = f"{folder}/{name}".rsplit("/", 1)[0]
            if parent != made:
                system.create_dir(parent)
                made = parent
            with system.open_output_stream(f"{folder}/{name}") as f:
                f.write(data)
            n += 1
        yield n

    return content.select("name", F.col("content").cast("binary")).rdd.mapPartitions(write).sum()


def write_frozen(df: DataFrame, path: str, refreeze: bool = False) -> None:
    """A split is written once; ``refreeze`` replaces it."""
    df.write.mode("overwrite" if refreeze else "errorifexists").parquet(path)


def frozen(df: DataFrame, path: str, refreeze: bool = False) -> DataFrame:
    """The split that stands at a path; ``df`` is written there, and computed, only where there is none or ``refreeze`` asks for it."""
    try:
        write_frozen(df, path, refreeze)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_tiles(df: DataFrame, path: str) -> None:
    """Tiles by map; the committer makes the write all or nothing."""
    df.write.mode("overwrite").partitionBy("map_id").parquet(path)


def write_labels(df: DataFrame, path: str) -> None:
    """Label pixels (map_id, x, y, lc, topo) by map."""
    df.select("map_id", "x", "y", "lc", "topo").write.mode("overwrite").partitionBy("map_id").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


BUILD_STATE = T.StructType([T.StructField("map_id", T.StringType()), T.StructField("finished", T.TimestampType())])


def mark_complete(maps: DataFrame, path: str) -> None:
    """Completion marks as rows, each map once however often it is marked; files whose names begin with ``_`` are not seen by Spark's listing.

    For pyramids written by ``pyramids.write`` the commit is the mark, see ``pyramids.completed_maps``.
    """
    spark = maps.sparkSession
    maps.select("map_id").limit(0).withColumn("finished", F.current_timestamp()).write.mode("append").parquet(path)  # so that there is a table
    new = maps.select("map_id").distinct().join(completed(spark, path).select("map_id"), "map_id", "left_anti")
    new.select("map_id", F.current_timestamp().alias("finished")).write.mode("append").parquet(path)


def completed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUILD_STATE).parquet(path)
