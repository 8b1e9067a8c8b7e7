"""Pyramids as files: a writer that commits in two steps, and what readers see of it.

A task writes each of its pyramids to a folder of its own attempt, reads every file back, compares it with what it has written, and
lists the pyramid with the number and a digest of its files. When all tasks are done, the commit names their lists in one small file,
which comes into being as a whole. Readers start from there: a task that was killed, or tried twice, leaves files that no commit names, so a
pyramid is either there with all of its files or not at all. The commit is the completion mark of its maps as well, so marks
and tiles cannot differ. Nothing but names passes through the driver.

    <root>/data/<attempt>/<map_id>/<pyramid_id>/896_image.png ...
    <root>/tasks/<attempt>.json
    <root>/commits/<time>_<job>.json
"""

from __future__ import annotations

import hashlib
import itertools
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import png

#: Sides of the three levels, and the step between pyramids.
SCALES, STRIDE = [896, 448, 224], 448
WEIGHTS_FILE, INDEX_FILE = "sample_weights.json", "pyramid.json"
#: Images of 21 tiles, the index, the weights.
FILES = 3 * 21 + 2

COMMIT = "job string, at double, tasks array<string>"
LISTED = "attempt string, map_id string, pyramid_id string, folder string, n_files int, digest string"


@dataclass(frozen=True)
class Tile:
    level: int
    tile_id: str
    parent_id: str | None
    dx: int
    dy: int
    size: int


def layout(scales: list[int] = SCALES) -> list[Tile]:
    """The 21 tiles of a pyramid, from the coarsest on; quadrants go by rows."""
    quadrants = list(enumerate([(0, 0), (1, 0), (0, 1), (1, 1)]))
    out = [Tile(0, str(scales[0]), None, 0, 0, scales[0])]
    for q, (x, y) in quadrants:
        out.append(Tile(1, f"{scales[1]}_{q}", str(scales[0]), x * scales[1], y * scales[1], scales[1]))
        out += [Tile(2, f"{scales[2]}_{q}_{r}", f"{scales[1]}_{q}", x * scales[1] + u * scales[2], y * scales[1] + v * scales[2], scales[2]) for r, (u, v) in quadrants]
    return out


def files_of(map_id: str, pyramid_id: str, origin: tuple[int, int], size: tuple[int, int], image: np.ndarray, lc: np.ndarray, topo: np.ndarray, weights: str, scales: list[int], stride: int) -> dict[str, bytes]:
    """Name and content of each file of a pyramid, whose arrays are as large as its coarsest tile."""
    files, tiles, shape = {}, [], layout(scales)
    for t in shape:
        names = {}
        for kind, band in (("image", image), ("land_cover", lc), ("topography", topo)):
            names[kind] = f"{t.tile_id}_{kind}.png"
            files[names[kind]] = png.encode(band[t.dy : t.dy + t.size, t.dx : t.dx + t.size])
        tiles.append({"id": t.tile_id, "x": origin[0] + t.dx, "y": origin[1] + t.dy, "size": t.size, "children": [c.tile_id for c in shape if c.parent_id == t.tile_id], **names})
    index = {"pyramid_id": pyramid_id, "origin": list(origin), "source_map": map_id, "source_size": list(size), "scales": scales, "stride": stride, "tiles": tiles}
    return files | {INDEX_FILE: json.dumps(index, indent=2).encode(), WEIGHTS_FILE: weights.encode()}


def _files(root: str):  # noqa: ANN202
    """The file system of an address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _put(system, path: str, data: bytes) -> None:  # noqa: ANN001
    with system.open_output_stream(path) as f:
        f.write(data)


def _get(system, path: str) -> bytes:  # noqa: ANN001
    with system.open_input_stream(path) as f:
        return f.read()


def digest_of(files: list[tuple[str, bytes]]) -> str:
    """One digest of names and contents, whatever their order."""
    return hashlib.sha256("".join(sorted(f"{n} {hashlib.sha256(c).hexdigest()}\n" for n, c in files)).encode()).hexdigest()


@dataclass
class _Written(WriterCommitMessage):
    attempt: str
    pyramids: int


class _Writer(DataSourceWriter):
    def __init__(self, root: str, expected: int):
        self.root, self.expected, self.job = root, expected, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> _Written:
        system, root = _files(self.root)
        attempt, n, lines = uuid.uuid4().hex, 0, None
        for (map_id, pyramid_id), own in itertools.groupby(iterator, lambda r: (r.map_id, r.pyramid_id)):
            folder = f"data/{attempt}/{map_id}/{pyramid_id}"
            system.create_dir(f"{root}/{folder}")
            files = [(r.name, bytes(r.content)) for r in own]
            for name, content in files:
                _put(system, f"{root}/{folder}/{name}", content)
            back = [(name, _get(system, f"{root}/{folder}/{name}")) for name, _ in files]
            if len({n for n, _ in files}) != self.expected or back != files:
                raise RuntimeError(f"{folder}: {len(files)} of {self.expected} files, {sum(a != b for a, b in zip(files, back, strict=True))} read back otherwise")
            if lines is None:
                system.create_dir(f"{root}/tasks")
                lines = system.open_output_stream(f"{root}/tasks/{attempt}.json")  # grows as pyramids are written; no commit names it before it is closed
            lines.write(json.dumps({"attempt": attempt, "map_id": map_id, "pyramid_id": pyramid_id, "folder": folder, "n_files": len(files), "digest": digest_of(back)}).encode() + b"\n")
            n += 1
        if lines is not None:
            lines.close()
        return _Written(attempt, n)

    def commit(self, messages: list[_Written | None]) -> None:
        tasks = [m.attempt for m in messages if m is not None and m.pyramids]
        if not tasks:
            return
        system, root = _files(self.root)
        for folder in ("pending", "commits"):
            system.create_dir(f"{root}/{folder}")
        name = f"{time.time():020.6f}_{self.job}.json"
        _put(system, f"{root}/pending/{name}", json.dumps({"job": self.job, "at": time.time(), "tasks": tasks}).encode())
        system.move(f"{root}/pending/{name}", f"{root}/commits/{name}")

    def abort(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        system, root = _files(self.root)
        for m in messages:
            if m is not None and system.get_file_info(f"{root}/data/{m.attempt}").type == fs.FileType.Directory:
                system.delete_dir(f"{root}/data/{m.attempt}")


class PyramidFiles(DataSource):
    """``df.write.format("pyramid_files").option("path", root)``: rows of map_id, pyramid_id, name and content, those of a pyramid in a row."""

    @classmethod
    def name(cls) -> str:
        return "pyramid_files"

    def schema(self) -> str:
        return "map_id string, pyramid_id string, name string, content binary"

    def writer(self, schema, overwrite: bool) -> _Writer:  # noqa: ANN001
        return _Writer(self.options["path"], int(self.options.get("files", FILES)))


def _there(root: str) -> bool:
    from pyarrow import fs

    system, path = _files(root)
    return system.get_file_info(f"{path}/commits").type == fs.FileType.Directory


def committed(spark: SparkSession, root: str) -> DataFrame:
    """The pyramids that readers see, each as its last commit has it: map_id, pyramid_id, folder, n_files, digest."""
    if not _there(root):
        return spark.createDataFrame([], LISTED).drop("attempt")
    commits = spark.read.schema(COMMIT).json(f"{root}/commits").select("at", F.explode("tasks").alias("attempt"))
    listed = spark.read.schema(LISTED).json(f"{root}/tasks").join(commits, "attempt")
    last = F.max_by(F.struct("folder", "n_files", "digest"), F.struct("at", "attempt"))
    return listed.groupBy("map_id", "pyramid_id").agg(last.alias("l")).select("map_id", "pyramid_id", "l.*")


def completed_maps(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """Maps of which all expected pyramids (map_id, pyramid_id) are committed."""
    want = expected.select(F.col("map_id").cast("string").alias("map_id"), "pyramid_id").distinct()
    got = committed(spark, root).select("map_id", "pyramid_id", F.lit(True).alias("_there"))
    return want.join(got, ["map_id", "pyramid_id"], "left").groupBy("map_id").agg(F.every(F.coalesce("_there", F.lit(False))).alias("_all")).where("_all").select("map_id")


def write(files: DataFrame, root: str, expected: int = FILES) -> None:
    """Writes the files of pyramids (``operators.pyramid.artifact_files``) and commits them."""
    spark = files.sparkSession
    spark.dataSource.register(PyramidFiles)
    files.select("map_id", "pyramid_id", "name", "content").write.format("pyramid_files").option("path", root).option("files", expected).mode("append").save()


def to_do(pyramids: DataFrame, root: str) -> DataFrame:
    """The pyramids that no commit has, so that a job that is run again adds nothing twice."""
    done = committed(pyramids.sparkSession, root).select(F.col("map_id").alias("_m"), F.col("pyramid_id").alias("_p"))
    return pyramids.join(done, (F.col("map_id").cast("string") == F.col("_m")) & (F.col("pyramid_id") == F.col("_p")), "left_anti")


def read(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """map_id, pyramid_id, name and content of the files of all committed pyramids."""
    folders = committed(spark, root).select("map_id", "pyramid_id", "folder")
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(f"{root}/data")
    parts = F.split("path", "/")
    placed = found.select(F.concat(F.lit("data/"), F.array_join(F.slice(parts, F.size(parts) - 3, 3), "/")).alias("folder"), F.element_at(parts, -1).alias("name"), "content")
    return placed.join(folders, "folder").select("map_id", "pyramid_id", "name", "content")


def checked(spark: SparkSession, root: str) -> DataFrame:
    """Per committed pyramid whether its files are all there now and have the digest that the commit lists."""
    own = F.struct("name", F.sha2("content", 256).alias("d"))
    lines = F.array_join(F.array_sort(F.collect_list(F.concat("o.name", F.lit(" "), "o.d", F.lit("\n")))), "")
    now = read(spark, root).select("map_id", "pyramid_id", own.alias("o")).groupBy("map_id", "pyramid_id").agg(F.count(F.lit(1)).alias("n"), F.sha2(lines.cast("binary"), 256).alias("now"))
    both = committed(spark, root).join(now, ["map_id", "pyramid_id"], "left")
    return both.select("map_id", "pyramid_id", "n_files", F.coalesce((F.col("n") == F.col("n_files")) & (F.col("now") == F.col("digest")), F.lit(False)).alias("sound"))


__all__ = ["FILES", "SCALES", "STRIDE", "PyramidFiles", "Tile", "checked", "committed", "completed_maps", "digest_of", "files_of", "layout", "read", "to_do", "write"]
