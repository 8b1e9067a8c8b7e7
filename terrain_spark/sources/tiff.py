"""GeoTIFF files, as far as the public format is needed here: headers, ranged reads of windows, and a writer of plain 8-bit rasters.

Files are read by seeking: the header, and of the pixels only the strips or tiles that a window touches. Both sizes of the format are read
(BigTIFF has 8-byte offsets); pixels are 8-bit and interleaved, plain or deflated.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions import idents
from .shared import stored

# Fixed values of the TIFF and GeoTIFF formats: tags, and bytes of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS = 317, 322, 323, 324, 325
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 12: 8, 16: 8}
CODES = {1: "B", 2: "B", 3: "H", 4: "I", 12: "d", 16: "Q"}
PLAIN, DEFLATE = 1, (8, 32946)
#: GeoTIFF keys: model type (geographic is 2), raster type (area is 1), geographic system.
MODEL, RASTER, GEOGRAPHIC, PROJECTED = 1024, 1025, 2048, 3072


@dataclass
class Header:
    """Tags of a file's first image, read piece by piece; ``read(offset, n)`` gives bytes and ``n_read`` counts them."""

    read_at: Callable[[int, int], bytes]
    tags: dict[int, tuple] = field(default_factory=dict)
    n_read: int = 0

    def read(self, at: int, n: int) -> bytes:
        data = self.read_at(at, n)
        self.n_read += len(data)
        return data

    def parse(self) -> Header:
        head = self.read(0, 16)
        order = {b"II": "<", b"MM": ">"}[head[:2]]
        magic = struct.unpack_from(f"{order}H", head, 2)[0]
        if magic not in (42, 43):
            raise KeyError("no TIFF")
        big = magic == 43
        place, n_entry, count = ("Q", 20, "Q") if big else ("I", 12, "H")
        size = 8 if big else 4
        at = struct.unpack_from(f"{order}{place}", head, 8 if big else 4)[0]
        width = struct.calcsize(count)
        n = struct.unpack(f"{order}{count}", self.read(at, width))[0]
        entries = self.read(at + width, n_entry * n)
        for i in range(n):
            tag, kind, items = struct.unpack_from(f"{order}HH{place}", entries, n_entry * i)
            if kind in CODES:
                inner = n_entry * i + 4 + size
                length = SIZES[kind] * items
                data = entries[inner : inner + length] if length <= size else self.read(struct.unpack_from(f"{order}{place}", entries, inner)[0], length)
                self.tags[tag] = struct.unpack(f"{order}{items}{CODES[kind]}", data)
        return self

    def one(self, tag: int, default: int | None = None) -> int | None:
        return self.tags.get(tag, (default,))[0]

    @property
    def epsg(self) -> int | None:
        keys = self.tags.get(GEO_KEYS, ())
        codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        return codes.get(PROJECTED) or codes.get(GEOGRAPHIC)

    def window(self, x: int, y: int, width: int, height: int) -> np.ndarray:
        """Height x width x bands of a window: only the strips or tiles that it touches are read, and of plain strips only their lines."""
        full, high, bands, how = self.one(WIDTH), self.one(HEIGHT), self.one(SAMPLES, 1), self.one(COMPRESSION, PLAIN)
        if set(self.tags.get(BITS, (8,))) != {8} or self.one(PLANAR, 1) != 1 or (how != PLAIN and how not in DEFLATE):
            raise ValueError("only interleaved 8-bit images, plain or deflated, are read")
        tiled = TILES in self.tags
        wide, tall = (self.one(TILE_WIDTH), self.one(TILE_HEIGHT)) if tiled else (full, min(self.one(ROWS, high), high))
        starts, counts = (self.tags[t] for t in ((TILES, TILE_COUNTS) if tiled else (STRIPS, COUNTS)))
        across, out = -(-full // wide), np.zeros((height, width, bands), np.uint8)
        for j in range(y // tall, -(-(y + height) // tall)):
            for i in range(x // wide, -(-(x + width) // wide)):
                k, left, top = j * across + i, i * wide, j * tall
                a, b, c, d = max(x, left), min(x + width, left + wide), max(y, top), min(y + height, top + tall)
                lines = tall if tiled else min(tall, high - top)
                if how == PLAIN:
                    first, line = (c - top) * wide * bands, wide * bands
                    block, skip = np.frombuffer(self.read(starts[k] + first, (d - c) * line), np.uint8).reshape(d - c, wide, bands), c
                else:
                    block, skip = np.frombuffer(zlib.decompress(self.read(starts[k], counts[k])), np.uint8).reshape(lines, wide, bands), top
                if self.one(PREDICTOR, 1) == 2:
                    block = np.cumsum(block, axis=1, dtype=np.uint8)
                out[c - y : d - y, a - x : b - x] = block[c - skip : d - skip, a - left : b - left]
        return out


def probe(data: bytes) -> tuple[int | None, int | None, int | None]:
    """EPSG code, width and height of a file's first image; nulls where they are missing or the file is none."""
    return probed_at(lambda at, n: data[at : at + n])[:3]


def probed_at(read_at: Callable[[int, int], bytes]) -> tuple[int | None, int | None, int | None, int]:
    """The same by ranged reads, and how many bytes they took."""
    head = Header(read_at)
    try:
        head.parse()
        return head.epsg, head.one(WIDTH), head.one(HEIGHT), head.n_read
    except (KeyError, IndexError, struct.error):
        return None, None, None, head.n_read


def _around(width: int, height: int, affine: tuple[float, float, float, float], sizes: list[int], bands: int, rows: int, deflate: bool, big: bool, nodata: int | None) -> tuple[bytes, bytes]:
    """What stands before and behind strips of these sizes, of so many lines each."""
    west, north, dx, dy = affine
    keys = (1, 1, 0, 3, MODEL, 0, 1, 2, RASTER, 0, 1, 1, GEOGRAPHIC, 0, 1, 4326)
    place, size, start = "Q" if big else "I", 8 if big else 4, 16 if big else 8
    starts = (start + np.cumsum([0, *sizes[:-1]], dtype=np.int64)).tolist()
    fields = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (8,) * bands), (COMPRESSION, 3, (DEFLATE[0] if deflate else PLAIN,)), (PHOTOMETRIC, 3, (2 if bands == 3 else 1,)), (STRIPS, 16 if big else 4, tuple(starts)),
        (SAMPLES, 3, (bands,)), (ROWS, 4, (rows,)), (COUNTS, 16 if big else 4, tuple(sizes)), (PLANAR, 3, (1,)),
        (PIXEL_SCALE, 12, (dx, dy, 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, west, north, 0.0)), (GEO_KEYS, 3, keys),
    ]
    if nodata is not None:
        fields.append((NO_DATA, 2, tuple(f"{nodata}\0".encode())))
    pad = b"\0" * (sum(sizes) % 2)
    at = start + sum(sizes) + len(pad)
    count = struct.pack("<Q" if big else "<H", len(fields))
    after, entries, extra = at + len(count) + (4 + 2 * size) * len(fields) + size, b"", b""
    for tag, kind, items in fields:
        data = struct.pack(f"<{len(items)}{CODES[kind]}", *items)
        entries += struct.pack(f"<HH{place}", tag, kind, len(items)) + (data.ljust(size, b"\0") if len(data) <= size else struct.pack(f"<{place}", after + len(extra)))
        extra += data if len(data) > size else b""
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)
    return head, pad + count + entries + struct.pack(f"<{place}", 0) + extra


def encode(rgb: bytes, width: int, height: int, affine: tuple[float, float, float, float], nodata: int | None = None, bands: int = 3, rows: int | None = None, deflate: bool = False, big: bool = False) -> bytes:
    """A file in EPSG:4326 of interleaved bytes. ``affine``: west, north, and degrees of a pixel across and down; ``rows``: lines of a strip."""
    if len(rgb) != width * height * bands:
        raise ValueError(f"{len(rgb)} bytes for {width} x {height} pixels of {bands} bands")
    rows = rows or height
    strips = [rgb[i : i + rows * width * bands] for i in range(0, len(rgb), rows * width * bands)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    head, tail = _around(width, height, affine, [len(s) for s in strips], bands, rows, deflate, big, nodata)
    return head + b"".join(strips) + tail


def valid(meta: DataFrame) -> DataFrame:
    """Rasters (epsg, width, height) that can be placed: a known system and a size."""
    return meta.where("epsg IS NOT NULL AND width > 0 AND height > 0")


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    """Lines of the files below a folder. Bounds on ``y`` are pushed down to the strips; ``window`` asks for the centred square of that side."""

    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", ".tif")
        self.window, self.each, self.only = int(options.get("window", 0)), int(options.get("files_per_task", 16)), options.get("only", "lines")
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            bound = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("y",) or not isinstance(bound, int) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, bound + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, bound + 1 - isinstance(f, LessThan))

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.root)
        found = sorted(i.path for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.is_file and i.path.endswith(self.pattern))
        return [_Files(found[i : i + self.each]) for i in range(0, len(found), self.each)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.root)
        for path in partition.paths:
            with system.open_input_file(path) as f:
                yield from self._headers(path, f) if self.only == "headers" else self._lines(path, f)

    @staticmethod
    def _at(f) -> Callable[[int, int], bytes]:  # noqa: ANN001
        return lambda at, n: f.read_at(max(0, min(n, f.size() - at)), at) if at < f.size() else b""

    def _headers(self, path: str, f) -> Iterator[tuple]:  # noqa: ANN001
        yield path, *probed_at(self._at(f))

    def _lines(self, path: str, f) -> Iterator[tuple]:  # noqa: ANN001
        head = Header(self._at(f)).parse()
        width, height = head.one(WIDTH), head.one(HEIGHT)
        side = min(self.window, width, height) if self.window else 0
        x, n = ((width - side) // 2, side) if side else (0, width)
        top, bottom = ((height - side) // 2, (height - side) // 2 + side) if side else (0, height)
        top, bottom = max(top, self.low), min(bottom, self.high)
        tall = head.one(TILE_HEIGHT, min(head.one(ROWS, height), height)) if head.one(COMPRESSION, PLAIN) != PLAIN or TILES in head.tags else 64
        while top < bottom:  # up to the next strip's edge, so that none is read twice
            step = min(bottom, (top // tall + 1) * tall) - top
            block = head.window(x, top, n, step)
            for i in range(step):
                yield path, head.epsg, width, height, block.shape[2], x, top + i, block[i].tobytes(), head.n_read
            top += step


class TiffLines(DataSource):
    """``spark.read.format("tiff_lines").option("path", folder)``: a row for each line of each image, or each header with ``only=headers``.

    ``n_read``: bytes that have been read of the file up to that row. Needs ``spark.sql.python.filterPushdown.enabled`` for bounds on y.
    """

    @classmethod
    def name(cls) -> str:
        return "tiff_lines"

    def schema(self) -> str:
        if self.options.get("only") == "headers":
            return "path string, epsg long, width long, height long, n_read long"
        return "path string, epsg long, width long, height long, bands int, x int, y int, line binary, n_read long"

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)


def lines(spark: SparkSession, path: str, window: int = 0, pattern: str = ".tif") -> DataFrame:
    """Lines of the images below a folder, or of the centred squares of side ``window`` (smaller where an image is)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffLines)
    return spark.read.format("tiff_lines").option("path", path).option("window", window).option("pattern", pattern).load()


def probed(spark: SparkSession, path: str, pattern: str = ".tif") -> DataFrame:
    """path, filename, epsg, width and height of the files below a folder, of which only the headers are read, and how many bytes."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffLines)
    found = spark.read.format("tiff_lines").option("path", path).option("only", "headers").option("pattern", pattern).load()
    return found.withColumn("filename", idents.basename(F.col("path")))


def encoded(pixels: DataFrame, affines: DataFrame, value: list[str], nodata: int | None = None) -> DataFrame:
    """map_id and ``content``: a file for each map, of its pixels (map_id, x, y, values) and affine (map_id, width, height, west, north, dx, dy).

    A map is a file, so its pixels meet in one task; ``raster_ok`` bounds them before.
    """
    schema = "map_id string, content binary"
    rows = pixels.join(affines, "map_id").select(F.col("map_id").cast("string").alias("map_id"), "width", "height", "west", "north", "dx", "dy", "x", "y", *[F.col(v).cast("int").alias(v) for v in value])

    def write(table: pa.Table) -> pa.Table:
        one = table.slice(0, 1).to_pylist()[0]
        out = np.full((one["height"], one["width"], len(value)), 0 if nodata is None else nodata, np.uint8)
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        for i, v in enumerate(value):
            out[y, x, i] = table.column(v).to_numpy()
        data = encode(out.tobytes(), one["width"], one["height"], (one["west"], one["north"], one["dx"], one["dy"]), nodata, len(value))
        return pa.table({"map_id": [one["map_id"]], "content": pa.array([data], pa.binary())})

    return rows.groupBy("map_id").applyInArrow(write, schema)


#: Lines of a strip, and bytes of strips from which on a file is a BigTIFF.
STRIP_ROWS, CLASSIC = 64, (1 << 32) - (64 << 20)
SHAPE = ["width", "height", "west", "north", "dx", "dy"]


def strips(pixels: DataFrame, affines: DataFrame, value: list[str], nodata: int | None = None, rows: int = STRIP_ROWS) -> DataFrame:
    """map_id, strip, the map's size and affine, and ``data``: the strip's deflated lines.

    A group holds a strip, never a map. Strips without any pixel are there too; pixels outside their map go, of several
    at one place any one stays, and maps without a size or an affine have no strips.
    """
    last = F.floor((F.col("height") - 1) / rows).cast("int")
    whole = affines.where("width > 0 AND height > 0").dropna(subset=SHAPE).select("map_id", *SHAPE, F.explode(F.sequence(F.lit(0), last)).alias("strip"))
    own = pixels.select("map_id", F.floor(F.col("y") / rows).cast("int").alias("strip"), "x", "y", *[F.col(v).cast("int").alias(f"_v{i}") for i, v in enumerate(value)])
    schema = f"map_id string, strip int, {', '.join(f'{c} {t}' for c, t in zip(SHAPE, ['int', 'int', *['double'] * 4], strict=True))}, data binary"

    def each(table: pa.Table) -> pa.Table:
        one = table.slice(0, 1).to_pylist()[0]
        top = one["strip"] * rows
        out = np.full((min(rows, one["height"] - top), one["width"], len(value)), 0 if nodata is None else nodata, np.uint8)
        table = table.filter(table.column("x").is_valid())
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        inside = (x >= 0) & (x < one["width"]) & (y < one["height"])
        for i in range(len(value)):
            out[y[inside] - top, x[inside], i] = table.column(f"_v{i}").fill_null(0 if nodata is None else nodata).to_numpy()[inside]
        return pa.table({"map_id": [one["map_id"]], "strip": pa.array([one["strip"]], pa.int32()), **{c: pa.array([one[c]], pa.int32() if i < 2 else pa.float64()) for i, c in enumerate(SHAPE)}, "data": pa.array([zlib.compress(out.tobytes())], pa.binary())})

    typed = whole.join(own, ["map_id", "strip"], "left").select(F.col("map_id").cast("string").alias("map_id"), "strip", *[F.col(c).cast("int" if i < 2 else "double").alias(c) for i, c in enumerate(SHAPE)], "x", "y", *[f"_v{i}" for i in range(len(value))])
    return typed.groupBy("map_id", "strip").applyInArrow(each, schema)


class _Writing:
    """A file whose strips come one after another: before them what the sum of their sizes tells, behind them the rest."""

    def __init__(self, system, path: str, row: dict, bands: int, rows: int, nodata: int | None, classic: int):  # noqa: ANN001
        self.shape = (row["width"], row["height"], tuple(row[c] for c in SHAPE[2:]))
        self.how = (bands, rows, True, row["total"] >= classic, nodata)
        self.sizes: list[int] = []
        self.stream = system.open_output_stream(path)
        self.stream.write(_around(*self.shape, [row["total"]], *self.how)[0])

    def add(self, data: bytes) -> None:
        self.stream.write(data)
        self.sizes.append(len(data))

    def close(self) -> int:
        self.stream.write(_around(*self.shape, self.sizes, *self.how)[1])
        n = self.stream.tell()
        self.stream.close()
        return n


def write(pixels: DataFrame, affines: DataFrame, value: list[str], root: str, nodata: int | None = None, rows: int = STRIP_ROWS, classic: int = CLASSIC) -> DataFrame:
    """Writes a file for each map below a folder and gives name and bytes of each.

    Strips are packed apart and written once; a file is then one stream of them in order, so its task holds a batch of packed
    strips, whatever the file's size. A task that is tried again writes the same file.
    """
    packed = stored(strips(pixels, affines, value, nodata, rows), "strips")
    totals = packed.groupBy("map_id").agg(F.sum(F.length("data")).alias("total"))
    ordered = packed.join(totals, "map_id").repartition("map_id").sortWithinPartitions("map_id", "strip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(root)
        system.create_dir(folder)
        name, file = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([file.close()], pa.int64())], names=["name", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if f"{row['map_id']}.tif" != name:
                    if file is not None:
                        yield done()
                    name = f"{row['map_id']}.tif"
                    file = _Writing(system, f"{folder}/{name}", row, len(value), rows, nodata, classic)
                file.add(row["data"])
        if file is not None:
            yield done()

    return stored(ordered.mapInArrow(run, "name string, bytes long"), "written")
