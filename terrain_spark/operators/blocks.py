"""Rasters as arrays by block: pixels that are near each other meet once, and numpy does the rest.

A block is a square of ``side`` by ``side`` pixels of one raster, so a task never holds more of a raster than that and its edge,
however large the raster is. Values lie in a block row by row as plain bytes (``binary``), one column for each value.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Sides of the blocks of tiles (all levels are multiples of it) and of those with a halo.
CELL, BLOCK = 224, 256

_KINDS = {T.ByteType: "i1", T.ShortType: "i2", T.IntegerType: "i4", T.LongType: "i8", T.FloatType: "f4", T.DoubleType: "f8"}


def kind_of(field: T.StructField, width: int | None = None) -> str:
    """How numpy calls a column's type; arrays of a fixed ``width`` count as so many values a pixel."""
    if isinstance(field.dataType, T.ArrayType):
        if not width:
            raise ValueError(f"{field.name} is an array: say how many values each has")
        return f"{width}{_KINDS[type(field.dataType.elementType)]}"
    return _KINDS[type(field.dataType)]


def _values(column: pa.ChunkedArray, kind: np.dtype, fill: float) -> np.ndarray:
    """A column as an array, with ``fill`` for nulls."""
    if kind.shape:
        array = column.combine_chunks()
        out = np.full((len(array), *kind.shape), fill, kind.base)
        there = np.asarray(array.is_valid())
        out[there] = np.asarray(array.filter(array.is_valid()).flatten()).reshape(-1, *kind.shape)
        return out
    return column.fill_null(fill).to_numpy().astype(kind)


def cells(pixels: DataFrame, key: list[str], value: dict[str, str], side: int = CELL, fill: dict[str, float] | None = None) -> DataFrame:
    """Rows of pixels (key, x, y, values) as blocks: key, cx, cy and the values' bytes. ``value``: numpy's type of each; one shuffle.

    Where a raster has no pixel, or its value is null, a block has ``fill`` (0 if nothing is said).
    """
    fill, kinds = fill or {}, {v: np.dtype(k) for v, k in value.items()}
    at = lambda c: F.floor(F.col(c) / side).cast("int")
    rows = pixels.select(*key, at("x").alias("cx"), at("y").alias("cy"), F.pmod("x", F.lit(side)).alias("_u"), F.pmod("y", F.lit(side)).alias("_v"), *value)
    schema = T.StructType([*[rows.schema[c] for c in (*key, "cx", "cy")], *[T.StructField(v, T.BinaryType()) for v in value]])

    def pack(table: pa.Table) -> pa.Table:
        place = table.column("_v").to_numpy() * side + table.column("_u").to_numpy()
        out = [table.column(c).slice(0, 1) for c in (*key, "cx", "cy")]
        for v, kind in kinds.items():
            block = np.full((side * side, *kind.shape), fill.get(v, 0), kind.base)
            block[place] = _values(table.column(v), kind, fill.get(v, 0))
            out.append(pa.array([block.tobytes()], pa.binary()))
        return pa.table(out, names=schema.names)

    return rows.groupBy(*key, "cx", "cy").applyInArrow(pack, schema)


def met(boxes: DataFrame, blocks: DataFrame, key: list[str], value: list[str], width: Column, height: Column, side: int = CELL) -> DataFrame:
    """Boxes (key, x, y and others) with every block that they touch; a box that lies off the raster keeps a row without one."""
    span = lambda start, n: F.sequence(F.floor(start / side).cast("int"), F.floor((start + n - 1) / side).cast("int"))
    wanted = boxes.select("*", F.explode(span(F.col("x"), width)).alias("cx")).select("*", F.explode(span(F.col("y"), height)).alias("cy"))
    return wanted.join(blocks.select(*key, "cx", "cy", *value), [*key, "cx", "cy"], "left")


def assembled(table: pa.Table, value: dict[str, np.dtype], x: int, y: int, width: int, height: int, side: int, pad: dict[str, float]) -> dict[str, np.ndarray]:
    """The values of one box from the blocks that it touches, ``pad`` where there is none."""
    out = {v: np.full((height, width, *k.shape), pad.get(v, 0), k.base) for v, k in value.items()}
    for i, (cx, cy) in enumerate(zip(table.column("cx").to_pylist(), table.column("cy").to_pylist(), strict=True)):
        left, top = cx * side - x, cy * side - y
        a, b, c, d = max(left, 0), min(left + side, width), max(top, 0), min(top + side, height)
        for v, k in value.items():
            data = table.column(v)[i].as_buffer()
            if data is not None:
                out[v][c:d, a:b] = np.frombuffer(data, k.base).reshape(side, side, *k.shape)[c - top : d - top, a - left : b - left]
    return out


def cut(boxes: DataFrame, pixels: DataFrame, key: list[str], value: dict[str, str], side: int = CELL, pad: dict[str, float] | None = None) -> DataFrame:
    """Each box (key, x, y, size and others) with its values as bytes, row by row; ``pad`` outside the raster.

    A pixel is shuffled once into its block; from there on blocks move, not pixels.
    """
    pad, kinds = pad or {}, {v: np.dtype(k) for v, k in value.items()}
    own = boxes.columns
    rows = met(boxes, cells(pixels, key, value, side, pad), key, list(value), F.col("size"), F.col("size"), side)
    schema = T.StructType([*[boxes.schema[c] for c in own], *[T.StructField(v, T.BinaryType()) for v in value]])

    def gather(table: pa.Table) -> pa.Table:
        x, y, size = (table.column(c)[0].as_py() for c in ("x", "y", "size"))
        got = assembled(table, kinds, x, y, size, size, side, pad)
        return pa.table([*[table.column(c).slice(0, 1) for c in own], *[pa.array([got[v].tobytes()], pa.binary()) for v in value]], names=schema.names)

    return rows.groupBy(*own).applyInArrow(gather, schema)


def unpacked(tiles: DataFrame, keep: list[str], value: dict[str, str]) -> DataFrame:
    """Tiles (size and values as bytes) as rows of pixels: ``keep``, tx, ty and the values; nothing is shuffled."""
    kinds = {v: np.dtype(k) for v, k in value.items()}
    names = {k: t for t, k in _KINDS.items()} | {"u1": T.ShortType}
    spark_type = lambda k: names[k.base.str.lstrip("<|")]()
    schema = T.StructType([*[tiles.schema[c] for c in keep], T.StructField("tx", T.IntegerType()), T.StructField("ty", T.IntegerType()), *[T.StructField(v, T.ArrayType(spark_type(k)) if k.shape else spark_type(k)) for v, k in kinds.items()]])

    def run(batches):
        for batch in batches:
            for i, size in enumerate(batch.column("size").to_pylist()):
                one = batch.slice(i, 1)
                for row in range(0, size, max(1, 65_536 // size)):  # so many lines at once that batches stay small
                    n = min(size - row, max(1, 65_536 // size)) * size
                    place = np.arange(row * size, row * size + n)
                    out = [one.column(c).take(pa.array(np.zeros(n, np.int64))) for c in keep]
                    out += [pa.array((place % size).astype(np.int32)), pa.array((place // size).astype(np.int32))]
                    for v, k in kinds.items():
                        flat = np.frombuffer(one.column(v)[0].as_buffer(), k.base).reshape(size * size, *k.shape)[place]
                        flat = flat.astype("i2") if k.base == "u1" else flat
                        out.append(pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), k.shape[0]).cast(pa.list_(pa.from_numpy_dtype(k.base))) if k.shape else pa.array(flat))
                    yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return tiles.select(*dict.fromkeys([*keep, "size", *value])).mapInArrow(run, schema)


def on_blocks(pixels: DataFrame, key: list[str], reach: int, added: dict[str, T.DataType], compute: Callable, side: int = BLOCK) -> DataFrame:
    """Pixels with columns that depend on all pixels up to ``reach`` away; one shuffle.

    Each pixel goes to its block, and one near the block's edge to the neighbours that need it. ``compute`` gets the rows of a block with its
    surroundings, their places (y, x) in it and its shape, and gives an array over the block for each of ``added`` (null for NaN).
    """
    if reach > side:
        raise ValueError(f"pixels {reach} away need blocks of that side at least")
    x, y = F.col("x"), F.col("y")
    u, v = F.pmod(x, F.lit(side)), F.pmod(y, F.lit(side))
    by_edge = lambda w, i: {-1: w < reach, 0: F.lit(True), 1: w >= side - reach}[i]
    place = lambda i, j: F.when(by_edge(u, i) & by_edge(v, j), F.struct((F.floor(x / side) + i).cast("int").alias("_bx"), (F.floor(y / side) + j).cast("int").alias("_by"), F.lit(i == 0 and j == 0).alias("_own")))
    near = F.filter(F.array(*[place(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]), lambda p: p.isNotNull())
    own = [c for c in pixels.columns if c not in added]
    rows = pixels.select("*", F.inline(near))
    schema = T.StructType([*[pixels.schema[c] for c in own], *[T.StructField(c, t) for c, t in added.items()]])

    def run(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        top, left = y.min() - reach, x.min() - reach  # no wider than the pixels that are there: many rasters are smaller than a block
        at = (y - top, x - left)
        mine = table.column("_own").to_numpy()
        got = compute(table, at, (int(y.max() - top) + reach + 1, int(x.max() - left) + reach + 1))
        kept, mine_at = table.filter(pa.array(mine)), (at[0][mine], at[1][mine])
        return pa.table([*[kept.column(c) for c in own], *[pa.array(g[mine_at], from_pandas=True).cast(to_arrow_type(t)) for g, t in zip(got, added.values(), strict=True)]], names=schema.names)

    return rows.groupBy(*key, "_bx", "_by").applyInArrow(run, schema)


def _grid(table: pa.Table, column: str, at: tuple, shape: tuple) -> np.ndarray:
    out = np.full(shape, np.nan)
    out[at] = table.column(column).cast(pa.float64()).to_numpy()
    return out


def _there(at: tuple, shape: tuple) -> np.ndarray:
    out = np.zeros(shape, bool)
    out[at] = True
    return out


def _difference(z: np.ndarray, there: np.ndarray, spacing: float) -> np.ndarray:
    """Along the second axis: central where both neighbours are there, one-sided or 0 where not."""
    out = np.zeros_like(z)
    before, after, mid = z[:, :-2], z[:, 2:], z[:, 1:-1]
    has_before, has_after = there[:, :-2], there[:, 2:]
    out[:, 1:-1] = np.where(has_before & has_after, (after - before) / (2 * spacing), np.where(has_after, (after - mid) / spacing, np.where(has_before, (mid - before) / spacing, 0.0)))
    return out


def gradient(pixels: DataFrame, key: list[str], z: str = "z", spacing: float = 1.0, side: int = BLOCK) -> DataFrame:
    """Adds dx and dy: central differences, one-sided where a neighbour is missing, 0 where both are; null from null or NaN."""
    def compute(table: pa.Table, at: tuple, shape: tuple) -> list[np.ndarray]:
        grid, there = _grid(table, z, at, shape), _there(at, shape)
        return [_difference(grid, there, spacing), _difference(grid.T, there.T, spacing).T]

    return on_blocks(pixels, key, 1, {"dx": T.DoubleType(), "dy": T.DoubleType()}, compute, side)


def _along(grid: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sums over neighbours along both axes, one after the other."""
    reach = len(weights) // 2
    for _ in range(2):
        wide = np.pad(grid, ((0, 0), (reach, reach)))
        grid = sum(w * wide[:, i : i + grid.shape[1]] for i, w in enumerate(weights)).T
    return grid


def blurred(pixels: DataFrame, radius: float, value: list[str], side: int = BLOCK) -> DataFrame:
    """Gaussian blur of images (map_id, x, y, values), three deviations wide, along rows and then columns; edges are renormalised."""
    reach = max(1, math.ceil(3 * radius))
    weights = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * radius * radius))

    def compute(table: pa.Table, at: tuple, shape: tuple) -> list[np.ndarray]:
        total = _along(_there(at, shape).astype(float), weights)
        with np.errstate(invalid="ignore"):
            return [_along(np.nan_to_num(_grid(table, v, at, shape)), weights) / total for v in value]

    return on_blocks(pixels.select("map_id", "x", "y", *value), ["map_id"], reach, dict.fromkeys(value, T.DoubleType()), compute, side)


def edges(pixels: DataFrame, feature: str, width: int, side: int = BLOCK) -> DataFrame:
    """Adds ``edge``: whether a pixel is within ``width`` pixels of its feature's edge, inside it.

    The outermost pixels of a feature are those beside another one or none; they grow inwards by running maxima along rows and columns, within
    the feature alone.
    """
    def compute(table: pa.Table, at: tuple, shape: tuple) -> list[np.ndarray]:
        number = table.column(feature).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        own = np.full(shape, -1)
        own[at] = number
        wide = np.pad(own, 1, constant_values=-1)
        outer = np.zeros(shape, bool)
        for i, j in ((0, 1), (2, 1), (1, 0), (1, 2)):
            outer |= wide[i : i + shape[0], j : j + shape[1]] != own
        grown = np.where(outer, own, -1)
        for _ in range(width - 1):  # a step takes the pixels around, if they are of the same feature
            wide, more = np.pad(grown, 1, constant_values=-1), grown.copy()
            for i in range(3):
                for j in range(3):
                    near = wide[i : i + shape[0], j : j + shape[1]]
                    more = np.where((more < 0) & (near == own), near, more)
            grown = more
        return [grown >= 0]

    return on_blocks(pixels, ["map_id"], width, {"edge": T.BooleanType()}, compute, side)


def sampled(target: DataFrame, source: DataFrame, key: list[str], value: str, nearest: bool = False, side: int = 64) -> DataFrame:
    """``target`` (key, map_id, sx, sy, mostly x and y, and others) with the source's value at the places (sx, sy); null where the source has none.

    Centres of source pixels (key, x, y, value) are at whole numbers. The value is the weighted mean of the four around the place, of those that
    are there and neither null nor NaN; with ``nearest``, that of the pixel whose area holds the place (from its number to the next).

    Source pixels go once into blocks, with a column and a row of their neighbours; target pixels go once into packets of a target block
    that fall into one source block. A packet and a block meet in a join of packed rows, which skew handling may split, as no group of rows is formed.
    """
    extra = 0 if nearest else 1
    of = lambda c: F.floor(F.floor(F.col(c)) / side).cast("int")
    own = target.columns
    parts = [F.floor(F.col(c) / side) if c in own else F.pmod(F.xxhash64("sx", "sy"), F.lit(16)) for c in ("x", "y")]
    parts = [p.cast("int").alias(n) for p, n in zip(parts, ("_tx", "_ty"), strict=True)]
    placed = target.where(F.col("sx").isNotNull() & F.col("sy").isNotNull()).select("*", of("sx").alias("_bx"), of("sy").alias("_by"), *parts)
    group = list(dict.fromkeys([*key, "map_id", "_tx", "_ty", "_bx", "_by"]))
    packets = placed.groupBy(*group).agg(F.collect_list(F.struct(*own)).alias("_rows")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_bx", "_by", "_rows")
    # a source pixel belongs to its block, and as the last column or row to the blocks before
    x, y = F.col("x"), F.col("y")
    before = lambda i, j: F.when((F.lit(i == 0) | (F.pmod(x, F.lit(side)) == 0)) & (F.lit(j == 0) | (F.pmod(y, F.lit(side)) == 0)), F.struct((F.floor(x / side) - i).cast("int").alias("_sx"), (F.floor(y / side) - j).cast("int").alias("_sy")))
    into = F.filter(F.array(*[before(i, j) for i in range(extra + 1) for j in range(extra + 1)]), lambda p: p.isNotNull())
    spread = source.where(F.col(value).isNotNull()).select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(key)], F.inline(into), "x", "y", F.col(value).cast("double").alias("_v"))
    names = [*[f"_s{i}" for i in range(len(key))], "_sx", "_sy"]
    schema = T.StructType([*[spread.schema[c] for c in names], T.StructField("_block", T.BinaryType())])
    wide = side + extra

    def pack(table: pa.Table) -> pa.Table:
        block = np.full((wide, wide), np.nan)
        left, top = table.column("_sx")[0].as_py() * side, table.column("_sy")[0].as_py() * side
        block[table.column("y").to_numpy() - top, table.column("x").to_numpy() - left] = table.column("_v").to_numpy()
        return pa.table([*[table.column(c).slice(0, 1) for c in names], pa.array([block.tobytes()], pa.binary())], names=schema.names)

    blocks = spread.groupBy(*names).applyInArrow(pack, schema)
    same = (F.col("_bx") == F.col("_sx")) & (F.col("_by") == F.col("_sy"))
    for i in range(len(key)):
        same = same & (F.col(f"_k{i}") == F.col(f"_s{i}"))
    met = packets.join(blocks, same, "left").select("_bx", "_by", "_rows", "_block")
    out_schema = T.StructType([*[target.schema[c] for c in own if c != value], T.StructField(value, T.DoubleType())])

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("_rows").slice(i, 1).flatten()
                cols = {c: rows.field(k) for k, c in enumerate(own)}
                data = batch.column("_block")[i].as_buffer()
                sx, sy = (cols[c].cast(pa.float64()).to_numpy() for c in ("sx", "sy"))
                fx, fy = np.floor(sx), np.floor(sy)
                u, v = (fx - batch.column("_bx")[i].as_py() * side).astype(int), (fy - batch.column("_by")[i].as_py() * side).astype(int)
                if data is None:
                    got = np.full(len(u), np.nan)
                elif nearest:
                    got = np.frombuffer(data).reshape(wide, wide)[v, u]
                else:
                    block, total, weight = np.frombuffer(data).reshape(wide, wide), np.zeros(len(u)), np.zeros(len(u))
                    for p, a in ((0, 1 - (sx - fx)), (1, sx - fx)):
                        for q, b in ((0, 1 - (sy - fy)), (1, sy - fy)):
                            z = block[v + q, u + p]
                            w = np.where(np.isnan(z), 0.0, a * b)
                            total, weight = total + w * np.nan_to_num(z), weight + w
                    with np.errstate(invalid="ignore"):
                        got = np.where(weight > 0, total / weight, np.nan)
                yield pa.RecordBatch.from_arrays([*[cols[c] for c in own if c != value], pa.array(got, pa.float64(), from_pandas=True)], names=out_schema.names)

    found = met.mapInArrow(read, out_schema)
    none = target.where(F.col("sx").isNull() | F.col("sy").isNull()).select(*[c for c in own if c != value], F.lit(None).cast("double").alias(value))
    return found.unionByName(none)
