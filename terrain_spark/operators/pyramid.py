"""Nested tile pyramids: origins, tiles, crops, priors and the walk from coarse to fine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import idents
from ..sources import pyramids as artefacts
from ..sources.pyramids import SCALES, STRIDE, layout
from . import blocks
from .spread import spread


def on_map(x: Column, y: Column, w: Column, h: Column, side: int = SCALES[0]) -> Column:
    """Twice the pixels of a pyramid that lie on the map, against its area: whole numbers, no rounding."""
    inside = lambda start, size: F.greatest(F.lit(0), F.least(start + side, size) - start)
    return inside(x, w).cast("bigint") * inside(y, h) * 2 >= side**2


def origins(maps: DataFrame, side: int = SCALES[0], stride: int = STRIDE) -> DataFrame:
    """Pyramids of each map (map_id, width, height) that are on it by half at least.

    A map becomes hundreds of tiles and thousands of names, so maps are spread first; as they are spread by ``map_id``, what is counted by map or
    pyramid later needs no other shuffle.
    """
    steps = lambda size: F.sequence(F.lit(0), F.greatest(F.lit(0), size - 1), F.lit(stride))
    rows = spread(maps.where("width > 0 AND height > 0"), "map_id").select("*", F.explode(steps(F.col("height").cast("int"))).alias("oy"))
    grid = rows.select("*", F.explode(steps(F.col("width").cast("int"))).alias("ox")).where(on_map(F.col("ox"), F.col("oy"), F.col("width"), F.col("height"), side))
    return grid.withColumn("pyramid_id", idents.pyramid_id(F.col("ox"), F.col("oy"), stride))


def tiles(pyramids: DataFrame, scales: list[int] = SCALES) -> DataFrame:
    """The 1 + 4 + 16 tiles of each pyramid with the id of their parent; ids hold the side and the quadrants.

    The 21 are a constant relation that each pyramid is shifted to, so nothing is computed for a tile but its place.
    """
    one = lambda t: F.struct(F.lit(t.level).alias("level"), F.lit(t.tile_id).alias("tile_id"), F.lit(t.parent_id).cast("string").alias("parent_id"), F.lit(t.dx).alias("_dx"), F.lit(t.dy).alias("_dy"), F.lit(t.size).alias("size"))
    placed = pyramids.select("*", F.inline(F.array(*map(one, layout(scales)))))
    return placed.select(*pyramids.columns, "level", "tile_id", "parent_id", (F.col("ox") + F.col("_dx")).alias("x"), (F.col("oy") + F.col("_dy")).alias("y"), "size")


def training_index(pyramids: DataFrame, weights: DataFrame) -> DataFrame:
    """Tiles of the pyramids (map_id, pyramid_id, path, ox, oy) that have weights (map_id, pyramid_id, ...).

    A path under ``test`` is a leak: reading the index then fails and names it, so that no training run begins. Neither side is broadcast: both
    grow with the maps, though the table they are made of may be small.
    """
    leak = F.when(idents.under_test(F.col("path")), F.raise_error(F.concat(F.lit("test data in the training index: "), F.col("path"))))
    safe = pyramids.where(F.coalesce(leak.cast("boolean"), F.lit(True)))
    key = ["map_id", "pyramid_id"]
    return tiles(spread(safe, *key).join(spread(weights, *key).hint("merge"), key))


def artifacts(tile_id: Column) -> Column:
    """The names of a tile's three images."""
    return F.struct(*[F.concat(tile_id, F.lit(f"_{kind}.png")).alias(kind) for kind in ("image", "land_cover", "topography")])


def children(tile: DataFrame, key: list[str]) -> DataFrame:
    """Each inner tile with its children: an aggregation by parent in place of a self-join."""
    return tile.where("parent_id IS NOT NULL").groupBy(*key, F.col("parent_id").alias("tile_id")).agg(F.sort_array(F.collect_list(F.col("tile_id"))).alias("children"))


def tile_pixels(box: DataFrame, pixels: DataFrame, key: list[str], value: list[str], pad: int = 255, side: int = blocks.CELL) -> DataFrame:
    """Pixels of each box (x, y, size), in its own coordinates; ``pad`` outside the map and for nulls.

    Pixels are packed into cells of ``side``, each tile gathers the cells that it touches, and its pixels are rows again at the
    end only. So a map's pixels are shuffled once however many tiles overlap.
    """
    kinds = {v: blocks.kind_of(pixels.schema[v]) for v in value}
    got = blocks.cut(box.select(*key, "tile_id", "x", "y", "size"), pixels, [k for k in key if k in pixels.columns], kinds, side, dict.fromkeys(value, pad))
    return blocks.unpacked(got, [*key, "tile_id"], kinds)


def prior_tiles(child: DataFrame, parent_pixels: DataFrame, key: list[str], width: int = 12, side: int = blocks.CELL) -> DataFrame:
    """Each child tile (key, tile_id, x, y, size) with its parent's probabilities at its pixels (``p``, bytes of doubles); zeros where it has none."""
    return blocks.cut(child.select(*key, "tile_id", "x", "y", "size"), parent_pixels, key, {"p": f"{width}f8"}, side)


def prior_of(child: DataFrame, parent_pixels: DataFrame, width: int = 12) -> DataFrame:
    """The parent's probabilities at each child pixel (key, x, y absolute); zeros where the parent has none."""
    zeros = F.array_repeat(F.lit(0.0), width)
    return child.join(parent_pixels, ["map_id", "x", "y"], "left").withColumn("prior", F.coalesce("p", zeros)).drop("p")


def recursive_predict(tile: DataFrame, model: Callable, schema: str, cell: int | None = None, clustered: bool = False) -> DataFrame:
    """Level by level: a level's tiles are predicted together, then their children get them as prior.

    ``tile``: map_id, pyramid_id, tile_id, parent_id, level and what the model reads; ids are unique in a pyramid. ``model`` takes and gives
    batches for ``mapInPandas`` with the columns of ``schema``, of which one is ``p``. With ``cell``, the pixels of a cell's side, ``p``
    is a map of cells row by row, and a child's prior is the part that its own box (x, y, size) cuts out of its parent's;
    without it, all of the parent's ``p``.

    The tiles of a pyramid stand in one task, some hundred pyramids are walked at a time, and the model is called for each of their levels (it keeps
    what is costly to load itself). So no level is joined with another, and a parent's prediction is neither shuffled nor made twice. With
    ``clustered`` the rows of a pyramid follow each other already, as those of ``tiles`` do; otherwise they are brought together by one shuffle.
    """
    import numpy as np
    import pandas as pd

    key, levels = ["map_id", "pyramid_id"], len(SCALES)
    if not clustered:
        tile = tile.repartition(*key).sortWithinPartitions(*key)

    def part_of(p, parent, box):  # noqa: ANN001, ANN202
        left, top, size, side = ((v // cell) for v in (box[0] - parent[0], box[1] - parent[1], box[2], parent[2]))
        return p.reshape(side, side)[top : top + size, left : left + size].reshape(-1)

    def level_by_level(rows: pd.DataFrame):  # noqa: ANN202
        known, boxes = {}, {}
        for level in range(levels):
            own = rows[rows["level"] == level].reset_index(drop=True)
            parents = list(zip(own["map_id"], own["pyramid_id"], own["parent_id"], strict=True))
            prior = [known.get(k) for k in parents]
            if cell:
                at = list(zip(own["x"], own["y"], own["size"], strict=True))
                prior = [None if p is None else part_of(p, boxes[k], b) for p, k, b in zip(prior, parents, at, strict=True)]
                boxes = dict(zip(zip(own["map_id"], own["pyramid_id"], own["tile_id"], strict=True), at, strict=True))
            own["prior"], known = pd.Series(prior, dtype=object), {}
            for got in model(iter([own])) if len(own) else ():
                if level + 1 < levels:
                    known.update(zip(zip(got["map_id"], got["pyramid_id"], got["tile_id"], strict=True), (None if p is None else np.asarray(p, float) for p in got["p"]), strict=True))
                yield got

    def walk(batches):  # noqa: ANN001, ANN202
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            other = (rows[key].ne(rows[key].iloc[-1])).any(axis=1).to_numpy().nonzero()[0]
            at = int(other[-1]) + 1 if len(other) else 0  # where the last pyramid begins, of which more may follow
            rest = rows.iloc[at:]
            if at:
                yield from level_by_level(rows.iloc[:at])
        if rest is not None and len(rest):
            yield from level_by_level(rest)

    return tile.mapInPandas(walk, schema)


def artifact_files(pyramids: DataFrame, pixels: DataFrame, weights: DataFrame, scales: list[int] = SCALES, stride: int = STRIDE) -> DataFrame:
    """map_id, pyramid_id, name and content of the images and sidecars of each pyramid, those of one in a row.

    ``pyramids``: map_id, pyramid_id, ox, oy, width, height; ``pixels``: map_id, x, y, r, g, b, lc, topo; ``weights``: map_id and the text of its
    weights, which every pyramid gets unchanged. Images are black outside the map, labels unknown (255). Pixels are packed
    into cells of the finest tiles' side; a pyramid gathers its 16 cells and cuts all 21 tiles out of them.
    """
    import numpy as np
    import pyarrow as pa

    value, side = dict.fromkeys(["r", "g", "b", "lc", "topo"], "u1"), scales[-1]
    pad = {"lc": 255, "topo": 255}
    kinds = {v: np.dtype(k) for v, k in value.items()}
    packed = blocks.cells(pixels, ["map_id"], value, side, pad)
    box = pyramids.join(weights.select("map_id", F.col("weights").alias("_weights")), "map_id").select("map_id", "pyramid_id", F.col("ox").alias("x"), F.col("oy").alias("y"), "width", "height", "_weights")
    rows = blocks.met(box, packed, ["map_id"], list(value), F.lit(scales[0]), F.lit(scales[0]), side).withColumn("map_id", F.col("map_id").cast("string"))

    def draw(table: pa.Table) -> pa.Table:
        one = {c: table.column(c)[0].as_py() for c in ("map_id", "pyramid_id", "x", "y", "width", "height", "_weights")}
        whole = blocks.assembled(table, kinds, one["x"], one["y"], scales[0], scales[0], side, pad)
        files = artefacts.files_of(one["map_id"], one["pyramid_id"], (one["x"], one["y"]), (one["width"], one["height"]), np.dstack([whole[c] for c in "rgb"]), whole["lc"], whole["topo"], one["_weights"], scales, stride)
        names = list(files)
        return pa.table({"map_id": [one["map_id"]] * len(names), "pyramid_id": [one["pyramid_id"]] * len(names), "name": names, "content": pa.array([files[n] for n in names], pa.binary())})

    return rows.groupBy("map_id", "pyramid_id").applyInArrow(draw, "map_id string, pyramid_id string, name string, content binary")
