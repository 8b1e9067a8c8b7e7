"""Hard negatives by bit-sliced integer products.

Components become whole numbers, and those of the rows are cut into bit-planes. The inner product with an anchor is the weighted sum of
the anchor's products with the planes. Planes are processed from the sign and the most significant bit down; what the planes to come can
add lies between sums of the anchor's negative and positive components, so each pair has an interval for its score that halves with every plane.
A pair is dropped as soon as its interval cannot qualify: as a positive, if it ends below the lower bounds of as many other
rows as are wanted; as a negative, if it lies outside the windows of all positives, or below the lower bounds of as many rows that are certain to
lie in the window. What is left after the last plane has its exact score.

Anchors are a stated share of the rows, and meet all rows in blocks of at most ``BLOCK`` of each: rows are dealt to blocks by a hash of
their content, a block of anchors is sent to each block of rows, and the two are read by one cogroup. Blocks give few
candidates for each anchor, which are ranked behind a limit in each task. Nothing is broadcast or collected.

Rows: without a label, a vector or an id, or with a null or non-finite component, they take no part; likewise vectors whose scaled squared
length is beyond 2**56, as their products times 100 are no 64-bit number; shorter vectors count as if zeros followed, empty ones score 0; an id
that comes with several rows has the one with the smallest label, then vector, so repeated rows count once; higher scores come first, equal ones
by vec_id; anchors without positives, and positives without negatives, give no row; other columns are not read,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window

from .common import F, T, stored

#: Rows and anchors of a block at most, rows of one at least before there are more blocks than shuffle partitions; what is looked at together.
BLOCK, SMALL, ANCHORS, ROWS = 32_768, 1024, 256, 4096
#: Anchors, rows with changed labels, number of labels, scale of components, positives and negatives for each.
EVERY, CHANGED, LABELS, SCALE, POSITIVES, NEGATIVES = 100, 7, 10, 256, 5, 5
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 80, 100
LONGEST = 1 << 56


def usable(df: DataFrame) -> DataFrame:
    """vec_id, label and v (whole numbers), a row for each id."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & sound)
    label = F.when(F.col("vec_id") % CHANGED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    scaled = F.transform(x, lambda c: F.floor(SCALE * c.cast("double")).cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), scaled.alias("d"))
    small = F.aggregate("d", F.lit(0.0), lambda a, c: a + c * c) <= LONGEST
    rows = rows.where(small).select("vec_id", "label", F.transform("d", lambda c: c.cast("int")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _blocks(n: int, spread: int) -> int:
    return max(1, -(-n // BLOCK), min(spread, n // SMALL))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end in zeros."""
    array = column.combine_chunks()
    size = np.diff(array.offsets.to_numpy())
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = array.flatten().to_numpy()
    return out


class Planes:
    """The bit-planes of rows, most significant first: the value of a plane's ones, and where they are."""

    def __init__(self, v: np.ndarray):
        top = int(max(v.max(initial=0), -(v.min(initial=0) + 1)))
        self.bits = top.bit_length() + 1
        self.v = v

    def __iter__(self):
        yield self.bits - 1, -(1 << (self.bits - 1)), self.v < 0
        for k in range(self.bits - 2, -1, -1):
            yield k, 1 << k, (self.v >> k) & 1 == 1


def _greatest(scores: np.ndarray, n: int) -> np.ndarray:
    """The n-th greatest of each row; the least number where there are fewer."""
    if scores.shape[1] < n:
        return np.full(len(scores), np.iinfo(np.int64).min)
    return np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]


def candidates(a: np.ndarray, c: np.ndarray, may: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """Anchor, row and exact score of the pairs that ``keep`` has not dropped.

    ``may``: which pairs count at all. ``keep``: from the lower and upper bounds of pairs of anchors and rows (two matrices, and which of
    them are left) it gives those that can still qualify. While many pairs are left a plane is one product of matrices; once they
    are few, each pair takes its own components.
    """
    exact = np.float32 if np.abs(a).sum(1).max(initial=0) < 1 << 24 else np.float64
    af, below, above = a.astype(exact), np.minimum(a, 0).sum(1), np.maximum(a, 0).sum(1)
    sums, left, planes = np.zeros((len(a), len(c)), np.int64), may, iter(Planes(c))
    for k, value, ones in planes:
        sums += (af @ ones.T.astype(exact)).astype(np.int64) * value
        rest = (1 << k) - 1
        left = left & keep(sums + (rest * below)[:, None], sums + (rest * above)[:, None], left)
        if k and left.sum() * 8 < left.size:
            break
    i, j = np.nonzero(left)
    score = sums[i, j]
    for k, value, ones in planes:
        score += np.einsum("ij,ij->i", a[i], ones[j], dtype=np.int64, casting="unsafe") * value
        rest = (1 << k) - 1
        low = np.full(left.shape, np.iinfo(np.int64).min)
        low[i, j] = score + rest * below[i]
        high = np.full(left.shape, np.iinfo(np.int64).min)
        high[i, j] = score + rest * above[i]
        stay = keep(low, high, left)[i, j]
        left[i[~stay], j[~stay]] = False
        i, j, score = i[stay], j[stay], score[stay]
    return i, j, score


def _met(left: pa.Table, right: pa.Table, windows: bool, most: int):
    """Blocks of anchors and rows that meet, in parts that are looked at together: ids, positives, and candidates."""
    if not left.num_rows or not right.num_rows:
        return
    size = lambda t: int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max(initial=0))
    width = max(size(left), size(right))
    a, c = _matrix(left.column("v"), width), _matrix(right.column("v"), width)
    a_id, a_label, c_id, c_label = (t.column(x).to_numpy() for t in (left, right) for x in ("vec_id", "label"))
    least = np.iinfo(np.int64).min
    if not windows:  # same labels alone: they lie side by side
        for x in np.unique(a_label):
            own, there = np.flatnonzero(a_label == x), np.flatnonzero(c_label == x)
            for s in range(0, len(own), ANCHORS):
                for t in range(0, len(there), ROWS):
                    i, j = own[s : s + ANCHORS], there[t : t + ROWS]
                    may = a_id[i][:, None] != c_id[j][None, :]

                    def keep(low, high, there):  # noqa: ANN001
                        return high >= _greatest(np.where(there, low, least), most)[:, None]

                    p, q, score = candidates(a[i], c[j], may, keep)
                    yield a_id[i[p]], None, c_id[j[q]], score
        return
    scores = left.column("positives").to_pylist()
    for s in range(0, len(a), ANCHORS):
        tops = [sorted(set(x)) for x in scores[s : s + ANCHORS]]
        widest = max(map(len, tops))
        top = np.array([x + [least] * (widest - len(x)) for x in tops], np.int64)
        bottom = np.where(top == least, least + 1, -(-LOW * np.where(top == least, 0, top) // HIGH))
        for t in range(0, len(c), ROWS):
            may = a_label[s : s + ANCHORS][:, None] != c_label[t : t + ROWS][None, :]
            first, last = np.where(top == least, np.iinfo(np.int64).max, bottom).min(1), top.max(1)

            def keep(low, high, there, top=top, bottom=bottom, first=first, last=last):  # noqa: ANN001
                some = there & (high >= first[:, None]) & (low <= last[:, None])
                if some.sum() * 16 > some.size:
                    return some
                i, j = np.nonzero(some)
                stays = np.zeros(len(i), bool)
                for m in range(top.shape[1]):
                    sure = some & (low >= bottom[:, m, None]) & (high <= top[:, m, None])
                    floor = np.maximum(bottom[:, m], _greatest(np.where(sure, low, least), most))
                    stays |= (high[i, j] >= floor[i]) & (low[i, j] <= top[i, m])
                out = np.zeros_like(some)
                out[i[stays], j[stays]] = True
                return out

            p, q, score = candidates(a[s : s + ANCHORS], c[t : t + ROWS], may, keep)
            for m in range(widest):
                inside = (score >= bottom[p, m]) & (score <= top[p, m])
                yield a_id[s + p[inside]], top[p[inside], m], c_id[t + q[inside]], score[inside]


def _first(groups: list[np.ndarray], ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Which rows are the first n of their group, higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, *groups[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([g[order][1:] != g[order][:-1] for g in groups], axis=0)
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < n]


FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor_id", "positive_score", "vec_id", "score")])


def search(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], most: int) -> DataFrame:
    """anchor_id, positive_score, vec_id and score: for each anchor the rows of its label with the highest scores, at least ``most`` of them.

    If ``anchors`` has ``positives`` (scores), then instead for each of these the rows of other labels in its window.
    """
    windows = "positives" in anchors.columns
    number = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select(*anchors.columns, number(blocks[0], "vec_id").alias("x")).select("*", every(blocks[1]).alias("y"))
    # other names than on the left, as both come from the same rows
    right = rows.select(*[F.col(c).alias(f"c_{c}") for c in ("vec_id", "label", "v")], number(blocks[1], "vec_id").alias("c_y")).select("*", every(blocks[0]).alias("c_x"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out, held = [np.zeros(0, np.int64)] * 4, 0
        for a, p, c, score in _met(left, right.rename_columns([x.removeprefix("c_") for x in right.column_names]), windows, most):
            some = (a, score * 0 if p is None else p, c, score)
            out = [np.concatenate(x) for x in zip(out, some, strict=True)]
            held += len(a)
            if held > 1 << 20:
                kept = _first(out[:2], out[2], out[3], most)
                out, held = [x[kept] for x in out], 0
        kept = _first(out[:2], out[2], out[3], most)
        return pa.table([pa.array(x[kept]) for x in out], names=FOUND.names)

    return left.groupBy("x", "y").cogroup(right.groupBy("c_x", "c_y")).applyInArrow(run, FOUND)


def _ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def mine(df: DataFrame, anchor: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; ``anchor`` says which rows are anchors."""
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(usable(df), "vectors")
    anchors = rows.where(F.col("vec_id") % EVERY == 0 if anchor is None else anchor)
    blocks = (-(-max(1, anchors.count()) // BLOCK), _blocks(rows.count(), spread))
    positives = stored(_ranked(search(anchors, rows, blocks, POSITIVES), ["anchor_id"], POSITIVES).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("positives"))
    found = search(anchors.join(scores, "vec_id"), rows, blocks, NEGATIVES)
    ranked = _ranked(found, ["anchor_id", "positive_score"], NEGATIVES)
    out = ranked.select("anchor_id", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(out, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
