"""Repeated passages: lines, and sentences of longer lines, found by digests that all documents share.

Words are compared in lower case and without the signs around them; what is signs alone is no word, and what has no word is no unit. Of each unit the first occurrence stays, by doc_id and place in the text;
the others are cut out, and their places in the original text are kept. A line counts whatever its length, a sentence
within a longer line from ``LEAST`` words on, as short ones repeat by chance; of a line that goes, no sentence is looked at. A sentence
ends with .!? and the signs after them. One of more than ``LONG`` words is cut further, at places that its words alone decide (see ``cuts``), so that
a passage within it is found wherever it stands.

Rows: null and empty texts have no units and stay as they are; rows with the same doc_id are one document for the
order and don't repeat each other; rows without an id (or with one that is no whole number) come last and are documents of their
own, but those of equal text are one; what a task gathers for a row are the repeated units of its text, however many rows have its id; very long texts are taken whole; ties cannot occur, as places in one document differ;
other columns may have any name, but one called ``removed`` is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import F, Rolling, T, WordHashes, free_name, hash64, map_arrow, stored
from .decontaminate import EMPTY as _EMPTY
from .decontaminate import plain

#: Words of the shortest sentence that counts within a longer line.
LEAST = 8
#: Words of the longest sentence that is not cut, and the words around a cut that decide it.
LONG, AROUND = 32, 8
_END = re.compile(r"\n+|[.!?]+[^\w\s]*[ \t]+")
#: Rows without an id come from here on, by a hash of their text.
_LAST = 1 << 62


def cuts(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places among the words ``h`` that begin a new unit within a sentence of more than ``LONG`` words; ``sizes``: words of each sentence.

    A place stands between two different words of a sentence, ``AROUND`` words or more from its ends; it is a cut if the hash of these two is
    the least of the places within ``AROUND`` words on both sides, the first of equal ones.
    """
    ends = np.cumsum(sizes)
    other = h[1:] != h[:-1]
    other[ends[(ends > 0) & (ends < len(h))] - 1] = False
    place = np.flatnonzero(other) + 1
    key = np.full(len(h) + 2 * AROUND + 1, np.iinfo(np.uint64).max)
    key[place + AROUND] = hash64(hash64(h[place - 1]) + h[place]) >> np.uint64(1)
    least, width = key, 1
    while width < AROUND:  # a power of two
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    own = key[place + AROUND]
    place = place[(own < least[place]) & (own <= least[place + AROUND + 1])]
    at = np.searchsorted(ends, place, side="right")
    return place[(sizes[at] > LONG) & (place - ends[at] + sizes[at] >= AROUND) & (ends[at] - place >= AROUND)]


class Units:
    def __init__(self, least: int):
        self.least = least
        self.hashes = WordHashes(200_000, normal=plain)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, and both halves of the digests, in the order of starts, a line before its sentences."""
        data = text.encode("utf-8", "surrogatepass")
        found = list(_END.finditer(text))
        cut = np.array([0, *(m.end() for m in found), len(text)], np.int64)
        begins = np.array([True, *(text[m.start()] == "\n" for m in found)])  # of each sentence, whether a line begins with it
        h = self.hashes.of(data.split())
        raw = np.frombuffer(data, np.uint8)
        space = np.concatenate(([True], (raw == 32) | (raw - np.uint8(9) < 5)))
        at = np.flatnonzero(space[:-1] & ~space[1:])  # where words begin
        if len(raw) > len(text):
            at -= np.cumsum((raw & 0xC0) == 0x80)[at]
        upto = np.searchsorted(at, cut)
        if (np.diff(upto) > LONG).any() and len(inner := cuts(h, np.diff(upto))):
            cut = np.concatenate((cut, at[inner]))
            order = np.argsort(cut, kind="stable")
            cut, upto = cut[order], np.concatenate((upto, inner))[order]
            begins = np.concatenate((begins, np.zeros(len(inner) + 1, bool)))[order][:-1]
        upto = np.concatenate(([0], np.cumsum(h != _EMPTY)))[upto]
        h, sizes = h[h != _EMPTY], np.diff(upto)
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(sizes))  # the sentence after each line
        several = np.add.reduceat((sizes > 0).astype(np.int64), first) > 1
        inner = np.flatnonzero(np.repeat(several, last - first) & (sizes >= self.least))
        low, high = np.concatenate((first, inner)), np.concatenate((last, inner + 1))
        order = np.lexsort((-high, low))
        low, high = low[order], high[order]
        good = upto[high] > upto[low]
        low, high = low[good], high[good]
        a, b = upto[low], upto[high]
        return cut[low], cut[high], Rolling(h, 0).of(a, b).view(np.int64), Rolling(h, 1).of(a, b).view(np.int64)


def _rank(text: str = "text") -> Column:
    """What documents are ordered by: the doc_id, or of rows without one a hash of the text beyond all ids."""
    return F.coalesce(F.col("doc_id").try_cast("long"), F.lit(_LAST) + F.shiftrightunsigned(F.xxhash64(text), 2))


def units(df: DataFrame, least: int = LEAST) -> DataFrame:
    """h1, h2, the rank of the document and a hash of the text of every unit, once for each row."""
    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in ("h1", "h2", "rank")], T.StructField("whose", T.IntegerType())])

    def make():
        find = Units(least).of

        def each(batch: pa.RecordBatch):
            ids, texts, whose = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            for i in range(0, len(ids), 1000):
                got = []
                for d, x, t in zip(ids[i : i + 1000], texts.slice(i, 1000).to_pylist(), whose[i : i + 1000], strict=True):
                    if x:
                        _, _, h1, h2 = find(x)
                        _, one = np.unique(h1, return_index=True)
                        got.append((h1[one], h2[one], np.full(len(one), d), np.full(len(one), t, np.int32)))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got, strict=True)], names=schema.names)

        return each

    return map_arrow(df.select(_rank().alias("rank"), "text", F.hash("text").alias("whose")), schema, make)


def repeats(df: DataFrame, least: int = LEAST) -> DataFrame:
    """rank, ``whose`` and ``seen``: digests of units that an earlier document has, with that document's rank.

    The list is that of a rank and text, so rows with the same id and other texts don't share one.
    """
    all_units = stored(units(df, least), "units")
    first = all_units.groupBy("h1", "h2").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last").drop("last")
    # stored, so that a line of very many documents is read from an exchange whose large partitions Spark splits
    later = all_units.join(stored(first, "first"), ["h1", "h2"]).where(F.col("rank") > F.col("first"))
    return later.groupBy("rank", "whose").agg(F.collect_set(F.struct("h1", "h2", "first")).alias("seen"))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("first_doc_id", T.LongType())]))


def dedup(df: DataFrame, least: int = LEAST) -> DataFrame:
    """``df`` without repeated units, and ``removed``: their code-point offsets in the original, and the document that keeps them (null without an id).

    Columns keep their values; where one is named removed, the spans get underscores before their name.
    """
    kept, removed = df.columns, free_name(df, "removed")
    rank, seen, whose = free_name(df, "rank"), free_name(df, "seen"), free_name(df, "whose")
    found = stored(repeats(df, least), "repeats").select(F.col("rank").alias(rank), F.col("whose").alias(whose), F.col("seen").alias(seen))
    joined = df.select(*kept, _rank().alias(rank), F.hash("text").alias(whose)).join(found, [rank, whose], "left").select(*kept, rank, seen)
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(removed, SPANS)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_doc_id", pa.int64())]))

    def make():
        find = Units(least).of

        def cut(own_rank, text, seen):
            if not text:
                return text, []
            starts, ends, h1, h2 = find(text)
            _, first = np.unique(h1, return_index=True)
            if not seen and len(first) == len(h1):
                return text, []
            earlier = {(int(s["h1"]), int(s["h2"])): s["first"] for s in seen or ()}
            own: set[tuple[int, int]] = set()
            spans, out, at = [], [], 0
            for a, b, x, y in zip(starts.tolist(), ends.tolist(), h1.tolist(), h2.tolist(), strict=True):
                if a < at:
                    continue  # within a line that is gone
                keeper = earlier.get((x, y))
                if keeper is None and (x, y) in own:
                    keeper = own_rank
                elif keeper is None:
                    own.add((x, y))
                    continue
                spans.append({"start": a, "end": b, "first_doc_id": keeper if keeper < _LAST else None})
                out.append(text[at:a])
                at = b
            return "".join(out) + text[at:], spans

        def each(batch: pa.RecordBatch):
            get = lambda i: batch.column(i).to_pylist()
            at = kept.index("text")
            got = [cut(d, x, s) for d, x, s in zip(get(len(kept)), get(at), get(len(kept) + 1), strict=True)]
            columns = [pa.array([x for x, _ in got], batch.schema.field(i).type) if i == at else batch.column(i) for i in range(len(kept))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([s for _, s in got], kind)], names=schema.names)

        return each

    return map_arrow(joined, schema, make)
