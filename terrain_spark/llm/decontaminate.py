"""Benchmark decontamination by greedy string tiling.

Windows of the shortest match length are seeds. A document's windows are joined with the items' on their hash, and only the pairs
that meet are tiled: the longest matches that don't overlap are marked again and again, found by running Karp-Rabin hashes over what is not
marked yet. An item leaks if its marked words are a large enough share of it, in whatever order they stand.

Most windows of documents are in no item, so a bit array of the items' seeds, of at most ``MOST_BITS``, is sent before the join; where items are many it
lets more through, and the join decides. An item that leaks shares a number of windows that its length gives, so its most frequent
windows, less than that many, need no seed: a phrase that very many items hold joins nothing if they have rarer ones. Documents and items
are written once with a number of their own, so that repeated rows and null ids stay apart.

Rows: null and empty texts match nothing; items without words are left out, those shorter than the shortest match
are matched as a whole; null ids are kept; repeated rows and items give a row each; very long
texts are compared whole; matches of the same length are marked in the order of the document, then of the item; columns keep their values whatever
their names (what is added gets underscores before its name if that is taken); an empty table on either side gives no match.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window

from .common import F, Rolling, T, WordHashes, free_name, map_arrow, stored, texts_of

#: Words of the shortest match, share of an item that makes a leak.
SHORTEST, COVERAGE = 5, 0.5
#: Bits for each seed, and of the whole array at most (16 MB).
BITS_PER_SEED, MOST_BITS = 16, 1 << 27


def plain(word: bytes) -> bytes:
    """Lower case, without what is no letter or digit at its ends."""
    text = word.decode("utf-8", "replace").lower()
    a, b = 0, len(text)
    while a < b and not text[a].isalnum():
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return text[a:b].encode()


#: The hash of what has no letter or digit.
EMPTY = WordHashes().hash(b"")


def tokens(text: str, hashes: WordHashes) -> np.ndarray:
    h = hashes.of(text.encode("utf-8", "surrogatepass").split())
    return h[h != EMPTY]


def tiles(doc: np.ndarray, item: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of the greedy tiles.

    The greatest length at which free places of both still match is found by halving, as a match holds shorter ones; all matches of that
    length are marked in turn, each place being looked at once, so repeats cost no more than other texts.
    """
    shortest = min(shortest, len(item))
    free_d, free_t = np.ones(len(doc), bool), np.ones(len(item), bool)
    roll_d, roll_t = Rolling(doc), Rolling(item)

    def places(size: int) -> tuple[np.ndarray, ...]:
        at_d, at_t = _free(free_d, size), _free(free_t, size)
        hash_d, hash_t = roll_d.of(at_d, at_d + size), roll_t.of(at_t, at_t + size)
        shared = np.isin(hash_d, hash_t)
        return at_d[shared], hash_d[shared], at_t, hash_t

    out: list[tuple[int, int, int]] = []
    most = min(len(item), len(doc))
    while most >= shortest > 0 and len(places(shortest)[0]):
        low = shortest
        while low < most:
            size = (low + most + 1) // 2
            low, most = (size, most) if len(places(size)[0]) else (low, size - 1)
        at_d, hash_d, at_t, hash_t = places(low)
        waiting: dict[int, list[int]] = {}
        for h, q in zip(hash_t[::-1].tolist(), at_t[::-1].tolist(), strict=True):
            waiting.setdefault(h, []).append(q)
        end = 0
        for p, h in zip(at_d.tolist(), hash_d.tolist(), strict=True):
            if p < end:
                continue
            left = waiting[h]
            while left and not (free_t[left[-1] : left[-1] + low].all() and (doc[p : p + low] == item[left[-1] : left[-1] + low]).all()):
                left.pop()
            if left:
                q, end = left.pop(), p + low
                free_d[p:end] = free_t[q : q + low] = False
                out.append((p, q, low))
        most = low - 1
    return out


def _free(free: np.ndarray, n: int) -> np.ndarray:
    """Starts of runs of ``n`` free places."""
    if len(free) < n:
        return np.zeros(0, np.int64)
    used = np.concatenate(([0], np.cumsum(~free)))
    return np.flatnonzero(used[n:] == used[:-n])


def tiled(doc: np.ndarray, item: np.ndarray, shortest: int = SHORTEST, coverage: float = COVERAGE) -> tuple[float, int] | None:
    """Share of the item that its tiles cover and their number, if that makes a leak."""
    n = min(shortest, len(item))
    if not n or len(doc) < n:
        return None
    # only what stands in shared windows can be in a tile
    there, shared = Rolling(item).windows(n), Rolling(doc).windows(n)
    inside, reach = np.isin(shared, there), np.isin(there, shared)
    spread = lambda hit, size: np.convolve(hit, np.ones(n, np.int64))[:size] > 0
    if spread(reach, len(item)).sum() < coverage * len(item):
        return None
    kept = spread(inside, len(doc))
    # a run that ends parts what stood apart: one word that no item has
    part = np.flatnonzero(kept[:-1] & ~kept[1:]) + 1
    short = np.where(kept, doc, EMPTY)
    kept[part] = True
    found = tiles(short[kept], item, shortest)
    share = sum(x[2] for x in found) / len(item)
    return (share, len(found)) if share >= coverage else None


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """``row`` (all columns) and ``number``, written once, and ``text``, read from the row."""
    written = stored(df.select(F.struct(*df.columns).alias("row"), F.monotonically_increasing_id().alias("number")), name)
    return written.withColumn("text", F.col("row.text").cast("string"))


def seeds(items: DataFrame, shortest: int = SHORTEST, coverage: float = COVERAGE) -> DataFrame:
    """item, n and hash: the windows of n words that tell whether an item can leak; ``items``: text, number."""
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("times", T.LongType()), T.StructField("spare", T.LongType())])

    def make():
        hashes = WordHashes(normal=plain)

        def each(batch: pa.RecordBatch):
            for number, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                t = tokens(text, hashes)
                if len(t):
                    n = min(shortest, len(t))
                    found, times = np.unique(Rolling(t).windows(n), return_counts=True)
                    # tiles of n words and more that cover so many words hold at least a window for every n of them
                    spare = max(0, -(-int(np.ceil(coverage * len(t))) // n) - 1)
                    same = lambda v, kind, m=len(found): pa.array(np.full(m, v, kind))
                    yield pa.RecordBatch.from_arrays([same(number, np.int64), same(n, np.int32), pa.array(found.view(np.int64)), pa.array(times.astype(np.int64)), same(spare, np.int64)], names=schema.names)

        return each

    every = stored(map_arrow(items.select("number", "text"), schema, make), "seeds")
    often = every.groupBy(F.col("hash").alias("_h")).agg(F.count(F.lit(1)).alias("_items"))
    frequent = Window.partitionBy("item").orderBy(F.desc("_items"), "hash")
    return every.join(often, F.col("hash") == F.col("_h")).withColumn("_upto", F.sum("times").over(frequent)).where("_upto > spare").select("item", "n", "hash")


def _bits(found: DataFrame) -> np.ndarray:
    """A bit for each seed, by the low bits of its hash."""
    n = found.count()
    size = 1 << min(MOST_BITS.bit_length() - 1, max(16, (BITS_PER_SEED * n).bit_length()))

    def run(batches):
        out = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(size - 1)
            np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bits"])

    none = found.sparkSession.sparkContext.parallelize([np.zeros(size // 8, np.uint8)], 1)
    return found.select("hash").mapInArrow(run, "bits binary").rdd.map(lambda r: np.frombuffer(r[0], np.uint8)).union(none).treeReduce(np.bitwise_or)


def _pairs(docs: DataFrame, items: DataFrame, shortest: int, coverage: float) -> DataFrame:
    """number, item, coverage and n_tiles of the documents and items of which one leaks into the other."""
    found = stored(seeds(items, shortest, coverage), "seeds")
    sent = docs.sparkSession.sparkContext.broadcast((sorted(r.n for r in found.select("n").distinct().collect()), _bits(found)))
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("hash", T.LongType())])

    def make():
        hashes = WordHashes(normal=plain)
        sizes, bits = sent.value
        mask = np.uint64(8 * len(bits) - 1)

        def each(batch: pa.RecordBatch):
            numbers, own = [], []
            for number, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                doc = tokens(text, hashes) if text else ()
                roll = Rolling(doc) if len(doc) else None
                for n in sizes if roll else ():
                    h = roll.windows(n)
                    at = h & mask
                    hit = np.unique(h[(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1])
                    numbers.append(np.full(len(hit), number, np.int64))
                    own.append(hit.view(np.int64))
            none = [np.zeros(0, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers or none)), pa.array(np.concatenate(own or none))], names=schema.names)

        return each

    hits = map_arrow(docs.select("number", "text"), schema, make)
    met = hits.join(found.select("hash", "item"), "hash").select("number", "item").distinct()
    texts = met.join(items.select(F.col("number").alias("item"), F.col("text").alias("item_text")), "item").join(docs.select("number", "text"), "number")
    out = T.StructType([*schema.fields[:1], T.StructField("item", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.IntegerType())])

    def compare():
        hashes, last = WordHashes(normal=plain), [None, None]

        def each(batch: pa.RecordBatch):
            rows = []
            for number, item, doc_text, item_text in zip(*(batch.column(c).to_pylist() for c in ("number", "item", "text", "item_text")), strict=True):
                if last[0] != number:
                    last[:] = number, tokens(doc_text, hashes)
                got = tiled(last[1], tokens(item_text, hashes), shortest, coverage)
                if got:
                    rows.append((number, item, *got))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int32()))], names=out.names)

        return each

    return map_arrow(texts, out, compare)


def _found(df: DataFrame, benchmark: DataFrame, shortest: int, coverage: float) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` as written, and number, item_id, coverage and n_tiles of their leaks."""
    docs, items = _numbered(df, "documents"), _numbered(benchmark.select("item_id", "text"), "items")
    pairs = _pairs(docs, items, shortest, coverage)
    named = pairs.join(items.select(F.col("number").alias("item"), F.col("row.item_id").alias("item_id")), "item")
    return docs, named.select("number", "item_id", "coverage", "n_tiles")


def leaking(df: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and item that leaks into it: the document's doc_id, item_id, coverage and n_tiles."""
    docs, found = _found(df.select("doc_id", "text"), benchmark, shortest, coverage)
    return found.join(docs.select("number", F.col("row.doc_id").alias("doc_id")), "number").select("doc_id", "item_id", "coverage", "n_tiles")


def leaks(df: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST, coverage: float = COVERAGE) -> DataFrame:
    """``df`` with ``leaks``: an array of item_id, coverage and n_tiles, empty for clean documents."""
    docs, found = _found(df, benchmark, shortest, coverage)
    every = found.groupBy(F.col("number").alias("_n")).agg(F.array_sort(F.collect_list(F.struct("item_id", "coverage", "n_tiles"))).alias("_leaks"))
    joined = docs.join(every, F.col("number") == F.col("_n"), "left")
    kind = every.schema["_leaks"].dataType
    return joined.select("row.*", F.coalesce("_leaks", F.array().cast(kind)).alias(free_name(df, "leaks")))


def clean(df: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``df`` into which no item leaks."""
    docs, found = _found(df, benchmark, shortest, coverage)
    return docs.join(found.select("number"), "number", "left_anti").select("row.*")
