"""Language-model scores by a weighted backoff automaton.

The model has the counts of all n-grams of the training texts. States are contexts, arcs are n-grams with
their smoothed log probability, and each state has a failure arc to the next shorter context. Texts are read from left to
right: an arc leads from the state before a word to the state behind it, and weights of arcs and failure arcs add up.
All texts of a block are read at the same time, so a step is one operation on arrays.

Smoothing: P(w | h) = (c(hw) + MU * P(w | h')) / (c(h) + MU), h' being h without its first word, down to
P(w) = (c(w) + 1) / (N + V + 1), whose rest is that of unknown words; the sum over all words is 1.

The model is never in one place. Texts are read once and written as blocks of bounded size. A block asks for the counts of
its own distinct n-grams, sorted and packed in one piece for each bucket of hashes; a bucket adds up what all blocks
have counted and answers each piece; the block then builds the part of the automaton that its texts can
reach. Frequent n-grams are counted within each block first, so none makes a bucket larger than others; the number of
buckets follows the size of the input, so a bucket does not grow with it.

Rows: null and empty texts have the end as their only token; rows without an id are not held out; repeated rows count
each; ids that are no whole numbers become null in the result, but still decide what is held out; very long texts make a block of their own; n-grams are told apart by ``BITS`` bits of
hash; other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import F, T, WordHashes, hash64, input_bytes, stored

#: Words of the longest n-gram, weight of the shorter context, characters of a block, bytes of input for each bucket.
ORDER, MU, BLOCK, BUCKET_BYTES = 3, 4.0, 4_000_000, 8 << 20
#: Bits of the hash of an n-gram; of N others one is taken for it with a chance of N / 2**55.
BITS = 55
#: Held out are the texts whose hash leaves this remainder.
MODULUS, HELD_OUT = 7, 2

_hash = WordHashes().hash
BEGIN, END = (np.uint64(_hash(x)) for x in (b"\n", b" "))  # no word holds these


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % MODULUS == HELD_OUT, F.lit(False))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list, list[bool], list[str]]]:
    """Rows of a task in blocks; where they end depends on the rows alone."""
    from pyspark import TaskContext

    number, total = TaskContext.get().partitionId() << 32, 0
    ids, held, texts = [], [], []
    for batch in batches:
        for d, h, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids.append(d)
            held.append(h)
            texts.append(x or "")
            total += len(texts[-1])
            if total >= size:
                yield number, ids, held, texts
                number, total = number + 1, 0
                ids, held, texts = [], [], []
    if ids:
        yield number, ids, held, texts


def words_of(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each with its begin and end, and their number in each text."""
    parts = [hashes.of(x.lower().split()) for x in texts]
    return np.concatenate([y for p in parts for y in (BEGIN[None], p, END[None])]), np.array([len(p) + 2 for p in parts])


class Grams:
    """The n-grams of a block.

    ``keys`` are sorted, the last bit tells words from other keys; ``at[n]`` has for every place of the text the index of the
    n-gram that ends there, or -1; every document is preceded by a place for its begin.
    """

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, train: np.ndarray, order: int):
        self.sizes = sizes
        self.first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        place = np.arange(len(flat)) - np.repeat(self.first, sizes)
        self.begins = place == 0
        training = np.repeat(train, sizes)
        made, where, key = [], [], flat
        for n in range(1, order + 1):
            if n > 1:
                key = hash64(np.concatenate((key[:1], key[:-1])) + np.uint64(n)) + flat
                good = np.flatnonzero(place >= n - 1)
            else:
                good = np.arange(len(flat))
            mark = np.where(self.begins, 0, 1).astype(np.uint64) if n == 1 else np.uint64(0)
            made.append((hash64(key) >> np.uint64(64 - BITS) << np.uint64(1) | mark)[good])
            where.append(good)
        self.keys, back = np.unique(np.concatenate(made), return_inverse=True)
        self.at, low, learned = [], 0, []
        for w in where:
            own = back[low : low + len(w)]
            low += len(w)
            a = np.full(len(flat), -1)
            a[w] = own
            self.at.append(a)
            learned.append(own[training[w]])
        self.counts = np.bincount(np.concatenate(learned), minlength=len(self.keys)).astype(np.uint32)
        self.n_train = int((~self.begins & training).sum())


def _pack(x: np.ndarray) -> bytes:
    """Bytes of numbers by their place, so that those that are zero vanish."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys."""
    bounds = np.array([(b << BITS + 1) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


BLOCKS = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("texts", T.BinaryType())])
ASKED = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("n_train", T.LongType())])
TOLD = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("counts", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("n_train", T.LongType())])
SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])


def _written(rows: DataFrame, size: int) -> DataFrame:
    """The blocks, each with its texts in one compressed piece."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(BLOCKS)

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for block, ids, held, texts in _blocks(batches, size):
            data = [x.encode("utf-8", "surrogatepass") for x in texts]
            yield pa.RecordBatch.from_pylist([{"block": block, "ids": ids, "held": held, "sizes": [len(x) for x in data], "texts": pack(b"".join(data))}], schema)

    return stored(rows.mapInArrow(run, BLOCKS), "blocks")


def _grams(row: dict, hashes: WordHashes, order: int) -> Grams:
    import zstandard

    data, ends = zstandard.ZstdDecompressor().decompress(row["texts"]), np.cumsum(row["sizes"]).tolist()
    return Grams(*words_of([data[a:b] for a, b in zip([0, *ends], ends, strict=False)], hashes), ~np.array(row["held"], bool), order)


def _ask(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """The sorted keys and counts of each block, a piece for each bucket."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(ASKED)

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = _grams(row, hashes, order)
                cut = _cuts(grams.keys, buckets)
                got = []
                for b in range(buckets):
                    keys = grams.keys[cut[b] : cut[b + 1]]
                    if len(keys) or b == 0:
                        got.append({"bucket": b, "block": row["block"], "keys": _pack(np.diff(keys, prepend=np.uint64(0))), "counts": _pack(grams.counts[cut[b] : cut[b + 1]]), "n_train": grams.n_train if b == 0 else 0})
                yield pa.RecordBatch.from_pylist(got, schema)

    return blocks.mapInArrow(run, ASKED)


def _tell(asked: DataFrame, buckets: int) -> DataFrame:
    """Adds up the counts of each bucket and answers every piece; a task has one bucket."""

    def run(batches):
        pieces: dict[int, list[tuple]] = {}
        for batch in batches:
            for p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces.setdefault(p[0], []).append(p)
        for bucket in sorted(pieces):
            own = pieces.pop(bucket)
            keys = [np.cumsum(_unpack(p[2], np.uint64)) for p in own]
            flat = np.concatenate(keys)
            order = np.argsort(flat, kind="stable")
            new = np.concatenate(([True], flat[order][1:] != flat[order][:-1])) if len(flat) else np.zeros(0, bool)
            number = np.empty(len(flat), np.int64)
            number[order] = np.cumsum(new) - 1
            sums = np.bincount(number, np.concatenate([_unpack(p[3], np.uint32) for p in own]), int(new.sum())).astype(np.int64)
            different = flat[order][new]
            n_words = int(((sums > 0) & (different & np.uint64(1) == 1)).sum())
            at = 0
            for i, p in enumerate(own):
                n = len(keys[i])
                yield pa.RecordBatch.from_arrays([pa.array([p[1]], pa.int64()), pa.array([bucket], pa.int32()), pa.array([_pack(sums[number[at : at + n]])], pa.binary()), pa.array([n_words if i == 0 else 0], pa.int64()), pa.array([p[4]], pa.int64())], names=TOLD.names)
                at += n

    return asked.repartitionById(buckets, F.col("bucket")).mapInArrow(run, TOLD)


class Automaton:
    """The states and arcs that the texts of a block can reach, by the index of their n-gram in ``grams.keys``.

    A state is a context that the model has, ``len(keys)`` is the root. The arc of n-gram hw leads from state h over w;
    it is there if the model has hw. Without it the failure arc of h leads on, to h without its first word.
    """

    def __init__(self, grams: Grams, counts: np.ndarray, n: int, v: int, order: int, mu: float):
        c = counts.astype(np.float64)
        self.grams, self.order, self.known = grams, order, counts > 0
        p = (c + 1) / (n + v + 1)  # of words; longer n-grams follow, each from the shorter ones
        for k in range(2, order + 1):
            place = np.flatnonzero(grams.at[k - 1] >= 0)
            end, context, shorter = grams.at[k - 1][place], grams.at[k - 2][place - 1], grams.at[k - 2][place]
            p[end] = (c[end] + mu * p[shorter]) / (c[context] + mu)
        self.weight = np.log10(p)
        self.fail_weight = np.log10(mu / (c + mu))

    def _state(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place the context of so many words before it, and whether that is a state."""
        if words == 0:
            return np.full(len(self.grams.begins), len(self.known)), np.ones(len(self.grams.begins), bool)
        before = self.grams.at[words - 1]
        before = np.concatenate((np.full(1, -1), before[:-1]))
        before[self.grams.begins] = -1
        return before, (before >= 0) & self.known[before]

    def read(self) -> np.ndarray:
        """The log probability that each place adds; at a place all texts take arcs at the same time.

        The state that the arc before has led to is the longest context that the model has; where it lacks the arc of
        the next word, its failure arc is taken, until a state has that arc. The root has arcs for all words.
        """
        total, waiting = np.zeros(len(self.grams.begins)), ~self.grams.begins
        for words in range(self.order - 1, -1, -1):
            state, there = self._state(words)
            here = waiting & there
            arc = self.grams.at[words]
            take = here & (self.known[arc] if words else True)
            total[take] += self.weight[arc[take]]
            fall = here & ~take
            total[fall] += self.fail_weight[state[fall]]
            waiting = waiting & ~take
        return total


def _scored(row: dict, hashes: WordHashes, told: list[tuple[int, bytes]], n: int, v: int, order: int, mu: float, buckets: int) -> pa.RecordBatch:
    grams = _grams(row, hashes, order)
    counts = np.zeros(len(grams.keys), np.int64)
    cut = _cuts(grams.keys, buckets)
    for bucket, data in told:
        counts[cut[bucket] : cut[bucket + 1]] = _unpack(data, np.int64)
    token, word = ~grams.begins, grams.at[0]
    base = np.where(token, np.log10((counts[word] + 1) / (n + v + 1)), 0)
    sums = [np.add.reduceat(x, grams.first) for x in (base, Automaton(grams, counts, n, v, order, mu).read(), token & (counts[word] > 0))]
    return pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(grams.sizes - 1, pa.int64()), pa.array(sums[2].astype(np.int64)), pa.array(np.full(len(grams.sizes), n), pa.int64()), pa.array(sums[0]), pa.array(sums[1])], names=SCORES.names)


def score(df: DataFrame, order: int = ORDER, mu: float = MU, block: int = BLOCK, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    buckets = buckets or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) // BUCKET_BYTES)
    rows = df.select(F.col("doc_id").cast("string").try_cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), "text")
    blocks = _written(rows, block)
    told = stored(_tell(_ask(blocks, order, buckets), buckets), "counts")
    n, v = told.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = list(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist(), strict=True))
        batches = [_scored(row, WordHashes(), answers, n, v, order, mu, buckets) for row in left.to_pylist()]
        return pa.Table.from_batches(batches, batches[0].schema if batches else None)

    return blocks.groupBy("block").cogroup(told.select("block", "bucket", "counts").groupBy("block")).applyInArrow(run, SCORES)
