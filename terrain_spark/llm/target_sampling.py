"""Importance resampling towards the distribution of a target, in two passes of Arrow batches.

The first pass hashes the words of each text into ``BUCKETS`` buckets: ``np.bincount`` gives a vector for each partition, and
``treeReduce`` adds them up. A bucket's gain is the log ratio of its shares in target and raw texts. The second pass gathers the gains,
which are broadcast (10,000 numbers), and sums them for each text by a weighted ``np.bincount``. Gumbel noise from the id is added, and
of the texts that are long enough a share with the highest scores is drawn.

Ranks need no sort in one task: scores are whole numbers within narrow bounds, so their counts give the score at the
cut; what lies above is dealt by ranges and numbered by prefix sums.

Rows: null and empty texts have no words, a weight of 0 and their noise alone; very long texts count whole, batches are cut into
portions; ties go to the smaller doc_id, rows without an id come last among ties and have the noise of an empty id; repeated rows
count each and are ranked each, equal ones in any order; ids that are no whole numbers become null in the result but keep their noise;
other columns are not read, whatever their names; an empty table gives an empty result, an empty target gains
of smoothing alone.
"""

from __future__ import annotations

import math
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..operators.ordinals import numbered
from .common import F, T, map_arrow, portions, stored

#: Buckets, words of the shortest text that may be drawn, drawn texts in a hundred, seed of the noise.
BUCKETS, LEAST, PERCENT, SEED = 10_000, 20, 10, 2024
#: Words whose buckets a task remembers.
REMEMBERED = 1_000_000

#: Letters in lower case, digits and all bytes beyond ASCII stay; others part words.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


class Buckets(dict):
    """Buckets of words, remembered up to a bound."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = crc32(word) % self.n
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in pc.cast(column, pa.binary()).to_pylist()]


def counts(df: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many words of all texts fall into each bucket."""

    def run(batches):
        look, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            texts = _bytes(batch.column(0))
            for a, b in portions(texts):
                for text in texts[a:b]:
                    total += np.bincount(look.of(words_of(text)), minlength=buckets) if len(text) > 100_000 else 0
                total += np.bincount(look.of(words_of(b" ".join(x for x in texts[a:b] if len(x) <= 100_000))), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = df.select(F.col("text").cast("string")).mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    none = df.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)  # an empty table has no partition
    return vectors.union(none).treeReduce(np.add)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 ln of each bucket's share in the target against that in the raw texts, smoothed by one, rounded down."""
    n, m, k = float(raw.sum()), float(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (n + k) / ((s + 1.0) * (m + k)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: str, seed: int) -> int:
    h = int(sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_features", "weight", "score")])


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight and score of every row."""
    gain = gains(counts(docs, buckets), counts(target, buckets))
    sent = docs.sparkSession.sparkContext.broadcast(gain.astype(np.float64))

    def make():
        look = Buckets(buckets)

        def each(batch: pa.RecordBatch):
            texts, weights, sizes = _bytes(batch.column(2)), [], []
            for a, b in portions(texts):
                words = [words_of(x) for x in texts[a:b]]
                n = np.fromiter(map(len, words), np.int64, b - a)
                found = look.of([w for own in words for w in own])
                sums = np.bincount(np.repeat(np.arange(b - a), n), sent.value[found], b - a).astype(np.int64)
                sizes.append(n)
                weights.append(sums // np.maximum(n, 1))
            n, weight = np.concatenate(sizes), np.concatenate(weights)
            own = weight + np.fromiter((noise(x or "", seed) for x in batch.column(1).to_pylist()), np.int64, len(n))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight), pa.array(own)], names=SCORED.names)

        return each

    key = F.col("doc_id").cast("string")
    return map_arrow(docs.select(key.try_cast("long").alias("doc_id"), key.alias("key"), F.col("text").cast("string")), SCORED, make)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is null where the row is not drawn."""
    found = stored(scored(docs, target, buckets, seed), "scored")
    may = F.col("n_features") >= least
    tally = found.where(may).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toArrow()  # whole numbers from some -60,000 to 80,000
    score, n = tally.column("score").to_numpy(), tally.column("n").to_numpy()
    wanted = percent * int(n.sum()) // 100
    none = found.select("*", F.lit(None).cast("long").alias("rank"))
    if not wanted:
        return none
    order = np.argsort(-score)
    cut = int(score[order][np.searchsorted(np.cumsum(n[order]), wanted)])
    above = may & (F.col("score") >= cut)
    # equal rows are told apart by where they stand in the stored files
    head = numbered(found.where(above).withColumn("_turn", F.monotonically_increasing_id()), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_turn")], name="rank")
    return head.select(*found.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")).unionByName(none.where(~above))
