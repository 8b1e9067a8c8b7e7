"""Quality classifier by importance resampling.

Two hashed n-gram models, of target text (good and harmless labelled documents) and of raw text (all labelled documents), are
fitted on a bounded sample of labelled documents. A document's log weight is the sum over its n-grams of the log ratio of their
probabilities in the two models; Gumbel noise is added to it, and the top k documents are kept. k is an input; by default it is
the share of target documents among the labelled ones, of all rows.

N-grams are words, and pairs of neighbours' shapes, hashed with the language into ``BUCKETS`` buckets for each kind. Ratios are
relative to those of usual target text of the language, so that a text's length carries no weight: raw counts are scaled so that the mean
log ratio over target n-grams is 0, and the mean that is left after shrinking is taken from every n-gram. A ratio is shrunk by how
well the numbers of documents tell it from chance: by z * z / (z * z + DOUBT * DOUBT) for a difference of z deviations, so weak
evidence counts a little and long texts gather little noise.

Rows: null and empty texts have a log weight of 0, which is neutral; texts of any length count whole; rows with the
same doc_id have the same noise, and the same doc_id and text are kept or rejected together, as a tie is decided by
doc_id; null languages are a language of their own; labels that are null or of unknown documents teach nothing, of several
labels of a document the worst counts; without labels, all weights are 0 and all rows are kept; other columns may have any name; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import F, T, WordHashes, free_name, hash64, map_arrow, stored
from .decontaminate import plain

#: Labelled documents of the sample, pseudo-count of a bucket, deviations at which a ratio is halved, groups of languages with a scale
#: of their own: the most frequent ones of the sample have one each, all others share one.
SAMPLE, PRIOR, DOUBT, LANGUAGES = 20_000, 0.5, 6.0, 12
#: Buckets of words and of pairs of shapes.
BUCKETS = (1 << 20, 1 << 16)
KINDS = (slice(0, BUCKETS[0]), slice(BUCKETS[0], sum(BUCKETS)))
#: Log weights are divided by the temperature before noise is added.
TEMPERATURE, SEED = 1.0, 17
#: Rows that are weighed at once, so that of a batch of 10,000 long texts not all are held as strings.
ROWS = 1000


_RUNS = re.compile(r"([A-Za-z0])\1+")


def shape(word: bytes) -> bytes:
    """``Word,!!`` as ``Aa,!!``: letters by case, digits as 0, runs as one."""
    text = word.decode("utf-8", "replace")
    return _RUNS.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in text)).encode()


class NGrams:
    """Buckets of the n-grams of texts: those of words first, then those of pairs of shapes."""

    def __init__(self):
        self.words, self.shapes = WordHashes(normal=plain), WordHashes(normal=shape)
        self.salts: dict[str | None, np.uint64] = {}

    def salt(self, lang: str | None) -> np.uint64:
        found = self.salts.get(lang)
        if found is None:
            found = self.salts[lang] = np.uint64(self.words.hash(b"" if lang is None else b"=" + lang.encode()))
        return found

    def of(self, text: str, lang: str | None) -> np.ndarray:
        salt, parts = self.salt(lang), text.encode("utf-8", "surrogatepass").split()
        w, s = self.words.of(parts) ^ salt, self.shapes.of(parts) ^ salt
        same = (w[1:] == w[:-1]).astype(np.uint64)
        pairs = hash64(s[:-1] + np.uint64(2)) + s[1:] + same
        return np.concatenate([(hash64(w) & np.uint64(BUCKETS[0] - 1)).astype(np.int64), (hash64(pairs) & np.uint64(BUCKETS[1] - 1)).astype(np.int64) + BUCKETS[0]])


COUNTS = T.StructType([T.StructField("lang", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("at", "target", "raw", "target_docs", "raw_docs")]])


def counted(batches: Iterable[pa.RecordBatch], groups: dict[str | None, int]) -> Iterator[pa.RecordBatch]:
    """Counts of texts by group of languages, handed on whenever another group begins, so that those of one (18 MB) are held at a time."""
    ngrams, own, table = NGrams(), None, None

    def found() -> pa.RecordBatch:
        at = np.flatnonzero(table[1])
        arrays = [at.astype("<u4"), *[x[at] for x in table]]
        return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]], names=COUNTS.names)

    for batch in batches:
        for text, lang, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            group = groups.get(lang, LANGUAGES - 1)
            if group != own:
                if table is not None:
                    yield found()
                own, table = group, np.zeros((4, sum(BUCKETS)), np.uint32)
            at, n = np.unique(ngrams.of(text or "", lang), return_counts=True)
            table[1, at] += n.astype(np.uint32)
            table[3, at] += np.uint32(1)
            if target:
                table[0, at] += n.astype(np.uint32)
                table[2, at] += np.uint32(1)
    if table is not None:
        yield found()


def _count(sample: DataFrame, groups: dict[str | None, int]) -> DataFrame:
    """Of each group of languages the buckets that occur; their occurrences, and documents, in target and raw text."""
    # sorted, so that a language's texts follow each other within a task
    return sample.select("text", "lang", "target").sortWithinPartitions("lang").mapInArrow(lambda batches: counted(batches, groups), COUNTS)


@dataclass
class Model:
    """Log ratio of each bucket, that of a usual target n-gram of each group of languages, and the share of target documents."""

    ratios: np.ndarray
    usual: np.ndarray
    groups: dict[str | None, int]
    share: float

    def weight(self, at: np.ndarray, lang: str | None) -> float:
        return float(self.ratios[at].sum(dtype=np.float64) - len(at) * self.usual[self.groups.get(lang, LANGUAGES - 1)])


def _scale(target: np.ndarray, raw: np.ndarray) -> float:
    """What raw counts are multiplied with for a mean log ratio of 0 over target n-grams."""
    some = target > 0
    return float(np.exp((target[some] * np.log(target[some] / raw[some])).sum() / target[some].sum())) if some.any() else 0.0


def ratios(tables: dict[int, np.ndarray], groups: dict[str | None, int], share: float) -> Model:
    """``tables``: for each group of languages target, raw, target_docs and raw_docs by bucket."""
    t, e, d, x, v = (np.zeros(sum(BUCKETS)) for _ in range(5))
    for table in tables.values():
        for kind in KINDS:
            target, raw, docs, of = table[:, kind].astype(np.float64)
            part, part_docs = _scale(target, raw), _scale(docs, of)
            t[kind] += target
            e[kind] += part * raw
            d[kind] += docs
            x[kind] += part_docs * of
            v[kind] += part_docs * (1 - part_docs) * of
    z = (d - x) ** 2 / (v + 1)
    found = np.log((t + PRIOR) / (e + PRIOR)) * z / (z + DOUBT**2)
    usual = np.zeros(LANGUAGES)
    for group, table in tables.items():
        if n := table[0].sum():
            usual[group] = (table[0] * found).sum() / n
    return Model(found.astype(np.float32), usual, groups, share)


def fit(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, parts: int = 8) -> Model:
    """The models of at most ``sample`` labelled documents: those with the lowest hashes of their doc_id. The share is that of all labels."""
    one = labels.where("quality IN (0, 1) AND toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > F.max("toxic")).alias("target"))
    share = one.agg(F.avg(F.col("target").cast("int"))).first()[0]
    few = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = df.select("doc_id", "text", "lang").join(F.broadcast(few), "doc_id").repartition(parts)
    most = df.join(F.broadcast(few), "doc_id").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES - 1)
    groups = {r.lang: i for i, r in enumerate(most.collect())}
    tables: dict[int, np.ndarray] = {}
    # stored first, so that the parts are counted at the same time and fetched one by one
    for row in stored(_count(chosen, groups), "ngram_counts").toLocalIterator():
        table = tables.setdefault(row.lang, np.zeros((4, sum(BUCKETS)), np.uint32))
        at = np.frombuffer(row.at, "<u4")
        for i, c in enumerate(COUNTS.names[2:]):
            table[i, at] += np.frombuffer(row[c], np.uint32)
    return ratios(tables, groups, 1.0 if share is None else share)


def weigh(df: DataFrame, model: Model, row: str | None = None) -> DataFrame:
    """``df`` without ``text`` and ``lang``, with log_weight; with ``row``, the text is that of this struct and is sent once. The models have a fixed size (4 MB)."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in ("text", "lang", "log_weight")]
    at = None if row is None else [c.lower() for c in df.schema[row].dataType.names].index("text")
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("log_weight", T.DoubleType())])

    def make():
        ngrams, model = NGrams(), sent.value

        def each(batch: pa.RecordBatch):
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                texts = some.column(len(kept) + 1) if row is None else some.column(kept.index(row)).field(at)
                got = [model.weight(ngrams.of(x, l), l) if x else 0.0 for x, l in zip(texts.to_pylist(), some.column(len(kept)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(kept)], pa.array(got, pa.float64())], names=schema.names)

        return each

    return map_arrow(df.select(*kept, "lang", *(["text"] if row is None else [])), schema, make)


def gumbel(df: DataFrame, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """Adds ``key``: the log weight by the temperature, and Gumbel noise from a hash of doc_id (null ids have noise too)."""
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return df.withColumn("key", F.col("log_weight") / temperature - F.ln(-F.ln(u)))


def kth(keys: DataFrame, k: int, least: int = 2000) -> tuple[float, int | None]:
    """The k-th highest (key, then lowest doc_id): counts of 4096 classes narrow it down until few rows are left."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while True:
        width = (high - low) / 4096
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        if width <= 0 or low + width == low:
            break
        bins = inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(4095)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("b")).collect()
        for r in bins:
            if above + r.n >= k:
                break
            above += r.n
        narrowed = (r.low, r.high) == (low, high)
        low, high, n = r.low, r.high, r.n
        if n <= least or narrowed:
            inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
            break
    rows = inside.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("key"), F.asc_nulls_last("doc_id")).limit(k - above).collect()
    for r in rows:
        above += r.n
        if above >= k:
            break
    return r.key, r.doc_id


def choose(weighed: DataFrame, k: int | None = None, share: float = 1.0, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """Adds ``key`` and ``kept``: the top k by key; without ``k``, the share of all rows."""
    keys = stored(gumbel(weighed, temperature, seed), "weights")
    n = keys.count()
    k = min(n, round(share * n) if k is None else k)
    if k <= 0:
        return keys.withColumn("kept", F.lit(False))
    key, doc_id = kth(keys, k)
    tie = F.lit(True) if doc_id is None else F.coalesce(F.col("doc_id") <= doc_id, F.lit(False))
    return keys.withColumn("kept", (F.col("key") > key) | ((F.col("key") == key) & tie))


def classify(df: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None, sample: int = SAMPLE, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, log_weight, key and kept of every row."""
    model = fit(df, labels, sample)
    return choose(weigh(df.select("doc_id", "text", "lang"), model), k, model.share if share is None else share, temperature)


def accept(df: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None, sample: int = SAMPLE, temperature: float = TEMPERATURE) -> DataFrame:
    """The rows of ``df`` that are kept, with their columns."""
    model = fit(df, labels, sample)
    row = free_name(df, "row")
    rows = df.select("doc_id", "lang", F.struct(*[F.col(c) for c in df.columns]).alias(row))
    return choose(weigh(rows, model, row), k, model.share if share is None else share, temperature).where("kept").select(f"{row}.*")
