"""URL filters by a Bloom filter cascade: exact membership of keys without a join.

Even levels hold listed keys, odd levels those of the corpus's other keys that the level before lets through by mistake, and
so on until no mistake is left; a key then belongs to the list if the first level that lacks it is odd. The
cascade is exact for every key of the corpus, as its whole key universe is tried when it is built.

Short lists travel inside the plan, as numbers that built-in functions look bits up in; for longer ones the same cascade is built
from numpy arrays, broadcast (some 20 bits a listed key), and read in Arrow batches.

Rows: a null url and one without ``://`` have an empty host and path, fit no rule and are allowed; urls of any
length are judged whole; repeated rows give a row each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from .common import F, T, map_arrow

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Listed keys up to which filters travel inside the plan: some 2 bytes a key and level. Beyond it, they are broadcast.
MOST_LISTED = 20_000


def _rest(url: Column) -> Column:
    """What stands behind the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))


def prefixes(path: Column, lengths: list[int]) -> Column:
    """The beginnings of ``path`` that have one of the ``lengths``."""
    return F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths)]), lambda x: x.isNotNull())


@dataclass
class Bloom:
    """``k`` bits of ``m`` for each key; ``level`` salts the hashes."""

    level: int
    k: int
    m: int
    words: list[int]

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.level * 64 + i)), F.lit(self.m)) for i in range(self.k)]

    def has(self, key: Column) -> Column:
        words = F.array(*[F.lit(w) for w in self.words])
        out = F.lit(True)
        for p in self.positions(key):
            out = out & (F.get(words, F.floor(p / 64).cast("int")).bitwiseAND(_bit(p)) != 0)
        return out

    @classmethod
    def of(cls, spark: SparkSession, keys: list[str], rate: float, level: int) -> Bloom:
        m = max(64, math.ceil(len(keys) * math.log2(1 / rate) / math.log(2) / 64) * 64)
        out = cls(level, max(1, round(math.log2(1 / rate))), m, [0] * (m // 64))
        if keys:
            at = spark.createDataFrame([(k,) for k in keys], "key string").select(F.array(*out.positions(F.col("key"))).alias("at"))
            for row in at.collect():
                for p in row.at:
                    w = out.words[p // 64] | 1 << p % 64
                    out.words[p // 64] = w
            out.words = [w - (1 << 64) if w >> 63 else w for w in out.words]
        return out


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(position, F.lit(64)).cast("int"))


@dataclass
class Cascade:
    levels: list[Bloom]

    def has(self, key: Column) -> Column:
        """True for listed keys of the universe the cascade was built over, false for its others."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
        return out

    @staticmethod
    def first(spark: SparkSession, listed: list[str], n: int) -> Bloom:
        """The first level, for a universe of about ``n`` keys."""
        return Bloom.of(spark, listed, _rate(listed, n), 0)

    @staticmethod
    def passing(universe: DataFrame, levels: list[Bloom]) -> DataFrame:
        """Keys of the universe that the first level of their list lets through; ``which`` are numbers of ``levels``."""
        hit = F.lit(False)
        for i, level in enumerate(levels):
            hit = hit | ((F.col("which") == i) & level.has(F.col("key")))
        return universe.where(hit)

    @classmethod
    def finish(cls, spark: SparkSession, listed: list[str], level: Bloom, passed: set[str]) -> Cascade:
        levels, inside, outside = [level], listed, sorted(passed - set(listed))
        while outside:
            levels.append(Bloom.of(spark, outside, 0.5, len(levels)))
            wrong = spark.createDataFrame([(k,) for k in inside], "key string").where(levels[-1].has(F.col("key")))
            inside, outside = outside, sorted(r.key for r in wrong.collect())
        return cls(levels)


def _rate(listed: list[str], n: int) -> float:
    return min(0.5, max(1, len(listed)) / (max(1, n - len(listed)) * math.sqrt(2)))


def build(universe: DataFrame, lists: list[list[str]], kind: type | None = None) -> list[Cascade | LongCascade]:
    """A cascade for each list. ``universe``: ``which`` list a key will be asked for in, and ``key``, repeated or not.

    Two passes over it for all lists: the numbers of keys by a sketch, which set the rates of the first levels, and the keys
    that those let through. These are no more than some times the lists, whatever the corpus.
    """
    spark, lists = universe.sparkSession, [sorted(set(x)) for x in lists]
    kind = kind or (LongCascade if max(map(len, lists)) > MOST_LISTED else Cascade)
    if not any(lists):
        return [kind([]) for _ in lists]
    sizes = {r.which: r.n for r in universe.groupBy("which").agg(F.approx_count_distinct("key", 0.05).alias("n")).collect()}
    levels = [kind.first(spark, x, sizes.get(i, 0)) for i, x in enumerate(lists)]
    passed: list[set[str]] = [set() for _ in lists]
    for r in kind.passing(universe, levels).distinct().collect():
        passed[r.which].add(r.key)
    return [kind.finish(spark, x, level, p) if x else kind([]) for x, level, p in zip(lists, levels, passed, strict=True)]


class Bits:
    """A level as a numpy array: ``k`` bits of ``m`` for each key; ``level`` salts the hashes."""

    def __init__(self, keys: list[str], rate: float, level: int):
        self.level, self.k = level, max(1, round(math.log2(1 / rate)))
        self.m = max(64, math.ceil(len(keys) * math.log2(1 / rate) / math.log(2)))
        self.bits = np.zeros((self.m + 7) // 8, np.uint8)
        for i in range(0, len(keys), 100_000):
            at = self.positions(keys[i : i + 100_000]).ravel()
            np.bitwise_or.at(self.bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    def positions(self, keys: list[str]) -> np.ndarray:
        import xxhash

        h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass"), self.level) for k in keys), np.uint64).reshape(-1, 2)
        return ((h[:, :1] + np.arange(self.k, dtype=np.uint64) * (h[:, 1:] | np.uint64(1))) % np.uint64(self.m)).astype(np.int64)

    def has(self, keys: list[str]) -> np.ndarray:
        at = self.positions(keys)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(1)


class LongCascade:
    """The cascade of a long list, as arrays of bits."""

    def __init__(self, levels: list[Bits]):
        self.levels = levels

    def has(self, keys: list[str]) -> np.ndarray:
        """For keys of the universe the cascade was built over, whether they are listed: the first level that lacks a key decides."""
        out, rest = np.full(len(keys), len(self.levels) % 2 == 1), np.arange(len(keys))
        for i, level in enumerate(self.levels):
            if not len(rest):
                break
            passed = level.has([keys[j] for j in rest])
            out[rest[~passed]] = i % 2 == 1
            rest = rest[passed]
        return out

    @staticmethod
    def first(spark: SparkSession, listed: list[str], n: int) -> Bits:
        return Bits(listed, _rate(listed, n), 0)

    @staticmethod
    def passing(universe: DataFrame, levels: list[Bits]) -> DataFrame:
        sent = universe.sparkSession.sparkContext.broadcast(levels)

        def make():
            def each(batch: pa.RecordBatch):
                which, keys = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                keep = np.zeros(len(keys), bool)
                for i, level in enumerate(sent.value):
                    own = np.flatnonzero(which == i)
                    if len(own):
                        keep[own] = level.has([keys[j] for j in own])
                return batch.filter(pa.array(keep))

            return each

        return map_arrow(universe.select("which", "key"), T.StructType([T.StructField("which", T.IntegerType()), T.StructField("key", T.StringType())]), make)

    @classmethod
    def finish(cls, spark: SparkSession, listed: list[str], level: Bits, passed: set[str]) -> LongCascade:
        levels, inside, outside = [level], listed, sorted(passed - set(listed))
        while outside:
            levels.append(Bits(outside, 0.5, len(levels)))
            inside, outside = outside, [k for k, hit in zip(inside, levels[-1].has(inside), strict=True) if hit]
        return cls(levels)


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def judge(pages: DataFrame, rules: list[Rule], listed_hosts: list[str]) -> DataFrame:
    """page_id, host, path, rule, verdict.

    The longest rule that fits decides; without one, a page is blocked if its host or a parent domain is listed.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    lengths = sorted({len(r.path) for r in rules})
    keys = parts.select("*", suffixes(F.col("host")).alias("domains")).select("*", _keys(lengths).alias("keys"))
    named = lambda c, i: F.transform(c, lambda k: F.struct(F.lit(i).alias("which"), k.alias("key")))
    universe = keys.select(F.inline(F.concat(named("keys", 0), named("keys", 1), named("domains", 2))))
    any_rule, allowing, bad = build(universe, [[r.key for r in rules], [r.key for r in rules if r.action == "allow"], listed_hosts])
    long = isinstance(any_rule, LongCascade)
    if long:
        return _judge_long(keys, any_rule, allowing, bad)
    fits = F.filter("keys", lambda k: any_rule.has(k))
    rule = F.when(F.size(fits) > 0, F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"])
    judged = keys.select("page_id", "host", "path", "domains", rule.alias("rule"))
    verdict = (
        F.when(F.col("rule").isNotNull() & allowing.has(F.col("rule")), "allow")
        .when(F.col("rule").isNotNull(), "block")
        .when(F.exists("domains", lambda d: bad.has(d)), "block")
        .otherwise("allow")
    )
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _keys(lengths: list[int]) -> Column:
    if not lengths:
        return F.array().cast("array<string>")
    return F.flatten(F.transform("domains", lambda d: F.transform(prefixes(F.col("path"), lengths), lambda p: F.concat(d, p))))


def _judge_long(keys: DataFrame, any_rule: LongCascade, allowing: LongCascade, bad: LongCascade) -> DataFrame:
    """Rules and verdicts of pages with their keys and domains, by cascades of long lists."""
    sent = keys.sparkSession.sparkContext.broadcast((any_rule, allowing, bad))
    schema = T.StructType([*[keys.schema[c] for c in ("page_id", "host", "path")], T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def make():
        any_rule, allowing, bad = sent.value

        def hits(lists: pa.Array, cascade: LongCascade) -> list[list[str]]:
            flat = lists.flatten().to_pylist()
            known = dict(zip(unique := list(set(flat)), cascade.has(unique).tolist() if unique else [], strict=True))
            return [[k for k in x if known[k]] for x in lists.to_pylist()]

        def each(batch: pa.RecordBatch):
            fits = [max(x, key=lambda k: (len(k), k), default=None) for x in hits(batch.column(3), any_rule)]
            named = sorted({x for x in fits if x is not None})
            allowed = {k for k, yes in zip(named, allowing.has(named).tolist() if named else [], strict=True) if yes}
            listed = hits(batch.column(4), bad)
            verdict = ["allow" if f in allowed else "block" if f is not None or h else "allow" for f, h in zip(fits, listed, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fits, pa.string()), pa.array(verdict, pa.string())], names=schema.names)

        return each

    return map_arrow(keys.select("page_id", "host", "path", "keys", "domains"), schema, make)
