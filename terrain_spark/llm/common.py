"""What the training-data operators share: the shared folder, broadcasts of bounded size, text pieces."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import CHECKPOINT_KEY, shared_dir, stored

#: A space that white space or the end follows, or that begins the text.
_ODD = re.compile(r" (?=\s|\Z)|\A ")


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files behind ``df`` as Catalyst estimates them; 0 where it can't."""
    found = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return found if found < 1 << 52 else 0


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_arrow(df: DataFrame, schema: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` with state that is made once in each task."""

    def run(batches):
        each = make()
        for batch in batches:
            if batch.num_rows:
                out = each(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def add_columns(batch: pa.RecordBatch, columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def portions(texts: list[str], size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Cuts of ``texts`` of some ``size`` characters each, so that what is made of them stays small."""
    start = total = 0
    for i, x in enumerate(texts, 1):
        total += len(x)
        if total >= size:
            yield start, i
            start, total = i, 0
    if start < len(texts):
        yield start, len(texts)


def chunks(text: str) -> list[str]:
    """Cuts ``text`` before single spaces, where the byte-level pattern always ends a match.

    A match never holds a space behind its first character unless it is white space alone, and of a run
    of white space the last character stays with what follows. So a space with another character
    than white space behind it begins a match. Each chunk comes without its space, but the
    first, which has none; chunks that white space follows stay together.
    """
    parts = text.split(" ")
    if _ODD.search(text):
        joined = [parts[0]]
        for x in parts[1:]:
            if x and not x[0].isspace():
                joined.append(x)
            else:
                joined[-1] += " " + x
        return joined
    return parts


class ChunkEncoder:
    """Ids of chunks (see ``chunks``) by the tokenizers library, many in one call.

    Chunks set one after another are a text whose matches end where the chunks do, so its ids are theirs
    in a row, and the bytes that each id stands for tell where to cut.
    """

    def __init__(self, data: bytes):
        import tokenizers

        self.lib = tokenizers.Tokenizer.from_buffer(data)
        self.lib.no_truncation()
        self.lib.no_padding()
        kind = json.loads(data)
        cut = kind.get("pre_tokenizer") or {}
        #: whether texts may be cut into chunks: bytes by the usual pattern, and nothing else before it
        self.apart = not kind.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.bytes_of = np.zeros(self.lib.get_vocab_size(), np.int64)
        for token, i in self.lib.get_vocab().items():
            self.bytes_of[i] = len(token)  # each byte is one character of the vocabulary

    def exact(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, some: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """All ids of the chunks, each with the space before it, and where each chunk's end."""
        text = " " + " ".join(some)
        ids = np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        upto = np.cumsum(self.bytes_of[ids])
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))  # bytes of UTF-8
        ends = lengths[np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1]
        at = np.searchsorted(upto, ends)
        if not len(upto) or at[-1] != len(upto) - 1 or (upto[at] != ends).any():
            return None
        return ids, at + 1

    def counts(self, some: list[str]) -> list[int]:
        if not some:
            return []
        got = self._cut(some)
        return [len(x) for x in self.exact([" " + x for x in some])] if got is None else np.diff(got[1], prepend=0).tolist()

    def packed(self, some: list[str], kind: str) -> list[bytes]:
        if not some:
            return []
        got = self._cut(some)
        if got is None:
            return [x.astype(kind).tobytes() for x in self.exact([" " + x for x in some])]
        data, ends = got[0].astype(kind).tobytes(), (got[1] * np.dtype(kind).itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Recent:
    """Values of the keys asked for last, in two generations of some ``bound`` keys; those of ``always`` never go."""

    def __init__(self, bound: int, always: dict | None = None):
        self.always, self.bound = always or {}, bound
        self.new: dict = dict(self.always)
        self.old: dict = {}

    def values(self, lists: list[list[str]], make: Callable[[list[str]], list]) -> list[list]:
        """The values of all keys of ``lists``: from before, or by ``make`` for what is new."""
        if len(self.new) - len(self.always) >= self.bound:
            self.old, self.new = self.new, dict(self.always)
        new, old = self.new, self.old
        wanted = set().union(*lists)
        missing = wanted.difference(new)
        known = [x for x in missing if x in old] if old else []
        new.update(zip(known, map(old.__getitem__, known), strict=True))
        rest = list(missing.difference(known)) if known else list(missing)
        for i in range(0, len(rest), 2000):
            some = rest[i : i + 2000]
            new.update(zip(some, make(some), strict=True))
        # a small table of what these lists hold is faster to ask again and again than the large one
        own = dict(zip(wanted, map(new.__getitem__, wanted), strict=True)).__getitem__
        return [list(map(own, keys)) for keys in lists]


def hash64(words: np.ndarray) -> np.ndarray:
    """Mixes unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = words.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    def __init__(self, bound: int = 400_000, normal: Callable[[bytes], bytes] | None = None):
        import xxhash

        super().__init__()
        self.bound, self.normal, self.hash = bound, normal, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        out = self.hash(self.normal(word) if self.normal else word)
        if len(self) >= self.bound:
            self.clear()
        self[word] = out
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbours of ``h``; one of all of ``h`` where it is shorter and not empty."""
    if not len(h):
        return h
    n = min(n, len(h))
    m = len(h) - n + 1
    out = h[:m].copy()
    for i in range(1, n):
        out = hash64(out) + h[i : i + m]
    return hash64(out)


__all__ = ["CHECKPOINT_KEY", "ChunkEncoder", "F", "Recent", "T", "WordHashes", "add_columns", "chunks", "documents", "free_name", "hash64", "input_bytes", "map_arrow", "portions", "shared_dir", "stored", "texts_of", "windows"]


class Rolling:
    """Karp-Rabin hashes of any run of ``h``, modulo 2**64, from prefix sums."""

    BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, h: np.ndarray, which: int = 0):
        up, down = self.powers(which, len(h))
        self.up = up
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * down[: len(h)], out=self.sums[1:])

    @classmethod
    def powers(cls, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        got = cls._powers.get(which)
        if got is None or len(got[0]) < n:
            size, base = max(4096, 1 << max(n, 1).bit_length()), cls.BASES[which]
            got = cls._powers[which] = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (base, pow(base, -1, 1 << 64)))
        return got

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of h[start:end], the same for the same run wherever it stands."""
        return hash64((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))

    def windows(self, n: int) -> np.ndarray:
        m = len(self.sums) - n
        return self.of(np.arange(m), np.arange(m) + n) if m > 0 else np.zeros(0, np.uint64)
