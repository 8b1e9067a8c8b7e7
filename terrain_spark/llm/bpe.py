"""Byte-level BPE: encoding with a segment tree of pair ranks, and decoding.

Rows: null texts count as empty and have no ids; very long texts without a space are one piece that is
encoded in n log n steps; repeated rows and rows without an id are encoded one by one; an
empty table gives an empty result. Input columns are kept, but one that has the name of a new column is replaced.
"""

from __future__ import annotations

import base64
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import F, T, add_columns, chunks, map_arrow, texts_of

_NONE = 1 << 62
#: Children of a node of the segment tree: the minimum of so many neighbours is one call.
_FAN = 16
#: Rows whose ids are handed on at once, so that of a batch of 10,000 long texts not all ids are held.
ROWS = 500
#: Chunks, and pieces of chunks, that a Python process keeps with their ids (up to 100 MB each).
CACHE = 600_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBPE:
    """Encodes and decodes with ``ranks``; ``pattern`` cuts a text into the pieces that are merged separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        self.ranks, self.find, self.bound = ranks, regex.compile(pattern).findall, cache
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self._pieces: dict[str, bytes] = {}
        outer = self

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                if len(self) >= outer.bound:
                    self.clear()
                out = self[chunk] = outer._chunk(" " + chunk)
                return out

        self._chunks = Chunks()

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece.

        The leaves of the segment tree are the byte positions; each holds rank and position of the pair that
        starts there, a node the least of its children, and the top so the lowest rank, leftmost first. A merge
        changes three leaves, of the pair itself and of its live neighbours, and the nodes above them.
        """
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        leaves = [_NONE] * n
        for i in range(n - 1):
            r = rank_of(piece[i : i + 2])
            if r is not None:
                leaves[i] = r << 32 | i
        levels = [leaves]
        while len(levels[-1]) > _FAN:
            low = levels[-1]
            levels.append([min(low[i : i + _FAN]) for i in range(0, len(low), _FAN)])
        above = levels[1:]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        while (top := min(levels[-1])) != _NONE:
            i = top & 0xFFFFFFFF
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            leaves[j] = _NONE
            r = rank_of(piece[i : after[k]]) if k < n else None
            leaves[i] = _NONE if r is None else r << 32 | i
            p = before[i]
            if p >= 0:
                r = rank_of(piece[p:k])
                leaves[p] = _NONE if r is None else r << 32 | p
            if above:
                low, changed = leaves, {i, j, p} if p >= 0 else {i, j}
                for high in above:
                    changed = {x // _FAN for x in changed}
                    for x in changed:
                        high[x] = min(low[x * _FAN : x * _FAN + _FAN])
                    low = high
        ids, i, rank = [], 0, self.ranks
        while i < n:
            ids.append(rank[piece[i : after[i]]])
            i = after[i]
        return ids

    def _chunk(self, chunk: str) -> bytes:
        found = self.find(chunk)
        if len(found) == 1:
            return array("I", self.merge(chunk.encode("utf-8", "surrogatepass"))).tobytes()
        pieces, out = self._pieces, []
        for x in found:
            ids = pieces.get(x)
            if ids is None:
                if len(pieces) >= self.bound:
                    pieces.clear()
                ids = array("I", self.merge(x.encode("utf-8", "surrogatepass"))).tobytes()
                if len(x) < 64:
                    pieces[x] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        parts = chunks(text)
        rest = map(self._chunks.__getitem__, parts[1:])
        return self._chunk(parts[0]) + b"".join(rest)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


def _shipped(df: DataFrame, path: str, pattern: str, cache: int = CACHE):
    """Makes a ``ByteBPE`` on the executors; one in each Python process. The rank file has a fixed size."""
    with open(path, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def get() -> ByteBPE:
        key = (path, pattern, cache)
        if key not in _MADE:
            _MADE[key] = ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}, pattern, cache)
        return _MADE[key]

    return get


_MADE: dict[tuple, ByteBPE] = {}


def encode_documents(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", n: str = "n_tokens", cache: int = CACHE) -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit) and their number ``n``; ``text`` goes. ``cache``: chunks that a Python process keeps."""
    get = _shipped(df, ranks, pattern, cache)
    kept = [c for c in df.columns if c not in (text, ids, n)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(ids, T.BinaryType()), T.StructField(n, T.LongType())])

    def make():
        encode = get().encode

        def each(batch: pa.RecordBatch):
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                out = [encode(x) for x in texts_of(some.column(len(kept)))]
                yield add_columns(some.select(kept), [pa.array(out, pa.binary()), pa.array([len(x) // 4 for x in out], pa.int64())], [ids, n])

        return each

    return map_arrow(df.select(*kept, F.col(text)), schema, make)


def decode_documents(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that ``ids`` stand for."""
    get = _shipped(df, ranks, pattern)
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.BinaryType())])

    def make():
        decode = get().decode

        def each(batch: pa.RecordBatch):
            got = [decode(x or b"") for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            return add_columns(batch, [pa.array(got, pa.binary())], [out])

        return each

    return map_arrow(df.select(*kept), schema, make)


def digests(df: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the bytes decoded from them."""
    both = decode_documents(encode_documents(df.select("doc_id", "text"), ranks, pattern), ranks, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
