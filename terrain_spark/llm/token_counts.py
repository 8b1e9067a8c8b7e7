"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the most frequent pre-tokens and their numbers of tokens, broadcast to all
workers; tier two is a bounded cache of each worker for what the table lacks. Entries are what stands between single
spaces, that is whole pre-tokens, one or several in a row, which no match of the pattern crosses. They are never shuffled:
each task counts all its texts in a summary of bounded size, and summaries are merged, some tens by one task at a time, until one is left. Which
entries the table has only moves work between the tiers.

Files of sentencepiece are looked up by words in the same way where texts are printable ASCII and the model's pieces don't cross
spaces; other texts, and those for .json files that do not cut bytes by the usual pattern, are counted whole.

Rows: null texts count as empty and have no tokens; texts that hold a special string, or any length, are
counted whole; repeated rows and null ids give a row each; ids may be of any type; other columns are not read, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter as Counts
from heapq import nlargest

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ChunkEncoder, Recent, T, chunks, map_arrow, portions, stored, texts_of

#: Summary entries of a task while it counts; entries of the broadcast table (some 1 MB), and of a summary that is handed on;
#: characters of the longest entry; summaries that a task merges; characters of text after which longer entries are let go.
COUNTED, FREQUENT, LONGEST, MERGED, HELD = 60_000, 30_000, 64, 32, 16_000_000


class Counter:
    """Numbers of tokens of chunks by the library of the file's kind; see ``chunks`` for why those add up."""

    def __init__(self, kind: str, data: bytes, frequent: bytes = b"", lengths: bytes = b"", bound: int = 150_000):
        self.kind = kind
        if kind == "json":
            self.lib = ChunkEncoder(data)
            self.special = self.lib.special
        else:
            import sentencepiece

            self.lib = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.special = []
            self.by_words = self._adds_up()
        self.known = Recent(bound, dict(zip(frequent.decode().split(" ") if lengths else [], lengths, strict=True)))

    def exact(self, texts: list[str]) -> list[int]:
        found = self.lib.exact(texts) if self.kind == "json" else self.lib.encode(texts, num_threads=1)
        return [len(x) for x in found]

    def _adds_up(self) -> bool:
        """Whether the numbers of tokens of words add up to those of a text: no piece crosses a space, and each word gets one before it."""
        pieces = (self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()))
        inside = any("\u2581" in x.lstrip("\u2581") for x in pieces)
        return not inside and self.lib.encode("a") == self.lib.encode("  a ") and self.lib.encode("a  b") == self.lib.encode("a b") == self.lib.encode("a") + self.lib.encode("b")

    def count(self, texts: list[str]) -> list[int]:
        if self.kind != "json":
            whole = [not self.by_words or not _PRINTABLE(x) for x in texts]
            rest = self.known.values([[] if w else x.split() for w, x in zip(whole, texts, strict=True)], self.exact)
            slow = iter(self.exact([x for w, x in zip(whole, texts, strict=True) if w]))
            return [next(slow) if w else sum(more) for w, more in zip(whole, rest, strict=True)]
        cut = [None if not self.lib.apart or any(s in x for s in self.special) else chunks(x) for x in texts]
        rest = self.known.values([p[1:] if p else [] for p in cut], self.lib.counts)
        first = self.exact([x if p is None else p[0] for x, p in zip(texts, cut, strict=True)])
        return [n + sum(more) for n, more in zip(first, rest, strict=True)]


_PRINTABLE = re.compile(r"[\x20-\x7E]*\Z").match


def _short(tally: Counts) -> Counts:
    """The entries that a table may have."""
    return Counts({k: v for k, v in tally.items() if 0 < len(k) <= LONGEST})


def _cut_back(tally: Counts, counted: int) -> Counts:
    """The larger half of a summary that is full."""
    if len(tally) <= counted:
        return tally
    least = sorted(tally.values())[len(tally) // 2]
    return Counts({k: v for k, v in tally.items() if v > least})


def frequent_chunks(df: DataFrame, counted: int = COUNTED, kept: int = FREQUENT, merged: int = MERGED) -> list[str]:
    """The chunks with the highest counts in all texts, by summaries of bounded size."""
    schema = T.StructType([T.StructField("chunks", T.StringType()), T.StructField("counts", T.BinaryType())])

    def handed(tally: Counts) -> pa.RecordBatch:
        top = nlargest(kept, ((v, k) for k, v in tally.items() if v > 1))
        return pa.RecordBatch.from_arrays([pa.array([" ".join(k for _, k in top)], pa.string()), pa.array([array("Q", [v for v, _ in top]).tobytes()], pa.binary())], names=schema.names)

    def count(batches):
        tally, read = Counts(), 0
        for batch in batches:
            for x in texts_of(batch.column(0)):
                tally.update(x.split(" ")[1:])
                read += len(x)
                if len(tally) > counted or read > HELD:
                    tally, read = _cut_back(_short(tally), counted), 0
        yield handed(_short(tally))

    def merge(batches):
        tally = Counts()
        for batch in batches:
            for words, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tally.update(dict(zip(words.split(" "), array("Q", n), strict=True)) if n else {})
                tally = _cut_back(tally, counted)
        yield handed(tally)

    found = stored(df.select("text").mapInArrow(count, schema), "summaries")
    n = found.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // merged)
        found = stored(found.coalesce(n).mapInArrow(merge, schema), "summaries")
    return [x for r in found.coalesce(1).mapInArrow(merge, schema).collect() for x in r.chunks.split(" ") if x]


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 1024, frequent: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; ``vocabulary`` is a .json or .model file."""
    kind = "json" if vocabulary.endswith(".json") else "model"
    with open(vocabulary, "rb") as f:
        data = f.read()
    found = Counter(kind, data)
    top = frequent_chunks(df) if frequent is None else frequent
    if kind == "json":
        top = [x for x in top if not any(s in " " + x for s in found.special) and " " not in x and not x[:1].isspace()]
    else:
        top = [x for x in top if found.by_words and _PRINTABLE(x) and " " not in x]
    pairs = [(x, n) for x, n in zip(top, found.exact([" " + x for x in top]), strict=True) if n < 256] if top else []
    top, lengths = [x for x, _ in pairs], bytes(n for _, n in pairs)
    sent = df.sparkSession.sparkContext.broadcast((data, " ".join(top).encode(), lengths))
    schema = T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def make():
        key = (vocabulary, len(sent.value[1]), sent.value[2][:64])
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = Counter(kind, *sent.value)
        count = _MADE[key].count

        def each(batch: pa.RecordBatch):
            texts = texts_of(batch.column(1))
            n = [x for a, b in portions(texts, 3_000_000) for x in count(texts[a:b])]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=schema.names)

        return each

    return map_arrow(df.select("doc_id", "text"), schema, make)


_MADE: dict[tuple, Counter] = {}
