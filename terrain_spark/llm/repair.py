"""Token ids in compact binary files: Re-Pair grammars per shard, with random access.

A shard holds the ids of documents in ascending order of doc_id. Its most frequent neighbours are replaced by new
symbols, again and again, until no pair is left that repeats often enough; the file keeps the rules, the symbols that
remain, and how many ids each symbol expands to, so that any range of ids is decoded without the rest.

File format, one row for each shard, Parquet as container: ``shard`` (partition and number in it), ``before`` (ids of
earlier shards of the partition), ``n_ids``, ``first_rule`` (symbols below it are ids),
``rules`` (pairs of little-endian unsigned 32-bit symbols), ``lengths`` (ids that each rule expands to, unsigned 32-bit),
``symbols`` (unsigned 32-bit), ``doc_ids`` (signed 64-bit), ``doc_lengths`` (unsigned 32-bit), ``doc_nulls`` (a byte for each row).
All arrays are stored by bytes, the lowest of all numbers first, and compressed with zstd.

Rows: null texts count as empty and have the end id alone; null ids, and ids that are no whole numbers, come first in the order,
like Spark sorts them; rows with the same doc_id follow each other in any order, and where they are many they are dealt
out to several partitions, be their texts equal or not; very long texts are never cut between shards; other columns are not read, whatever their
names; an empty table gives no file and no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import ChunkEncoder, F, T, input_bytes, map_arrow, shared_dir

#: Ids in a shard at which it ends; how often a pair occurs to become a rule: in the first round, what it is divided by
#: each round, and at least, as a rule takes the bytes of some three symbols. Bytes of input for each partition, and how many
#: partitions there are at most: what the driver holds of them are bounds and two numbers each; beyond it they get larger.
SHARD_IDS, START, STEP, LEAST, RANGE_BYTES, MOST_PARTS = 1_000_000, 1024, 4, 4, 16 << 20, 20_000
#: Characters of the longest chunk whose ids are kept.
LONGEST = 64


class WordEncoder(ChunkEncoder):
    """A word of letters, with the space before it, is one match, so the library's model gets it without being searched for matches."""

    LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZäöüßáéíóúñàâçèêëîïôûùÄÖÜÁÉÍÓÚÑÀÂÇÈÊ"

    def __init__(self, data: bytes):
        import tokenizers

        super().__init__(data)
        self.one_match = re.compile(f"[{self.LETTERS}]+").fullmatch
        cut = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: bytes as the vocabulary has them
        self.space, self.written = cut.pre_tokenize_str(" ")[0][0], {ord(x): cut.pre_tokenize_str(x)[0][0] for x in self.LETTERS if not x.isascii()}
        self.model = tokenizers.Tokenizer(self.lib.model)
        self.model.pre_tokenizer = tokenizers.pre_tokenizers.CharDelimiterSplit("\n")

    def packed(self, some: list[str], kind: str) -> list[bytes]:
        words = list(filter(self.one_match, some)) if self.apart else []
        made = {}
        for part in ([x for x in words if x.isascii()], [x for x in words if not x.isascii()]):
            if part:
                made.update(zip(part, self._words(part, kind), strict=True))
        other = [x for x in some if x not in made]
        made.update(zip(other, super().packed(other, kind), strict=True))
        return list(map(made.__getitem__, some))

    def _words(self, some: list[str], kind: str) -> list[bytes]:
        text = self.space + f"\n{self.space}".join(some)
        if not text.replace(self.space, "").isascii():
            text = text.translate(self.written)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        upto = np.cumsum(self.bytes_of[ids])
        ends = np.cumsum(np.fromiter(map(len, text.split("\n")), np.int64, len(some)))
        at = np.searchsorted(upto, ends)
        if not len(upto) or at[-1] != len(upto) - 1 or (upto[at] != ends).any():
            return super().packed(some, kind)
        data, ends = ids.astype(kind).tobytes(), ((at + 1) * np.dtype(kind).itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Ids by the tokenizers library, remembered for each chunk (see ``chunks``; here with the space before it) up to a bound.

    A portion's texts are cut where its bytes say so, without a string for each chunk; only chunks that differ are looked up.
    Signs at the end of a word are a match of their own, so a chunk that ends in them is two, its word and its signs, and the
    library sees each once. An apostrophe is no such sign, as contractions begin with it.
    """

    SIGNS, LETTERS = ".,;:!?$%&*#|<>()[]{}=+-/\"", frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789äöüßáéíóúñàâçèêëîïôûùÄÖÜÁÉÍÓÚÑÀÂÇÈÊ")
    #: White space by its UTF-8: of one byte, and the others by three bytes, or two and none.
    WHITE = np.array([chr(i).isspace() for i in range(128)] + [False] * 128)
    WIDE = np.array([int.from_bytes(b.ljust(3, b"\0")) for i in range(128, 1 << 16) if chr(i).isspace() for b in [chr(i).encode()]])

    SIGN, LETTER = np.isin(np.arange(256), [*map(ord, SIGNS)]), np.isin(np.arange(256), [ord(x) for x in LETTERS if x.isascii()])
    #: Second bytes of the other letters; the first is 0xC3.
    SECOND = np.isin(np.arange(256), [x.encode()[1] for x in LETTERS if not x.isascii()])

    def __init__(self, data: bytes, bound: int = 800_000):
        self.lib, self.bound, self.new, self.old = WordEncoder(data), bound, {}, {}
        self.kind = "<u2" if self.lib.lib.get_vocab_size() <= 1 << 16 else "<u4"

    def _made(self, some: list[str]) -> dict[str, bytes]:
        """Ids of different chunks, by the library."""
        special = self.lib.special
        apart = [x for x in some if x[:1] == " " and not any(s in x for s in special)] if self.lib.apart else []
        made = dict(zip(apart, self.lib.packed([x[1:] for x in apart], self.kind), strict=True))
        if len(made) < len(some):
            rest = [x for x in some if x not in made]
            made.update(zip(rest, (x.astype(self.kind).tobytes() for x in self.lib.exact(rest)), strict=True))
        return made

    def _values(self, words: list[str]) -> list[bytes]:
        """The ids of different chunks: from before, or from the library."""
        if len(self.new) >= self.bound:
            self.old, self.new = self.new, {}
        out = list(map(self.new.get, words))
        missing = [i for i, v in enumerate(out) if v is None]
        rest = []
        for i in missing:
            found = out[i] = self.old.get(x := words[i])
            if found is None:
                rest.append(i)
            else:
                self.new[x] = found
        for k in range(0, len(rest), 2000):
            at = rest[k : k + 2000]
            made = self._made([words[i] for i in at])
            for i in at:
                out[i] = made[words[i]]
            self.new.update(made if max(map(len, made)) <= LONGEST else {x: ids for x, ids in made.items() if len(x) <= LONGEST})
        return out

    def _starts(self, raw: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Where the chunks of texts begin that end at ``ends`` of ``raw``; those of ``whole`` are one."""
        begins = ends - np.diff(ends, prepend=0)
        after = np.flatnonzero(raw == 32) + 1  # what follows each space
        last = np.zeros(len(raw) + 1, bool)
        last[ends] = True
        after = after[~last[after]]
        first = raw[after]
        white = self.WHITE[first]
        wide = np.flatnonzero((first >= 0xC2) & (first <= 0xE3))
        if len(wide):
            more = np.concatenate((raw, np.zeros(2, np.uint8))).astype(np.int64)
            at = after[wide]
            point = more[at] << 16 | more[at + 1] << 8 | np.where(first[wide] < 0xE0, 0, more[at + 2])
            white[wide] = np.isin(point, self.WIDE)
        at = after[~white] - 1
        if whole.any():
            at = at[~whole[np.searchsorted(ends, at, side="right")]]
        mark = np.zeros(len(raw), bool)
        mark[at] = True
        mark[begins[begins < ends]] = True
        starts = np.flatnonzero(mark)
        if not len(starts):
            return starts
        # signs at a word's end
        stops = np.append(starts[1:], len(raw))
        other = np.maximum.accumulate(np.where(self.SIGN[raw], np.int32(-1), np.arange(len(raw), dtype=np.int32)))
        at = other[stops - 1].astype(np.int64) + 1
        some = np.flatnonzero((at > starts) & (at < stops))
        at, behind = at[some], raw[at[some] - 1]
        good = self.LETTER[behind] | ((at - starts[some] > 1) & (raw[at - 2] == 0xC3) & self.SECOND[behind])
        if whole.any():
            good &= ~whole[np.searchsorted(ends, starts[some], side="right")]
        mark[at[good]] = True
        return np.flatnonzero(mark)

    def arrays(self, column: pa.Array, end: int, size: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of portions of the texts (null: empty) of some ``size`` bytes each: all ids, and how many each text has."""
        texts = column.fill_null("").cast(pa.large_string())
        if not len(texts):
            return
        whole = np.full(len(texts), not self.lib.apart)
        for s in self.lib.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        _, offsets, data = texts.buffers()
        upto = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + size, side="right")) - 1)
            raw, ends = every[upto[i] : upto[j]], upto[i + 1 : j + 1] - upto[i]
            starts = self._starts(raw, ends, whole[i:j])
            cut = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
            ids = [*self._values(cut.dictionary.to_numpy(zero_copy_only=False).tolist()), np.array([end], self.kind).tobytes()]
            flat = np.frombuffer(b"".join(ids), self.kind)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // flat.itemsize
            # the end id stands behind each text like a chunk
            upto_text = np.searchsorted(starts, ends)
            which = np.insert(cut.indices.to_numpy().astype(np.int64), upto_text, len(ids) - 1)
            sizes = lengths[which]
            place = np.cumsum(lengths) - lengths
            done = np.cumsum(sizes)
            total = done[upto_text + np.arange(j - i)]
            yield flat[np.repeat(place[which] - done + sizes, sizes) + np.arange(done[-1])].astype("<u4"), np.diff(total, prepend=0)
            i = j

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """The ids of each text as bytes."""
        out = []
        for ids, sizes in self.arrays(pa.array(texts, pa.large_string()), end):
            out += [x.astype(self.kind).tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        return out


def compress(ids: np.ndarray, first_rule: int, start: int = START, step: int = STEP, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules, their lengths and the symbols that remain: no pair of them is left that occurs ``least`` times or more.

    A round gives all pairs that occur often enough a symbol each; where occurrences overlap, the more frequent pair goes first,
    and of a row of equal ones every second. What is often enough starts at ``start`` and falls by ``step`` each round
    to ``least``. From then on only pairs with a new symbol, or whose occurrences had to give way, can still
    be frequent, so a round looks at these places alone, until none is left.
    """
    seq, rules = ids.astype(np.uint32), []
    lengths, next_rule = np.ones(max(first_rule, 1), np.int64), first_rule
    limit, near = max(start, least), None
    while len(seq) > 1:
        pairs, at, which, count = _frequent(seq, near, limit)
        if not len(pairs):
            if limit == least:
                break
            limit = max(least, limit // step)
            continue
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((pairs, -count))] = np.arange(len(pairs))
        r = rank[which]
        touch = np.diff(at) == 1
        wins = np.ones(len(at), bool)
        wins[1:] &= ~touch | (r[1:] < r[:-1])
        wins[:-1] &= ~touch | (r[:-1] < r[1:])
        taken, chosen = at[wins], which[wins]
        # a pair of which too few are left waits for the next round; the most frequent never has to
        enough = np.bincount(chosen, minlength=len(pairs)) >= limit
        taken, chosen = taken[enough[chosen]], chosen[enough[chosen]]
        both = np.stack([pairs[enough] >> np.uint64(32), pairs[enough] & np.uint64(0xFFFFFFFF)], 1).astype(np.int64)
        seq[taken] = (np.cumsum(enough) - 1 + next_rule)[chosen]
        rules.append(both)
        next_rule += len(both)
        if next_rule > len(lengths):
            lengths = np.concatenate([lengths, np.zeros(max(len(lengths), next_rule), np.int64)])
        lengths[next_rule - len(both) : next_rule] = lengths[both[:, 0]] + lengths[both[:, 1]]
        keep = np.ones(len(seq), bool)
        keep[taken + 1] = False
        if limit == least:
            # changed places, and those of pairs that had to give way, by their place in what is left
            mark = np.zeros(len(seq), bool)
            mark[taken] = True
            mark[at] = True
            near = np.flatnonzero(mark[keep])
        limit = max(least, limit // step)
        seq = seq[keep]
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return pairs.astype("<u4"), lengths[first_rule:next_rule].astype("<u4"), seq.astype("<u4")


def _frequent(seq: np.ndarray, near: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that occur ``limit`` times or more, in their order; the places of all of them, which pair stands at each, and how often each occurs.

    Of a row of equal symbols every second place counts, from the first. ``near``: the places to look at.
    """
    if near is None:
        at, slot = None, _slots(seq[:-1], seq[1:])
    else:
        mark = np.zeros(len(seq), bool)
        mark[near] = True
        mark[near[near > 0] - 1] = True
        at = np.flatnonzero(mark[:-1])
        slot = _slots(seq[at], seq[at + 1])
    if len(slot) > _FEW:
        # counters of hashes are never too low, so what they rule out is not sorted; where that is much, a second hash rules out most of the rest
        all_of = len(slot)
        some = np.flatnonzero((np.bincount(slot, minlength=1 << _SLOT_BITS) >= limit)[slot])
        at, slot = some if at is None else at[some], slot[some]
        if 2 * len(at) < all_of:
            other = _slots(seq[at + 1], seq[at])
            some = np.flatnonzero((np.bincount(other, minlength=1 << _SLOT_BITS) >= limit)[other])
            at, slot = at[some], slot[some]
    elif at is None:
        at = np.arange(len(slot))
    same = np.flatnonzero(seq[:-1] == seq[1:])
    if len(same):
        place = np.arange(len(same))
        begins = np.concatenate(([True], np.diff(same) > 1))
        odd = np.zeros(len(seq), bool)
        odd[same[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 1]] = True
        stay = ~odd[at]
        at, slot = at[stay], slot[stay]
    pairs = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
    order = np.sort(pairs)
    edge = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1], [True]))) if len(order) else np.zeros(1, np.int64)
    count = np.diff(edge)
    found, count = order[edge[:-1]][count >= limit], count[count >= limit]
    if not len(found):
        return found, at[:0], at[:0], count
    if len(at) > _FEW:
        # a table by hash finds nearly all, a search the others
        table = np.zeros(1 << _SLOT_BITS, np.int32)
        table[_slots((found >> np.uint64(32)).astype(np.uint32), found.astype(np.uint32))] = np.arange(len(found))
        which = table[slot].astype(np.int64)
        hit = found[which] == pairs
        miss = np.flatnonzero(~hit)
        which[miss] = np.minimum(np.searchsorted(found, pairs[miss]), len(found) - 1)
        hit[miss] = found[which[miss]] == pairs[miss]
    else:
        which = np.minimum(np.searchsorted(found, pairs), len(found) - 1)
        hit = found[which] == pairs
    return found, at[hit], which[hit], count


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs of unsigned 32-bit symbols, of ``_SLOT_BITS`` bits."""
    return ((left * np.uint32(0x9E3779B1) ^ right) * np.uint32(0x85EBCA77) >> np.uint32(32 - _SLOT_BITS)).astype(np.int64)


#: Bits of the hashes of pairs; places so few that they are sorted at once.
_SLOT_BITS, _FEW = 20, 1 << 14


#: Ids of a rule up to which its ids stand in a table when a shard is read; a table of 1,000 rules has 32,000 at most.
_SHORT = 32


class Shard:
    """A shard as it was read."""

    def __init__(self, first_rule: int, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray):
        self.first, self.rules, self.symbols = first_rule, rules.reshape(-1, 2).astype(np.int64), symbols.astype(np.int64)
        self.size = np.concatenate([np.ones(first_rule, np.int64), lengths.astype(np.int64)])
        self.start = np.concatenate(([0], np.cumsum(self.size[self.symbols])))
        self.short = self.place = None

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of ``symbols``: long rules are taken apart until all are short, whose ids stand in a table."""
        symbols = self._apart(symbols, _SHORT)
        if self.short is None:
            few = np.flatnonzero(self.size[self.first :] <= _SHORT) + self.first
            self.short = np.concatenate([np.arange(self.first, dtype="<u4"), self._apart(few, 1).astype("<u4")])
            self.place = np.zeros(len(self.size), np.int64)
            self.place[: self.first] = np.arange(self.first)
            self.place[few] = self.first + np.cumsum(self.size[few]) - self.size[few]
        size = self.size[symbols]
        return self.short[np.repeat(self.place[symbols] - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def _apart(self, symbols: np.ndarray, most: int) -> np.ndarray:
        """Takes rules of more than ``most`` ids apart, again and again."""
        while len(at := np.flatnonzero(self.size[symbols] > most)):
            times = np.ones(len(symbols), np.int64)
            times[at] = 2
            where = np.cumsum(times) - times
            out = np.repeat(symbols, times)
            pair = self.rules[symbols[at] - self.first]
            out[where[at]], out[where[at] + 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return symbols

    def read(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on; only the symbols that cover them are expanded."""
        if n <= 0:
            return np.zeros(0, "<u4")
        a = int(np.searchsorted(self.start, start, "right")) - 1
        b = int(np.searchsorted(self.start, start + n, "left"))
        got = self.expand(self.symbols[a:b])
        skip = start - int(self.start[a])
        return got[skip : skip + n]


FILE = T.StructType(
    [T.StructField("shard", T.LongType()), T.StructField("before", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("first_rule", T.LongType())]
    + [T.StructField(c, T.BinaryType()) for c in ("rules", "lengths", "symbols", "doc_ids", "doc_lengths", "doc_nulls")]
)


def _packed(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a.reshape(-1).view(np.uint8).reshape(a.size, -1).T).tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def write(df: DataFrame, tokenizer: str, path: str, end: int = 0, shard_ids: int = SHARD_IDS, parts: int | None = None) -> None:
    """Encodes ``text`` and writes the files, in ascending order of doc_id.

    Rows go to partitions by ranges of doc_id and, among equal ones, of a hash that differs from row to row, so that no
    id fills a partition; Spark takes the bounds from a sample. The number of partitions follows the size of the input;
    each sorts its rows, encodes them and closes a shard whenever ``shard_ids`` ids are reached, so memory holds one shard.
    """
    import tokenizers

    with open(tokenizer, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    first_rule = tokenizers.Tokenizer.from_file(tokenizer).get_vocab_size()
    parts = parts or min(MOST_PARTS, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) // RANGE_BYTES))
    rows = df.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("text", F.monotonically_increasing_id()))
    placed = rows.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id").select("doc_id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        if tokenizer not in _MADE:
            _MADE[tokenizer] = Encoder(sent.value)
        encoder = _MADE[tokenizer]
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        total = before = 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
            rules, lengths, symbols = compress(flat, first_rule)
            arrays = [rules, lengths, symbols, np.array([d or 0 for d in docs], "<i8"), np.array([len(x) for x in ids], "<u4"), np.array([d is None for d in docs], bool)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([before], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([first_rule], pa.int64()), *[pa.array([_packed(a)], pa.binary()) for a in arrays]], names=FILE.names)

        for batch in batches:
            every, at = batch.column(0).to_pylist(), 0
            for flat, sizes in encoder.arrays(batch.column(1), end):
                for one in np.split(flat, np.cumsum(sizes)[:-1]):
                    ids.append(one)
                    docs.append(every[at])
                    at += 1
                    total += len(one)
                    if total >= shard_ids:
                        yield close()
                        number, before = number + 1, before + total
                        ids, docs, total = [], [], 0
        if docs:
            yield close()

    placed.mapInArrow(shards, FILE).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, unsigned 32-bit) of every document in the files."""
    files = spark.read.schema(FILE).parquet(path)
    part = F.shiftright("shard", 32).alias("part")
    totals = files.groupBy(part).agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # two numbers for each partition
    starts, at = {}, 0
    for r in totals:
        starts[r.part] = at
        at += r.n
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def make():
        def each(batch: pa.RecordBatch):
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                get = lambda c, kind: _unpacked(row[c], kind)  # noqa: B023, E731
                shard = Shard(row["first_rule"], get("rules", "<u4"), get("lengths", "<u4"), get("symbols", "<u4"))
                docs, sizes = get("doc_ids", "<i8"), get("doc_lengths", "<u4").astype(np.int64)
                nulls = get("doc_nulls", "?")
                ends = np.cumsum(sizes)
                base = starts[row["shard"] >> 32] + row["before"]
                for i in range(0, len(docs), 4000):
                    j = min(i + 4000, len(docs))
                    low = int(ends[i] - sizes[i])
                    got = shard.read(low, int(ends[j - 1]) - low)
                    ids = [got[int(e - s) - low : int(e) - low].tobytes() for s, e in zip(sizes[i:j], ends[i:j], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(docs[i:j], pa.int64(), mask=nulls[i:j]), pa.array(base + ends[i:j] - sizes[i:j], pa.int64()), pa.array(sizes[i:j], pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

        return each

    return map_arrow(files, schema, make)


def read_range(spark: SparkSession, path: str, shard: int, start: int, n: int) -> np.ndarray:
    """``n`` ids from ``start`` on of one shard."""
    row = spark.read.schema(FILE).parquet(path).where(F.col("shard") == shard).first()
    get = lambda c, kind: _unpacked(row[c], kind)
    return Shard(row["first_rule"], get("rules", "<u4"), get("lengths", "<u4"), get("symbols", "<u4")).read(start, n)


def written(df: DataFrame, tokenizer: str, end: int = 0, **how) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    import uuid

    path = f"{shared_dir(df.sparkSession)}/repair_{uuid.uuid4().hex}"
    write(df, tokenizer, path, end, **how)
    return read(df.sparkSession, path)


_MADE: dict[str, Encoder] = {}
