"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with the counts of the bytes that follow. A byte is coded in the longest
context that the tree has: with probability c / (n + d) if it has followed c of n times there, d being the number of different followers;
otherwise an escape of probability d / (n + d) is coded and the next shorter context is asked, down to equal chances of all 256 bytes (method C,
no exclusions). A context that a language has never seen costs it nothing. The language whose statistics give the
shortest code wins; the score is its share of 2**-length over all languages.

Texts are read as words: A-Z in lower case, each run of other ASCII characters than letters as one space. Statistics are frozen, so
the code lengths of all bytes after all contexts are a table, and the trees of all languages are one automaton over contexts with
failure links. As a context holds ``ORDER`` bytes at most, so many passes over an array of bytes give the state before each
byte of all texts, and one more gathers the lengths. Lengths are whole numbers of 2**-16 bits, so sums are exact in any order.

The statistics come from at most some ``SAMPLE`` documents of each language, chosen by a hash of doc_id and text, whole texts. n-grams are
counted in Spark; the driver gets the followers of the most frequent contexts, as many as ``CELLS`` allows. Prefixes and suffixes of a
context are at least as frequent and shorter, so they are there if it is.

Rows: null texts and those without a letter are ``und`` with score 0, as are all texts if nothing was learned; texts of any length count
whole; languages that are null teach nothing, beyond the ``LANGUAGES`` most frequent ones none is learned; equal lengths go to the first
language by name; rows without an id are not held out; repeated rows count each; other columns are not read, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from .common import F, T, map_arrow, portions, stored, texts_of

#: Bytes of the longest context, documents of a language that teach (some), languages, numbers in the tables.
ORDER, SAMPLE, LANGUAGES, CELLS = 4, 3000, 200, 1 << 22
#: Held out are the texts whose hash leaves this remainder.
MODULUS, HELD_OUT = 5, 0
#: Parts of a bit.
UNIT = 1 << 16
UNKNOWN = "und"

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % MODULUS == HELD_OUT, F.lit(False))


def plain(text: bytes) -> bytes:
    return b" ".join(text.translate(_PLAIN).split())


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and how many each has."""
    texts = [plain(x or b"") for x in pc.cast(column, pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))


def _counted(df: DataFrame, order: int) -> DataFrame:
    """language, gram (a byte behind ``order`` bytes, zeros before the text begins) and n; ``df``: language, text."""
    schema = T.StructType([T.StructField("language", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def each(batch: pa.RecordBatch):
        language, texts = batch.column(0).to_numpy(), batch.column(1)
        for a, b in portions(texts_of(texts), 4_000_000):
            flat, sizes = _flat(texts.slice(a, b - a))
            own, at = np.repeat(language[a:b], sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            gram = flat.astype(np.int64)
            for k in range(1, order + 1):
                gram[k:] |= np.where(at[k:] >= k, flat[: len(flat) - k], 0).astype(np.int64) << (8 * k)
            for x in np.unique(own):
                grams, n = np.unique(gram[own == x], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), x, np.int32)), pa.array(grams), pa.array(n.astype(np.int64))], names=schema.names)

    return map_arrow(df, schema, lambda: each).groupBy("language", "gram").agg(F.sum("n").alias("n"))


class Trees:
    """The context trees of all languages as one automaton, and the code lengths of bytes behind its states.

    ``keys``: contexts as numbers, their length above the bytes; ``followers``: language, key, byte, n.
    """

    def __init__(self, languages: list[str], keys: np.ndarray, followers: tuple[np.ndarray, ...], order: int):
        self.languages, self.order = languages, order
        self.keys = np.sort(keys)  # shorter ones first, so the root is 0
        language, key, byte, n = followers
        seen = np.unique(byte)
        #: bytes that no language has seen share the class 0
        self.kind = np.zeros(256, np.int64)
        self.kind[seen] = np.arange(1, len(seen) + 1)
        size, width = len(self.keys), len(seen) + 1
        length = self.keys >> (8 * order)
        body = self.keys & ((1 << (8 * order)) - 1)
        suffix = np.zeros(size, np.int64)
        longer = length > 0
        cut = (1 << (8 * (np.maximum(length, 1) - 1))) - 1
        suffix[longer] = np.searchsorted(self.keys, ((length - 1) << (8 * order) | body & cut)[longer])
        count = np.zeros((size, width, len(languages)))
        count[np.searchsorted(self.keys, key), self.kind[byte], language] = n
        total, different = count.sum(1), (count > 0).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(different / (total + different)), 0.0)
            bits = -np.log2(count / (total + different)[:, None, :])
        self.goto = np.zeros((size, width), np.int32)
        for k in range(order + 1):
            own = np.flatnonzero(length == k)
            lower = bits[suffix[own]] if k else np.full((len(own), width, len(languages)), 8.0)
            bits[own] = np.where(count[own] > 0, bits[own], lower + escape[own][:, None, :])
            self.goto[own] = self.goto[suffix[own]] if k else 0
            if k < order:
                wanted = (k + 1) << (8 * order) | body[own][:, None] << 8 | seen[None, :]
                place = np.minimum(np.searchsorted(self.keys, wanted), size - 1)
                there = self.keys[place] == wanted
                self.goto[own, 1:] = np.where(there, place, self.goto[own, 1:])
        self.bits = np.rint(bits * UNIT).astype(np.int32).reshape(size * width, len(languages))

    def lengths(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The code length of each text for each language, in parts of a bit."""
        out = np.zeros((len(sizes), len(self.languages)), np.int64)
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        begins = (np.cumsum(sizes) - sizes)[full]
        kind, goto, width = self.kind[flat], self.goto.reshape(-1), self.goto.shape[1]
        place = kind.copy()  # of the root's row
        for _ in range(self.order):
            state = goto[place]
            place[1:] = state[:-1] * np.int64(width) + kind[1:]
            place[begins] = kind[begins]
        out[full] = np.add.reduceat(self.bits[place], begins, axis=0, dtype=np.int64)
        return out


def learn(df: DataFrame, order: int = ORDER, sample: int = SAMPLE, cells: int = CELLS) -> Trees | None:
    """Trees of the languages of ``df`` (doc_id, text, lang); None without any text."""
    spark = df.sparkSession
    usable = df.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    found = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not found:
        return None
    languages = sorted(r.lang for r in found)
    shares = spark.createDataFrame([(languages.index(r.lang), r.lang, min(1.0, sample / r["count"])) for r in found], "language int, lang string, share double")
    dealt = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    grams = stored(_counted(usable.join(F.broadcast(shares), "lang").where(dealt).select("language", "text"), order), "grams")
    last = F.col("gram").bitwiseAND(255)
    width = grams.select(last).distinct().count() + 1
    if width == 1:
        return None
    before = F.shiftright("gram", 8)
    whole = lambda j: F.lit(True) if j == 0 else F.shiftright("gram", 8 * j).bitwiseAND(255) > 0  # noqa: E731  it begins in the text
    context = F.filter(F.array(*[F.when(whole(j), before.bitwiseAND((1 << (8 * j)) - 1).bitwiseOR(F.lit(j << (8 * order)))) for j in range(order + 1)]), lambda c: c.isNotNull())
    each = grams.select("language", last.cast("int").alias("byte"), "n", F.explode(context).alias("key"))
    states = max(1, cells // (width * (len(languages) + 1)))
    keys = each.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(states).select("key")
    kept = spark.createDataFrame(keys.toArrow())
    got = each.join(F.broadcast(kept), "key").groupBy("language", "key", "byte").agg(F.sum("n").alias("n")).toArrow()
    chosen = np.unique(got.column("key").to_numpy())
    return Trees(languages, chosen, tuple(got.column(c).to_numpy() for c in ("language", "key", "byte", "n")), order)


def predict(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def each(batch: pa.RecordBatch):
        model, letters = sent.value, batch.column(2).to_numpy(zero_copy_only=False)
        names, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
        if model is not None:
            texts = batch.column(3)
            lengths = np.concatenate([model.lengths(*_flat(texts.slice(a, b - a))) for a, b in portions(texts_of(texts))])
            best = lengths.argmin(1)
            share = 1 / np.exp2((lengths.min(1)[:, None] - lengths) / UNIT).sum(1)
            names[letters], score[letters] = np.array(model.languages, object)[best][letters], share[letters]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(names, pa.string()), pa.array(score)], names=schema.names)

    return map_arrow(rows, schema, lambda: each)


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the texts of ``docs`` (doc_id, text, lang) that are not held out, and predicts the language of all."""
    return predict(docs, learn(docs.select("doc_id", "text", "lang")))
