"""Hard negatives, target sampling and language identification against plain Python, and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrain_spark.llm import hard_negatives, language_id, queries, target_sampling

SF = "/root/testdata/sf0.001"
EMB = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string, lang string"


def mined_by_force(rows, every=100):
    own = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
        own[i] = min(own.get(i, r), r)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in own.items():
        if a % every:
            continue
        scored = sorted((-dot(v, w), i, x) for i, (x, w) in own.items() if i != a)
        for p, i, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(a, i, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fit)]
    return sorted(out)


def vectors(n, dims, labels, seed, scale=1.0):
    r = random.Random(seed)
    centre = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    return [(i, [(r.gauss(0, 1) + x) * scale for x in centre[r.randrange(labels)]], r.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize(("dims", "scale"), [(3, 0.01), (16, 0.3), (40, 300.0)])
def test_negatives_equal_brute_force(spark, monkeypatch, dims, scale):
    """Several blocks of anchors and rows, ties in small whole numbers, and numbers beyond 24 bits."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 60)
    rows = vectors(700, dims, 4, dims, scale)
    df = spark.createDataFrame(rows, EMB).repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 5 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(map(tuple, got.collect())) == mined_by_force(rows, 5)


def test_negatives_of_odd_rows(spark):
    """Nulls, infinities, other lengths, repeated ids, equal vectors, huge numbers, and columns with the names used inside."""
    base = vectors(230, 6, 3, 5)
    odd = [(None, [1.0] * 6, 1), (300, None, 1), (400, [1.0, None], 1), (500, [float("nan")] * 6, 1), (501, [float("inf")] * 6, 2), (600, [0.5, 0.5], None), (700, [], 1), (800, [0.25, -0.5], 2), (100, [0.0] * 6, 9), (801, [3e38] * 6, 0)]
    copies = [(900 + i, [0.5] * 6, i % 3) for i in range(40)]
    rows = base + odd + copies + copies
    df = spark.createDataFrame(rows, EMB).withColumns({c: F.lit(1) for c in ("x", "y", "positives", "score")})
    assert sorted(map(tuple, hard_negatives.mine(df).collect())) == mined_by_force([r for r in rows if r[0] != 801])
    assert hard_negatives.mine(df.where("false")).collect() == []


def test_bounds_drop_pairs_before_the_last_plane():
    rng = np.random.default_rng(1)
    a, c = rng.integers(-256, 256, (20, 32)), rng.integers(-256, 256, (900, 32))
    left = []

    def keep(low, high, there):
        left.append(int(there.sum()))
        assert ((a @ c.T >= low) & (a @ c.T <= high))[there].all()
        return high >= hard_negatives._greatest(np.where(there, low, np.iinfo(np.int64).min), 5)[:, None]

    i, j, score = hard_negatives.candidates(a, c, np.ones((20, 900), bool), keep)
    assert (score == (a @ c.T)[i, j]).all() and len(i) == 100
    assert left[0] == 18_000 and left[-1] < 400


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sampled_by_force(docs, target):
    words = lambda x: WORD.findall((x or "").translate(LOW))
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    s, t = (collections.Counter(bucket(w) for x in texts for w in words(x)) for texts in ([r[1] for r in docs], target))
    n, m = sum(s.values()), sum(t.values())
    out = []
    for i, x, *_ in docs:
        own = [math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000)))) for b in map(bucket, words(x))]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(own) // len(own) if own else 0
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {}
    for k, r in enumerate(may[: len(may) // 10]):
        rank.setdefault(r, []).append(k + 1)
    return sorted(((*r, rank[r].pop() if rank.get(r) else None) for r in out), key=repr)


def test_samples_equal_brute_force(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    odd = [(None, None, "en"), (None, "", "en"), (9001, "A1 É-x\0y_Z" * 7, "en"), (9002, "word " * 60_000, None), *[(9003, "the same row again " * 9, "fr")] * 60]
    df = spark.createDataFrame(docs + odd, DOCS).repartition(5).withColumns({c: F.lit("mine") for c in ("rank", "score", "_turn", "key", "n")})
    got = target_sampling.resample(df, spark.createDataFrame([(x,) for x in [*target, None]], "text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sampled_by_force(docs + odd, target)


def test_samples_of_empty_tables(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "en")], DOCS)
    assert target_sampling.resample(none, one).collect() == []
    assert [tuple(r) for r in target_sampling.resample(one, none).collect()] == [x for x in sampled_by_force([(1, "a b", "en")], [])]


def bits_by_force(trees, counts, text):
    """The code length of a text in one language, from followers of each context."""
    words = language_id.plain(text.encode())
    total = 0
    for p, b in enumerate(words):
        known = [k for k in range(min(p, trees.order), -1, -1) if (k << (8 * trees.order) | int.from_bytes(words[p - k : p], "big")) in set(trees.keys.tolist())]
        bits = 0.0
        for k in known:
            own = counts[words[p - k : p]]
            n, d = sum(own.values()), len(own)
            if own[b]:
                bits -= math.log2(own[b] / (n + d))
                break
            bits -= math.log2(d / (n + d)) if n else 0
        else:
            bits += 8
        total += bits
    return total


@pytest.mark.parametrize("cells", [1 << 22, 4000])
def test_code_lengths_equal_plain_python(spark, cells):
    """With all contexts, and with the most frequent ones alone."""
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.doc_id < 40]
    trees = language_id.learn(spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in docs], DOCS), order=3, cells=cells)
    texts = ["", "The thing", "Éréier enqueeau", "zz ж 漢 ~ 9", "a" * 300, docs[3].text[:400]]
    flat = [language_id.plain(x.encode()) for x in texts]
    got = trees.lengths(np.frombuffer(b"".join(flat), np.uint8), np.array([len(x) for x in flat]))
    for language in trees.languages:
        counts = collections.defaultdict(collections.Counter)
        for r in docs:
            if r.lang == language and zlib.crc32(str(r.doc_id).encode()) % 5:
                w = language_id.plain(r.text.encode())
                for p, b in enumerate(w):
                    for k in range(min(p, 3) + 1):
                        counts[w[p - k : p]][b] += 1
        for i, x in enumerate(texts):
            assert got[i, trees.languages.index(language)] / language_id.UNIT == pytest.approx(bits_by_force(trees, counts, x), abs=0.01)


def test_held_out_texts_get_their_language(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op13_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(held) > 150 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(spark):
    rows = [(1, "the cat sat on the mat " * 5, "en"), (2, "der hund und die katze " * 5, "de"), (3, None, "en"), (4, "", None), (None, "the cat " * 30_000, "de"), (6, "12 345 ... $$", "en"), (7, "the mat", None), (7, "the mat", None), (8, "Привет", "xx"), (9, "1", "zz")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("mine") for c in ("held_out", "language", "gram", "n", "letters", "share")})
    got = collections.defaultdict(set)
    for r in language_id.identify(df).collect():
        got[r.doc_id].add((r.lang_pred, r.score if r.lang_pred == "und" else r.score > 0.2))
    assert got[3] == got[4] == got[6] == got[9] == {("und", 0.0)} and got[1] == {("en", True)} and got[2] == {("de", True)}
    assert language_id.identify(df.where("lang IS NULL")).where("lang_pred <> 'und' OR score <> 0").collect() == []
    assert language_id.identify(df.where("false")).collect() == []
