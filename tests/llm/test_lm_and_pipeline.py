"""Language-model scores against plain Python, and the pipeline's stages."""

import collections
import math
import re
import zlib

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from terrain_spark.llm import bpe, lm_score
from terrain_spark.llm.common import documents

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def scores_by_force(rows, order):
    counts = [collections.Counter() for _ in range(order + 1)]
    texts = [(i, ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(LOW)), "</s>"]) for i, x in rows]
    for i, w in texts:
        if not held(i):
            for k in range(1, order + 1):
                counts[k].update(tuple(w[p : p + k]) for p in range(len(w) - k + 1))
    n, v = sum(c for k, c in counts[1].items() if k != ("<s>",)), len(counts[1]) - (("<s>",) in counts[1])

    def p(ctx, w):
        if not ctx:
            return (counts[1][(w,)] + 1) / (n + v + 1)
        lower, c = p(ctx[1:], w), counts[len(ctx)][ctx]
        return (counts[len(ctx) + 1][(*ctx, w)] + lm_score.MU * lower) / (c + lm_score.MU) if c else lower

    out = []
    for i, w in texts:
        base = sum(math.log10((counts[1][(x,)] + 1) / (n + v + 1)) for x in w[1:])
        own = sum(math.log10(p(tuple(w[max(0, k - order + 1) : k]), w[k])) for k in range(1, len(w)))
        out.append((i, held(i), len(w) - 1, sum(counts[1][(x,)] > 0 for x in w[1:]), n, base, own))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(spark, order):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF).limit(80).collect()] + [(900, None), (901, ""), (None, "The of and"), (3, "twice"), (902, "a " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm_score.score(df, order, block=20_000, buckets=5).collect()
    want = scores_by_force(rows, order)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-6)


def test_probabilities_add_up_to_one(spark):
    """Over all words of the training texts and one for the unknown."""
    train = [(1, "a b a c"), (3, "b b d")]
    import numpy as np

    vocabulary = ["a", "b", "c", "d", "zzz"]
    texts = [t for _, t in train] + [f"{ctx} {w}" for ctx in ("a", "b", "zzz") for w in vocabulary] + [ctx for ctx in ("a", "b", "zzz")]
    mask = np.array([True] * 2 + [False] * (len(texts) - 2))
    grams = lm_score.Grams(*lm_score.words_of([t.encode() for t in texts], lm_score.WordHashes()), mask, 2)
    n, v = grams.n_train, 5
    added = lm_score.Automaton(grams, grams.counts.astype(np.int64), n, v, 2, lm_score.MU).read()
    prob = {t: 10 ** added[grams.first[i] + 2] for i, t in enumerate(texts[2:], 2)}  # of the second token, a word or the end
    for ctx in ("a", "b", "zzz"):
        assert sum(prob[f"{ctx} {w}"] for w in vocabulary) + prob[ctx] == pytest.approx(1.0)


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    """Behind a shuffle rows may come in another order when they are read again; blocks are written once."""
    df = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3} x") for i in range(300)], "doc_id long, text string")
    get = lambda d, **how: sorted((r.doc_id, round(r.score, 9)) for r in lm_score.score(d, **how).collect())
    want = get(df.coalesce(1))
    assert get(df.repartition(7).orderBy(lm_score.F.rand()), block=200) == want
    assert get(df.withColumn("bucket", lm_score.F.lit(1)).withColumn("block", lm_score.F.lit("x")), buckets=3) == want


def test_text_that_occurs_twice_scores_higher(spark):
    import random

    r = random.Random(5)
    texts = [" ".join(f"w{min(int(r.expovariate(0.02)), 400)}" for _ in range(120)) for _ in range(60)]
    rows = [(i, x) for i, x in enumerate(texts + texts[:5])]
    got = {r.doc_id: r.score / r.n_tokens for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # both texts of a pair must be in the training part, for counts of two
    twice = [i for i in range(5) if not held(i) and not held(60 + i)]
    once = [i for i in range(5, 60) if not held(i)]
    assert twice and min(got[i] for i in twice) > max(got[i] for i in once)


def test_ids_of_any_kind(spark):
    df = spark.createDataFrame([("12", "a b"), ("x-1", "a c"), (None, "b"), ("1.5", "a")], "doc_id string, text string")
    got = lm_score.score(df).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == [(-1, 2), (-1, 2), (-1, 3), (12, 3)]


def test_empty_table(spark):
    assert lm_score.score(documents(spark, SF).limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs, names = documents(spark, SF), []
    before = docs.count()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        names.append((name, docs.count()))
        assert docs.columns == columns and names[-1][1] <= before
        before = names[-1][1]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = out.collect()
    assert len(rows) == len(texts) > 50
    for r in rows:
        assert memoryview(bytes(r.ids)).cast("I").tolist() == tik.encode_ordinary(texts[r.doc_id])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(texts)


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated ids and rows, empty and very long texts, extra columns with names of the stages' own, empty tables."""
    from pyspark.sql import functions as F

    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    labels.union(spark.createDataFrame([(None, 1, 0), (1, None, None)], labels.schema)).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.union(spark.createDataFrame([(None, None), (99_999, "")], benchmark.schema)).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, SF)
    odd = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, None), (3, "word " * 30_000, "en", "s", 1), (None, "Text without an id.", "en", None, None), (3, "word " * 30_000, "en", "s", 1)]
    df = docs.limit(60).union(docs.limit(3)).union(spark.createDataFrame(odd, docs.schema))
    for c in ("key", "kept", "log_weight", "rank", "seen", "removed", "leaks", "node", "row", "class_id"):
        df = df.withColumn(c, F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        rows = out.collect()
        assert 0 < len(rows) <= df.count() and all(r.key == r.row == r.removed == r.leaks == r.seen == "mine" for r in rows), name
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name
    name, stage = corpus_pipeline.STAGES[-1]
    out = stage(spark, df, str(tmp_path))
    assert {"ids", "n_tokens", "key"} <= set(out.columns) and out.count() == df.count()
    assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
