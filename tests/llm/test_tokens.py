"""Byte-level BPE, token counts and token files against the libraries."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from terrain_spark.llm import bpe, repair, token_counts
from terrain_spark.llm.common import chunks

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
ODD = " \n\t\r\x0b\x0c\x1c\x1d\x85\u00a0\u2003\u3000\u1680\u180e\u200b'sStTreé字́1²aB.!😀<|endoftext|>١"
TEXTS = [None, "", " ", "a", "a b", "  a  b \n", "don't I'LL", "x" * 5000, "ab" * 4000, "a<|endoftext|> b", "<|endoftext|>", "naïve café 北京 😀😀", "a\n b\r\n\tc   ", "the " * 300]


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBPE(bpe.read_ranks(RANKS), P.PATTERN)


@pytest.fixture(scope="module")
def tik(coder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


@pytest.fixture(scope="module")
def lib():
    return tokenizers.Tokenizer.from_file(JSON)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(ODD), max_size=40))
def test_chunks_join_to_the_text(text):
    assert " ".join(chunks(text)) == text


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(st.sampled_from(ODD), max_size=40), st.text(max_size=40)))
def test_bpe_equals_library(coder, tik, text):
    text = text.encode("utf-8", "replace").decode()
    assert array("I", coder.encode(text)).tolist() == tik.encode_ordinary(text)
    assert coder.decode(coder.encode(text)) == text.encode()


def test_bpe_long_pieces_need_n_log_n_steps(coder, tik):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdeé") for _ in range(60_000))
    assert array("I", coder.encode(text)).tolist() == tik.encode_ordinary(text)


def test_merge_takes_the_leftmost_of_equal_ranks():
    own = bpe.ByteBPE({bytes([b]): b for b in range(256)} | {b"aa": 300}, P.PATTERN)
    assert own.merge(b"aaaaa") == [300, 300, 97]


def test_bpe_digests(spark, tik):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(None, "a b", "n"), (4, "a b", "again")]
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, ids string"), RANKS, P.PATTERN).collect()
    assert len(got) == len(rows)
    want = set()
    for i, t, _ in rows:
        ids = tik.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert set(map(tuple, got)) == want


def test_bpe_keeps_other_columns_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", 5)], "doc_id long, text string, n_tokens int")
    assert bpe.encode_documents(df, RANKS, P.PATTERN).columns == ["doc_id", "ids", "n_tokens"]
    assert bpe.digests(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_bpe_keeps_as_many_chunks_as_it_is_told(spark, tik):
    few = bpe.ByteBPE(bpe.read_ranks(RANKS), P.PATTERN, cache=5)
    texts = [" ".join(f"w{i}, x{i}" for i in range(k, k + 40)) for k in range(0, 400, 40)]
    assert [array("I", few.encode(x)).tolist() for x in texts] == [tik.encode_ordinary(x) for x in texts]
    assert len(few._chunks) <= 5 and len(few._pieces) <= 5
    rows = spark.createDataFrame(list(enumerate(texts * 150)), "doc_id long, text string").coalesce(1)  # more rows than are handed on at once
    out = bpe.encode_documents(rows, RANKS, P.PATTERN, cache=5).collect()
    assert [(r.doc_id, array("I", r.ids).tolist(), r.n_tokens) for r in out] == [(i, ids := tik.encode_ordinary(x), len(ids)) for i, x in enumerate(texts * 150)]


def test_token_counts_equal_library(spark, lib):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (3, "a")]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), JSON, limit=100).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_token_counts_do_not_depend_on_the_table(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    a, b = (sorted(map(tuple, token_counts.count_tokens(df, JSON, frequent=f).collect())) for f in ([], ["b", "the", "odd <|endoftext|>", "x y"]))
    assert a == b
    assert token_counts.count_tokens(df.limit(0), JSON).count() == 0


def test_token_counts_by_sentencepiece(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = token_counts.count_tokens(spark.createDataFrame([(1, "Hello  world"), (2, None)], "doc_id long, text string"), P.path("piece_bpe_32k.model")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {1: len(lib.encode("Hello  world")), 2: 0}


def test_sentencepiece_words_add_up(spark):
    import sentencepiece

    name = "piece_bpe_32k.model"
    lib, rng = sentencepiece.SentencePieceProcessor(model_file=P.path(name)), random.Random(4)
    texts = ["".join(rng.choice(["the", "a", "Xq", " ", "  ", ".", ",", "123", "é", "\t", "\n", "<s>", "▁", "token", "ing", "\u00b4"]) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", " ", "plain words of ASCII " * 500]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), P.path(name)).collect()}
    assert got == {i: len(lib.encode(x)) for i, x in rows}


def test_counts_by_a_file_with_another_pattern(spark):
    import tokenizers

    own = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), P.path("word_bpe_49k.json")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}


def test_frequent_chunks_are_those_of_all_texts(spark):
    rows = [(i, f"x common other{i % 3} rare{i} " + "w" * (70 + i)) for i in range(500)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    top = token_counts.frequent_chunks(df, counted=300, kept=6, merged=2)
    assert top[:4] == ["common", "other1", "other0", "other2"] and not any(x.startswith("w") for x in top)
    assert token_counts.frequent_chunks(df.limit(0)) == []


def test_long_chunks_are_let_go_while_counting(spark, monkeypatch):
    """Chunks too long for the table don't pile up, and the table stays that of all texts."""
    held = []
    short = token_counts._short
    monkeypatch.setattr(token_counts, "_short", lambda tally: held.append(sum(map(len, tally))) or short(tally))
    monkeypatch.setattr(token_counts, "HELD", 3000)
    schema = []

    class Taken:
        def select(self, *_):
            return self

        def mapInArrow(self, count, kind):  # noqa: N802
            schema.append(count)
            raise StopIteration

    with pytest.raises(StopIteration):
        token_counts.frequent_chunks(Taken())
    texts = [f"a {'x' * 500}{i} b c" for i in range(100)]
    out = list(schema[0]([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
    assert set(out[0].column(0)[0].as_py().split()) == {"b", "c"}
    assert len(held) > 10 and max(held) < 5000


def test_odd_texts_in_one_cache(lib):
    counter = token_counts.Counter("json", open(JSON, "rb").read(), bound=50)
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert counter.count(texts) == counter.exact(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=300), st.sampled_from([10, 1 << 17]))
def test_repair_round_trip_and_random_access(ids, first):
    x = np.array(ids, "<u4")
    rules, lengths, symbols = repair.compress(x, first, start=8, step=2, least=2)
    shard = repair.Shard(first, rules, lengths, symbols)
    assert (shard.expand(symbols.astype(np.int64)) == x).all()
    for a in range(0, len(x), 7):
        assert (shard.read(a, 11) == x[a : a + 11]).all()


def test_repair_makes_repeated_ids_smaller():
    x = np.tile(np.arange(50, dtype="<u4"), 200)
    rules, _, symbols = repair.compress(x, 100)
    assert len(symbols) + 2 * len(rules) < len(x) / 3


@pytest.mark.parametrize("least", [2, 4, 9])
def test_repair_goes_on_until_no_pair_repeats(least):
    r = np.random.default_rng(least)
    passage = r.integers(0, 500, 300)
    x = np.concatenate([np.concatenate((passage[: r.integers(50, 300)], r.integers(0, 500, 40), [7] * r.integers(0, 30))) for _ in range(100)]).astype("<u4")
    rules, lengths, symbols = repair.compress(x, 500, least=least)
    assert (repair.Shard(500, rules, lengths, symbols).read(0, len(x)) == x).all()
    counts, last = {}, None
    for p in zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True):
        last = None if p == last and p[0] == p[1] else p  # of a row of equal symbols every second place
        if last:
            counts[p] = counts.get(p, 0) + 1
    assert max(counts.values(), default=0) < least
    assert len(repair.compress(np.tile(passage.astype("<u4"), 500), 500, least=least)[2]) < 20


def test_repair_files_of_one_hot_id(spark, lib):
    """An id that most rows have is dealt out to several partitions, and the order by id holds."""
    rows = [(5 if i % 4 else i, f"text {i} of many") for i in range(400)] + [(None, f"null {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = f"{repair.shared_dir(spark)}/hot_id"
    repair.write(df, JSON, path, parts=8)
    shards = [r.shard >> 32 for r in spark.read.parquet(path).collect()]
    assert len(set(shards)) >= 7
    got = sorted(repair.read(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((d is not None, d or 0) for d, _ in rows)
    ends = [r.start + r.n_tokens for r in got]
    assert [r.start for r in got] == [0, *ends[:-1]]


def test_repair_files_of_equal_rows(spark, lib):
    """Rows that are equal, without an id, spread over the partitions too."""
    df = spark.createDataFrame([(None, "the same text")] * 4000 + [(i, "x") for i in range(4000)], "doc_id long, text string").repartition(4)
    path = f"{repair.shared_dir(spark)}/equal_rows"
    repair.write(df, JSON, path, parts=8)
    held = {}
    for r in spark.read.parquet(path).collect():
        held[r.shard >> 32] = held.get(r.shard >> 32, 0) + r.n_ids
    assert len(held) == 8 and max(held.values()) < 0.3 * sum(held.values())
    got = repair.read(spark, path)
    n = len(lib.encode("the same text", add_special_tokens=False).ids) + 1
    assert got.where("doc_id IS NULL").agg({"start": "max"}).first()[0] == 3999 * n
    assert got.count() == 8000


def test_repair_files(spark, lib):
    rows = [(i * 7 % 41, t) for i, t in enumerate(TEXTS * 3)] + [(None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repair.written(df, JSON, shard_ids=2000, parts=3).collect()
    want, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got), key=repr) == sorted(want, key=repr)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ordered == [d for d, _, _ in want]
    assert repair.written(df.limit(0), JSON).count() == 0


def test_words_that_differ_in_their_signs_reach_the_library_once():
    """Signs at a word's end are a match of their own; ids are those of the whole text all the same."""
    with open(JSON, "rb") as f:
        encoder = repair.Encoder(f.read())
    asked, packed = [], encoder.lib.packed
    encoder.lib.packed = lambda some, kind: asked.extend(some) or packed(some, kind)
    texts = ["a zorbling, zorbling. zorbling%%% zorbling", "the zorbling?! zorbling's. zorbling'; ... zorbling.\nNo größe. größe, é. é ٣. x²: ​.", "b zorbling$$$ größe$ 7. 7%", "a b.  . .. ' '. ''.", ""]
    got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts[:1], 0) + encoder.encode(texts[1:], 0)]
    library = encoder.lib.lib
    assert got == [library.encode(x, add_special_tokens=False).ids + [0] for x in texts]
    assert asked.count("zorbling") == 1 and not any(x.startswith("zorbling") and x.strip(".,%?!$") == "zorbling" and x != "zorbling" for x in asked)


def test_reading_a_shard_takes_long_rules_apart(monkeypatch):
    """Rules longer than the table's are taken apart first, whatever its bound; all ranges are those that were written."""
    ids = np.tile(np.random.default_rng(3).integers(0, 500, 300), 40)
    made = repair.compress(ids, 500)
    for bound in (1, 2, 32, 1 << 20):
        monkeypatch.setattr(repair, "_SHORT", bound)
        shard = repair.Shard(500, *made)
        assert all((shard.read(a, n) == ids[a : a + n]).all() for a, n in ((0, len(ids)), (0, 1), (17, 1000), (len(ids) - 1, 1), (5, 0)))


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.sampled_from(TEXTS), st.text(st.sampled_from(ODD + ".,é%"), max_size=40)), max_size=12), size=st.integers(1, 200))
def test_ids_by_bytes_equal_library(words, lib, texts, size):
    column = pa.array(["before", *texts], pa.string()).slice(1)
    got = [x.tolist() for ids, sizes in words.arrays(column, 0, size) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [lib.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


@pytest.fixture(scope="module")
def words():
    with open(JSON, "rb") as f:
        return repair.Encoder(f.read(), bound=50)


def test_words_of_letters_are_not_searched_for_matches(lib):
    with open(JSON, "rb") as f:
        encoder = repair.Encoder(f.read())
    asked = []
    for name in ("exact", "_cut"):
        setattr(encoder.lib, name, lambda some, f=getattr(encoder.lib, name): asked.extend(some) or f(some))
    texts = ["a gröling zorbling, thonly. zorbling 12x été"]
    assert np.frombuffer(encoder.encode(texts, 0)[0], encoder.kind).tolist() == lib.encode(texts[0], add_special_tokens=False).ids + [0]
    assert sorted(asked) == sorted(["a", ",", ".", "12x"])
