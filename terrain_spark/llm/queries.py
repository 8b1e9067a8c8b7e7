"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hard_negatives, language_id, line_dedup, lm_score, near_dup, outliers, quality, repair, target_sampling, token_counts, url_filter
from .common import documents


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and their decoding, as digests."""
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log ratios of every document, and whether it is kept."""
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as Re-Pair files and read back."""
    back = repair.written(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that leak into them."""
    return decontaminate.leaking(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated units; their places in the original, and the documents that keep them."""
    return line_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of bytes and tokens of every text."""
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


#: Rules of the query, and hosts that are blocked where no rule fits.
RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]
LISTED_HOSTS = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    return near_dup.classes(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text by a model of the texts that are not held out."""
    found = lm_score.score(documents(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every url."""
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, LISTED_HOSTS)


def op10_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every text, and whether they lie among those of its language and source."""
    return outliers.judge(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that are nearly as near to an anchor as its positives."""
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of every text towards the benchmark's words, and the ranks of those that are drawn."""
    return target_sampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text by the shortest code."""
    return language_id.identify(documents(spark, sf_dir))


OP9_SQL = """
WITH parts AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
urls AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts),
ruled AS (
  SELECT page_id, host, path,
    CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
    END AS rule
  FROM urls)
SELECT page_id, host, path, rule,
  CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '(^|[.])(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)[.]example[.](com|net|org)$') THEN 'block'
    ELSE 'allow'
  END AS verdict
FROM ruled
"""


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

#: Runs of five words with their turn among equal ones, their overlaps, and what links lead to.
OP7_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM l),
f AS (SELECT doc_id, p, n, concat_ws(' ', w, lead(w, 1) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d, lead(w, 4) OVER d) AS run FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
g AS (SELECT doc_id, run, row_number() OVER (PARTITION BY doc_id, run) AS k FROM f WHERE p <= greatest(n - {near_dup.WORDS - 1}, 1)),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.run = b.run AND a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE c >= {near_dup.SIMILARITY}::DOUBLE * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a
"""

_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda h, b: list_reduce(list_concat([xor(h, b)], range(8)), lambda d, i: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT)"
_MU = f"{lm_score.MU}::DOUBLE"

#: Counts of one, two and three words of the training texts, and the smoothed probability of each token.
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_CRC} % {lm_score.MODULUS} = {lm_score.HELD_OUT} AS held_out, list_concat(['<begin> '], {_WORDS}, ['<end> ']) AS ws FROM documents),
t AS (SELECT doc_id, held_out, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
g AS (SELECT *, lag(w, 1) OVER o AS u, lag(w, 2) OVER o AS v FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
c1 AS (SELECT w, count(*) AS c FROM g WHERE NOT held_out GROUP BY 1),
c2 AS (SELECT u, w, count(*) AS c FROM g WHERE NOT held_out AND p > 1 GROUP BY 1, 2),
c3 AS (SELECT v, u, w, count(*) AS c FROM g WHERE NOT held_out AND p > 2 GROUP BY 1, 2, 3),
n AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c1 WHERE w <> '<begin> '),
k AS (SELECT g.*, coalesce(c1.c, 0) AS a, coalesce(x.c, 0) AS au, coalesce(c2.c, 0) AS b, coalesce(y.c, 0) AS bu, coalesce(c3.c, 0) AS cc, n.n, (coalesce(c1.c, 0) + 1)::DOUBLE / (n.n + n.v + 1) AS p1
  FROM g CROSS JOIN n LEFT JOIN c1 ON c1.w = g.w LEFT JOIN c1 x ON x.w = g.u LEFT JOIN c2 ON c2.u = g.u AND c2.w = g.w LEFT JOIN c2 y ON y.u = g.v AND y.w = g.u LEFT JOIN c3 ON c3.v = g.v AND c3.u = g.u AND c3.w = g.w WHERE g.p > 1),
s AS (SELECT *, (b + {_MU} * p1) / (au + {_MU}) AS p2 FROM k)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE a > 0) AS n_known, any_value(n) AS train_tokens, round(sum(log10(p1)), 6) AS base_score,
  round(sum(log10(CASE WHEN p > 2 THEN (cc + {_MU} * p2) / (bu + {_MU}) ELSE p2 END)), 6) AS score
FROM s GROUP BY doc_id, held_out
"""

#: Products of all anchors with all rows, ranked.
OP11_SQL = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % {hard_negatives.CHANGED} = 0 THEN (label + 1) % {hard_negatives.LABELS} ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({hard_negatives.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT vec_id, label, v FROM e QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % {hard_negatives.EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {hard_negatives.POSITIVES}),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {hard_negatives.LOW} * positive_score <= 100 * score AND 100 * score <= {hard_negatives.HIGH} * positive_score)
SELECT * FROM n WHERE rank <= {hard_negatives.NEGATIVES}
"""

_HEX = "(SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM t))"
_BUCKET = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda d, i: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % {target_sampling.BUCKETS}"
_PLAIN = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Words by bucket, gains, and noise from digests.
OP12_SQL = f"""
WITH t AS (SELECT doc_id, FALSE AS target, unnest({_PLAIN}) AS w FROM documents UNION ALL SELECT NULL, TRUE, unnest({_PLAIN}) FROM benchmark),
b AS (SELECT w, {_BUCKET} AS bucket FROM {_HEX}),
c AS (SELECT bucket, count(*) FILTER (WHERE NOT target) AS s, count(*) FILTER (WHERE target) AS t FROM t JOIN b USING (w) GROUP BY 1),
n AS (SELECT sum(s)::DOUBLE AS ns, sum(t)::DOUBLE AS nt FROM c),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (ns + {target_sampling.BUCKETS}) / ((s + 1.0::DOUBLE) * (nt + {target_sampling.BUCKETS})))) AS BIGINT) AS gain FROM c, n),
w AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)::DOUBLE) AS BIGINT) AS weight FROM t JOIN b USING (w) JOIN g USING (bucket) WHERE NOT target GROUP BY 1),
d AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{target_sampling.SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN w USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {target_sampling.LEAST} ORDER BY score DESC, doc_id) AS place, (SELECT count(*) FROM d WHERE n_features >= {target_sampling.LEAST}) * {target_sampling.PERCENT} // 100 AS wanted FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {target_sampling.LEAST} AND place <= wanted THEN place END AS rank FROM k
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality": op2_quality,
    "op3_repair_files": op3_repair_files,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_near_dup": op7_near_dup,
    "op8_lm_score": op8_lm_score,
    "op9_url_filter": op9_url_filter,
    "op10_outliers": op10_outliers,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_target_sampling": op12_target_sampling,
    "op13_language_id": op13_language_id,
}

ORACLE_SQL: dict[str, str] = {"op7_near_dup": OP7_SQL, "op8_lm_score": OP8_SQL, "op9_url_filter": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_target_sampling": OP12_SQL}
