"""Quality rules: statistics of texts, and robust outliers among them by language and source. DataFrame functions only.

A group's centre and covariance are minimum-covariance-determinant estimates. Concentration steps take the share of rows that lie
nearest and estimate anew from them; they begin from three starts (medians with median deviations, means with covariances,
medians with covariances), the one with the lowest determinant after ``TRIES`` steps goes on until its determinant falls
no more. Distances are counted in narrow classes, of which the last counts with the part that is needed, so a step is one
aggregation with partial sums, whatever the size of a group; it needs no sort of rows.

Rows: null texts have no words, fail the base rules and are not kept; a group under ``MIN_ROWS`` is judged with the other
small ones of its language, by the estimates of the whole language if those are too few too, and by those of the whole
corpus if the language is; of a corpus under ``MIN_ROWS`` all such rows are kept; null languages and sources are groups
of their own; repeated rows count each; very long texts are taken whole; other columns are
not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Share of a group that its estimates rest on, steps from each start, relative fall of a determinant that is none, rows of the smallest
#: group, share of clean rows to lose.
SHARE, TRIES, FALL, MIN_ROWS, TAIL = 0.75, 2, 0.01, 60, 1e-7
#: Classes of a unit of ln(1 + squared distance), and of a transformed statistic.
FINE, FINE_X = 16, 64
#: The statistics' standard deviations are taken as at least these.
FLOOR = (0.10, 0.25, 0.30, 0.30)
P = len(FLOOR)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more.

    Each window becomes a 64-bit hash whose low bits give way to its position; sorted, equal windows are neighbours,
    and those are compared word by word. The words that they cover are counted by the gaps
    between their positions. It takes n log n steps.
    """
    n = F.size(words)

    def covered(keys: Column, mask: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            p, q = a.bitwiseAND(F.bitwise_not(mask)).cast("int"), b.bitwiseAND(F.bitwise_not(mask)).cast("int")
            out = b.isNotNull() & (a.bitwiseAND(mask) == b.bitwiseAND(mask))
            for i in range(width):
                out = out & (F.get(words, p + i) == F.get(words, q + i))
            return F.coalesce(out, F.lit(False))

        twice = F.filter(keys, lambda x, j: same(x, F.get(keys, j + 1)) | same(x, F.get(keys, j - 1)))
        at = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.bitwise_not(mask)).cast("int")))
        return let(at, lambda at: F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - p, F.lit(width)))), F.lit(0).cast("bigint"), lambda a, x: a + x))

    mask = F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.length(F.bin(n.cast("bigint"))))
    hashed = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)])
    windows = F.transform(F.sequence(F.lit(0), n - width), lambda i: hashed(i))
    return F.when(n < width, F.lit(0).cast("bigint")).otherwise(
        let(mask, lambda m: let(F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(m).bitwiseOR(i.cast("bigint")))), lambda keys: covered(keys, m)))
    )


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words; ``text`` goes."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    counted = let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    lined = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
    kept = [c for c in df.columns if c != text and c not in new]
    out = df.select(
        *kept,
        F.length(F.regexp_replace(t, SPACE, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        counted.alias("_words"),
        lined.alias("_lines"),
    )
    return out.select(*kept, F.col("_words.n_words").alias("n_words"), "word_chars", "n_symbols", F.col("_lines.n_dup_lines").alias("n_dup_lines"), F.col("_lines.n_lines").alias("n_lines"), F.col("_words.n_repeat_words").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def transformed() -> list[Column]:
    """The statistics as near-normal numbers; the constants in the ratios calm those of short texts."""
    n = F.col("n_words") + 50.0
    return [
        F.ln((F.col("word_chars") + 250.0) / n),
        F.ln(F.lit(1.0) + F.col("n_symbols") * 20.0 / n),
        F.ln(F.lit(1.0) + F.col("n_dup_lines") * 10.0 / (F.col("n_lines") + 5.0)),
        F.ln(F.lit(1.0) + F.col("n_repeat_words") * 5.0 / n),
    ]


def cut_of(tail: float) -> float:
    """The squared distance that a share ``tail`` of normal rows exceeds, for four statistics."""
    low, high = 0.0, 400.0
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if math.exp(-x / 2) * (1 + x / 2) > tail else (low, x)
    return low


def consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal rows, for four statistics, is too small by."""
    q = cut_of(1 - share)
    return share / (1 - math.exp(-q / 2) * (1 + q / 2 + q * q / 8))


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _factors(widen: float = 1.0) -> list[Column]:
    """Centre and Cholesky factor of the covariance from the sums of the rows taken: m0.., l00, l10, l11, ...; and the determinant."""
    n = F.col("s")
    means = [F.col(f"s{i}") / n for i in range(P)]
    low: dict[tuple[int, int], Column] = {}
    for i in range(P):
        for j in range(i + 1):
            a = (F.col(f"s{i}{j}") / n - means[i] * means[j]) * widen
            if i == j:
                a = F.greatest(a, F.lit(0.0)) + FLOOR[i] ** 2
            for k in range(j):
                a = a - low[i, k] * low[j, k]
            low[i, j] = F.sqrt(F.greatest(a, F.lit(1e-9))) if i == j else a / low[j, j]
    det = low[0, 0] * low[0, 0]
    for i in range(1, P):
        det = det * low[i, i] * low[i, i]
    return [m.alias(f"m{i}") for i, m in enumerate(means)] + [low[i, j].alias(f"l{i}{j}") for i, j in PAIRS] + [det.alias("det")]


#: Sums that estimates come from: of rows, of each statistic, of products.
SUMS = ["s", *[f"s{i}" for i in range(P)], *[f"s{i}{j}" for i, j in PAIRS]]


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).cast("double").alias("s"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS]]


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. by forward substitution."""
    y: list[Column] = []
    for i in range(P):
        v = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            v = v - F.col(f"l{i}{j}") * y[j]
        y.append(v / F.col(f"l{i}{i}"))
    out = y[0] * y[0]
    for v in y[1:]:
        out = out + v * v
    return out


def _starts(rows: DataFrame) -> DataFrame:
    """g, start and its estimates, three for each group."""
    robust, plain = stored(_first(rows), "medians"), stored(rows.groupBy("g").agg(*_sums()).select("g", *_factors()), "means")
    middle, factor = [f"m{i}" for i in range(P)], [f"l{i}{j}" for i, j in PAIRS]
    mixed = robust.select("g", *middle).join(plain.select("g", *factor), "g")
    named = lambda df, i: df.select("g", F.lit(i).alias("start"), *middle, *factor)
    return named(robust, 0).union(named(plain, 1)).union(named(mixed, 2))


def _first(rows: DataFrame) -> DataFrame:
    """Medians and median deviations of each statistic, from counts of narrow classes."""
    long = rows.select("g", F.posexplode(F.array(*[F.floor(F.col(f"x{i}") * FINE_X) for i in range(P)])).alias("c", "b"))
    mids = _middle(long.groupBy("g", "c", "b").agg(F.count(F.lit(1)).alias("n")), 0.5).withColumnRenamed("b", "mid")
    far = long.join(mids, ["g", "c"]).select("g", "c", F.abs(F.col("b") - F.col("mid")).alias("b"))
    devs = _middle(far.groupBy("g", "c", "b").agg(F.count(F.lit(1)).alias("n")), 0.5).withColumnRenamed("b", "dev")
    wide = mids.join(devs, ["g", "c"]).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("c", "mid"))).alias("mid"), F.map_from_entries(F.collect_list(F.struct("c", "dev"))).alias("dev"))
    centre = [((F.col("mid")[i] + 0.5) / FINE_X).alias(f"m{i}") for i in range(P)]
    spread = [(F.sqrt(F.pow(F.col("dev")[i] * 1.4826 / FINE_X, 2) + FLOOR[i] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS]
    return wide.select("g", *centre, *spread)


def _middle(counts: DataFrame, share: float) -> DataFrame:
    """For each group and statistic the class that holds the ``share`` quantile."""
    from pyspark.sql import Window

    w = Window.partitionBy("g", "c")
    run = counts.select("g", "c", "b", F.sum("n").over(w.orderBy("b")).alias("run"), F.sum("n").over(w).alias("all"))
    return run.where(F.col("run") >= F.col("all") * share).groupBy("g", "c").agg(F.min("b").alias("b"))


def _concentrate(rows: DataFrame, params: DataFrame, share: float) -> DataFrame:
    """A concentration step from each start: estimates from the nearest rows, a class of distances at a time."""
    from pyspark.sql import Window

    near = rows.join(params, "g").select("g", "start", F.floor(F.ln(F.lit(1.0) + _distance()) * FINE).alias("b"), *[f"x{i}" for i in range(P)])
    sums = near.groupBy("g", "start", "b").agg(*_sums())
    w = Window.partitionBy("g", "start")
    needed = F.ceil(F.sum("s").over(w) * share)
    # of the class that holds the last row that is needed, a part counts
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (needed - (F.sum("s").over(w.orderBy("b")) - F.col("s"))) / F.col("s")))
    taken = sums.select("g", "start", part.alias("part"), *SUMS).groupBy("g", "start").agg(*[F.sum(F.col(c) * F.col("part")).alias(c) for c in SUMS])
    return taken.select("g", "start", *_factors(consistency(share)))


def estimates(rows: DataFrame, share: float = SHARE, tries: int = TRIES) -> DataFrame:
    """g and its centre, factor and determinant; ``rows`` has g and the statistics x0.. ."""
    params = _starts(rows)
    for _ in range(tries):
        params = stored(_concentrate(rows, params, share), "estimates")
    names = [c for c in params.columns if c not in ("g", "start")]
    best = params.groupBy("g").agg(F.min(F.struct("det", "start", F.struct(*names).alias("of"))).alias("t")).select("g", "t.start", "t.of.*")
    best = stored(best, "estimates")
    while True:
        step = _concentrate(rows, best, share)
        old = best.select("g", F.struct(*names).alias("old"))
        falls = F.col("det") < F.col("old.det") * (1 - FALL)
        both = step.select("g", "start", "det", F.struct(*names).alias("new")).join(old, "g")
        moved = stored(both.select("g", "start", F.when(falls, F.col("new")).otherwise(F.col("old")).alias("of"), falls.alias("falls")), "estimates")
        best = moved.select("g", "start", "of.*")
        if not moved.where("falls").limit(1).count():
            return best


def judge(df: DataFrame, share: float = SHARE, tries: int = TRIES, min_rows: int = MIN_ROWS, tail: float = TAIL) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    Estimates rest on the rows that pass the base rules; rows beyond ``tail`` of their group are rejected.
    """
    counted = statistics(df.select("doc_id", "text", "lang", "source"))
    ready = stored(counted.select("*", base_failed().alias("base_failed"), *[x.alias(f"x{i}") for i, x in enumerate(transformed())]), "statistics")
    key = lambda *c: F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), F.col(x)), F.lit("-")) for x in c])
    passed = ready.withColumn("own", key("lang", "source")).withColumn("tongue", key("lang"))
    sizes = stored(passed.groupBy("own", "tongue").agg(F.count_if(~F.col("base_failed")).alias("n")), "sizes")
    tongues = sizes.groupBy("tongue").agg(F.sum("n").alias("whole"), F.sum(F.when(F.col("n") < min_rows, F.col("n")).otherwise(0)).alias("pool"))
    pooled, language, corpus = F.concat(F.lit("\x02"), "tongue"), F.concat(F.lit("\x03"), "tongue"), F.lit("\x04")
    judged_by = F.when(F.col("n") >= min_rows, F.col("own")).when(F.col("pool") >= min_rows, pooled).when(F.col("whole") >= min_rows, language).otherwise(corpus)
    places = stored(sizes.join(tongues, "tongue").select("own", "tongue", judged_by.alias("g")), "places")
    wide = places.where(F.col("g") == language).select("tongue", F.col("g").alias("wide")).distinct()
    everything = places.where(F.col("g") == corpus).limit(1).count() > 0
    grouped = passed.join(places.select("own", "g"), "own")
    # a language or the corpus is estimated from all its rows, for the groups that are judged by it
    lent = F.array_compact(F.array(F.when(~F.col("g").startswith("\x03") & (F.col("g") != corpus), F.col("g")), F.col("wide"), corpus if everything else F.lit(None).cast("string")))
    rows = stored(grouped.where(~F.col("base_failed")).join(wide, "tongue", "left").select(F.explode(lent).alias("g"), *[f"x{i}" for i in range(P)]), "rows")
    enough = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows).select("g")
    params = estimates(rows, share, tries).join(enough, "g", "left_semi").drop("start", "det")
    out = grouped.join(params, "g", "left").withColumn("distance", _distance())
    near = F.coalesce(F.col("distance") <= cut_of(tail), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "distance")
