"""Manifests, splits, completeness and incremental builds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import idents
from ..functions.taxonomy import REQUIRED_FILES


def reconcile(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Files (``filename``) against manifest entries (``filename``, ``template``): a row per filename and error.

    bad_name, unlisted, phantom, template_mismatch; a file may have several.
    """
    f, e = files.select("filename", F.lit(True).alias("there")), entries.select("filename", "template", F.lit(True).alias("listed"))
    both = f.join(e, "filename", "full_outer")
    there, listed = F.coalesce("there", F.lit(False)), F.coalesce("listed", F.lit(False))
    errors = F.array(
        F.when(there & ~idents.is_map_filename(F.col("filename")), "bad_name"),
        F.when(there & ~listed, "unlisted"),
        F.when(listed & ~there, "phantom"),
        F.when(there & listed & (F.col("template") != idents.expected_template(F.col("filename"))), "template_mismatch"),
    )
    return both.select("filename", F.explode(F.filter(errors, lambda x: x.isNotNull())).alias("error"))


def with_template(sources: DataFrame, templates: DataFrame | None) -> DataFrame:
    """``template`` of each ``src_id``: that given, else its key."""
    key = idents.template_key(F.col("src_id"))
    if templates is None:
        return sources.withColumn("template", key)
    return sources.join(templates.select("src_id", F.col("template").alias("_given")), "src_id", "left").withColumn("template", F.coalesce("_given", key)).drop("_given")


def quota(n: Column, fraction: float) -> Column:
    """At least one, half-even rounding as in bround."""
    return F.least(n, F.greatest(F.lit(1), F.bround(n * F.lit(fraction), 0).cast("bigint")))


def stratified_split(sources: DataFrame, seed: int = 42, fraction: float = 0.15) -> DataFrame:
    """``src_id``, ``template`` and ``subset``: in each template the quota with the lowest seeded digests is test."""
    marked = lowest_digests(sources.select("src_id", "template"), "src_id", seed, lambda n: quota(n, fraction), "_test", ["template"])
    return marked.select("src_id", "template", F.when(F.col("_test"), "test").otherwise("train").alias("subset"))


def lowest_digests(rows: DataFrame, key: str, seed: int, wanted: Callable[[Column], Column], name: str, by: list[str] = ()) -> DataFrame:
    """Adds ``name``: whether a row is among the ``wanted(n)`` of all n rows (of its group ``by``) with the lowest seeded digests of ``key``.

    Digests are counted in classes, their first four hex digits, which gives the class that holds the cut; the rows of that class alone are
    ranked, which gives the last digest that is in. Then each row is compared with its group's last digest, so rows are neither sorted nor
    shuffled: the counts and the cuts, a row for each group, are what moves.
    """
    digest = rows.withColumn("_d", F.md5(F.concat_ws(":", F.lit(str(seed)), *by, F.col(key)).cast("binary"))).withColumn("_c", F.substring("_d", 1, 4))
    group = [f"_by{i}" for i in range(len(by))]
    counts = digest.groupBy(*[F.col(c).alias(g) for c, g in zip(by, group, strict=True)], F.col("_c").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))  # 65,536 rows a group at most
    whole = Window.partitionBy(*group)
    run = counts.select(*group, "_k", "_n", F.sum("_n").over(whole.orderBy("_k")).alias("_upto"), F.sum("_n").over(whole).alias("_all")).withColumn("_want", wanted(F.col("_all")))
    cut = run.where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want"))).withColumn("_left", F.col("_want") - F.col("_upto") + F.col("_n"))
    same = F.lit(True)
    for c, g in zip(by, group, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(g))
    inside = digest.join(cut.select(*group, "_k", "_left"), same & (F.col("_c") == F.col("_k"))).select(*group, "_k", "_left", "_d", F.col(key).alias("_key"))
    rank = F.row_number().over(Window.partitionBy(*group, "_k").orderBy("_d", "_key"))
    last = inside.withColumn("_rank", rank).where("_rank = _left").select(*group, F.struct("_d", "_key").alias("_last"))
    placed = digest.join(last if by else F.broadcast(last), same, "left")
    return placed.withColumn(name, F.coalesce(F.struct(F.col("_d"), F.col(key).alias("_key")) <= F.col("_last"), F.lit(False))).drop("_d", "_c", "_last", *group)


def row_split(rows: DataFrame, key: str, seed: int = 42, fraction: float = 0.2) -> DataFrame:
    """Exact ``int(fraction * n)`` rows to val, those with the lowest digests."""
    marked = lowest_digests(rows, key, seed, lambda n: F.floor(n * fraction), "_val")
    return marked.withColumn("part", F.when(F.col("_val"), "val").otherwise("train")).drop("_val")


def group_split(rows: DataFrame, by: list[str], seed: int = 42, fraction: float = 0.2) -> DataFrame:
    """Splits whole groups (pyramids, or maps), so that none has rows on both sides: ``by`` and ``part`` of each group."""
    groups = rows.select(*by).distinct().withColumn("_g", F.concat_ws("/", *by))
    return row_split(groups, "_g", seed, fraction).drop("_g")


def routed(rows: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """``subset`` of each row by whether its key is in the frozen test set."""
    marks = test.select(F.col(key).alias("_k")).distinct().withColumn("_t", F.lit(True))
    return rows.join(marks, F.col(key) == F.col("_k"), "left").withColumn("subset", F.when(F.col("_t"), "test").otherwise("train")).drop("_k", "_t")


def collisions(names: DataFrame) -> DataFrame:
    """Ids that several originals sanitise to."""
    return names.select(F.col("name"), idents.sanitised(F.col("name")).alias("sid")).distinct().groupBy("sid").agg(F.sort_array(F.collect_list("name")).alias("names"), F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_files(present: DataFrame) -> DataFrame:
    """Per map_id the required artifacts that are not there; ``present``: map_id, name."""
    need = F.array(*[F.lit(x) for x in REQUIRED_FILES])
    found = present.where(F.col("name").isin(REQUIRED_FILES)).select("map_id", "name").distinct()
    every = present.select("map_id").distinct()
    have = found.groupBy("map_id").agg(F.collect_list("name").alias("have"))
    return every.join(have, "map_id", "left").select("map_id", F.sort_array(F.array_except(need, F.coalesce("have", F.array().cast("array<string>")))).alias("missing")).where(F.size("missing") > 0)


def incomplete_pyramids(objects: DataFrame, least: int = 60, within: tuple[str, ...] = ()) -> DataFrame:
    """Pyramids with fewer images than they need; ``within``: columns that ids are unique in, so that rows spread by them are not shuffled again."""
    return objects.groupBy(*within, "pyramid_id").agg(F.count_if(F.col("name").endswith(".png")).alias("n_png")).where(F.col("n_png") < least)


def unfinished(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What still has to be built: completed maps go before anything expensive starts."""
    return expected.join(done.select(key).distinct(), key, "left_anti")


def require_empty(found: DataFrame, what: str, shown: int = 5) -> None:
    """Raises with some of the rows if there are any."""
    rows = found.limit(shown).collect()
    if rows:
        raise ValueError(f"{what}: {[tuple(r) for r in rows]}")


def guarded(paths: DataFrame) -> DataFrame:
    """Paths with what is wrong with them: ``traversal``, ``leak`` or null."""
    p = F.col("path")
    return paths.withColumn("problem", F.when(idents.is_traversal(p), "traversal").when(idents.under_test(p), "leak"))
