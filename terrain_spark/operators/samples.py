"""Labels of tiles, and samples of image, prompt and answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import idents
from ..functions.taxonomy import LAND_COVER, TOPOGRAPHY, descriptions, prompts
from .ordinals import numbered


def longest_prefix(names: DataFrame, rules: DataFrame, name: str = "name", lengths: list[int] | None = None) -> DataFrame:
    """Each name with the values of the longest rule (``prefix``) it starts with; others go.

    The match is an equi-join on the beginnings of the rules' ``lengths``, whatever the number of rules; where the lengths
    aren't given, a job finds them. Whether rules are broadcast is left to their size.
    """
    if lengths is None:
        lengths = [r.n for r in rules.select(F.length("prefix").alias("n")).distinct().collect()]
    if not lengths:
        return names.join(rules, F.lit(False))
    heads = F.array(*[F.when(F.length(name) >= n, F.substring(name, 1, n)) for n in sorted(set(lengths))])
    probe = names.select("*", F.explode(F.filter(heads, lambda h: h.isNotNull())).alias("prefix"))
    joined = probe.join(rules, "prefix")
    value = [c for c in joined.columns if c not in names.columns]
    return joined.groupBy(*names.columns).agg(F.max_by(F.struct(*value), F.length("prefix")).alias("_b")).select(*names.columns, "_b.*")


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in the order of seeded digests, with their ``place``: a sort by ranges, the same in any partitioning."""
    return rows.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key)).cast("binary"))).orderBy("place", key)


def styled(sources: DataFrame, styles: DataFrame) -> DataFrame:
    """Every source in every style; styles are a handful."""
    return sources.select("*", F.explode(F.array(*[F.lit(r.style) for r in styles.select("style").distinct().orderBy("style").collect()])).alias("style")).withColumn("map_id", idents.styled_id(F.col("src_id"), F.col("style")))


def peers(tiles: DataFrame, key: str, most: int = 4, seed: int = 42) -> DataFrame:
    """For each tile up to ``most`` others of its class (lc, topo), null counting as a class.

    Tiles of a class lie on a ring in the order of their digests, and each takes those that follow: no pairs are made
    that are not kept. Places on the ring come from ranges, so a class of all tiles is spread over all tasks.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key)).cast("binary"))
    sizes = tiles.groupBy("lc", "topo").agg(F.count(F.lit(1)).alias("n")).select(F.col("lc").alias("_lc"), F.col("topo").alias("_topo"), "n")
    same = F.col("lc").eqNullSafe(F.col("_lc")) & F.col("topo").eqNullSafe(F.col("_topo"))
    ring = numbered(tiles.select(key, "lc", "topo", digest.alias("_digest")), [F.col("_digest"), F.col(key)], ["lc", "topo"], "at")
    wanted = ring.join(sizes, same).select(F.col(key).alias("tile"), "lc", "topo", "n", F.explode(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda k: k < F.col("n"))).alias("k"), "at").withColumn("at", F.pmod(F.col("at") - 1 + F.col("k"), F.col("n")) + 1)
    other = ring.select(F.col(key).alias("peer"), F.col("lc").alias("_lc"), F.col("topo").alias("_topo"), F.col("at").alias("_at"))
    return wanted.join(other, same & (F.col("at") == F.col("_at"))).select("tile", "peer", "k")


def answer(texts: Column, lc: Column, topo: Column, ordinal: Column) -> Column:
    """The description whose turn it is, or the class's name where there is none, with the topography in brackets where there is one."""
    texts = F.coalesce(texts, F.array(F.get(F.array(*[F.lit(c) for c in LAND_COVER]), lc.cast("int"))))
    text = F.get(texts, F.pmod(ordinal, F.size(texts)).cast("int"))
    names = F.array(*[F.lit(t) for t in TOPOGRAPHY])
    return F.when(topo.isNull(), text).otherwise(F.concat(text, F.lit(" ("), F.get(names, topo.cast("int")), F.lit(")")))


def tuning_samples(tiles: DataFrame, augmentations: list[str], grids: bool = True) -> DataFrame:
    """tile × augmentation × layout × prompt with its answer; grids only for classes of two tiles at least."""
    spark = tiles.sparkSession
    n = tiles.groupBy("lc", "topo").agg(F.count(F.lit(1)).alias("_n")).select(F.col("lc").alias("_lc"), F.col("topo").alias("_topo"), "_n")
    same = F.col("lc").eqNullSafe(F.col("_lc")) & F.col("topo").eqNullSafe(F.col("_topo"))
    rows = tiles.join(n, same).drop("_lc", "_topo")
    layouts = F.when((F.col("_n") >= 2) & F.lit(grids), F.array(F.lit("single"), F.lit("grid"))).otherwise(F.array(F.lit("single")))
    rows = rows.select("*", F.explode(F.array(*[F.lit(a) for a in augmentations])).alias("augmentation")).select("*", F.explode(layouts).alias("layout")).drop("_n")
    asked = rows.join(F.broadcast(prompts(spark)))
    texts = descriptions(spark).select(F.col("lc").alias("_lc"), F.col("topo").alias("_topo"), "texts")
    joined = asked.join(F.broadcast(texts), same, "left").drop("_lc", "_topo")
    return joined.withColumn("answer", answer(F.col("texts"), F.col("lc"), F.col("topo"), F.col("prompt_idx"))).drop("texts")
