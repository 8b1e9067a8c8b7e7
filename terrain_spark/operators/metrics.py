"""Losses and histograms of predicted classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classes
from ..functions.taxonomy import LAND_COVER, TOPOGRAPHY, TOPOGRAPHY_WEIGHT

N_LC, N_TOPO = len(LAND_COVER), len(TOPOGRAPHY)


def valid() -> Column:
    return F.col("lc").between(0, N_LC - 1) & F.col("topo").between(0, N_TOPO - 1)


def with_nll(pixels: DataFrame) -> DataFrame:
    """Adds lc_nll and topo_nll from logits (9 and 3 of them) and labels lc, topo."""
    lc = classes.nll_of(F.slice("logits", 1, N_LC), F.col("lc"), N_LC)
    topo = classes.nll_of(F.slice("logits", N_LC + 1, N_TOPO), F.col("topo"), N_TOPO)
    return pixels.withColumns({"lc_nll": lc, "topo_nll": topo})


def joint_nll(pixels: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean joint loss over pixels whose two labels are valid; NaN without any."""
    n = F.count_if(valid())
    mean = lambda c: F.when(n == 0, float("nan")).otherwise(F.sum(F.when(valid(), c)) / n)
    rows = with_nll(pixels).groupBy(*by) if by else with_nll(pixels).groupBy()
    return rows.agg(n.alias("n_valid"), mean(F.col("lc_nll")).alias("lc_nll"), mean(F.col("topo_nll")).alias("topo_nll"), mean(F.col("lc_nll") + F.col("topo_nll")).alias("joint_nll"))


def weighted_ce(pixels: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """Per group the weighted mean of the land-cover loss and the plain one of topography, and their sum.

    A head without a valid label gives null, and the sum takes the other alone; without any, the loss is null too.
    """
    rows = with_nll(pixels).join(weights.select(F.col("source").alias("_s"), F.col("lc").alias("_lc"), "weight"), (F.col("source") == F.col("_s")) & (F.col("lc") == F.col("_lc")), "left")
    lc_ok, topo_ok = F.col("lc").between(0, N_LC - 1), F.col("topo").between(0, N_TOPO - 1)
    lc = F.try_divide(F.sum(F.when(lc_ok, F.col("weight") * F.col("lc_nll"))), F.sum(F.when(lc_ok, F.col("weight"))))
    topo = F.avg(F.when(topo_ok, F.col("topo_nll")))
    return rows.groupBy(*by).agg(lc.alias("lc_loss"), topo.alias("topo_loss")).withColumn("loss", F.when(F.coalesce("lc_loss", "topo_loss").isNotNull(), F.coalesce("lc_loss", F.lit(0.0)) + TOPOGRAPHY_WEIGHT * F.coalesce("topo_loss", F.lit(0.0))))


def batch_ce(pixels: DataFrame, weights: DataFrame, sample: list[str], batch: list[str]) -> DataFrame:
    """Per batch the mean of its samples' losses, each sample weighted by its own source; samples without a valid label don't count."""
    return weighted_ce(pixels, weights, [*batch, *sample]).groupBy(*batch).agg(F.count("loss").alias("n_samples"), F.avg("loss").alias("loss"))


def tile_histogram(pixels: DataFrame, label: str, n: int = N_LC) -> DataFrame:
    """Class counts over the pixels of overlapping tiles (map_id, x, y): ``raw`` counts a pixel in each tile, ``fair`` once for its map."""
    places = pixels.where(F.col(label).between(0, n - 1)).groupBy("map_id", "x", "y", F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return places.groupBy("class").agg(F.sum("n").alias("raw"), F.count(F.lit(1)).alias("fair"))


def histogram(rows: DataFrame, label: str, n: int = N_LC) -> DataFrame:
    """Counts of classes 0 to n-1 and of an overflow class n, zero where there is none."""
    counts = rows.groupBy(F.when(F.col(label).between(0, n - 1), F.col(label)).otherwise(n).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return rows.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("class")).join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


def nodata_pct(rows: DataFrame, label: str, by: list[str], nodata: int = 255) -> DataFrame:
    return rows.groupBy(*by).agg((F.avg((F.col(label) == nodata).cast("double")) * 100).alias("nodata_pct"))


def epoch_mean(total: Column, n: Column) -> Column:
    return total / F.greatest(n, F.lit(1))


def missing_weights(weights: Column) -> Column:
    """Class names that a weight map lacks."""
    return F.array_except(F.array(*[F.lit(c) for c in LAND_COVER]), F.map_keys(weights))


def extra_weights(weights: Column) -> Column:
    """Names in a weight map that are no class."""
    return F.array_sort(F.array_except(F.map_keys(weights), F.array(*[F.lit(c) for c in LAND_COVER])))


def probe_projection(hours: Column, epochs: Column, configs: int = 6) -> Column:
    """Hours that all configurations take, from those of one epoch."""
    return hours * epochs * configs


def weight_vector(weights: Column) -> Column:
    """Weights in the order of the classes."""
    return F.transform(F.array(*[F.lit(c) for c in LAND_COVER]), lambda c: F.try_element_at(weights, c))
