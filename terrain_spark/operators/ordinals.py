"""Places of rows in an order, by ranges: no class is sorted in one task, however many rows it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

_LOCAL = (1 << 33) - 1  # what monotonically_increasing_id counts with in a partition


def numbered(rows: DataFrame, order: list[Column], by: list[str] = (), name: str = "place", parts: int | None = None) -> DataFrame:
    """Adds ``name``: the place of each row, from 1, in the given order; within its class ``by`` if there is one.

    Rows are dealt by ranges of (class, order), so a large class is spread over as many tasks as its rows fill, and sorted
    within each range. What a range holds of a class is counted; prefix sums of these counts, a row for each range and class, are
    the places at which the range begins. The ranges are written once, as their bounds come from a sample. Rows that
    are equal in the whole order stay in one range, so give an order that tells them apart.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(c) for c in by], *order]
    ranges = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    laid = stored(ranges.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(_LOCAL).alias("_at")), "ranges")
    held = [f"_by{i}" for i in range(len(by))]
    counts = laid.groupBy(*[F.col(c).alias(h) for c, h in zip(by, held, strict=True)], F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*held).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(*held, "_r", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = F.col("_range") == F.col("_r")
    for c, h in zip(by, held, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(h))
    return laid.join(begins, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))
