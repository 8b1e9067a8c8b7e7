"""Rows of small tables dealt out before much is made of each."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """Rows by key in as many partitions as the session's shuffles have.

    A table of some MB is one task to its reader, whatever is made of each row later. The number is given, as partitions that are small by their bytes
    would be merged again otherwise.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
