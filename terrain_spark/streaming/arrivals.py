"""Maps that arrive over time. The reference has no streams; this is an extension over the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pyramid


def arriving_maps(spark: SparkSession, path: str, schema: str = "map_id string, width int, height int, arrived timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def arriving_tiles(maps: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tiles of each map that arrives, once for each map while the watermark holds."""
    first = maps.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["map_id"])
    return pyramid.tiles(pyramid.origins(first))


def arrivals_by_hour(maps: DataFrame, late: str = "1 hour") -> DataFrame:
    return maps.withWatermark("arrived", late).groupBy(F.window("arrived", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
