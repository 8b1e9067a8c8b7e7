"""Places in an order by ranges against a plain sort."""

import collections

from pyspark.sql import functions as F

from terrain_spark.operators import ordinals


def test_places_in_an_order(spark):
    rows = [(i, (i * 7919) % 101) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, v int").repartition(5)
    got = {r.i: r.place for r in ordinals.numbered(df, [F.desc("v"), F.asc("i")], parts=7).collect()}
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want


def test_places_within_classes_of_which_one_has_nearly_all_rows(spark):
    rows = [(i, None if i % 50 == 7 else "hot" if i % 50 else f"c{i % 7}") for i in range(4000)]
    df = spark.createDataFrame(rows, "i int, c string").repartition(3)
    out = ordinals.numbered(df, [F.desc("i")], ["c"], parts=16)
    assert out.columns == ["i", "c", "place"]
    got = out.collect()
    held = collections.defaultdict(list)
    for i, c in rows:
        held[c].append(i)
    want = {i: k + 1 for own in held.values() for k, i in enumerate(sorted(own, reverse=True))}
    assert {r.i: r.place for r in got} == want


def test_a_large_class_is_spread_over_tasks(spark):
    df = spark.range(20_000).withColumn("c", F.lit("one"))
    ranges = df.repartitionByRange(16, "c", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranges) == 16 and max(r["count"] for r in ranges) < 4000
    assert ordinals.numbered(df, [F.col("id")], ["c"], parts=16).where("place <> id + 1").count() == 0


def test_no_rows(spark):
    assert ordinals.numbered(spark.range(0), [F.col("id")]).collect() == []
