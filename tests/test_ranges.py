"""explode_range: same rows as explode(sequence), long ranges spread over tasks."""

from pyspark.sql import functions as F

from revcurve.operators.ranges import explode_range


def test_same_rows_as_sequence(spark):
    df = spark.createDataFrame(
        [("a", 1, 5), ("b", 3, 3), ("c", 4, 2), ("d", -2, 1), ("a", 1, 5)], "k string, lo int, hi int")
    got = explode_range(df, F.col("lo"), F.col("hi"), "v", chunk=2, partitions=3)
    exp = df.filter(F.col("hi") >= F.col("lo")).select(
        "*", F.explode(F.sequence(F.col("lo").cast("bigint"), F.col("hi").cast("bigint"))).alias("v"))
    assert got.columns == exp.columns
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_long_range_is_spread(spark):
    df = spark.createDataFrame([("hot", 1, 200_000), ("cold", 1, 3)], "k string, lo int, hi int")
    got = explode_range(df, F.col("lo"), F.col("hi"), "v", chunk=1000, partitions=16)
    per_task = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in per_task) == 200_003
    assert len(per_task) == 16 and max(r["count"] for r in per_task) < 200_000 / 4
