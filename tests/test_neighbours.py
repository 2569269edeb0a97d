"""The skew-safe neighbour operator equals plain windows, also when groups span slices."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from revcurve.operators.neighbours import ordered_neighbours

SCHEMA = "g int, h string, d int, s string, o int, v int, m int"


def _rows(seed, n=3000):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # one hot group holding about a third of the rows, some NULL groups and order values
        g = 0 if rnd.random() < 0.35 else rnd.choice([1, 2, 3, None, 5, 6, 7, 8, 9])
        h = rnd.choice(["a", "b", None]) if g != 0 else "a"
        rows.append((g, h, rnd.choice([None, 1, 2, 3, 4, 5]), rnd.choice(["x", "y", None]), i,
                     rnd.choice([None, rnd.randint(0, 50)]), rnd.randint(1, 3)))
    return rows


def _same(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0
    assert b.exceptAll(a).count() == 0


def _ordered(*cols):
    return [F.col(c).asc_nulls_first() for c in cols]


def test_matches_window(spark):
    order = ["d", "s", "o"]
    for seed, slices in [(1, None), (2, 3), (3, 40)]:
        df = spark.createDataFrame(_rows(seed), SCHEMA).withColumn("r", F.xxhash64("o") % 1000)
        got = ordered_neighbours(
            df, ["g", "h"], order, lag={"pv": "v", "pd": "d"}, lead={"nv": "v", "ns": "s"},
            count_before="before", weight="m", running={"x": ("xor", "r"), "t": ("sum", "r")}, slices=slices,
        )
        w = Window.partitionBy("g", "h").orderBy(*_ordered(*order))
        _same(got, df.select(
            "*",
            F.lag("v").over(w).alias("pv"),
            F.lag("d").over(w).alias("pd"),
            F.lead("v").over(w).alias("nv"),
            F.lead("s").over(w).alias("ns"),
            F.bit_xor("r").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("x"),
            F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("t"),
            F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(0).cast("bigint")).alias("before"),
        ))


def test_row_count_without_weight(spark):
    df = spark.createDataFrame(_rows(9, 500), SCHEMA)
    got = ordered_neighbours(df, ["g"], ["d", "o"], count_before="rn")
    w = Window.partitionBy("g").orderBy(*_ordered("d", "o"))
    _same(got, df.select("*", (F.row_number().over(w) - 1).cast("bigint").alias("rn")))


def test_empty_input(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ordered_neighbours(df, ["g"], ["d", "o"], lag={"pv": "v"}).count() == 0


def test_hot_group_is_spread_over_tasks(spark):
    """One customer with a third of all rows, highly compressible: no task holds more than its slice."""
    n_rows, days = 300_000, 1000
    df = spark.range(0, n_rows, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000).alias("g"),
        (F.col("id") % days).alias("d"), F.lit("x").alias("s"), F.lit("y").alias("p"), F.col("id").alias("o"),
    )
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = ordered_neighbours(df, ["g"], ["d", "s", "p", "o"], lag={"po": "o"}).withColumn("task", F.spark_partition_id())
        per_task = got.groupBy("task").agg(
            F.count("*").alias("n"), F.count_if(F.col("g") == -1).alias("hot"), F.sum("po").alias("used")
        ).collect()
        sizes, hot = [r["n"] for r in per_task], sum(r["hot"] > 0 for r in per_task)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == n_rows and hot >= 5  # a third of the rows: about a third of the 16 slices
    assert max(sizes) <= 2 * n_rows / 16


def test_one_exchange_of_rows(spark):
    """The stored order is read without an exchange; only edge rows (one per slice) are shuffled or broadcast."""
    df = spark.createDataFrame(_rows(4, 4000), SCHEMA)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in ("-1", "10m"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            got = ordered_neighbours(df, ["g"], ["d", "o"], lag={"pv": "v"}, lead={"nv": "v"})
            plan = got._jdf.queryExecution().executedPlan().toString()
            back = 1 if "SortMergeJoin" in plan or "BroadcastHashJoin" in plan else 0
            # the edges go to one window and back to the slices; the rows stay where they are stored
            assert back and plan.count("Exchange") == 2 and plan.count("Exchange SinglePartition") == 1, plan
            assert "rangepartitioning" not in plan  # done when the table was stored
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hot_block_is_spread_over_tasks(spark):
    """All rows of one customer share a day, a status and a product: no task holds over twice the mean."""
    n_rows = 160_000
    df = spark.range(0, n_rows, numPartitions=8).select(
        F.lit(7).alias("g"), F.lit(1).alias("d"), F.lit("x").alias("s"), F.lit("y").alias("p"), F.col("id").alias("o")
    )
    got = ordered_neighbours(df, ["g"], ["d", "s", "p", "o"], lag={"po": "o"}, count_before="n", slices=16)
    rows = got.withColumn("task", F.spark_partition_id()).groupBy("task").agg(
        F.count("*").alias("n"), F.sum((F.col("o") != F.col("n")).cast("int")).alias("wrong"),
        F.sum((F.coalesce("po", F.lit(-1)) + 1 != F.col("o")).cast("int")).alias("wrong_lag"),
    ).collect()
    assert sum(r["n"] for r in rows) == n_rows and max(r["n"] for r in rows) <= 2 * n_rows / 16
    assert all(r["wrong"] == 0 and r["wrong_lag"] == 0 for r in rows)


def test_edges_are_found_slice_by_slice(spark, monkeypatch):
    """No task reads or sorts all stored rows for the edges: one task gets the edge rows only."""
    from revcurve.operators import neighbours as N

    plans, stored_table = [], N.stored_table

    def spied(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored_table(df, label)

    monkeypatch.setattr(N, "stored_table", spied)
    df = spark.createDataFrame(_rows(5, 2000), SCHEMA)
    assert ordered_neighbours(df, ["g"], ["d", "o"], lag={"pv": "v"}, count_before="n").count() == 2000
    assert len(plans) == 2  # the ends, the totals
    for plan in plans:
        assert "Coalesce 1" not in plan and "SinglePartition" in plan, plan
        assert "SortMergeJoin" not in plan, plan


def test_slices_grow_with_the_input(spark, monkeypatch):
    """Above the session's shuffle partitions, a slice stands for 16 MB of files."""
    from revcurve.operators import neighbours as N

    monkeypatch.setattr(N, "scanned_bytes", lambda df: 40 * N.ORDERED_BYTES)
    df = spark.createDataFrame(_rows(6, 500), SCHEMA)
    stored = N.store_in_order(df, ["g", "d", "o"])
    assert stored.select(N.SLICE).distinct().count() > 20
    assert N.slice_count(df) == int(spark.conf.get("spark.sql.shuffle.partitions"))
