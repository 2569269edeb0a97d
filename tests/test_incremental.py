"""Loading batch by batch ends in the same tables as loading everything at once."""

import os

import pytest
from pyspark.sql import functions as F

from revcurve.functions import domain as D
from revcurve.operators import staging as T
from revcurve.operators import subscription as M
from revcurve.operators import transitions as J
from revcurve.plans import incremental as I
from revcurve.sources.files import read_model, write_model

from hand_rows import crafted, frame, random_rows
from test_hand_rows import _spark_sales


def _same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def sales(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sales") / "rows")
    write_model(_spark_sales(spark, frame(crafted() + random_rows(11, 120))), path)
    return read_model(spark, path)


def _check(spark, root, sales):
    stg = T.staging_model(sales)
    assert _same(I.staging(spark, root), stg)
    assert _same(I.transactional_mart(spark, root), J.transactional_mart(stg))
    assert _same(I.subscription_mart(spark, root), M.subscription_mart(stg))


def test_days_in_any_order_equal_one_load(spark, sales, tmp_path):
    """A single late day first, then the rest out of order, overlapping, and one batch twice."""
    root = str(tmp_path)
    days = [r[0] for r in sales.select("processed_date").distinct().orderBy(F.col("processed_date").desc_nulls_last()).collect()]
    batches = {f"day{i}": sales.filter(F.col("processed_date").eqNullSafe(F.lit(d).cast("date"))) for i, d in enumerate(days[:1])}
    rest = sales.filter(F.col("processed_date").isNull() | ~F.col("processed_date").isin(days[:1]))
    batches |= {"late": rest.filter("customer % 2 = 0 OR customer IS NULL"), "last": rest}
    for name, rows in batches.items():
        I.add_batch(spark, root, rows, name, parts=4)
    I.add_batch(spark, root, batches["late"], "late", parts=4)
    _check(spark, root, sales)


def test_only_the_parts_of_a_batch_are_written(spark, sales, tmp_path):
    root = str(tmp_path)
    I.add_batch(spark, root, sales, "all", parts=8)
    tables = [os.path.join(root, t) for t in (I.STAGING, I.TRANSACTIONAL, I.EVENTS, I.MONTHS)]
    files = lambda: {os.path.join(d, f) for t in tables for d, _, fs in os.walk(t) for f in fs if f.endswith(".parquet")}
    before = files()
    one = sales.filter("customer = 11").limit(1).withColumn("processed_date", F.lit("2020-12-30").cast("date"))
    hit = I.add_batch(spark, root, one, "one", parts=8)
    assert len(hit) == 1
    replaced = {f for f in before - files()}
    assert replaced and all(f"/part={hit[0]}/" in f for f in replaced)
    assert I.add_batch(spark, root, one.limit(0), "none", parts=8) == []
    _check(spark, root, sales.unionByName(one))


def test_parts_can_become_empty(spark, tmp_path):
    """A customer whose only rows are removed by the next batch leaves no stale rows."""
    root, schema = str(tmp_path), D.SALES_DDL
    first = spark.createDataFrame([(1, D.RENEWAL, "P", "Upgrade", None, 7, 1, 5.0, 0.0)], schema.replace("DATE", "STRING"))
    first = first.withColumn("processed_date", F.lit("2019-01-01").cast("date"))
    second = first.withColumn("customer_status", F.lit(D.NEW_CUSTOMER)).withColumn("license_type", F.lit("New"))
    I.add_batch(spark, root, first, "1", parts=2)
    assert I.staging(spark, root).count() == 1
    I.add_batch(spark, root, second, "2", parts=2)
    _check(spark, root, first.unionByName(second))
    free = first.withColumn("license_type", F.lit("Renew")).withColumn("amount_in_usd", F.lit(0.0)).withColumn("discount_in_usd", F.lit(3.0))
    free = free.withColumn("discount_id", F.lit(None).cast("bigint"))
    I.add_batch(spark, str(tmp_path / "free"), free, "1", parts=2)
    assert I.staging(spark, str(tmp_path / "free")).count() == 0 and I.subscription_mart(spark, str(tmp_path / "free")).count() == 0


def test_large_customers_give_the_same_tables(spark, sales, tmp_path):
    """Customers over ``whole_rows`` go through the operators that spread them; results are those of one load."""
    late = F.coalesce(F.col("processed_date") >= "2019-06-01", F.lit(False))
    assert sales.groupBy("customer").count().where("count > 10").count() > 0
    for name, rows in (("late", sales.filter(late)), ("others", sales.filter(~late))):
        I.add_batch(spark, str(tmp_path), rows, name, parts=4, whole_rows=10)
    _check(spark, str(tmp_path), sales)


def test_rows_of_a_batch_move_once(spark, sales, monkeypatch):
    """Staging has one exchange, by customer; the transitions and intervals have none."""
    plans, plan = [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    staging, mart, classified = T.staging_model, J.transactional_mart, M.classified
    for module, name, fn in ((T, "staging_model", staging), (J, "transactional_mart", mart), (M, "classified", classified)):
        monkeypatch.setattr(module, name, lambda *a, fn=fn, **k: plans.append(plan(fn(*a, **k))) or fn(*a, **k))
    I.add_batch(spark, f"{I.ensure_checkpoint_dir(spark)}/moves-once", sales, "all", parts=4)
    # a plan names each exchange once; that of the rows is by customer alone
    assert len(plans) == 3 and [p.count("Exchange hashpartitioning") for p in plans] == [1, 0, 0], plans
    assert not any("Join" in p for p in plans)
