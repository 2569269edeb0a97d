"""Physical-plan shape: pushdown, pruning, no anti joins, bounded broadcasts."""

import os
import tempfile

from revcurve.operators import profile as P
from revcurve.operators import staging as T
from revcurve.sources.files import read_sales, write_model

from hand_rows import crafted, frame, random_rows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _sales_file(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="revcurve-test-"), "sales")
    pdf = frame(crafted() + random_rows(3, 300))
    from pyspark.sql import functions as F  # noqa: F401
    from test_hand_rows import _spark_sales

    write_model(_spark_sales(spark, pdf), path)
    return read_sales(spark, path)


def test_filters_and_columns_reach_the_scan(spark):
    sales = _sales_file(spark)
    plan = _plan(P.discount_at_least_amount(sales))
    assert "PushedFilters: [IsNotNull(discount_in_usd), IsNotNull(amount_in_usd), IsNotNull(discount_id)" in plan
    plan = _plan(P.totals(sales))
    assert "ReadSchema: struct<customer:bigint>" in plan


def test_staging_uses_no_anti_join_and_no_row_window_by_customer(spark):
    sales = _sales_file(spark)
    plan = _plan(T.staging_model(sales))
    assert "LeftAnti" not in plan
    # no window at all: every per-customer fact is an aggregate joined back
    assert "Window" not in plan


def test_staging_scans_sales_twice(spark):
    """Once for the block table, which is stored, and once for the rows."""
    sales = _sales_file(spark)
    plan = _plan(T.staging_model(sales))
    assert plan.count("FileScan") == 2 and plan.count("/sales]") == 1  # the rows and the few flagged blocks


def test_csv_source_reads_with_fixed_schema(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="revcurve-test-"), "sales.csv")
    pdf = frame(crafted())
    pdf.to_csv(path, index=False)
    df = read_sales(spark, path, fmt="csv")
    assert df.count() == len(pdf)
    assert [f.dataType.simpleString() for f in df.schema.fields] == [
        "bigint", "string", "string", "string", "date", "bigint", "int", "double", "double"]


def _hot_block_sales(spark, n=200_000):
    from pyspark.sql import functions as F

    from revcurve.functions import domain as D

    hot = F.col("id") % 3 == 0  # one (customer, day, product) block holds a third of all rows
    return spark.range(n).select(
        F.when(hot, F.lit(1)).otherwise(F.col("id") % 997 + 2).cast("bigint").alias("customer"),
        F.when(hot, F.lit(D.NEW_PRODUCT_USE)).otherwise(F.lit(D.RENEWAL)).alias("customer_status"),
        F.when(hot, F.lit("P00")).otherwise(
            F.concat(F.lit("P"), (F.col("id") % 13).cast("string"))).alias("product_code"),
        F.lit("New").alias("license_type"),
        F.when(hot, F.lit("2019-01-01")).otherwise(
            F.date_add(F.lit("2018-01-01"), (F.col("id") % 700).cast("int"))).cast("date")
        .alias("processed_date"),
        F.lit(None).cast("bigint").alias("discount_id"),
        F.lit(1).cast("int").alias("quantity"),
        (F.col("id") / 100.0).alias("amount_in_usd"),
        F.lit(0.0).alias("discount_in_usd"),
    )


def test_free_renewals_alone_need_no_flags(spark):
    assert "Join" not in _plan(T.clean_rows(_sales_file(spark), ("t07",)))


def test_hot_block_join_is_split_by_aqe(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    }
    old = {k: spark.conf.get(k, None) for k in [*conf, "spark.sql.adaptive.skewJoin.enabled"]}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sales = _hot_block_sales(spark)
        df = T.staging_model(sales)
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "SortMergeJoin(skew=true)" in plan
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
        plain = T.staging_model(sales).collect()
        assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, plain), key=repr)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_months_are_summed_from_change_events(spark):
    """At most two rows of a (customer, start month, interval) enter the month totals, and none per running month."""
    from pyspark.sql import functions as F

    from revcurve.operators import subscription as M

    cls = M.classified(T.staging_model(_sales_file(spark)))
    pre = cls.select("customer", F.trunc("processed_date", "month").alias("m"), "final_billing_interval").distinct().count()
    events = M.change_events(cls)
    assert 0 < events.count() <= 2 * pre
    plan = _plan(M.month_changes(events))
    assert "sequence(" not in plan


def test_command_line_runs_a_query_on_csv(spark, tmp_path, capsys):
    from revcurve.__main__ import main

    path = str(tmp_path / "sales.csv")
    frame(crafted()).to_csv(path, index=False)
    assert main(["run", "s02_totals", "--sales", path, "--format", "csv"]) == 0
    assert "total_transactions" in capsys.readouterr().out
    out = str(tmp_path / "out")
    assert main(["run", "t16_staging", "--sales", path, "--format", "csv", "--out", out]) == 0
    assert spark.read.parquet(out).count() > 0


def test_models_write_as_csv_and_read_back(spark, tmp_path):
    from revcurve.operators import subscription as M
    from revcurve.sources.files import write_model as wm

    sales = _sales_file(spark)
    mart = M.subscription_mart(T.staging_model(sales))
    out = str(tmp_path / "mrr_csv")
    wm(mart, out, fmt="csv")
    back = spark.read.option("header", "true").csv(out)
    assert back.count() == mart.count() and "churned_mrr" in back.columns


def test_customer_lookup_forms(spark):
    from pyspark.sql import functions as F

    from revcurve.operators import explore as E

    sales = _sales_file(spark)
    one = E.customer_rows(sales, 13)
    assert one.count() == sales.filter(F.col("customer") == 13).count() > 0
    some = E.customer_rows(sales, [13, 14])
    assert some.count() == sales.filter(F.col("customer").isin(13, 14)).count()
    ids = spark.createDataFrame([(13,), (14,), (14,)], "customer bigint")
    assert E.customer_rows(sales, ids).exceptAll(some).count() == 0
    assert "PushedFilters: [IsNotNull(customer), EqualTo(customer,13)]" in _plan(one)


def test_read_sales_with_renamed_export(spark, tmp_path):
    from revcurve.functions import domain as D
    from revcurve.sources.files import read_sales

    pdf = frame(crafted())
    names = {c: f"src_{c}" for c in D.SALES_COLUMNS}
    path = str(tmp_path / "export.csv")
    pdf.rename(columns=names).to_csv(path, index=False)
    df = read_sales(spark, path, fmt="csv", rename={v: k for k, v in names.items()})
    assert df.columns == list(D.SALES_COLUMNS)
    assert df.count() == len(pdf)
    assert df.filter("discount_id IS NULL").count() == int(pdf["discount_id"].isna().sum())


def test_bucketed_model_table_round_trip(spark, tmp_path):
    from revcurve.sources.files import save_model_table

    stg = T.staging_model(_sales_file(spark))
    save_model_table(stg, "revcurve_test_stg", bucket_by="customer", buckets=4,
                     sort_by=("customer",), path=str(tmp_path / "stg_table"))
    back = spark.table("revcurve_test_stg")
    assert back.exceptAll(stg).count() == 0 and stg.exceptAll(back).count() == 0
    # a per-customer aggregate on the bucketed table needs no shuffle
    plan = _plan(back.groupBy("customer").count())
    assert "Exchange" not in plan
    spark.sql("DROP TABLE revcurve_test_stg")


def test_no_query_uses_a_cross_or_nested_loop_join(spark, monkeypatch):
    from revcurve.plans import registry as R

    sales = _sales_file(spark)
    stg = T.staging_model(sales)
    monkeypatch.setattr(T, "staging_model", lambda rows: stg)  # built once for all marts
    for name, fn in R.operators().items():
        if name in R.INCREMENTAL:
            continue  # many jobs; they only call the models
        plan = _plan(fn(sales))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_csv_columns_are_found_by_name(spark, tmp_path):
    pdf = frame(crafted())
    path = str(tmp_path / "reordered.csv")
    pdf[list(pdf.columns)[::-1]].assign(extra=1).to_csv(path, index=False)
    straight = str(tmp_path / "straight.csv")
    pdf.to_csv(straight, index=False)
    got, want = read_sales(spark, path, fmt="csv"), read_sales(spark, straight, fmt="csv")
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_csv_without_a_column_or_with_a_bad_value_fails(spark, tmp_path):
    import pytest

    pdf = frame(crafted())
    short = str(tmp_path / "short.csv")
    pdf.drop(columns=["quantity"]).to_csv(short, index=False)
    with pytest.raises(ValueError, match="quantity"):
        read_sales(spark, short, fmt="csv")
    for column, value in (("processed_date", "01/02/2019"), ("customer", "x"), ("amount_in_usd", "abc")):
        bad = pdf.astype(object).copy()
        bad.loc[bad.index[0], column] = value
        path = str(tmp_path / f"bad_{column}.csv")
        bad.to_csv(path, index=False)
        with pytest.raises(Exception, match="(?i)malformed|parse|cannot"):
            read_sales(spark, path, fmt="csv").collect()


def test_large_amounts_do_not_overflow(spark):
    """1e14 dollars: shares and growth in percent stay exact."""
    from revcurve.operators import dashboard as B

    stg = spark.createDataFrame(
        [("new customer", "New", 1e14, 0.0), ("existing customer: renewal", "Renew", 3e14, 0.0)],
        "customer_status string, updated_license_type string, paid_amount_in_usd double, updated_discount_in_usd double",
    )
    got = {r["customer_status"]: r["revenue_share_pct"] for r in B.revenue_split(stg).collect()}
    assert got == {"new customer": 25.0, "existing customer: renewal": 75.0}
    month = spark.sql(
        "SELECT DATE'2020-01-01' mrr_month, 30000000000000000L mrr_c, 10000000000000000L previous_mrr_c, 1L active_customers, "
        "1L churned_customers, 4L previous_month_active_customers, 5000000000000000L churned_mrr_c, "
        "0L expansion_mrr_c, 0L contraction_mrr_c"
    )
    assert B.mrr_trend(month).first()["mrr_growth_pct"] == 200.0
    assert B.net_dollar_retention(month).first()["net_dollar_retention_pct"] == 50.0
    assert B.churn_rate(month).first()["revenue_churn_pct"] == 50.0


def test_repeat_npu_output_splits_a_hot_day(spark):
    """Many copies on one (customer, day): no output task holds most of them."""
    from pyspark.sql import functions as F

    from revcurve.functions import domain as D
    from revcurve.operators import explore as E

    hot = _hot_block_sales(spark, 6).where("customer = 1").limit(1)
    sales = hot.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(300_000)))).select(*D.SALES_COLUMNS)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = E.repeat_npu(sales).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    sizes = [r["count"] for r in got]
    assert sum(sizes) == 299_999 and max(sizes) < 0.4 * 299_999


def test_shared_folder_is_required_off_one_machine():
    from types import SimpleNamespace

    import pytest

    from revcurve.plans.session import ensure_checkpoint_dir

    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=None)
    session = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session)
