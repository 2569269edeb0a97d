"""Model invariants, the NOT EXISTS twin of staging, and golden values of the test tables."""

import pytest
from pyspark.sql import functions as F

from revcurve.functions import domain as D
from revcurve.operators import explore as E
from revcurve.operators import staging as T
from revcurve.operators import subscription as M
from revcurve.operators import transitions as J
from revcurve.sources.testdata import sales_from_testdata

from conftest import SF001, SF01


@pytest.fixture(scope="module")
def sales(spark):
    return sales_from_testdata(spark, SF001).cache()


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_removals_on_hand_computed_rows(spark):
    """Each removal keeps and drops what its rule says, worked out by hand."""
    nc, npu, ren = D.NEW_CUSTOMER, D.NEW_PRODUCT_USE, D.RENEWAL
    rows = [  # (keep, customer, status, product, license, day, code, amount, discount)
        (True, 1, nc, "A", "New", "2019-01-01", None, 10.0, 0.0),
        (False, 1, npu, "A", "New", "2019-01-01", None, 11.0, 0.0),  # opens and adds on one day
        (False, 1, ren, "A", "Renew", "2019-01-01", None, 12.0, 0.0),  # renewal on the first day
        (False, 1, npu, "A", "New", "2019-02-01", None, 13.0, 0.0),  # not the first purchase
        (True, 1, npu, "A", "New", "2019-03-01", 7, 14.0, 1.0),  # the same with a code
        (True, 1, npu, "B", "New", "2019-02-01", None, 15.0, 0.0),  # first purchase of B
        (True, 1, ren, "B", "Renew", "2019-04-01", None, 16.0, 0.0),
        (False, 2, ren, "A", "Renew", "2019-01-01", None, 0.0, 5.0),  # free renewal without a code
        (True, 2, ren, "A", "Renew", "2019-01-02", 9, 0.0, 5.0),  # with a code
        (True, None, npu, "A", "New", "2019-01-05", None, 17.0, 0.0),
        (True, None, npu, "A", "New", "2019-01-06", None, 18.0, 0.0),  # a null key never matches
    ]
    sales = spark.createDataFrame(
        [(c, s, p, lic, d, k, 1, a, x) for _, c, s, p, lic, d, k, a, x in rows],
        "customer bigint, customer_status string, product_code string, license_type string, d string, "
        "discount_id bigint, quantity int, amount_in_usd double, discount_in_usd double",
    ).withColumn("processed_date", F.to_date("d")).select(*D.SALES_COLUMNS)
    got = sorted((r["customer"] or 0, r["amount_in_usd"], str(r["processed_date"])) for r in T.clean_rows(sales).collect())
    assert got == sorted((r[1] or 0, r[7], r[5]) for r in rows if r[0])


def test_staging_is_subset_of_dedup_and_ignores_copies(sales):
    clean = T.clean_rows(sales)
    assert clean.exceptAll(E.deduplicate(sales)).count() == 0
    assert _same(T.staging_model(sales), T.staging_model(sales.unionByName(sales)))


def test_results_do_not_depend_on_partitioning(sales):
    a = M.subscription_mart(T.staging_model(sales.repartition(3)))
    b = M.subscription_mart(T.staging_model(sales.repartition(17, "product_code")))
    assert _same(a, b)
    ja = J.transactional_mart(T.staging_model(sales.repartition(5)))
    jb = J.transactional_mart(T.staging_model(sales.coalesce(1)))
    assert _same(ja, jb)


def test_waterfall_steps_add_up(sales):
    mom = M.month_over_month(M.monthly_aggregation(M.classified(T.staging_model(sales))))
    bad = mom.filter(F.col("previous_mrr_c").isNotNull()).filter(
        F.col("previous_mrr_c") + F.col("new_mrr_c") + F.col("expansion_mrr_c")
        - F.col("contraction_mrr_c") - F.col("churned_mrr_c") != F.col("mrr_c"))
    assert bad.count() == 0
    first = mom.orderBy("mrr_month").first()
    assert first["previous_mrr_c"] is None and first["churned_mrr_c"] is None


def test_revenue_is_conserved_by_expansion(sales):
    cls = M.classified(T.staging_model(sales))
    cm = M.customer_months(cls)
    spread = cm.agg(F.sum("total_mrr")).first()[0]
    paid = cls.agg(F.sum(F.round(F.col("paid_amount_in_usd") * 100).cast("bigint"))).first()[0]
    assert spread == 12 * paid


def test_transition_flag_implies_change(sales):
    mart = J.transactional_mart(T.staging_model(sales))
    assert mart.filter(F.col("transition_flag") & (F.col("from_path") == F.col("to_path"))).count() == 0
    assert mart.filter(F.col("transition_flag").isNull()).count() == 0


def test_golden_values_sf001(spark):
    """Values measured on the sf0.01 test tables (FIXTURES.md section 4)."""
    s = sales_from_testdata(spark, SF01)
    assert s.count() == 61495
    assert T.staging_model(s).count() == 53429
    mart = M.subscription_mart(T.staging_model(s)).orderBy("mrr_month").collect()
    assert len(mart) == 47
    by_month = {str(r["mrr_month"])[:7]: r for r in mart}
    r = by_month["2018-02"]
    assert (r["mrr"], r["previous_mrr"], r["new_mrr"], r["expansion_mrr"], r["contraction_mrr"],
            r["churned_mrr"], r["active_customers"], r["arpu"], r["existing_customers"],
            r["churned_customers"]) == (112989.85, 64259.36, 41006.64, 16424.41, 8502.05, 198.51,
                                        748, 151.06, 461, 1)
    r = by_month["2021-11"]
    assert (r["mrr"], r["contraction_mrr"], r["churned_mrr"], r["active_customers"], r["arpu"],
            r["churned_customers"]) == (30509.24, 5750.70, 21322.12, 345, 88.43, 242)
    assert by_month["2018-01"]["previous_mrr"] is None


def test_entry_smoke(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == list(D.SUBSCRIPTION_COLUMNS)
    assert df.count() > 0
    from revcurve.plans import oracle, registry

    assert set(registry.queries()) == set(oracle.oracle_sql()) <= set(entry.queries())


def test_write_models_round_trip(spark, sales):
    import tempfile

    from revcurve.plans.models import STAGING, SUBSCRIPTION, TRANSACTIONAL, write_models
    from revcurve.sources.files import read_model

    paths = write_models(spark, sales, tempfile.mkdtemp(prefix="revcurve-models-"))
    stg = T.staging_model(sales)
    assert _same(read_model(spark, paths[STAGING]), stg)
    assert _same(read_model(spark, paths[SUBSCRIPTION]), M.subscription_mart(stg))
    assert _same(read_model(spark, paths[TRANSACTIONAL]), J.transactional_mart(stg))


# Row counts measured on the sf0.01 test tables (FIXTURES.md section 4).
GOLDEN_ROWS_SF001 = {
    "s03_txn_histogram": 86, "s12_discount_ge_amount": 503, "e01b_duplicates": 1495,
    "e02_zero_revenue_codes": 14, "e03_free_renewals": 1573, "e06_suspicious_pairs": 3087,
    "e07_same_day_new_and_npu": 780, "e08_first_day_not_new": 1990, "e09_negative_by_status": 4,
    "e11_uncoded_by_free": 2, "e12_free_npu_by_license": 3, "e13_self_transitions": 9,
    "e14_same_day_anomaly_rows": 415, "e15_repeat_npu": 4209, "t01_dedup": 60000,
    "t16_staging": 53429, "m13_subscription_mart": 47,
}


def test_golden_row_counts_sf001(spark):
    from revcurve.plans import registry as R
    from revcurve.sources.testdata import load_sales

    sales = load_sales(spark, SF01)
    ops = R.operators()
    got = {q: ops[q](sales).count() for q in GOLDEN_ROWS_SF001}
    assert got == GOLDEN_ROWS_SF001
    s = sales.agg(F.min("processed_date"), F.max("processed_date"),
                  F.countDistinct("processed_date"), F.countDistinct("discount_id")).first()
    assert (str(s[0]), str(s[1]), s[2], s[3]) == ("2018-01-01", "2020-12-31", 1096, 13)


def test_golden_transition_outcomes_sf001(spark):
    from revcurve.sources.testdata import load_sales

    mart = J.transactional_mart(T.staging_model(load_sales(spark, SF01)))
    c = mart.agg(
        F.count_if(F.col("transition_flag") & (F.col("from_path") == D.NEW_CUSTOMER_PATH)).alias("a"),
        F.count_if(F.col("transition_flag") & (F.col("from_path") != D.NEW_CUSTOMER_PATH)).alias("b"),
        F.count_if(~F.col("transition_flag") & (F.col("from_path") == F.col("to_path"))).alias("c"),
        F.count_if(F.col("from_path").isNull()).alias("d"),
    ).first()
    assert (c["a"], c["b"], c["c"], c["d"]) == (2884, 6592, 42874, 1079)


def test_golden_billing_rules_sf001(spark):
    """(rule, interval) counts on the sf0.01 test tables (FIXTURES.md section 4)."""
    from revcurve.sources.testdata import load_sales

    rows = (M.classified_with_rule(T.staging_model(load_sales(spark, SF01)))
            .groupBy("billing_rule", "final_billing_interval").count().collect())
    got = {(r["billing_rule"], r["final_billing_interval"]): r["count"] for r in rows}
    expected = {
        (1, "Monthly"): 90, (1, "Yearly"): 1698, (2, "Monthly"): 161, (2, "Yearly"): 3975,
        (3, "Monthly"): 480, (3, "Yearly"): 10553, (4, "Monthly"): 125, (4, "Yearly"): 2759,
        (5, "Monthly"): 1150, (5, "Yearly"): 5571, (6, "Monthly"): 968, (6, "Yearly"): 5027,
        (7, "Yearly"): 20872,
    }
    assert got == expected


def test_golden_counts_sf0001(spark):
    """Measured on the sf0.001 test tables (FIXTURES.md section 4)."""
    from revcurve.sources.testdata import load_sales

    sales = load_sales(spark, SF001)
    stg = T.staging_model(sales)
    assert sales.count() == 6142
    assert E.deduplicate(sales).count() == 6000
    assert stg.count() == 5796
    assert stg.filter(F.col("discount_percentage").isNull()).count() == 2
    assert stg.filter(F.col("surcharge_amount_in_usd") > 0).count() == 17
    mart = J.transactional_mart(stg)
    flags = mart.agg(
        F.count_if(F.col("transition_flag") & (F.col("from_path") == D.NEW_CUSTOMER_PATH)),
        F.count_if(F.col("transition_flag") & (F.col("from_path") != D.NEW_CUSTOMER_PATH)),
        F.count_if(~F.col("transition_flag") & (F.col("from_path") == F.col("to_path"))),
        F.count_if(F.col("from_path").isNull()),
    ).first()
    assert tuple(flags) == (278, 1048, 4358, 112)
    assert M.subscription_mart(stg).count() == 47
