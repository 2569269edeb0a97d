"""Dashboard aggregates over the marts (d01-d13).

The dashboards are named by the modelled project but their formulas are not part of it; the
definitions here are this package's own. Conventions:

* money is summed as integer cents and published as dollars;
* averages, ratios and percentages are rounded half away from zero on integers, to 2 decimals;
* every ranking window runs over an aggregate whose size is bounded by a catalogue (products,
  transition paths, discount levels, months), never over raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revcurve.functions import domain as D
from revcurve.functions.money import div_round, to_cents, usd

TOP_PRODUCTS = 10


def _cents(stg: DataFrame) -> DataFrame:
    return stg.withColumn("_paid_c", to_cents("paid_amount_in_usd")).withColumn(
        "_disc_c", to_cents("updated_discount_in_usd")
    )


def _pct2(num: str, den: str):
    """``num / den`` as a percentage with 2 decimals."""
    return (div_round(f"10000 * CAST({num} AS DECIMAL(25, 0))", den) / F.lit(100.0))


def top_products(stg: DataFrame, k: int = TOP_PRODUCTS) -> DataFrame:
    """d01: the ``k`` products with the highest paid revenue (rows, customers, rank)."""
    g = _cents(stg).groupBy("product_code").agg(
        F.sum("_paid_c").alias("_paid"),
        F.count(F.lit(1)).alias("transactions"),
        F.countDistinct("customer").alias("customers"),
    )
    w = Window.orderBy(F.col("_paid").desc(), F.col("product_code").asc_nulls_first())
    return (
        g.select(
            "product_code", usd("_paid").alias("total_paid"), "transactions", "customers",
            F.row_number().over(w).cast("bigint").alias("paid_rank"),
        )
        .filter(F.col("paid_rank") <= k)
    )


def revenue_trend(stg: DataFrame) -> DataFrame:
    """d02: per month, paid revenue, discounts given and transactions."""
    return (
        _cents(stg)
        .groupBy(F.trunc("processed_date", "month").alias("month"))
        .agg(F.sum("_paid_c").alias("_paid"), F.sum("_disc_c").alias("_disc"),
             F.count(F.lit(1)).alias("transactions"))
        .select("month", usd("_paid").alias("total_paid"), usd("_disc").alias("total_discount"),
                "transactions")
    )


def product_positioning(stg: DataFrame) -> DataFrame:
    """d03: per product, transactions, discounted transactions, average discount %."""
    g = stg.groupBy("product_code").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_if(F.col("updated_discount_in_usd") > 0).alias("discounted_transactions"),
        F.sum(F.col("discount_percentage").cast("bigint")).alias("_pct_sum"),
        F.count("discount_percentage").alias("_pct_n"),
    )
    return g.select(
        "product_code", "transactions", "discounted_transactions",
        (div_round("100 * _pct_sum", "_pct_n") / F.lit(100.0)).alias("avg_discount_percentage"),
    )


def revenue_per_sale(stg: DataFrame) -> DataFrame:
    """d04: per band of 10 discount points, transactions, revenue and revenue per sale."""
    band = (F.floor(F.col("discount_percentage") / 10) * 10).cast("bigint")
    g = _cents(stg).groupBy(band.alias("discount_band")).agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("_paid_c").alias("_paid")
    )
    return g.select(
        "discount_band", "transactions", usd("_paid").alias("total_paid"),
        usd(div_round("_paid", "transactions")).alias("revenue_per_sale"),
    )


def acquisition_cost(stg: DataFrame) -> DataFrame:
    """d05: per month, discount given on new-customer rows per new customer."""
    nc = _cents(stg).filter(F.col("customer_status") == D.NEW_CUSTOMER)
    g = nc.groupBy(F.trunc("processed_date", "month").alias("month")).agg(
        F.countDistinct("customer").alias("new_customers"),
        F.sum("_disc_c").alias("_disc"),
    )
    return g.select(
        "month", "new_customers", usd("_disc").alias("acquisition_discount"),
        usd(div_round("_disc", "new_customers")).alias("cost_per_acquisition"),
    )


def discount_levels(stg: DataFrame) -> DataFrame:
    """d06: per discount percentage, transactions, revenue, revenue per sale, rank by revenue."""
    g = _cents(stg).groupBy("discount_percentage").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("_paid_c").alias("_paid")
    )
    w = Window.orderBy(F.col("_paid").desc())
    return g.select(
        "discount_percentage", "transactions", usd("_paid").alias("total_paid"),
        usd(div_round("_paid", "transactions")).alias("revenue_per_sale"),
        F.rank().over(w).cast("bigint").alias("revenue_rank"),
    )


def transition_paths(mart: DataFrame) -> DataFrame:
    """d07: transitions per (from, to): rows, customers, revenue, ranks by count and value."""
    t = _cents(mart.filter(F.col("transition_flag")))
    g = t.groupBy("from_path", "to_path").agg(
        F.count(F.lit(1)).alias("transitions"),
        F.countDistinct("customer").alias("customers"),
        F.sum("_paid_c").alias("_paid"),
    )
    return g.select(
        "from_path", "to_path", "transitions", "customers", usd("_paid").alias("total_paid"),
        F.rank().over(Window.orderBy(F.col("transitions").desc())).cast("bigint").alias("count_rank"),
        F.rank().over(Window.orderBy(F.col("_paid").desc())).cast("bigint").alias("value_rank"),
    )


def transition_matrix(mart: DataFrame, products: Sequence[str]) -> DataFrame:
    """d08: transition counts as a from x to matrix, one column per product of the given catalogue."""
    t = mart.filter(F.col("transition_flag"))
    piv = t.groupBy("from_path").pivot("to_path", list(products)).agg(F.count(F.lit(1)))
    return piv.select(
        "from_path", *[F.coalesce(F.col(p), F.lit(0).cast("bigint")).alias(p) for p in products]
    )


def mrr_trend(mom: DataFrame) -> DataFrame:
    """d09: the mart's monthly MRR with month-on-month growth (%)."""
    return mom.select(
        "mrr_month", usd("mrr_c").alias("mrr"), usd("previous_mrr_c").alias("previous_mrr"),
        "active_customers",
        _pct2("mrr_c - previous_mrr_c", "previous_mrr_c").alias("mrr_growth_pct"),
    )


def net_dollar_retention(mom: DataFrame) -> DataFrame:
    """d10: (previous + expansion - contraction - churned) / previous, in %."""
    return mom.select(
        "mrr_month",
        _pct2("previous_mrr_c + expansion_mrr_c - contraction_mrr_c - churned_mrr_c",
              "previous_mrr_c").alias("net_dollar_retention_pct"),
    )


def churn_rate(mom: DataFrame) -> DataFrame:
    """d11: customer churn and revenue churn, in % of the previous month."""
    return mom.select(
        "mrr_month", "churned_customers", "previous_month_active_customers",
        _pct2("churned_customers", "previous_month_active_customers").alias("customer_churn_pct"),
        usd("churned_mrr_c").alias("churned_mrr"),
        _pct2("churned_mrr_c", "previous_mrr_c").alias("revenue_churn_pct"),
    )


def mrr_waterfall(mom: DataFrame) -> DataFrame:
    """d12: long form per month: opening, +new, +expansion, -contraction, -churned, closing."""
    steps = [
        (1, "opening", F.col("previous_mrr_c")),
        (2, "new", F.col("new_mrr_c")),
        (3, "expansion", F.col("expansion_mrr_c")),
        (4, "contraction", -F.col("contraction_mrr_c")),
        (5, "churned", -F.col("churned_mrr_c")),
        (6, "closing", F.col("mrr_c")),
    ]
    arr = F.array(*[
        F.struct(F.lit(i).alias("step_order"), F.lit(name).alias("step"), v.alias("_c"))
        for i, name, v in steps
    ])
    return mom.select("mrr_month", F.explode(arr).alias("s")).select(
        "mrr_month", "s.step_order", "s.step", usd("s._c").alias("amount")
    )


def revenue_split(stg: DataFrame) -> DataFrame:
    """d13: paid revenue per (customer status, license type) with its share of the total (%)."""
    g = _cents(stg).groupBy("customer_status", "updated_license_type").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("_paid_c").alias("_paid")
    )
    g = g.withColumn("_all", F.sum("_paid").over(Window.partitionBy()))
    return g.select(
        "customer_status", "updated_license_type", "transactions", usd("_paid").alias("total_paid"),
        _pct2("_paid", "_all").alias("revenue_share_pct"),
    )
