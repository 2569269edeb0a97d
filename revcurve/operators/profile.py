"""Profiling queries over the raw sales table (s01-s13).

All are scans with aggregates. Distinct counts go through Spark's two-phase distinct
aggregation (map-side partial aggregation on ``(group, customer)`` first), so a customer
owning many rows is collapsed before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def schema_profile(sales: DataFrame) -> DataFrame:
    """s01: column name, type, position, non-null and distinct counts.

    Re-aimed catalog lookup: Spark has no information schema for a DataFrame, so the types
    come from ``df.schema``. Counting is one pass: the table is unpivoted to
    (column, value-as-string), partially aggregated per distinct value, then counted per
    column. A value shared by many rows is collapsed map-side.
    """
    fields = sales.schema.fields
    pairs = F.explode(
        F.array(*[
            F.struct(F.lit(i + 1).alias("ordinal_position"), F.col(f.name).cast("string").alias("value"))
            for i, f in enumerate(fields)
        ])
    ).alias("p")
    per_value = (
        sales.select(pairs).select("p.*").groupBy("ordinal_position", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    counts = per_value.groupBy("ordinal_position").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(F.lit(0))).cast("bigint")
        .alias("non_null_count"),
        F.count("value").alias("distinct_count"),
    )
    # names and types join the few result rows, not the shuffled pairs
    names = F.array(*[F.lit(f.name) for f in fields])
    types = F.array(*[F.lit(f.dataType.simpleString()) for f in fields])
    return counts.select(
        "ordinal_position",
        F.element_at(names, F.col("ordinal_position")).alias("column_name"),
        F.element_at(types, F.col("ordinal_position")).alias("data_type"),
        "non_null_count",
        "distinct_count",
    )


def totals(sales: DataFrame) -> DataFrame:
    """s02: rows and distinct customers."""
    return sales.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.countDistinct("customer").alias("total_unique_customers"),
    )


def transaction_histogram(sales: DataFrame) -> DataFrame:
    """s03: number of customers per number of transactions, ordered."""
    per_customer = sales.groupBy("customer").agg(F.count(F.lit(1)).alias("cnt_transactions"))
    return (
        per_customer.groupBy("cnt_transactions")
        .agg(F.count(F.lit(1)).alias("cnt_customers"))
        .orderBy("cnt_transactions")
    )


def _rows_and_customers(sales: DataFrame, key: str, rows_name: str, cust_name: str) -> DataFrame:
    return sales.groupBy(key).agg(
        F.count(F.lit(1)).alias(rows_name),
        F.countDistinct("customer").alias(cust_name),
    )


def by_status(sales: DataFrame) -> DataFrame:
    """s04: rows and distinct customers per customer_status."""
    return _rows_and_customers(sales, "customer_status", "total_records", "total_unique_customers")


def by_product(sales: DataFrame) -> DataFrame:
    """s05: rows and distinct customers per product."""
    return _rows_and_customers(sales, "product_code", "total_transactions", "total_unique_customers")


def by_quantity(sales: DataFrame) -> DataFrame:
    """s06: rows and distinct customers per quantity."""
    return _rows_and_customers(sales, "quantity", "total_transactions", "total_unique_customers")


def by_license(sales: DataFrame) -> DataFrame:
    """s07: rows and distinct customers per license type."""
    return _rows_and_customers(sales, "license_type", "total_records", "unique_customers")


def date_range(sales: DataFrame) -> DataFrame:
    """s08: first and last day, number of distinct days."""
    return sales.agg(
        F.min("processed_date").alias("min_date"),
        F.max("processed_date").alias("max_date"),
        F.countDistinct("processed_date").alias("distinct_days"),
    )


def discount_codes(sales: DataFrame) -> DataFrame:
    """s09: number of distinct discount codes (NULL is not a code)."""
    return sales.agg(F.countDistinct("discount_id").alias("distinct_discount_ids"))


def code_presence(sales: DataFrame) -> DataFrame:
    """s10: rows with and without a discount code."""
    return sales.groupBy(F.col("discount_id").isNull().alias("is_null_discount_id")).agg(
        F.count(F.lit(1)).alias("total_transactions")
    )


def amount_range(sales: DataFrame) -> DataFrame:
    """s11: smallest and largest amount."""
    return sales.agg(F.min("amount_in_usd").alias("min_amount"), F.max("amount_in_usd").alias("max_amount"))


def discount_at_least_amount(sales: DataFrame) -> DataFrame:
    """s12: coded rows whose discount is at least the (net) amount; pushed down to the scan."""
    return sales.filter(
        (F.col("discount_in_usd") >= F.col("amount_in_usd")) & F.col("discount_id").isNotNull()
    )


def discount_sign_by_code(sales: DataFrame) -> DataFrame:
    """s13: discount sign (negative / zero / positive / NULL) x code presence."""
    d = F.col("discount_in_usd")
    flag = (
        F.when(d < 0, "negative").when(d == 0, "zero").when(d > 0, "positive")
        .otherwise(F.lit(None).cast("string"))
    )
    return sales.groupBy(
        flag.alias("discount_amount_flag"),
        F.col("discount_id").isNull().alias("is_null_discount"),
    ).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.countDistinct("customer").alias("total_unique_customers"),
    )


def sub_cent_amounts(sales: DataFrame) -> DataFrame:
    """Amounts that are not whole cents (money is carried in integer cents from staging on).

    Reports how many amounts and discounts change when converted to cents, so that the
    conversion never hides data.
    """
    def off(c: str):
        return F.col(c) * 100 != F.round(F.col(c) * 100)

    return sales.agg(
        F.count_if(off("amount_in_usd")).alias("sub_cent_amounts"),
        F.count_if(off("discount_in_usd")).alias("sub_cent_discounts"),
    )
