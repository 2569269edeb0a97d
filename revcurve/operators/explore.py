"""Exploratory queries over the raw sales table (e01-e15).

Row-order questions (previous product, purchase rank) run on the raw table, which holds
exact copies. Copies are first collapsed into one row with a multiplicity (an aggregate with
map-side combining, so even a huge pile of copies is reduced before the shuffle), and the
ordered computation runs on distinct rows through the skew-safe neighbour operator. The
multiplicity is expanded again only where single rows are reported, through
``explode_range``, which spreads a long expansion over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcurve.functions import domain as D
from revcurve.functions.money import div_round, to_cents, usd
from revcurve.operators.neighbours import ordered_neighbours
from revcurve.operators.ranges import explode_range

# Exact-duplicate key: the nine columns, with the two amounts compared as text (so that
# values that print differently, such as 0.0 and -0.0, stay different rows).
_KEY_PLAIN = (
    "customer", "customer_status", "product_code", "license_type",
    "processed_date", "discount_id", "quantity",
)


def _with_text_amounts(sales: DataFrame) -> DataFrame:
    return sales.withColumn("_amount_txt", F.col("amount_in_usd").cast("string")).withColumn(
        "_discount_txt", F.col("discount_in_usd").cast("string")
    )


def deduplicate(sales: DataFrame) -> DataFrame:
    """Drop exact duplicate rows (a hash aggregate with partial aggregation; no sort).

    Grouping is on the text of the amounts; the amounts are read back from that text, which
    round-trips every double exactly (including -0.0), so no ``first()`` is needed.
    """
    keyed = _with_text_amounts(sales)
    return (
        keyed.select(*_KEY_PLAIN, "_amount_txt", "_discount_txt")
        .distinct()
        .select(
            *_KEY_PLAIN,
            F.col("_amount_txt").cast("double").alias("amount_in_usd"),
            F.col("_discount_txt").cast("double").alias("discount_in_usd"),
        )
        .select(*D.SALES_COLUMNS)
    )


def dedup_with_row_num(sales: DataFrame) -> DataFrame:
    """e01: the deduplicated rows, carrying ``row_num`` (always 1)."""
    return deduplicate(sales).withColumn("row_num", F.lit(1).cast("bigint"))


def dedup_totals(sales: DataFrame) -> DataFrame:
    """e01c: transactions and customers after deduplication."""
    return deduplicate(sales).agg(
        F.count(F.lit(1)).alias("transactions"), F.countDistinct("customer").alias("customers")
    )


def duplicate_copies(sales: DataFrame) -> DataFrame:
    """e01b: the copies removed by deduplication, numbered 2..k within each group."""
    groups = (
        _with_text_amounts(sales)
        .groupBy(*_KEY_PLAIN, "_amount_txt", "_discount_txt")
        .agg(F.count(F.lit(1)).alias("_k"))
        .filter(F.col("_k") > 1)
        .withColumn("amount_in_usd", F.col("_amount_txt").cast("double"))
        .withColumn("discount_in_usd", F.col("_discount_txt").cast("double"))
    )
    return explode_range(groups.select(*D.SALES_COLUMNS, "_k"), F.lit(2), F.col("_k"),
                         "row_num").select(*D.SALES_COLUMNS, "row_num")


def zero_revenue_codes(sales: DataFrame) -> DataFrame:
    """e02: zero-revenue rows per discount code (NULL code -> 'untracked_discount').

    Averages, sums and the revenue/discount ratio are computed on integer cents and rounded
    half away from zero to 2 decimals; the ratio is NULL when the discounts sum to 0.
    """
    z = sales.filter(F.col("amount_in_usd") == 0).select(
        F.coalesce(F.col("discount_id").cast("string"), F.lit(D.UNTRACKED_DISCOUNT))
        .alias("grouped_discount_id"),
        to_cents("discount_in_usd").alias("_dc"),
        to_cents("amount_in_usd").alias("_ac"),
    )
    g = z.groupBy("grouped_discount_id").agg(
        F.count(F.lit(1)).alias("cnt_transactions"),
        F.sum("_dc").alias("_sd"),
        F.count("_dc").alias("_nd"),
        F.sum("_ac").alias("_sa"),
        F.count("_ac").alias("_na"),
    )
    return g.select(
        "grouped_discount_id",
        "cnt_transactions",
        usd(div_round("_sd", "_nd")).alias("avg_discount"),
        usd(div_round("_sa", "_na")).alias("avg_revenue"),
        usd("_sd").alias("total_discount"),
        usd("_sa").alias("total_revenue"),
        usd(div_round("100 * _sa", "_sd")).alias("effective_discount_roi"),
    ).orderBy(F.col("grouped_discount_id").desc())


def free_renewal_condition():
    """Uncoded, discounted, zero-revenue renewal of a Renew license (3-valued)."""
    return (
        F.col("discount_id").isNull()
        & (F.col("discount_in_usd") > 0)
        & (F.col("amount_in_usd") == 0)
        & (F.col("customer_status") == D.RENEWAL)
        & (F.col("license_type") == D.LICENSE_RENEW)
    )


def free_renewals(sales: DataFrame) -> DataFrame:
    """e03: the free renewals."""
    return sales.filter(free_renewal_condition())


def not_free_renewals(sales: DataFrame) -> DataFrame:
    """e04: the 3-valued complement of e03 (a row whose test is unknown is dropped)."""
    return sales.filter(~free_renewal_condition())


def status_license(sales: DataFrame) -> DataFrame:
    """e05: rows and distinct customers per (status, license)."""
    return sales.groupBy("customer_status", "license_type").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct("customer").alias("total_unique_customers"),
    )


def license_fix_condition(status: str = "customer_status", license_col: str = "license_type"):
    """(status, license) is one of the pairs rewritten to New (OR of ANDs, pushdown-friendly)."""
    cond = None
    for s, lic in D.LICENSE_FIX_PAIRS:
        c = (F.col(status) == s) & (F.col(license_col) == lic)
        cond = c if cond is None else (cond | c)
    return cond


def suspicious_pairs(sales: DataFrame) -> DataFrame:
    """e06: rows whose (status, license) pair is one of the suspicious ones."""
    return sales.filter(license_fix_condition())


def same_day_new_and_npu(sales: DataFrame) -> DataFrame:
    """e07: customer-days that hold both a new-customer and a new-product-use row."""
    flags = (
        sales.filter(F.col("customer_status").isin(D.NEW_CUSTOMER, D.NEW_PRODUCT_USE))
        .groupBy("customer", "processed_date")
        .agg(
            F.max(F.when(F.col("customer_status") == D.NEW_CUSTOMER, 1).otherwise(0)).alias("_nc"),
            F.max(F.when(F.col("customer_status") == D.NEW_PRODUCT_USE, 1).otherwise(0)).alias("_npu"),
        )
    )
    return (
        flags.filter((F.col("_nc") == 1) & (F.col("_npu") == 1))
        .select("customer", "processed_date")
        .orderBy("customer", "processed_date")
    )


def first_day_not_new(sales: DataFrame) -> DataFrame:
    """e08: rows on a customer's first new-customer day whose status is not new customer.

    The first day is an aggregate per customer, joined back on (customer, day): no window, so
    AQE can split a hot customer's partition.
    """
    first = (
        sales.filter(F.col("customer_status") == D.NEW_CUSTOMER)
        .groupBy("customer")
        .agg(F.min("processed_date").alias("first_transaction_date"))
    )
    t = sales.alias("t")
    f = first.alias("f")
    return (
        t.join(
            f,
            (F.col("t.customer") == F.col("f.customer"))
            & (F.col("t.processed_date") == F.col("f.first_transaction_date")),
            "inner",
        )
        .filter(F.col("t.customer_status") != D.NEW_CUSTOMER)
        .select("t.customer", "t.processed_date", "t.customer_status", "t.license_type")
    )


def first_day_customers(sales: DataFrame) -> DataFrame:
    """e08b: how many customers have a row of e08."""
    return first_day_not_new(sales).agg(F.countDistinct("customer").alias("customers"))


def negative_by_status(sales: DataFrame) -> DataFrame:
    """e09: negative discounts (surcharges) per status."""
    return (
        sales.filter(F.col("discount_in_usd") < 0)
        .groupBy("customer_status")
        .agg(F.count(F.lit(1)).alias("cnt_transactions"))
    )


def customer_rows(sales: DataFrame, customers) -> DataFrame:
    """e10: all rows of the given customer(s).

    ``customers`` is one id, a list of ids (a pushed-down ``IN`` filter), or a DataFrame
    with a ``customer`` column (a left-semi join, broadcast by AQE only when it is small).
    """
    if isinstance(customers, DataFrame):
        return sales.join(customers.select("customer").distinct(), "customer", "left_semi")
    if isinstance(customers, (list, tuple, set)):
        return sales.filter(F.col("customer").isin(list(customers)))
    return sales.filter(F.col("customer") == F.lit(customers))


def surcharged_customers(sales: DataFrame) -> DataFrame:
    """Customers with at least one negative discount (the ids the e10 lookup studies)."""
    return sales.filter(F.col("discount_in_usd") < 0).select("customer").distinct()


def uncoded_by_free(sales: DataFrame) -> DataFrame:
    """e11: uncoded positive discounts split by zero revenue."""
    return (
        sales.filter((F.col("discount_in_usd") > 0) & F.col("discount_id").isNull())
        .groupBy((F.col("amount_in_usd") == 0).alias("flag"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def free_npu_by_license(sales: DataFrame) -> DataFrame:
    """e12: uncoded, fully discounted new-product-use rows per license type."""
    return (
        sales.filter(
            F.col("discount_id").isNull()
            & (F.col("discount_in_usd") > 0)
            & (F.col("amount_in_usd") == 0)
            & (F.col("customer_status") == D.NEW_PRODUCT_USE)
        )
        .groupBy("license_type")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def _collapse_copies(sales: DataFrame) -> DataFrame:
    return sales.groupBy(*D.SALES_COLUMNS).agg(F.count(F.lit(1)).alias("_mult"))


def self_transitions(sales: DataFrame) -> DataFrame:
    """e13: rows whose path goes from a product to itself, per (status, license).

    The previous product is taken in the order (day, status, product, then the remaining
    columns). Of ``k`` identical copies, the first sees the previous distinct row and the
    other ``k - 1`` see a copy of themselves.
    """
    distinct_rows = _collapse_copies(sales)
    order = ["processed_date", "customer_status", "product_code", *D.RAW_TIE_ORDER]
    nb = ordered_neighbours(distinct_rows, ["customer"], order, lag={"_prev": "product_code"})
    from_path = F.when(
        F.col("_prev").isNull() & (F.col("customer_status") == D.NEW_CUSTOMER),
        F.lit(D.NEW_CUSTOMER_PATH),
    ).otherwise(F.col("_prev"))
    matches = (
        F.when(from_path == F.col("product_code"), 1).otherwise(0)
        + F.when(F.col("product_code").isNotNull(), F.col("_mult") - 1).otherwise(0)
    )
    return (
        nb.groupBy("customer_status", "license_type")
        .agg(F.sum(matches).cast("bigint").alias("cnt_transactions"))
        .filter(F.col("cnt_transactions") > 0)
    )


def same_day_anomaly_rows(sales: DataFrame) -> DataFrame:
    """e14: New-license NC / NPU rows of (customer, day, product) groups holding both statuses."""
    cand = sales.filter(
        (F.col("license_type") == D.LICENSE_NEW)
        & F.col("customer_status").isin(D.NEW_CUSTOMER, D.NEW_PRODUCT_USE)
    )
    keys = (
        cand.groupBy("customer", "processed_date", "product_code")
        .agg(
            F.max((F.col("customer_status") == D.NEW_CUSTOMER).cast("int")).alias("_nc"),
            F.max((F.col("customer_status") == D.NEW_PRODUCT_USE).cast("int")).alias("_npu"),
        )
        .filter((F.col("_nc") == 1) & (F.col("_npu") == 1))
        .select("customer", "processed_date", "product_code")
    )
    return cand.join(keys, ["customer", "processed_date", "product_code"], "left_semi")


def repeat_npu(sales: DataFrame) -> DataFrame:
    """e15: new-product-use New rows that are not the first purchase of that product.

    ``purchase_rank`` is the row number within (customer, product) in the order (day,
    status, then the remaining columns); copies take consecutive ranks.
    """
    distinct_rows = _collapse_copies(sales)
    order = ["processed_date", "customer_status", *D.RAW_TIE_ORDER]
    nb = ordered_neighbours(
        distinct_rows, ["customer", "product_code"], order, count_before="_before", weight="_mult"
    )
    hits = nb.filter(
        (F.col("customer_status") == D.NEW_PRODUCT_USE) & (F.col("license_type") == D.LICENSE_NEW)
    )
    # ranks above 1 only: the copies of a row take consecutive ranks
    hits = hits.select(
        "customer", "product_code", "processed_date", "customer_status", "license_type",
        "_before", "_mult",
    )
    ranked = explode_range(
        hits, F.greatest(F.col("_before") + 1, F.lit(2)), F.col("_before") + F.col("_mult"),
        "purchase_rank",
    )
    return ranked.select(
        "customer", "product_code", "processed_date", "customer_status", "license_type",
        "purchase_rank",
    ).orderBy(
        # the reference order (customer, day), completed to a unique key so that a hot day is split
        "customer", "processed_date", "product_code", "customer_status", "license_type", "purchase_rank"
    )
