"""Staging model: clean the raw sales table (t01-t16).

Steps (IDs as in the blueprint):

t01  drop exact duplicates
t02  first new-customer day per customer
t03  renewal rows on that day                        -> t10 drops those renewals
t04  (customer, day, product) holding both a new-customer and a new-product-use New row
                                                     -> t08 drops the new-product-use rows there
t05  purchase rank per (customer, product) by day
t06  uncoded New new-product-use rows that are not the first purchase
                                                     -> t09 drops new-product-use rows on that key
t07  drop free renewals
t11-t15  license fix, discount clamp, surcharge, total, discount percentage
t16  the whole model

Distributed plan. The three removals are anti-joins on ``(customer, day[, product])``. Instead
of three joins (each shuffling both sides on its own keys) or windows over ``customer``
(which put a hot customer into one task), every flag is computed once per *block*
``(customer, day, product)``:

* one ``groupBy`` over the rows gives per-block facts (map-side partial aggregation, so a huge
  block is reduced before it is shuffled; the facts are max / min, so copies need no
  deduplication first and the dedup shuffle is paid only on the row side);
* each customer's first new-customer day and each (customer, product)'s first day are small
  aggregates over the block table, which is stored, so the sales are scanned twice in all (blocks, rows); no
  window holds a customer's blocks, so a customer with a long history and a large catalogue is not one task;
* one join attaches the flags to the rows (null-safe on the block key, so a row with a NULL
  product still gets its customer-day flag). Only blocks with a flag are kept for it, as a stored table whose
  size the optimiser knows: while it is below the broadcast threshold no row moves for it, beyond that
  AQE's skew-join handling splits a hot block.

Removal semantics follow NOT EXISTS exactly: a NULL in a compared key never matches, so the
row is kept; every flag is therefore ``coalesce(..., false)``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revcurve.functions import domain as D
from revcurve.functions.money import div_round, to_cents, usd
from revcurve.operators.explore import deduplicate, free_renewal_condition, license_fix_condition
from revcurve.operators.neighbours import ordered_neighbours, stored_table

BLOCK = ("customer", "processed_date", "product_code")
# Order of purchases within (customer, product): day, then the remaining columns.
PURCHASE_ORDER = ("processed_date", "customer_status", *D.RAW_TIE_ORDER)
# Columns in which two candidate rows of one block can differ (the rest is shared).
_CAND_COLS = ("amount_in_usd", "discount_in_usd", "quantity")


def first_new_customer_day(dd: DataFrame) -> DataFrame:
    """t02: each customer's first day with a new-customer row (aggregate, no window)."""
    return (
        dd.filter(F.col("customer_status") == D.NEW_CUSTOMER)
        .groupBy("customer")
        .agg(F.min("processed_date").alias("first_transaction_date"))
    )


def invalid_first_entries(dd: DataFrame) -> DataFrame:
    """t03: renewal rows dated on the customer's first new-customer day -> (customer, day)."""
    f = first_new_customer_day(dd)
    t = dd.filter(F.col("customer_status") == D.RENEWAL)
    return t.join(
        f,
        (t.customer == f.customer) & (t.processed_date == f.first_transaction_date),
        "inner",
    ).select(t.customer, t.processed_date)


def status_anomalies(dd: DataFrame) -> DataFrame:
    """t04: New-license NC / NPU rows of blocks that hold both statuses, with the count."""
    cand = dd.filter(
        (F.col("license_type") == D.LICENSE_NEW)
        & F.col("customer_status").isin(D.NEW_CUSTOMER, D.NEW_PRODUCT_USE)
    )
    counts = cand.groupBy(*BLOCK).agg(
        F.countDistinct("customer_status").alias("distinct_status_count")
    ).filter(F.col("distinct_status_count") > 1)
    counts = counts.select(*[F.col(c).alias(f"_k_{c}") for c in BLOCK], "distinct_status_count")
    cond = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in BLOCK]
    return cand.join(counts, cond, "inner").select(*BLOCK, "customer_status", "distinct_status_count")


def purchase_rank(dd: DataFrame) -> DataFrame:
    """t05: row number of each purchase within (customer, product), by day then tie order.

    Runs through the skew-safe neighbour operator: a customer with a huge history is split
    over many tasks.
    """
    cols = ["customer", "product_code", "customer_status", "license_type", "processed_date",
            "discount_id", "amount_in_usd", "discount_in_usd", "quantity"]
    nb = ordered_neighbours(dd.select(*cols), ["customer", "product_code"], list(PURCHASE_ORDER),
                            count_before="_before")
    return nb.select(
        "customer", "product_code", "customer_status", "license_type", "processed_date",
        "discount_id", "amount_in_usd", (F.col("_before") + 1).alias("purchase_rank"),
    )


def repeat_new_product_use(dd: DataFrame) -> DataFrame:
    """t06: uncoded New new-product-use rows whose purchase rank is above 1."""
    return purchase_rank(dd).filter(
        (F.col("customer_status") == D.NEW_PRODUCT_USE)
        & (F.col("license_type") == D.LICENSE_NEW)
        & (F.col("purchase_rank") > 1)
        & F.col("discount_id").isNull()
    ).select("customer", "product_code", "processed_date", "customer_status", "license_type",
             "purchase_rank")


def _facts(rows: DataFrame):
    """(name, aggregate) pairs of the per-block facts."""
    status, lic = F.col("customer_status"), F.col("license_type")
    cand = (status == D.NEW_PRODUCT_USE) & (lic == D.LICENSE_NEW) & F.col("discount_id").isNull()
    # A row that sorts before any candidate in the purchase order (status, license, code NULLS
    # FIRST, ...): candidates all share (NPU, New, NULL code), so only status / license decide.
    before_cand = (
        status.isNull() | (status < D.NEW_PRODUCT_USE)
        | ((status == D.NEW_PRODUCT_USE) & (lic.isNull() | (lic < D.LICENSE_NEW)))
    )
    facts = [
        ("_nc", F.max(status == D.NEW_CUSTOMER)),
        ("_nc_new", F.max((status == D.NEW_CUSTOMER) & (lic == D.LICENSE_NEW))),
        ("_npu_new", F.max((status == D.NEW_PRODUCT_USE) & (lic == D.LICENSE_NEW))),
        ("_has_cand", F.max(cand)),
        ("_before_cand", F.max(F.coalesce(before_cand, F.lit(False)))),
    ]
    # distinct candidates differ in amount, discount or quantity (all else is shared)
    for c in _CAND_COLS:
        facts += [
            (f"_min_{c}", F.min(F.when(cand, F.col(c)))),
            (f"_max_{c}", F.max(F.when(cand, F.col(c)))),
            (f"_maxnull_{c}", F.max(F.when(cand, F.col(c).isNull()))),
            (f"_minnull_{c}", F.min(F.when(cand, F.col(c).isNull()))),
        ]
    return facts


def _flags():
    """The three removal flags from the facts and the first days (never NULL)."""
    day = F.col("processed_date")
    has_cand = F.coalesce(F.col("_has_cand"), F.lit(False))
    several = F.lit(False)
    for c in _CAND_COLS:
        several = (several | ~F.col(f"_min_{c}").eqNullSafe(F.col(f"_max_{c}"))
                   | ~F.col(f"_minnull_{c}").eqNullSafe(F.col(f"_maxnull_{c}")))
    not_first = F.col("_before_cand")
    later = F.col("_null_day") | (day > F.col("_first_day"))
    first = day == F.col("_first_day")
    repeat = has_cand & (later | (first & (several | not_first)))
    return [
        F.coalesce(F.col("_nc_new") & F.col("_npu_new"), F.lit(False)).alias("drop_npu_anomaly"),
        F.coalesce(repeat, F.lit(False)).alias("drop_npu_repeat"),
        F.coalesce(day == F.col("_first_nc_day"), F.lit(False)).alias("drop_renewal"),
    ]


def block_flags(rows: DataFrame) -> DataFrame:
    """The (customer, day, product) blocks with a removal flag, stored.

    ``drop_npu_anomaly``  block holds New rows of both new-customer and new-product-use (t04)
    ``drop_npu_repeat``   block holds an uncoded New new-product-use row of rank > 1 (t06)
    ``drop_renewal``      the day is the customer's first new-customer day (t03)

    Every block fact is a max / min, so exact copies do not change it: the flags can be taken
    from the raw rows directly, and the deduplication shuffle is paid once, on the row side
    only. All facts are scalar max / min, so the aggregate stays a hash aggregate. The block table is stored:
    the first days of customers and of (customer, product) are minima over it, not over the rows.
    """
    blocks = stored_table(rows.groupBy(*BLOCK).agg(*[e.alias(n) for n, e in _facts(rows)]), "blocks")
    # Per customer and per (customer, product): small aggregates joined to the block table
    # (no window over a customer's blocks, so no task holds a whole customer). A NULL key
    # never matches here, like in NOT EXISTS; the row-level guards skip such rows anyway.
    first_nc = blocks.filter("_nc").groupBy("customer").agg(F.min("processed_date").alias("_first_nc_day"))
    first_day = blocks.groupBy("customer", "product_code").agg(
        F.min("processed_date").alias("_first_day"),
        # rank order puts NULL days first: a NULL-day purchase precedes every dated one
        F.max(F.col("processed_date").isNull()).alias("_null_day"),
    )
    flags = blocks.join(first_nc, "customer", "left").join(first_day, ["customer", "product_code"], "left").select(*BLOCK, *_flags())
    return stored_table(flags.filter("drop_npu_anomaly OR drop_npu_repeat OR drop_renewal"), "flags")


def flagged_rows(sales: DataFrame) -> DataFrame:
    """Deduplicated rows with their block's removal flags attached (NULL without a flag).

    Hash aggregates and AQE-splittable joins, no window, so no task holds a whole customer.
    """
    dd = deduplicate(sales)
    flags = block_flags(sales)
    flags = flags.select(
        *[F.col(c).alias(f"_k_{c}") for c in BLOCK],
        "drop_npu_anomaly", "drop_npu_repeat", "drop_renewal",
    )
    cond = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in BLOCK]
    return dd.join(flags, cond, "left").select(
        *D.SALES_COLUMNS, "drop_npu_anomaly", "drop_npu_repeat", "drop_renewal"
    )


def flagged_rows_within(sales: DataFrame) -> DataFrame:
    """:func:`flagged_rows` of customers whose rows one task can hold: windows, no exchange if ``sales`` is parted by customer.

    The windows go from block to (customer, product) to customer, so one sort serves all three. NULL keys form groups
    here; the conditions on the rows leave these out.
    """
    product, customer = Window.partitionBy("customer", "product_code"), Window.partitionBy("customer")
    block = Window.partitionBy("customer", "product_code", "processed_date")
    day = F.col("processed_date")
    dd = deduplicate(sales)
    rows = dd.select("*", *[e.over(block).alias(n) for n, e in _facts(dd)]).select(
        "*", F.min(day).over(product).alias("_first_day"), F.max(day.isNull()).over(product).alias("_null_day")
    ).select("*", F.min(F.when(F.col("customer_status") == D.NEW_CUSTOMER, day)).over(customer).alias("_first_nc_day"))
    return rows.select(*D.SALES_COLUMNS, *_flags())


def _keys_present(*cols: str):
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def removal_conditions():
    """Row-level NOT EXISTS conditions (each never NULL)."""
    npu = F.coalesce(F.col("customer_status") == D.NEW_PRODUCT_USE, F.lit(False))
    ren = F.coalesce(F.col("customer_status") == D.RENEWAL, F.lit(False))
    all_keys = _keys_present(*BLOCK)
    day_keys = _keys_present("customer", "processed_date")
    return {
        "t08": npu & all_keys & F.coalesce(F.col("drop_npu_anomaly"), F.lit(False)),
        "t09": npu & all_keys & F.coalesce(F.col("drop_npu_repeat"), F.lit(False)),
        "t10": ren & day_keys & F.coalesce(F.col("drop_renewal"), F.lit(False)),
    }


def clean_rows(sales: DataFrame, removals: tuple[str, ...] = ("t07", "t08", "t09", "t10"), with_flags=flagged_rows) -> DataFrame:
    """Deduplicated rows that survive the chosen removals (raw nine columns)."""
    flagged = [r for r in ("t08", "t09", "t10") if r in removals]
    rows = with_flags(sales) if flagged else deduplicate(sales)
    keep = F.lit(True)
    if "t07" in removals:
        keep = keep & ~free_renewal_condition()
    for r in flagged:
        keep = keep & ~removal_conditions()[r]
    return rows.filter(keep).select(*D.SALES_COLUMNS)


# --- t11-t15: derived columns ----------------------------------------------------------------

def updated_license_type():
    """t11: (NC, Renew), (NC, Upgrade), (NPU, Renew) become New."""
    return F.when(license_fix_condition(), F.lit(D.LICENSE_NEW)).otherwise(F.col("license_type"))


def with_cents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_paid_c", to_cents("amount_in_usd")).withColumn(
        "_disc_c", to_cents("discount_in_usd")
    )


def clamped_discount_c():
    """t12: negative discount -> 0; NULL stays NULL."""
    return F.when(F.col("_disc_c") < 0, F.lit(0).cast("bigint")).otherwise(F.col("_disc_c"))


def surcharge_c():
    """t13: the negative part of the discount, never NULL."""
    return F.coalesce(F.when(F.col("_disc_c") < 0, -F.col("_disc_c")), F.lit(0).cast("bigint"))


def total_c():
    """t14: paid + clamped discount (the surcharge is not added)."""
    return F.col("_paid_c") + clamped_discount_c()


def discount_percentage():
    """t15: clamped discount / total x 100, 0 decimals half away from zero; NULL at total 0."""
    return div_round(
        "100 * (CASE WHEN _disc_c < 0 THEN 0 ELSE _disc_c END)",
        "(_paid_c + CASE WHEN _disc_c < 0 THEN 0 ELSE _disc_c END)",
    ).cast("double")


def derive_columns(rows: DataFrame) -> DataFrame:
    """Apply t11-t15 and publish the twelve staging columns."""
    c = with_cents(rows)
    return c.select(
        "customer",
        "customer_status",
        "product_code",
        "quantity",
        updated_license_type().alias("updated_license_type"),
        "processed_date",
        "discount_id",
        usd("_paid_c").alias("paid_amount_in_usd"),
        usd(clamped_discount_c()).alias("updated_discount_in_usd"),
        usd(surcharge_c()).alias("surcharge_amount_in_usd"),
        usd(total_c()).alias("total_amount_in_usd"),
        discount_percentage().alias("discount_percentage"),
    )


class ByCustomer(NamedTuple):
    """Sales partitioned by customer, each customer's rows few enough for one task."""

    rows: DataFrame


def staging_model(sales: DataFrame | ByCustomer, with_flags=flagged_rows) -> DataFrame:
    """t16: the whole staging model (twelve columns); of :class:`ByCustomer` rows by :func:`flagged_rows_within`."""
    if isinstance(sales, ByCustomer):
        sales, with_flags = sales.rows, flagged_rows_within
    return derive_columns(clean_rows(sales, with_flags=with_flags))


def derived_column(sales: DataFrame, which: str) -> DataFrame:
    """t11-t15 on their own: the deduplicated rows plus one derived column."""
    dd = with_cents(deduplicate(sales))
    col = {
        "t11": updated_license_type().alias("updated_license_type"),
        "t12": usd(clamped_discount_c()).alias("updated_discount_in_usd"),
        "t13": usd(surcharge_c()).alias("surcharge_amount_in_usd"),
        "t14": usd(total_c()).alias("total_amount_in_usd"),
        "t15": discount_percentage().alias("discount_percentage"),
    }[which]
    return dd.select(*D.SALES_COLUMNS, col)
