"""The raw ``sales`` table derived from the TPC-H-style test tables.

The modelled workload reads a nine-column sales table. The test suite has no such table, so
one is derived deterministically from ``lineitem`` joined with ``orders``; every value comes
from integer arithmetic on the source columns, so any engine derives the same rows. Each
rule below is a fixture definition, not business logic.

Scale notes
-----------
* ``lineitem`` and ``orders`` are joined on the order key: a shuffle join at scale (AQE turns
  it into a broadcast join only when the runtime size of ``orders`` is under the broadcast
  threshold, i.e. behind a size check).
* Each customer's first purchase day depends only on the order dates, so it is an aggregate
  over ``orders`` (restricted to orders that have lines) joined back to ``orders``: the
  order-line rows are never partitioned by customer, so a hot customer does not skew them.
* Duplicate rows (the fixture's exact copies) come from a narrow ``explode``, not a union.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import os
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcurve.functions import domain as D
from revcurve.plans.session import ensure_checkpoint_dir
from revcurve.sources.files import read_sales, scanned_bytes

# --- fixed values: parameters of the fixture mapping ----------------------------------------
PRODUCT_COUNT = 13
PRODUCT_CODES = [f"P{i:02d}" for i in range(PRODUCT_COUNT)]
DATE_ORIGIN = _dt.date(1995, 1, 1)
DATE_BASE = _dt.date(2018, 1, 1)
DATE_SPAN_DAYS = 1096
FREE_PRICE_MODULUS = 997
PRICE_MODULUS = 1500
PRODUCT_PRICE_STEP_CENTS = 4000
FULL_DISCOUNT_TAX = 8
CODE_SUPPLIER_MODULUS = 8
CODE_BASE = 100
CODE_COUNT = 115
DOUBLE_QUANTITY = 50
DUPLICATE_ORDER_MODULUS = 40


def _processed_date():
    day = F.pmod(
        F.datediff(F.to_date("o_orderdate"), F.lit(DATE_ORIGIN)), F.lit(DATE_SPAN_DAYS)
    )
    return F.date_add(F.lit(DATE_BASE), day.cast("int"))


def _mapped_rows(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    li = lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )
    od = orders.select(
        "o_orderkey", F.col("o_custkey").alias("customer"), _processed_date().alias("processed_date")
    )
    # first purchase day per customer, over the orders that have at least one line
    with_lines = od.join(
        lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi"
    )
    first_day = with_lines.groupBy("customer").agg(F.min("processed_date").alias("_fd"))
    od = od.join(first_day, "customer", "inner")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    return j.select(
        "customer",
        F.col("l_orderkey").alias("_ok"),
        F.col("l_suppkey").alias("_s"),
        F.col("l_linenumber").alias("_ln"),
        (F.col("l_partkey") % PRODUCT_COUNT).alias("_p"),
        F.floor("l_extendedprice").cast("bigint").alias("_ep"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("_pct"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("_tax"),
        F.col("l_quantity").alias("_q"),
        "processed_date",
        "_fd",
    )


def sales_from_tables(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Map ``lineitem`` x ``orders`` onto the nine sales columns (plus exact duplicates)."""
    rows = _mapped_rows(lineitem, orders)

    s, ln, p = F.col("_s"), F.col("_ln"), F.col("_p")
    ep, pct, tax = F.col("_ep"), F.col("_pct"), F.col("_tax")
    gross = F.expr(f"(_p + 1) * {PRODUCT_PRICE_STEP_CENTS} + _ep % {PRICE_MODULUS}")
    net_part = F.expr(
        f"((_p + 1) * {PRODUCT_PRICE_STEP_CENTS} + _ep % {PRICE_MODULUS}) * _pct div 100"
    )
    free = ep % FREE_PRICE_MODULUS == 0
    full = tax == FULL_DISCOUNT_TAX
    plain = (tax == 0) & (pct == 0)
    amount_c = (
        F.when(free, F.lit(0)).when(full, F.lit(0)).when(plain, gross)
        .otherwise(gross - net_part)
    )
    discount_c = (
        F.when(free, F.lit(0)).when(full, gross)
        .when(plain, -F.expr(f"((_p + 1) * {PRODUCT_PRICE_STEP_CENTS} + _ep % {PRICE_MODULUS}) div 10"))
        .otherwise(net_part)
    ).cast("bigint")

    first_day_status = (
        F.when(ln % 4 == 0, D.RENEWAL).when(ln % 4 == 3, D.NEW_PRODUCT_USE)
        .otherwise(D.NEW_CUSTOMER)
    )
    later_status = (
        F.when(s % 5 == 2, D.ADDITIONAL_LICENSES).when(s % 5 == 3, D.NEW_PRODUCT_USE)
        .otherwise(D.RENEWAL)
    )
    status = F.when(
        (F.col("processed_date") == F.col("_fd")) & (F.col("customer") % 5 != 0),
        first_day_status,
    ).otherwise(later_status)

    s20 = s % 20
    license_type = (
        F.when(F.col("customer_status") == D.NEW_CUSTOMER,
               F.when(s20 == 0, D.LICENSE_RENEW).when(s20 == 1, D.LICENSE_UPGRADE)
               .otherwise(D.LICENSE_NEW))
        .when(F.col("customer_status") == D.NEW_PRODUCT_USE,
              F.when(s20 == 3, D.LICENSE_RENEW).when(s20 == 8, D.LICENSE_UPGRADE)
              .otherwise(D.LICENSE_NEW))
        .when(F.col("customer_status") == D.ADDITIONAL_LICENSES, F.lit(D.LICENSE_NEW))
        .otherwise(F.when(s20.isin(4, 9), D.LICENSE_UPGRADE).otherwise(D.LICENSE_RENEW))
    )

    mapped = (
        rows.withColumn("customer_status", status)
        .withColumn("_amount_c", amount_c.cast("bigint"))
        .withColumn("_discount_c", discount_c)
        .select(
            "customer",
            "customer_status",
            F.concat(F.lit("P"), F.lpad(p.cast("string"), 2, "0")).alias("product_code"),
            license_type.alias("license_type"),
            "processed_date",
            F.when((F.col("_discount_c") > 0) & (s % CODE_SUPPLIER_MODULUS == 0),
                   F.lit(CODE_BASE) + s % CODE_COUNT).cast("bigint").alias("discount_id"),
            F.when(F.col("_q") == DOUBLE_QUANTITY, 2).otherwise(1).cast("int").alias("quantity"),
            (F.col("_amount_c") / F.lit(100.0)).alias("amount_in_usd"),
            (F.col("_discount_c") / F.lit(100.0)).alias("discount_in_usd"),
            F.explode(
                F.when(F.col("_ok") % DUPLICATE_ORDER_MODULUS == 0, F.array(F.lit(1), F.lit(2)))
                .otherwise(F.array(F.lit(1)))
            ).alias("_copy"),
        )
        .drop("_copy")
    )
    return mapped.select(*D.SALES_COLUMNS)


def sales_from_testdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read ``lineitem`` and ``orders`` under ``sf_dir`` and derive the sales table (lazy)."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return sales_from_tables(lineitem, orders)


_LOADED: dict[tuple[str, str], str] = {}
_LOAD_LOCK = threading.Lock()
FILE_INPUT_BYTES = 128 * 1024 * 1024


def load_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales table of ``sf_dir``, written once per application and then read as Parquet.

    Like loading the sales export into the warehouse: every query then scans a stored
    nine-column table (filters and column pruning reach that scan) instead of re-deriving it.
    The table is written under the session's checkpoint folder (``spark.checkpoint.dir`` on a
    cluster: a shared folder), in a sub-folder unique to this application.
    """
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    with _LOAD_LOCK:  # queries built from several threads write the table once
        path = _load_once(spark, sf_dir, key)
    return read_sales(spark, path)


def _load_once(spark: SparkSession, sf_dir: str, key: tuple[str, str]) -> str:
    path = _LOADED.get(key)
    if path is None:
        base = ensure_checkpoint_dir(spark)
        tag = hashlib.sha1(key[1].encode()).hexdigest()[:16]
        path = f"{base.rstrip('/')}/revcurve-sales-{tag}"
        sales = sales_from_testdata(spark, sf_dir)
        # one file per 128 MB of scanned input, at least one per core: later scans start with
        # full parallelism whatever AQE coalesced the derivation's last shuffle to
        scanned = scanned_bytes(sales) or 0
        files = max(spark.sparkContext.defaultParallelism, scanned // FILE_INPUT_BYTES)
        sales.repartition(int(files)).write.mode("overwrite").parquet(path)
        _LOADED[key] = path
    return path
