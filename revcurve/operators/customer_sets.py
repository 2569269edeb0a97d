"""Exact distinct customers that can be stored, merged and rolled up: bitmaps by key and block of ids.

``count(DISTINCT customer)`` shuffles every (key, customer) pair for every question and cannot be added up. Here
one scan leaves a small table: per combination of the six profile keys and block of 32,768 customer ids, a
bitmap of the customers and the number of rows, combined in the map tasks before anything moves. Tables
of several batches merge by OR, and every question about fewer keys is a roll-up by OR, all of them together in
one pass of grouping sets. Counting is exact.

A bitmap takes 4 KB, so ids should be dense (a key of a dimension table); sparse ids cost space, not correctness.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("customer_status", "license_type", "product_code", "quantity", "is_null_discount_id", "discount_amount_flag")
# question: its keys. s02, s04-s07, s10, s13 and e05.
QUESTIONS = {
    "s02": (), "s04": ("customer_status",), "s05": ("product_code",), "s06": ("quantity",), "s07": ("license_type",),
    "s10": ("is_null_discount_id",), "s13": ("discount_amount_flag", "is_null_discount_id"), "e05": ("customer_status", "license_type"),
}


def customer_sets(sales: DataFrame) -> DataFrame:
    """One row per combination of KEYS and block of ids: ``rows`` and the bitmap ``customers``.

    Rows without a customer count as rows and set no bit.
    """
    d = F.col("discount_in_usd")
    sign = F.when(d < 0, "negative").when(d == 0, "zero").when(d > 0, "positive")
    keyed = sales.withColumn("is_null_discount_id", F.col("discount_id").isNull()).withColumn("discount_amount_flag", sign)
    return keyed.groupBy(*KEYS, F.bitmap_bucket_number("customer").alias("block")).agg(
        F.count(F.lit(1)).alias("rows"), F.bitmap_construct_agg(F.bitmap_bit_position("customer")).alias("customers")
    )


def merged(*sets: DataFrame) -> DataFrame:
    """The sets of several tables of rows as those of one."""
    rows = reduce(DataFrame.unionByName, sets)
    return rows.groupBy(*KEYS, "block").agg(F.sum("rows").alias("rows"), F.bitmap_or_agg("customers").alias("customers"))


def answers(sets: DataFrame, questions: dict[str, tuple[str, ...]] = QUESTIONS) -> DataFrame:
    """(question, KEYS, total_records, total_unique_customers): all questions from one pass over the sets.

    Keys that a question does not ask for are NULL in its rows.
    """
    block = F.col("block")
    grouped = sets.groupingSets([[*map(F.col, keys), block] for keys in questions.values()], *map(F.col, KEYS), block).agg(
        F.grouping_id().alias("_id"), F.sum("rows").alias("rows"), F.bitmap_count(F.bitmap_or_agg("customers")).alias("customers")
    )
    totals = grouped.groupBy(*KEYS, "_id").agg(
        F.sum("rows").cast("bigint").alias("total_records"), F.sum("customers").cast("bigint").alias("total_unique_customers")
    )
    # the bits of the grouping id: a key is set where the question leaves it out; the block, the last bit, never is
    ids = {name: 2 * sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in keys) for name, keys in questions.items()}
    names = F.create_map(*[F.lit(x) for name, i in ids.items() for x in (i, name)])
    found = totals.select(names[F.col("_id").cast("int")].alias("question"), *KEYS, "total_records", "total_unique_customers")
    return found
