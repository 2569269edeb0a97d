"""Figures of the sales table taken while it is read for something else: no scan of their own.

``observed`` hangs the counts, ranges and checks of s02 and s08-s11b on a DataFrame; whatever job then reads it
(writing the staging model, a load) computes them on the side. The days and discount codes are gathered as sets,
whose size the calendar and the catalogue of codes bound.

Spark adds the figures up over finished tasks; a stage that is computed again after a lost executor may be
counted twice, so a load that reports odd figures is checked with the queries themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from revcurve.sources.files import write_model

FIGURES = "total_transactions BIGINT, min_date DATE, max_date DATE, distinct_days BIGINT, distinct_discount_ids BIGINT, " \
    "rows_without_code BIGINT, min_amount DOUBLE, max_amount DOUBLE, sub_cent_amounts BIGINT, sub_cent_discounts BIGINT"


def observed(sales: DataFrame, name: str = "sales") -> tuple[DataFrame, Observation]:
    """``sales`` with its figures hung on, and where they can be had after the first job that reads it."""
    def off(c: str):
        return F.count_if(F.col(c) * 100 != F.round(F.col(c) * 100))

    seen = Observation(name)
    return sales.observe(
        seen,
        F.count(F.lit(1)).alias("total_transactions"),
        F.min("processed_date").alias("min_date"), F.max("processed_date").alias("max_date"),
        F.size(F.collect_set("processed_date")).cast("bigint").alias("distinct_days"),
        F.size(F.collect_set("discount_id")).cast("bigint").alias("distinct_discount_ids"),
        F.count_if(F.col("discount_id").isNull()).alias("rows_without_code"),
        F.min("amount_in_usd").alias("min_amount"), F.max("amount_in_usd").alias("max_amount"),
        off("amount_in_usd").alias("sub_cent_amounts"), off("discount_in_usd").alias("sub_cent_discounts"),
    ), seen


def write_observed(sales: DataFrame, model: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Write ``model(sales)`` to ``path``; one row with the figures of ``sales``, which is not read for them.

    Only for a model that does not read the rows it is given are they read on their own: the figures would never come.
    """
    rows, seen = observed(sales)
    written = model(rows)
    write_model(written, path)
    if "CollectMetrics" not in written._jdf.queryExecution().analyzed().toString():
        rows.write.format("noop").mode("overwrite").save()
    names = [f.split(" ")[0] for f in FIGURES.split(", ")]
    return sales.sparkSession.createDataFrame([tuple(seen.get[n] for n in names)], FIGURES)
