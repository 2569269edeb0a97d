"""Approximate column profiles as mergeable sketches, beside the exact s01.

The exact profile shuffles every distinct value of every column. A sketch profile is one pass that leaves a few
kilobytes per column whatever the input: HyperLogLog for distinct values, KLL for quantiles, both from Spark's own
aggregates. Stored sketches of batches merge into that of all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 14  # 2^14 registers: a standard error of about 0.8 %
TEXT = ("string", "boolean")  # types without quantiles
QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def sketches(sales: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(column_name, data_type, rows, non_null, distinct, quantiles): one row per column; the last two are sketches.

    Dates and numbers have a quantile sketch, over days since 1970 and doubles; it is NULL for text.
    """
    aggs, parts = [], []
    for i, f in enumerate(sales.schema.fields):
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        number = F.unix_date(c) if kind == "date" else c if kind not in TEXT else None
        aggs += [F.count(c).alias(f"n{i}"), F.hll_sketch_agg(c.cast("string"), lg_k).alias(f"d{i}")]
        if number is not None:
            aggs.append(F.kll_sketch_agg_double(number.cast("double")).alias(f"q{i}"))
        parts.append(F.struct(
            F.lit(f.name).alias("column_name"), F.lit(kind).alias("data_type"), F.col("rows"), F.col(f"n{i}").alias("non_null"),
            F.col(f"d{i}").alias("distinct"), (F.col(f"q{i}") if number is not None else F.lit(None).cast("binary")).alias("quantiles"),
        ))
    return sales.agg(F.count(F.lit(1)).alias("rows"), *aggs).select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def merged(*parts: DataFrame) -> DataFrame:
    """The sketches of several tables of rows as those of one."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("column_name", "data_type").agg(
        F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"), F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )


def profile(sketched: DataFrame) -> DataFrame:
    """(column_name, data_type, non_null_count, approx_distinct, approx_quantiles) of stored sketches."""
    ranks = F.array(*[F.lit(q) for q in QUANTILES])
    has_values = ~F.col("data_type").isin(*TEXT) & (F.col("non_null") > 0)
    quantiles = F.when(has_values, F.kll_sketch_get_quantile_double("quantiles", ranks))
    return sketched.select(
        "column_name", "data_type", F.col("non_null").alias("non_null_count"), F.hll_sketch_estimate("distinct").alias("approx_distinct"),
        quantiles.alias("approx_quantiles"),
    )
