"""CSV loads that survive bad rows: good rows and rejects are written in one pass, with a bound on the rejects.

A line is rejected if it has too few or too many columns, or a value that is not of its column's type. Rejects
keep the whole line and say why. A load with more rejects than the bound fails after it was written, so
what was rejected can be looked at.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from revcurve.functions import domain as D

LINE, REASON = "line", "reason"
WRONG_COLUMNS, UNREADABLE = "wrong number of columns", "unreadable: "


class Load(NamedTuple):
    """``good``: the nine sales columns; ``rejects``: (reason, line); ``read`` = good rows + ``rejected``."""

    good: DataFrame
    rejects: DataFrame
    read: int
    rejected: int


class TooManyRejects(ValueError):
    """More lines were rejected than the bound of the load allows."""


def _reason(header: list[str], types: Mapping[str, str], options: Mapping[str, str]) -> Column:
    """Why a line is rejected; NULL for a good one."""
    texts = ", ".join(f"`{c}` STRING" for c in header) + ", `_bad` STRING"
    seps = {k: v for k, v in options.items() if k in ("sep", "delimiter", "quote", "escape")}
    fields = F.from_csv(F.col("_corrupt"), F.lit(texts), {**seps, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    unreadable = F.array(*[F.when(F.expr(f"try_cast(_fields.`{c}` AS {types[c]})").isNull() & F.col(f"_fields.`{c}`").isNotNull(), F.lit(c))
                           for c in header if c in types])
    named = F.array_join(F.array_compact(unreadable), ", ")
    why = F.when(F.col("_fields._bad").isNotNull(), F.lit(WRONG_COLUMNS)).otherwise(F.concat(F.lit(UNREADABLE), named))
    return fields, F.when(F.col("_corrupt").isNotNull(), why)


def load_csv(
    spark: SparkSession,
    path: str,
    out: str,
    max_rejected_share: float = 0.01,
    rename: Mapping[str, str] | None = None,
    **options: str,
) -> Load:
    """Read the CSV sales export at ``path`` and write it under ``out``, good rows apart from rejects.

    Columns are found by name, as in ``read_sales``; the header of every file must be that of the first one.
    The input is scanned once and counted while it is written. More than ``max_rejected_share`` of all lines
    rejected raises :class:`TooManyRejects`.
    """
    ddl = dict(f.split(" ", 1) for f in D.SALES_DDL.split(", "))
    names = dict(rename or {})
    opts = {"header": "true", "mode": "PERMISSIVE", "enforceSchema": "false", **options}
    header = spark.read.options(**{**opts, "inferSchema": "false"}).csv(path).columns
    missing = [c for c in D.SALES_COLUMNS if c not in {names.get(h, h) for h in header}]
    if missing:
        raise ValueError(f"the sales export lacks the columns {missing}; it has {header}")
    types = {c: ddl[names.get(c, c)] for c in header if names.get(c, c) in ddl}
    schema = ", ".join(f"`{c}` {types.get(c, 'STRING')}" for c in header) + ", `_corrupt` STRING"
    raw = spark.read.options(**{**opts, "columnNameOfCorruptRecord": "_corrupt"}).schema(schema).csv(path)
    fields, why = _reason(header, types, options)
    named = {names.get(c, c): c for c in header}
    rows = raw.withColumn("_fields", fields).select(
        *[F.col(f"`{named[c]}`").alias(c) for c in D.SALES_COLUMNS], why.alias(REASON), F.col("_corrupt").alias(LINE)
    ).withColumn("rejected", F.col(REASON).isNotNull())
    seen = Observation("load_csv")
    rows = rows.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if("rejected").alias("rejected"))
    rows.write.partitionBy("rejected").parquet(out)
    read, rejected = seen.get["read"], seen.get["rejected"]
    written = spark.read.schema(rows.schema).parquet(out)
    if rejected > max_rejected_share * read:
        raise TooManyRejects(f"{rejected} of {read} lines were rejected, more than {max_rejected_share:.2%}; they are in {out}/rejected=true")
    return Load(
        written.where(~F.col("rejected")).select(*D.SALES_COLUMNS), written.where("rejected").select(REASON, LINE), read, rejected
    )
