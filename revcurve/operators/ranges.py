"""Expand integer ranges into rows without letting one long range become one task.

``explode(sequence(a, b))`` produces all ``b - a + 1`` rows in the task that holds the input
row. When a collapsed group of copies is expanded back (a multiplicity of billions, if one
group of copies holds a third of all rows), that single task would produce them all.

``explode_range`` first cuts each range into chunks of at most ``chunk`` values (a long
range yields one small descriptor row per chunk), spreads the descriptors over tasks by a
hash of the row and the chunk number, and only then expands each chunk. Every task emits at
most about (total output / partitions) rows plus one chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 20


def explode_range(
    df: DataFrame,
    first: Column,
    last: Column,
    name: str,
    chunk: int = CHUNK_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """One output row per integer ``v`` in ``[first, last]`` (none when ``last < first``),
    with ``v`` in the BIGINT column ``name``."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns
    spans = (
        df.withColumn("_er_first", first.cast("bigint"))
        .withColumn("_er_last", last.cast("bigint"))
        .filter(F.col("_er_last") >= F.col("_er_first"))
    )
    n_chunks = F.floor((F.col("_er_last") - F.col("_er_first")) / F.lit(chunk)).cast("bigint")
    chunks = spans.withColumn("_er_c", F.explode(F.sequence(F.lit(0).cast("bigint"), n_chunks)))
    # hash over the row's own columns and the chunk number: ordinary rows spread by content,
    # the chunks of one long range spread by number
    spread = chunks.repartition(n, *cols, "_er_c")
    lo = F.col("_er_first") + F.col("_er_c") * F.lit(chunk)
    hi = F.least(F.col("_er_last"), lo + F.lit(chunk - 1))
    return spread.select(*cols, F.explode(F.sequence(lo, hi)).alias(name))
