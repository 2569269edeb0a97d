"""Skew-safe ``lag`` / ``lead`` / running total within ordered groups: a range-partitioned prefix scan.

A plain ``Window.partitionBy(group).orderBy(order)`` sends every row of a group to one task: a customer
that owns a third of all rows would become a single task holding a third of the data. Here the rows are
put in one global order instead, with one plan at every size:

1. One range exchange on (group, order), each partition sorted, and the result stored with its partition
   number and the row's place in the partition. A hot group simply spans several partitions.
2. One *edge* row per partition (its first and last row, and what its last group sums to). A window over
   the edges, one row per partition, carries them forward and backward.
3. A window over each stored partition gives every row its neighbours; the edges, joined by partition
   number, complete the partition's first and last row and the running totals of its first group.

The stored table is bucketed by a number that stands for the partition, so step 3 reads it partition by
partition without another exchange: one exchange of rows and one of edge rows in all. Each partition is
one task; there are ``slices`` of them (``spark.sql.shuffle.partitions``, or more when the input files
hold more than :data:`ORDERED_BYTES` for each: compressed rows take several times as much in an exchange and a sort).

The table is written while the DataFrame is built, under the session's shared checkpoint folder, and
stays there for as long as the result may be read; the folder's owner clears it.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revcurve.plans.session import ensure_checkpoint_dir
from revcurve.sources.files import save_model_table, scanned_bytes

SLICE_BYTES = 128 * 1024 * 1024
ORDERED_BYTES = 16 * 1024 * 1024
# Columns of a stored range-partitioned table: partition number, its bucket number, place in the partition.
SLICE, BUCKET, PLACE = "_nb_slice", "_nb_bucket", "_nb_place"
_PLACE_BITS = 33  # monotonically_increasing_id: the row number stands in the lower 33 bits

# how two partial totals combine and how the part before the group began is taken off again
TOTALS = {
    "sum": (F.sum, lambda a, b: a + b, lambda a, b: a - b),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), lambda a, b: a.bitwiseXOR(b)),
}


@functools.lru_cache(maxsize=16)
def _bucket_numbers(spark: SparkSession, n: int) -> list[int]:
    """For each partition number, an integer that ``bucketBy(n)`` puts into the bucket of that number."""
    tries = int(n * (math.log(n) + 12)) + 16
    number = F.col("id").cast("int")
    found = spark.range(tries).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("bucket")).agg(F.min(number).alias("number"))
    return [r["number"] for r in sorted(found.collect(), key=lambda r: r["bucket"])]


def _ascending(names: Sequence[str]):
    return [F.col(c).asc_nulls_first() for c in names]


def slice_count(df: DataFrame, slice_bytes: int = SLICE_BYTES) -> int:
    """Partitions of a copy of ``df``: the session's, or one per ``slice_bytes`` of input files."""
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, (scanned_bytes(df) or 0) // slice_bytes)


def store_slices(df: DataFrame, buckets: int) -> DataFrame:
    """``df``, which holds SLICE, stored with BUCKET: work by (BUCKET, ...) then needs no exchange.

    Every task of ``df`` writes the rows of its own slices; nothing is shuffled here.
    """
    spark = df.sparkSession
    numbers = F.array(*[F.lit(b) for b in _bucket_numbers(spark, buckets)])
    placed = df.withColumn(BUCKET, F.element_at(numbers, F.pmod(F.col(SLICE), F.lit(buckets)) + 1))
    name = f"revcurve_slices_{uuid.uuid4().hex}"
    save_model_table(placed, name, bucket_by=BUCKET, buckets=buckets, path=f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog entry only: the files are external to it
    return stored


def store_in_order(df: DataFrame, keys: Sequence[str], slices: int | None = None) -> DataFrame:
    """``df`` in the ascending order of ``keys`` (NULLs first), stored, with SLICE, BUCKET and PLACE.

    Rows equal in all ``keys`` share a slice. Windows and aggregates by (BUCKET, ...) need no exchange.
    """
    n = slices or slice_count(df, ORDERED_BYTES)
    row = F.monotonically_increasing_id()
    placed = df.repartitionByRange(n, *_ascending(keys)).sortWithinPartitions(*_ascending(keys)).select(
        "*", F.spark_partition_id().alias(SLICE), row.bitwiseAND((1 << _PLACE_BITS) - 1).alias(PLACE)
    )
    return store_slices(placed, n)


def _same_group(side: str, group: list[str]) -> Column:
    """Whether a neighbouring row (a struct, NULL for none) is of the row's own group."""
    same = F.col(side).isNotNull()
    for c in group:
        same = same & F.col(side)[c].eqNullSafe(F.col(c))
    return same


def _edges(stored: DataFrame, group: list[str], sources: list[str], totals: dict) -> DataFrame:
    """One row per slice: its neighbours' edge rows and the totals carried into its first group."""
    edges = slice_ends(stored, list(dict.fromkeys([*group, *sources])))
    of = lambda side: F.struct(*[F.col(side)[c].alias(c) for c in group])
    if totals:
        last = edges.select(BUCKET, of("last").alias("_nb_key"))
        rows = stored.join(last, BUCKET, "left").where(F.struct(*group).eqNullSafe(F.col("_nb_key")))
        sums = rows.groupBy(BUCKET).agg(*[TOTALS[kind][0](value).alias(f"_nb_{out}") for out, (kind, value) in totals.items()])
        edges = stored_table(edges.join(sums, BUCKET).repartition(1), "slice-totals")
    along = Window.orderBy(SLICE)  # one row per slice
    edges = edges.withColumn("_nb_first_key", of("first")).withColumn("_nb_last_key", of("last"))
    carried = [
        TOTALS[kind][0](f"_nb_{out}").over(Window.partitionBy("_nb_last_key").orderBy(SLICE)).alias(f"_nb_{out}")
        for out, (kind, _) in totals.items()
    ]
    edges = edges.select(SLICE, BUCKET, "first", "last", "_nb_first_key", "_nb_last_key", *carried)
    continued = F.lag("_nb_last_key").over(along).eqNullSafe(F.col("_nb_first_key")) & F.lag(SLICE).over(along).isNotNull()
    return edges.select(
        F.col(BUCKET),
        F.lag("last").over(along).alias("_nb_before"),
        F.lead("first").over(along).alias("_nb_after"),
        "_nb_first_key",
        *[F.when(continued, F.lag(f"_nb_{out}").over(along)).otherwise(F.lit(0)).cast("bigint").alias(f"_nb_carry_{out}")
          for out in totals],
    )


def stored_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed once, written under the shared checkpoint folder and read back."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/revcurve-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slice_ends(stored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(SLICE, BUCKET, first, last): the given columns of each slice's first and last row, stored; one row per slice.

    Every slice is read by a task of its own and no row is sorted; what meets in one task is the end rows.
    """
    sizes = stored.groupBy(BUCKET, SLICE).agg(F.max(PLACE).alias("_last_place"))  # one row per slice
    ends = stored.select(*columns, BUCKET, SLICE, PLACE).join(F.broadcast(sizes), [BUCKET, SLICE], "left")
    ends = ends.where((F.col(PLACE) == 0) | (F.col(PLACE) == F.col("_last_place")))
    values = F.struct(*columns)
    return stored_table(ends.groupBy(SLICE, BUCKET).agg(
        F.min_by(values, PLACE).alias("first"), F.max_by(values, PLACE).alias("last")
    ).repartition(1), "slice-ends")


def whole_group_neighbours(
    df: DataFrame, group: Sequence[str], order: Sequence[str], lag: Mapping[str, str] | None = None, lead: Mapping[str, str] | None = None
) -> DataFrame:
    """:func:`ordered_neighbours` of groups that one task can hold: plain windows, no exchange if ``df`` is parted by the group."""
    lag, lead = dict(lag or {}), dict(lead or {})
    row = Window.partitionBy(*group).orderBy(*_ascending(list(dict.fromkeys([*order, *lag.values(), *lead.values()]))))
    return df.select(
        "*", *[F.lag(src).over(row).alias(out) for out, src in lag.items()], *[F.lead(src).over(row).alias(out) for out, src in lead.items()]
    )


def ordered_neighbours(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    count_before: str | None = None,
    weight: str | None = None,
    running: Mapping[str, tuple[str, str]] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add neighbour columns to ``df``.

    ``lag``  maps output column -> source column; output is the source value of the previous
             row of the same group (NULL for the first row).
    ``lead`` same, for the next row.
    ``count_before`` names an output column holding the number of earlier rows of the group
             (or the sum of ``weight`` over them when ``weight`` names a multiplicity column).
    ``running`` maps output column -> (``"sum"`` or ``"xor"``, bigint source column without NULLs):
             the total over the group up to and including the row.

    Sort order is ascending with NULLs first for every ``order`` column; NULLs of ``group`` are
    one group. Ties in ``order`` are broken by the source columns, then arbitrarily.
    """
    lag, lead, running = dict(lag or {}), dict(lead or {}), dict(running or {})
    group, order = list(group), list(order)
    sources = [c for c in dict.fromkeys([*lag.values(), *lead.values()]) if c not in group + order]
    stored = store_in_order(df, [*group, *order, *sources], slices)

    one = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    totals = {out: (kind, F.col(src)) for out, (kind, src) in running.items()}
    if count_before:
        totals["_nb_count"] = ("sum", one)
    carried = list(dict.fromkeys([*group, *lag.values(), *lead.values()]))
    edges = _edges(stored, group, carried, totals)

    key = F.struct(*group)
    beside = F.struct(*carried)
    row = Window.partitionBy(BUCKET).orderBy(PLACE)
    so_far = row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = [F.lag(beside).over(row).alias("_nb_lag")]
    if lead:
        spans.append(F.lead(beside).over(row).alias("_nb_lead"))
    spans += [TOTALS[kind][0](value).over(so_far).alias(f"_nb_total_{out}") for out, (kind, value) in totals.items()]
    rows = stored.select("*", *spans)
    if totals:
        # the total at the end of the row before the group began, in this slice
        begins = (F.col(PLACE) == 0) | ~_same_group("_nb_lag", group)
        rows = rows.select("*", *[
            F.last(F.when(begins, TOTALS[kind][2](F.col(f"_nb_total_{out}"), value)), ignorenulls=True).over(so_far).alias(f"_nb_base_{out}")
            for out, (kind, value) in totals.items()
        ])
    joined = rows.join(edges, BUCKET, "left")  # left: the rows are never the side to broadcast

    # NULL beside the slice's first / last row: the neighbour is in another slice
    joined = joined.withColumn("_nb_lag", F.coalesce("_nb_lag", "_nb_before"))
    if lead:
        joined = joined.withColumn("_nb_lead", F.coalesce("_nb_lead", "_nb_after"))

    def neighbour(near: str, src: str):
        return F.when(_same_group(near, group), F.col(near)[src])

    def total(out: str):
        _, join, less = TOTALS[totals[out][0]]
        own = less(F.col(f"_nb_total_{out}"), F.col(f"_nb_base_{out}"))
        return F.when(F.col("_nb_first_key").eqNullSafe(key), join(own, F.col(f"_nb_carry_{out}"))).otherwise(own)

    out_cols = [F.col(c) for c in df.columns]
    out_cols += [neighbour("_nb_lag", src).alias(out) for out, src in lag.items()]
    out_cols += [neighbour("_nb_lead", src).alias(out) for out, src in lead.items()]
    out_cols += [total(out).alias(out) for out in running]
    if count_before:
        out_cols.append((total("_nb_count") - one).alias(count_before))
    return joined.select(*out_cols)
