"""The models kept up to date batch by batch: only the parts that hold customers of a batch are computed again.

Every rule of the models looks at one customer's rows, so a batch of sales changes the staging rows, the
transitions and the change events of the customers in it, and of nobody else. The tables lie under one folder,
parted by a hash of the customer:

``raw``            the sales rows of every batch, ``batch=<id>/part=<n>``
``stg_sales_data``, ``mart_transactional_analysis``, ``change_events``   the customers' rows, ``part=<n>``
``month_changes``  per part and month the sums that the subscription mart is made of

:func:`add_batch` stores the batch, finds the parts of its customers, computes these parts again from all their raw
rows and replaces them (dynamic partition overwrite). A part that no customer of the batch falls into is neither
read nor written. The subscription mart is then a sum over parts x months rows.

The raw rows are moved once, by customer: staging is stored in buckets of customers, and the staging rules, the
transitions and the billing intervals are windows within a bucket. So no row of another customer is looked up or
joined, and nothing is moved again to be written. A customer with more rows than a task should hold goes
through the operators of the full models, which spread it.

Whatever a run left behind when it was lost, running the same batch again gives the same tables: the raw
rows of a batch replace those of an earlier try, and all else is a function of the raw rows. Batches may come
in any order, overlap, repeat rows or bring old days.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revcurve.functions import domain as D
from revcurve.operators import staging as T
from revcurve.operators import subscription as M
from revcurve.operators import transitions as J
from revcurve.operators.explore import deduplicate
from revcurve.operators.neighbours import ORDERED_BYTES, slice_count, stored_table, whole_group_neighbours
from revcurve.plans.models import STAGING, TRANSACTIONAL
from revcurve.plans.session import ensure_checkpoint_dir
from revcurve.sources.files import delete_folder, folder_exists, save_model_table

RAW, EVENTS, MONTHS = "raw", "change_events", "month_changes"
PART = "part"
PARTS = 64
WHOLE_ROWS = 1 << 20


def part_of(parts: int) -> Column:
    """A customer's part; the customer NULL has one too."""
    return F.pmod(F.hash("customer"), F.lit(parts))


def _same_customer(a: str, b: str) -> Column:
    return F.col(f"{a}.customer").eqNullSafe(F.col(f"{b}.customer"))


def _of(rows: DataFrame, customers: DataFrame, how: str) -> DataFrame:
    """Rows of the customers (``left_semi``) or of all others (``left_anti``), NULL being a customer."""
    return rows.alias("r").join(customers.alias("c"), _same_customer("r", "c"), how)


def _held(path: str, like: DataFrame, hit: Sequence[int]) -> DataFrame:
    """The parts ``hit`` of a table with the columns of ``like``."""
    return like.sparkSession.read.schema(like.schema).parquet(path).where(F.col(PART).isin(list(hit)))


def _files(path: str, like: DataFrame) -> set[str]:
    return set(like.sparkSession.read.schema(like.schema).parquet(path).inputFiles())


def _replace(path: str, rows: DataFrame, hit: Sequence[int]) -> None:
    """Make ``rows``, which must not read the table, the content of the parts ``hit``; parts left without rows are deleted."""
    spark, before = rows.sparkSession, _files(path, rows)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    # a part that was written holds new files only
    kept = {int(re.search(rf"/{PART}=(-?\d+)/", f)[1]) for f in before & _files(path, rows)}
    for part in kept & set(hit):
        delete_folder(spark, f"{path}/{PART}={part}")


def _begin(path: str, like: DataFrame) -> None:
    """A new table gets one part without rows, which keeps its columns when it holds no others."""
    if not folder_exists(like.sparkSession, path):
        like.drop(PART).limit(0).coalesce(1).write.parquet(f"{path}/{PART}=-1")


def _staged(raw: DataFrame, parts: int, path: str) -> DataFrame:
    """The staging model of customers whose rows one task can hold, stored by customer: what runs by customer then needs no exchange.

    The number of buckets is a multiple of ``parts``, so a bucket's customers are of one part.
    """
    spark, buckets = raw.sparkSession, parts * -(-slice_count(raw, ORDERED_BYTES) // parts)
    name = f"revcurve_staged_{uuid.uuid4().hex}"
    by_customer = raw.select(*D.SALES_COLUMNS).repartition(buckets, "customer")
    save_model_table(T.staging_model(T.ByCustomer(by_customer)), name, bucket_by="customer", buckets=buckets, path=path)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog entry only: the files are external to it
    return stored


def add_batch(spark: SparkSession, root: str, batch: DataFrame, batch_id: str, parts: int = PARTS, whole_rows: int = WHOLE_ROWS) -> list[int]:
    """Add the sales rows of ``batch`` to the tables under ``root``; returns the parts it changed.

    ``parts`` must stay the same for all batches of a folder. A batch without rows changes nothing. Customers of more
    than ``whole_rows`` rows are computed by the operators that spread a customer over tasks; no result depends on it.
    """
    root = root.rstrip("/")
    of_batch = f"{root}/{RAW}/batch={batch_id}"
    rows = deduplicate(batch).withColumn(PART, part_of(parts))
    rows.write.mode("overwrite").partitionBy(PART).parquet(of_batch)
    if not spark.read.schema(rows.schema).parquet(of_batch).head(1):
        return []
    hit = sorted(r[PART] for r in spark.read.parquet(of_batch).select(PART).distinct().collect())  # at most one row for each part

    raw = spark.read.parquet(f"{root}/{RAW}").where(F.col(PART).isin(hit))
    # at most one customer for every whole_rows rows
    large = stored_table(raw.groupBy("customer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole_rows).select("customer"), "large")
    split = bool(large.head(1))
    staged = f"{ensure_checkpoint_dir(spark).rstrip('/')}/revcurve-staged-{uuid.uuid4().hex}"
    stg = _staged(_of(raw, F.broadcast(large), "left_anti") if split else raw, parts, staged)
    models = {
        STAGING: stg, TRANSACTIONAL: J.transactional_mart(stg, whole_group_neighbours),
        EVENTS: M.change_events(M.classified(stg, whole_group_neighbours)),
    }
    if split:
        spread = stored_table(T.staging_model(_of(raw, F.broadcast(large), "left_semi").select(*D.SALES_COLUMNS)), "staged-large")
        models[STAGING] = stg.unionByName(spread)
        models[TRANSACTIONAL] = models[TRANSACTIONAL].unionByName(J.transactional_mart(spread))
        models[EVENTS] = models[EVENTS].unionByName(M.change_events(M.classified(spread)))
    for name, new in models.items():
        new = new.withColumn(PART, part_of(parts))
        _begin(f"{root}/{name}", new)
        _replace(f"{root}/{name}", new, hit)
    months = M.month_changes(_held(f"{root}/{EVENTS}", new, hit), (PART,))
    _begin(f"{root}/{MONTHS}", months)
    _replace(f"{root}/{MONTHS}", months, hit)
    delete_folder(spark, staged)
    return hit


def staging(spark: SparkSession, root: str) -> DataFrame:
    """The staging model as of the last batch."""
    return spark.read.parquet(f"{root.rstrip('/')}/{STAGING}").select(*D.STAGING_COLUMNS)


def transactional_mart(spark: SparkSession, root: str) -> DataFrame:
    """The transactional mart as of the last batch."""
    return spark.read.parquet(f"{root.rstrip('/')}/{TRANSACTIONAL}").select(*D.TRANSACTIONAL_COLUMNS)


def subscription_mart(spark: SparkSession, root: str) -> DataFrame:
    """The subscription mart as of the last batch, from the months of all parts."""
    changes = M.merged_changes(spark.read.parquet(f"{root.rstrip('/')}/{MONTHS}"))
    return M.publish(M.month_over_month(M.aggregation_of_changes(changes)))
