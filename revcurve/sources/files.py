"""Readers for the raw sales table and sinks for the derived models.

``read_sales`` reads CSV (the shape the sales export arrives in) or Parquet with an explicit
schema: no inference pass over the data, and Parquet scans keep column pruning and filter
pushdown. ``write_model`` persists a model under its name so that later models read the
table instead of recomputing it; ``read_model`` reads it back.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcurve.functions import domain as D


def read_sales(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    rename: Mapping[str, str] | None = None,
    **options: str,
) -> DataFrame:
    """Read the raw sales table and return the nine sales columns with their types.

    Columns are found by name in every format, whatever their order; extra columns are left out
    and a missing one is an error. ``rename`` maps source column names to sales column names.
    CSV has a header and typed columns: a value that is not of its column's type fails the read
    (``FAILFAST``), and so does a file whose header differs from the others'. Parquet is read as
    stored and cast, so pruning and pushdown still reach the scan.
    """
    types = dict(f.split(" ", 1) for f in D.SALES_DDL.split(", "))
    names = dict(rename or {})
    if fmt == "csv":
        opts = {"header": "true", "mode": "FAILFAST", "enforceSchema": "false", **options}
        header = spark.read.options(**{**opts, "mode": "PERMISSIVE", "inferSchema": "false"}).csv(path).columns
        ddl = ", ".join(f"`{c}` {types.get(names.get(c, c), 'string')}" for c in header)
        df = spark.read.options(**opts).schema(ddl).csv(path)
    else:
        df = spark.read.options(**options).format(fmt).load(path)
    for src, dst in names.items():
        df = df.withColumnRenamed(src, dst)
    missing = [c for c in D.SALES_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"the sales export lacks the columns {missing}; it has {df.columns}")
    return df.select(*[F.col(c).cast(types[c]).alias(c) for c in D.SALES_COLUMNS])


def write_model(
    df: DataFrame,
    path: str,
    partition_by: tuple[str, ...] = (),
    mode: str = "overwrite",
    fmt: str = "parquet",
) -> None:
    """Persist a model (Parquet by default; CSV / ORC / JSON for extracts), optionally
    partitioned by columns (e.g. a large mart by month)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def save_model_table(
    df: DataFrame,
    name: str,
    bucket_by: str | None = None,
    buckets: int = 0,
    sort_by: tuple[str, ...] = (),
    path: str | None = None,
) -> None:
    """Persist a model as a catalog table, optionally bucketed (e.g. staging by customer).

    A table bucketed by ``customer`` lets later per-customer jobs skip their shuffle.
    ``path`` makes it an external table at that location (a shared folder on a cluster)
    instead of the warehouse folder.
    """
    w = df.write.mode("overwrite").format("parquet")
    if path:
        w = w.option("path", path)
    if bucket_by and buckets > 0:
        w = w.bucketBy(buckets, bucket_by)
        if sort_by:
            w = w.sortBy(*sort_by)
    w.saveAsTable(name)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """Read a model written by :func:`write_model`."""
    return spark.read.parquet(path)


def _hadoop(spark: SparkSession, path: str):
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hp


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its Hadoop file system."""
    fs, hp = _hadoop(spark, path)
    return fs.exists(hp)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on its Hadoop file system, if it exists."""
    fs, hp = _hadoop(spark, path)
    fs.delete(hp, True)


# Leaves whose size statistics are the data actually read.
_SIZED_LEAVES = ("LogicalRelation", "HiveTableRelation", "LocalRelation", "DataSourceV2Relation",
                 "DataSourceV2ScanRelation", "Range")


def scanned_bytes(df: DataFrame) -> int | None:
    """Bytes of the relations ``df`` reads (file sizes), or None when one is unknown.

    Plan-level estimates multiply through joins and can be off by orders of magnitude; the
    leaves' sizes are the files actually scanned.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() not in _SIZED_LEAVES:
            return None  # e.g. an RDD-backed relation carrying a stale plan estimate
        size = int(str(leaf.stats().sizeInBytes()))
        if size >= 1 << 62:
            return None
        total += size
    return total
