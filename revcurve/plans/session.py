"""SparkSession set-up.

The settings that matter for this workload:

* AQE on, with partition coalescing and skew-join splitting: the per-customer joins of the
  models can meet a customer that owns a large share of all rows; AQE splits such a
  partition at run time.
* Shuffle partitions sized by the caller (default: 4 x cores locally; on a cluster, size it
  so one partition is ~128-256 MB of shuffle data).
* Session time zone UTC: dates are derived from timestamps without zone.
* The checkpoint folder is read from ``spark.checkpoint.dir``. Only a local master may run
  without it (tests, one machine); anything else fails, because executors on other machines
  would each write to a disk of their own.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even when that costs an extra shuffle downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "revcurve",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or get) a session with the settings above."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_one_machine(master: str) -> bool:
    """True for masters whose tasks all run in the driver's process."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder (``spark.checkpoint.dir``).

    Unset on a local master: a folder of this machine is chosen. Unset on any other master:
    an error, since a folder of one machine cannot be read by the others.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not is_one_machine(sc.master):
            raise RuntimeError(
                f"spark.checkpoint.dir is not set and the master is {sc.master}: set it to a folder "
                "that the driver and all executors share"
            )
        configured = tempfile.mkdtemp(prefix="revcurve-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
