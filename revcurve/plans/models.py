"""Persist the models under their names, marts reading the stored staging model.

``write_models`` is the batch job: staging is computed from the raw sales once and written;
both marts then read the written staging table (its Parquet scan, with pruning), exactly as
the marts of the modelled project read the staging model by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revcurve.operators import staging as T
from revcurve.operators import subscription as M
from revcurve.operators import transitions as J
from revcurve.sources.files import read_model, write_model

STAGING = "stg_sales_data"
SUBSCRIPTION = "mart_subscription_metrics"
TRANSACTIONAL = "mart_transactional_analysis"


def write_models(spark: SparkSession, sales: DataFrame, root: str) -> dict[str, str]:
    """Write staging, then both marts from the written staging; return name -> path."""
    paths = {name: f"{root.rstrip('/')}/{name}" for name in (STAGING, SUBSCRIPTION, TRANSACTIONAL)}
    write_model(T.staging_model(sales), paths[STAGING])
    stg = read_model(spark, paths[STAGING])
    write_model(M.subscription_mart(stg), paths[SUBSCRIPTION])
    write_model(J.transactional_mart(stg), paths[TRANSACTIONAL])
    return paths
