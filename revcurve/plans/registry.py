"""Query registry: one callable ``(spark, sf_dir) -> DataFrame`` per operator ID.

Every query starts from the raw sales table derived from the test tables under ``sf_dir``
(written once per application, see ``load_sales``) and runs over all of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcurve.functions import domain as D
from revcurve.operators import customer_sets as C
from revcurve.operators import dashboard as B
from revcurve.operators import explore as E
from revcurve.operators import observed as O
from revcurve.operators import profile as P
from revcurve.operators import staging as T
from revcurve.operators import subscription as M
from revcurve.operators import transitions as J
from revcurve.plans import incremental as I
from revcurve.plans.session import ensure_checkpoint_dir
from revcurve.sources import rejects as R
from revcurve.sources.files import read_model, read_sales, write_model
from revcurve.sources.testdata import PRODUCT_CODES, load_sales

Query = Callable[[SparkSession, str], DataFrame]


def _on_sales(fn: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_sales(spark, sf_dir))

    run.__doc__ = fn.__doc__
    return run


def _customer_lookup(sales: DataFrame) -> DataFrame:
    return E.customer_rows(sales, E.surcharged_customers(sales))


def _single_customer(sales: DataFrame) -> DataFrame:
    """e10b: the rows of one id taken from the data, the smallest customer with a surcharge."""
    wanted = E.surcharged_customers(sales).agg(F.min("customer")).first()[0]
    return E.customer_rows(sales, wanted)


PROFILE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "s01_schema_profile": P.schema_profile,
    "s02_totals": P.totals,
    "s03_txn_histogram": P.transaction_histogram,
    "s04_by_status": P.by_status,
    "s05_by_product": P.by_product,
    "s06_by_quantity": P.by_quantity,
    "s07_by_license": P.by_license,
    "s08_date_range": P.date_range,
    "s09_discount_codes": P.discount_codes,
    "s10_code_presence": P.code_presence,
    "s11_amount_range": P.amount_range,
    "s11b_sub_cent_amounts": P.sub_cent_amounts,
    "s12_discount_ge_amount": P.discount_at_least_amount,
    "s13_sign_by_code": P.discount_sign_by_code,
}

EXPLORE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "e01_dedup": E.dedup_with_row_num,
    "e01b_duplicates": E.duplicate_copies,
    "e01c_dedup_totals": E.dedup_totals,
    "e02_zero_revenue_codes": E.zero_revenue_codes,
    "e03_free_renewals": E.free_renewals,
    "e04_not_free_renewals": E.not_free_renewals,
    "e05_status_license": E.status_license,
    "e06_suspicious_pairs": E.suspicious_pairs,
    "e07_same_day_new_and_npu": E.same_day_new_and_npu,
    "e08_first_day_not_new": E.first_day_not_new,
    "e08b_first_day_customers": E.first_day_customers,
    "e09_negative_by_status": E.negative_by_status,
    "e10_customer_lookup": _customer_lookup,
    "e10b_single_customer": _single_customer,
    "e11_uncoded_by_free": E.uncoded_by_free,
    "e12_free_npu_by_license": E.free_npu_by_license,
    "e13_self_transitions": E.self_transitions,
    "e14_same_day_anomaly_rows": E.same_day_anomaly_rows,
    "e15_repeat_npu": E.repeat_npu,
}


def _dd(fn):
    return lambda sales: fn(E.deduplicate(sales))


STAGING: dict[str, Callable[[DataFrame], DataFrame]] = {
    "t01_dedup": E.deduplicate,
    "t02_first_txn": _dd(T.first_new_customer_day),
    "t03_invalid_first": _dd(T.invalid_first_entries),
    "t04_status_anomaly": _dd(T.status_anomalies),
    "t05_purchase_rank": _dd(T.purchase_rank),
    "t06_repeat_npu": _dd(T.repeat_new_product_use),
    "t07_drop_free_renewals": lambda s: T.clean_rows(s, ("t07",)),
    "t08_anti_status": lambda s: T.clean_rows(s, ("t07", "t08")),
    "t09_anti_repeat": lambda s: T.clean_rows(s, ("t07", "t09")),
    "t10_anti_first": lambda s: T.clean_rows(s, ("t07", "t10")),
    "t11_license_fix": lambda s: T.derived_column(s, "t11"),
    "t12_discount_clamp": lambda s: T.derived_column(s, "t12"),
    "t13_surcharge": lambda s: T.derived_column(s, "t13"),
    "t14_total": lambda s: T.derived_column(s, "t14"),
    "t15_discount_pct": lambda s: T.derived_column(s, "t15"),
    "t16_staging": T.staging_model,
}


def _stg(fn):
    return lambda sales: fn(T.staging_model(sales))


TRANSITIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "j01_previous_product": _stg(J.previous_product),
    "j02_paths": _stg(lambda s: J.paths(J.previous_product(s))),
    "j03_transition_flag": _stg(lambda s: J.with_transition_flag(J.paths(J.previous_product(s)))),
    "j04_path_fix": _stg(J.rewritten_paths),
    "j05_transactional_mart": _stg(J.transactional_mart),
}

SUBSCRIPTION: dict[str, Callable[[DataFrame], DataFrame]] = {
    "m01_projection": _stg(M.projection),
    "m02_neighbours": _stg(M.neighbour_view),
    "m03_intervals": _stg(M.interval_view),
    "m04_billing_interval": _stg(M.classified),
    "m05_expand_yearly": _stg(lambda s: M.yearly_rows(M.classified(s))),
    "m06_monthly_rows": _stg(lambda s: M.monthly_rows(M.classified(s))),
    "m07_union": _stg(lambda s: M.combined_rows(M.classified(s))),
    "m08_customer_month": _stg(lambda s: M.customer_month_view(s, "m08")),
    "m09_is_new": _stg(lambda s: M.customer_month_view(s, "m09")),
    "m10_previous_mrr": _stg(lambda s: M.customer_month_view(s, "m10")),
    "m11_monthly": _stg(M.monthly_view),
    "m11b_churned_direct": _stg(lambda s: M.monthly_view(s, direct_churn=True)),
    "m12_month_over_month": _stg(M.month_over_month_view),
    "m13_subscription_mart": _stg(M.subscription_mart),
}


def _mart(fn):
    return _stg(lambda s: fn(J.transactional_mart(s)))


def _mom(fn):
    return _stg(lambda s: fn(M.month_over_month(M.monthly_aggregation(M.classified(s)))))


def _matrix(sales: DataFrame) -> DataFrame:
    return B.transition_matrix(J.transactional_mart(T.staging_model(sales)), PRODUCT_CODES)


DASHBOARDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "d01_top_products": _stg(B.top_products),
    "d02_revenue_trend": _stg(B.revenue_trend),
    "d03_product_positioning": _stg(B.product_positioning),
    "d04_revenue_per_sale": _stg(B.revenue_per_sale),
    "d05_acquisition_cost": _stg(B.acquisition_cost),
    "d06_discount_levels": _stg(B.discount_levels),
    "d07_transition_paths": _mart(B.transition_paths),
    "d08_transition_matrix": _matrix,
    "d09_mrr_trend": _mom(B.mrr_trend),
    "d10_net_dollar_retention": _mom(B.net_dollar_retention),
    "d11_churn_rate": _mom(B.churn_rate),
    "d12_mrr_waterfall": _mom(B.mrr_waterfall),
    "d13_revenue_split": _stg(B.revenue_split),
}


def _folder(spark: SparkSession, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/revcurve-{label}-{uuid.uuid4().hex}"


def _stored_staging(sales: DataFrame) -> DataFrame:
    """sink_model / src_stg: write the staging model once, read it back by path."""
    path = _folder(sales.sparkSession, "stg_sales_data")
    write_model(T.staging_model(sales), path)
    return read_model(sales.sparkSession, path)


def _sales_through_csv(sales: DataFrame) -> DataFrame:
    """src_sales_csv: the sales table written as a CSV export and read back by the CSV reader."""
    path = _folder(sales.sparkSession, "sales_export")
    write_model(sales.select(*reversed(sales.columns)), path, fmt="csv")  # not in the reader's order
    return read_sales(sales.sparkSession, path, fmt="csv")


def _in_batches(sales: DataFrame) -> str:
    """The sales added to incremental tables in two batches, the later years first; rows without a day come last."""
    root, late = _folder(sales.sparkSession, "incremental"), F.coalesce(F.col("processed_date") >= "2020-01-01", F.lit(False))
    for name, rows in (("late", late), ("others", ~late)):
        I.add_batch(sales.sparkSession, root, sales.filter(rows), name)
    return root


INCREMENTAL: dict[str, Callable[[DataFrame], DataFrame]] = {
    "t16i_incremental_staging": lambda s: I.staging(s.sparkSession, _in_batches(s)),
    "m13i_incremental_mart": lambda s: I.subscription_mart(s.sparkSession, _in_batches(s)),
}


def _two_halves(sales: DataFrame) -> DataFrame:
    """Every profile question from the merged customer sets of two halves of the sales, split by day."""
    old = F.coalesce(F.col("processed_date") < "2019-07-01", F.lit(False))
    return C.answers(C.merged(C.customer_sets(sales.filter(old)), C.customer_sets(sales.filter(~old))))


def _observed_staging(sales: DataFrame) -> DataFrame:
    """The figures of the sales, taken while the staging model is written."""
    return O.write_observed(sales, T.staging_model, _folder(sales.sparkSession, "stg_observed"))


def _sales_with_rejects(sales: DataFrame) -> DataFrame:
    """Lines per reason of a CSV export in which customers 0, 1 and 2 (mod 97) have bad dates, short and long lines."""
    spark, text = sales.sparkSession, F.col("customer") % 97
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in D.SALES_COLUMNS]
    day = D.SALES_COLUMNS.index("processed_date")
    bad = [*cells[:day], F.lit("31/12/2019"), *cells[day + 1 :]]
    line = F.when(text == 0, F.concat_ws(",", *bad)).when(text == 1, F.concat_ws(",", *cells[:-1])).when(
        text == 2, F.concat_ws(",", *cells, F.lit("x"))).otherwise(F.concat_ws(",", *cells))
    path = _folder(spark, "export_with_rejects")
    header = F.lit(",".join(D.SALES_COLUMNS))
    # every file of the export begins with the header
    lines = sales.select(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"), line.alias("value"))
    lines = lines.select(F.explode(F.when(F.col("at") == 0, F.array(header, F.col("value"))).otherwise(F.array(F.col("value")))).alias("value"))
    lines.write.text(path)
    load = R.load_csv(spark, path, _folder(spark, "sales_loaded"), max_rejected_share=1.0)
    good = load.good.agg(F.count(F.lit(1)).alias("lines")).select(F.lit("good").alias("reason"), "lines")
    return good.unionByName(load.rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("lines")))


SOURCES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "src_sales": lambda sales: sales,
    "src_sales_csv": _sales_through_csv,
    "sink_model": _stored_staging,
    "src_sales_rejects": _sales_with_rejects,
    "s_observed_staging": _observed_staging,
    "s_customer_sets": _two_halves,
    "src_stg": lambda sales: M.projection(_stored_staging(sales)),
}


def operators() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Every query as a function of the raw sales DataFrame."""
    out: dict[str, Callable[[DataFrame], DataFrame]] = {}
    for table in (SOURCES, PROFILE, EXPLORE, STAGING, TRANSITIONS, SUBSCRIPTION, DASHBOARDS, INCREMENTAL):
        out.update(table)
    return out


def queries() -> dict[str, Query]:
    return {name: _on_sales(fn) for name, fn in operators().items()}
