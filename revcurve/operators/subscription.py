"""Subscription mart: monthly recurring revenue and its movements (m01-m13).

m01  the twelve staging columns
m02  previous / next purchase day and total of the same (customer, product)
m03  backward / forward interval from the day gaps: 25..45 -> Monthly, > 320 -> Yearly
m04  final billing interval: the first of seven ordered rules
m05  a yearly purchase spreads paid/12 over 12 months from its month
m06  a monthly purchase counts in full in its month
m07  both together
m08  revenue per (month, customer)
m09  is this the customer's first month
m10  revenue of the customer's previous present month
m11  per month: mrr, active customers, arpu, new / expansion / contraction, existing customers
m11b the direct churn measure (previous revenue of customers at 0)
m12  month over month: previous mrr, churned mrr (balancing residual), churned customers
m13  the whole mart (11 columns)

Money is integer (see ``revcurve.functions.money``): revenue is carried in twelfths of a
cent, so a yearly purchase of ``c`` cents is exactly ``c`` per month; m11 rounds to cents
where the model rounds, m12 works on those rounded cents.

Distributed plan
----------------
* m02 runs through the range-partitioned scan (a hot customer is split by range).
* m05-m07 lay purchases out over their months, because those rows are the result. The marts (m11-m13) do not:
  they run on change events. A yearly purchase of monthly value v is +v at its month and -v twelve months
  later; per customer and month the changes are added up, and running sums over a customer's
  events give its revenue, its previous revenue and whether it is active. Month totals are running sums of the
  changes over the calendar. Revenue is linear, so purchases are pre-aggregated per (customer, start month,
  interval) before they move, and at most two rows per pre-aggregate are shuffled, once, by customer.
* m08-m10 lay the levels between events out over the months, once per customer and month.
* A customer has at most one event per month, so the per-customer windows are bounded whatever the data
  volume; the windows over months hold one row per month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revcurve.functions import domain as D
from revcurve.functions.money import div_round, to_cents, usd
from revcurve.operators.neighbours import ordered_neighbours

HISTORY_ORDER = ("processed_date", "customer_status", *D.STAGING_TIE_ORDER)
TWELFTHS_TO_USD = 1200.0


def projection(stg: DataFrame) -> DataFrame:
    """m01: the explicit twelve-column projection."""
    return stg.select(*D.STAGING_COLUMNS)


def transaction_history(stg: DataFrame, neighbours=ordered_neighbours) -> DataFrame:
    """m02 + m03: neighbours within (customer, product) and the two gap intervals."""
    base = projection(stg).withColumn("_total_c", to_cents("total_amount_in_usd"))
    nb = neighbours(
        base, ["customer", "product_code"], list(HISTORY_ORDER),
        lag={"previous_date": "processed_date", "_prev_total_c": "_total_c"},
        lead={"next_date": "processed_date", "_next_total_c": "_total_c"},
    )
    back_gap = F.datediff("processed_date", "previous_date")
    fwd_gap = F.datediff("next_date", "processed_date")

    def interval(gap):
        return (
            F.when(gap.between(D.MONTHLY_GAP_MIN_DAYS, D.MONTHLY_GAP_MAX_DAYS), F.lit(D.MONTHLY))
            .when(gap > D.YEARLY_GAP_MIN_DAYS_EXCLUSIVE, F.lit(D.YEARLY))
        )

    return nb.withColumn("backward_interval", interval(back_gap)).withColumn(
        "forward_interval", interval(fwd_gap)
    )


def _within_band(total: str, other: str):
    # total BETWEEN other * 0.85 AND other * 1.15, exactly, on integer cents
    t, o = F.col(total) * 100, F.col(other)
    return (t >= o * D.BAND_LOW_PCT) & (t <= o * D.BAND_HIGH_PCT)


def _rules():
    """The seven ordered rules of m04 as (condition, interval) pairs; the last is the default."""
    lic, status = F.col("updated_license_type"), F.col("customer_status")
    back, fwd = F.col("backward_interval"), F.col("forward_interval")
    yearly = F.lit(D.YEARLY)
    return [
        ((lic == D.LICENSE_UPGRADE) & (status == D.NEW_PRODUCT_USE)
         & _within_band("_total_c", "_next_total_c"), F.coalesce(fwd, yearly)),
        ((lic == D.LICENSE_UPGRADE) & (status == D.RENEWAL)
         & _within_band("_total_c", "_prev_total_c"), F.coalesce(back, yearly)),
        (status == D.ADDITIONAL_LICENSES, F.coalesce(back, yearly)),
        (status == D.NEW_CUSTOMER, F.coalesce(fwd, yearly)),
        (back.isNotNull(), back),
        (fwd.isNotNull(), fwd),
        (F.lit(True), yearly),
    ]


def billing_interval():
    """m04: the interval of the first matching rule."""
    rules = _rules()
    expr = F.when(rules[0][0], rules[0][1])
    for cond, value in rules[1:-1]:
        expr = expr.when(cond, value)
    return expr.otherwise(rules[-1][1])


def billing_rule():
    """Which of the seven rules decided the interval (1-7), for diagnostics."""
    rules = _rules()
    expr = F.when(rules[0][0], F.lit(1))
    for i, (cond, _) in enumerate(rules[1:-1], start=2):
        expr = expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(len(rules)))


def classified(stg: DataFrame, neighbours=ordered_neighbours) -> DataFrame:
    """m04 rows: each purchase with its intervals and final billing interval."""
    h = transaction_history(stg, neighbours)
    return h.select(
        "customer", "product_code", "customer_status", "updated_license_type", "processed_date",
        "paid_amount_in_usd", "updated_discount_in_usd", "total_amount_in_usd",
        F.datediff("processed_date", "previous_date").cast("bigint").alias("date_diff_1"),
        "backward_interval", "forward_interval",
        billing_interval().alias("final_billing_interval"),
    )


def classified_with_rule(stg: DataFrame) -> DataFrame:
    """m04 rows plus the number of the rule that decided the interval (diagnostics)."""
    h = transaction_history(stg)
    return h.select(
        "customer", "product_code", "customer_status", "processed_date",
        billing_interval().alias("final_billing_interval"),
        billing_rule().alias("billing_rule"),
    )


def _months(n):
    """Explode 1..n as the month counter."""
    return F.explode(F.sequence(F.lit(1), n)).alias("month_counter")


def yearly_rows(cls: DataFrame) -> DataFrame:
    """m05: twelve monthly rows per yearly purchase, paid/12 each."""
    y = cls.filter(F.col("final_billing_interval") == D.YEARLY)
    e = y.select(
        "customer", "updated_license_type", F.trunc("processed_date", "month").alias("_start"),
        to_cents("paid_amount_in_usd").alias("_twelfths"), _months(F.lit(D.MONTHS_PER_YEARLY_TERM)),
    )
    return e.select(
        "customer", "updated_license_type",
        F.add_months("_start", F.col("month_counter") - 1).alias("mrr_month"),
        (F.col("_twelfths") / F.lit(TWELFTHS_TO_USD)).alias("monthly_revenue"),
        "month_counter",
    )


def monthly_rows(cls: DataFrame) -> DataFrame:
    """m06: one row per monthly purchase, the full amount."""
    m = cls.filter(F.col("final_billing_interval") == D.MONTHLY)
    return m.select(
        "customer", "updated_license_type",
        F.trunc("processed_date", "month").alias("mrr_month"),
        F.col("paid_amount_in_usd").alias("monthly_revenue"),
    )


def combined_rows(cls: DataFrame) -> DataFrame:
    """m07: yearly and monthly revenue rows in one pass (one explode, no union)."""
    yearly = F.col("final_billing_interval") == D.YEARLY
    n = F.when(yearly, F.lit(D.MONTHS_PER_YEARLY_TERM)).otherwise(F.lit(1))
    paid = to_cents("paid_amount_in_usd")
    e = cls.filter(F.col("final_billing_interval").isin(D.YEARLY, D.MONTHLY)).select(
        "customer", "updated_license_type", F.trunc("processed_date", "month").alias("_start"),
        F.when(yearly, paid).otherwise(paid * 12).alias("_twelfths"), _months(n),
    )
    return e.select(
        "customer", "updated_license_type",
        F.add_months("_start", F.col("month_counter") - 1).alias("mrr_month"),
        (F.col("_twelfths") / F.lit(TWELFTHS_TO_USD)).alias("monthly_revenue"),
    )


def change_events(cls: DataFrame) -> DataFrame:
    """(customer, month, dv, dc, dn): by how much a customer's monthly revenue, in twelfths, the number of running terms
    and that of terms with a known amount change in a month.

    A purchase of monthly value v begins at its month (+v, +1, +1) and ends twelve months (yearly) or one month
    (monthly) later (-v, -1, -1); without an amount it is (0, +1, 0). Purchases are added up per (customer, start month, interval) first, so at most two rows per
    such pre-aggregate exist at any point; nothing is laid out month by month. Purchases without a day have no
    month: their whole value is one row of month NULL.
    """
    yearly = F.col("final_billing_interval") == D.YEARLY
    paid = to_cents("paid_amount_in_usd")
    pre = (
        cls.filter(F.col("final_billing_interval").isin(D.YEARLY, D.MONTHLY))
        .groupBy("customer", F.trunc("processed_date", "month").alias("_start"), yearly.alias("_yearly"))
        .agg(F.sum(F.when(yearly, paid).otherwise(paid * 12)).alias("_v"))
    )
    n = F.when(F.col("_yearly"), F.lit(D.MONTHS_PER_YEARLY_TERM)).otherwise(F.lit(1))
    known = F.col("_v").isNotNull().cast("bigint")
    event = lambda month, dv, dc: F.struct(
        month.cast("date").alias("month"), dv.cast("bigint").alias("dv"), F.lit(dc).cast("bigint").alias("dc"), (known * dc).alias("dn")
    )
    v = F.coalesce("_v", F.lit(0))
    events = pre.repartition("customer").select("customer", F.explode(
        F.when(F.col("_start").isNull(), F.array(event(F.col("_start"), v * n, 1)))
        .otherwise(F.array(event(F.col("_start"), v, 1), event(F.add_months("_start", n), -v, -1)))
    ).alias("e"))
    return events.groupBy("customer", F.col("e.month").alias("month")).agg(*[F.sum(f"e.{c}").alias(c) for c in ("dv", "dc", "dn")])


def customer_levels(events: DataFrame) -> DataFrame:
    """Per event row: the revenue from that month on (``total``, NULL if no running term has an amount), whether any term runs (``present``), the revenue of the
    customer's previous present month (``previous``), the next event's month (``until``) and ``is_new``.

    The windows run by customer over event rows: at most one for each month of the calendar.
    """
    by_month = Window.partitionBy("customer").orderBy(F.col("month").asc_nulls_first())
    so_far = by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dated = F.col("month").isNotNull()
    levels = events.select(
        "*",
        F.when(dated, F.when(F.sum(F.when(dated, F.col("dn"))).over(so_far) > 0, F.sum(F.when(dated, F.col("dv"))).over(so_far)))
        .otherwise(F.when(F.col("dn") > 0, F.col("dv"))).alias("total"),
        F.when(dated, F.sum(F.when(dated, F.col("dc"))).over(so_far) > 0).otherwise(F.lit(True)).alias("present"),
        F.lead("month").over(by_month).alias("until"),
        (F.min("month").over(Window.partitionBy("customer")) == F.col("month")).alias("is_new"),
    )
    earlier = by_month.rowsBetween(Window.unboundedPreceding, -1)
    last_present = F.last(F.when(F.col("present"), F.struct("total")), ignorenulls=True).over(earlier)
    return levels.select("*", last_present["total"].alias("previous"))


def customer_months(cls: DataFrame) -> DataFrame:
    """m08-m10 on integers: (mrr_month, customer, is_new, total, previous) in twelfths.

    The present months of every customer, laid out from the levels between events.
    """
    levels = customer_levels(change_events(cls)).filter("present")
    last = F.when(F.col("month").isNull(), F.lit(None).cast("date")).otherwise(F.add_months("until", -1))
    months = F.when(F.col("month").isNull(), F.array(F.col("month"))).otherwise(
        F.sequence(F.col("month"), last, F.expr("INTERVAL 1 MONTH"))
    )
    laid = levels.select("*", F.posexplode(months).alias("_at", "mrr_month"))
    first = F.col("_at") == 0
    return laid.select(
        "mrr_month",
        "customer",
        (F.col("is_new") & first).alias("is_new_customer_this_month"),
        F.col("total").alias("total_mrr"),
        F.when(first, F.col("previous")).otherwise(F.col("total")).alias("previous_customer_mrr"),
    )


def month_changes(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per month with an event: the changes of revenue, of present and active customers, and the month's movements.

    The rows that enter this aggregate are the customers' events. An active customer has an id; a present one may be
    the customer NULL. Every column is a sum over customers, so tables of parts of the customers (``by``: columns that
    part them) are added up by :func:`merged_changes`.
    """
    levels = customer_levels(events)
    by_month = Window.partitionBy("customer").orderBy(F.col("month").asc_nulls_first())

    def turned(state):
        before = F.lag(F.when(F.col("month").isNotNull(), state.cast("int"))).over(by_month)
        return state.cast("int") - F.coalesce(before, F.lit(0))

    valued = F.col("present") & F.col("total").isNotNull()
    levels = levels.select("*", turned(F.col("present")).alias("_turned"), turned(valued).alias("_valued"))
    total, prev, new = F.col("total"), F.col("previous"), F.col("is_new")
    has_id = F.col("customer").isNotNull()
    here = F.col("present")
    return levels.groupBy(*by, "month").agg(
        F.sum("dv").alias("dv"),
        F.sum("_turned").alias("d_present"),
        F.sum(F.when(has_id, F.col("_turned")).otherwise(0)).alias("d_active"),
        F.sum("_valued").alias("d_valued"),
        F.count(F.when(here & new, F.col("customer"))).alias("new_customers"),
        F.count_if(here & new).alias("new_present"),
        F.count(F.when(here & new, total)).alias("new_valued"),
        F.sum(F.when(here & new, total).otherwise(0)).alias("_new"),
        F.sum(F.when(here & ~new & (total > prev), total - prev).otherwise(0)).alias("_exp"),
        F.sum(F.when(here & (total < prev), prev - total).otherwise(0)).alias("_con"),
        F.sum(F.when(here & (total == 0) & (prev > 0), prev).otherwise(0)).alias("_churn"),
    )


CHANGES = ("dv", "d_present", "d_active", "d_valued", "new_customers", "new_present", "new_valued", "_new", "_exp", "_con", "_churn")


def merged_changes(changes: DataFrame) -> DataFrame:
    """Month changes of several parts of the customers, added up."""
    return changes.groupBy("month").agg(*[F.sum(c).alias(c) for c in CHANGES])


def monthly_totals(changes: DataFrame) -> DataFrame:
    """Per month with a present customer: running sums of month changes, months without an event filled in.

    One row per month of the calendar enters the window.
    """
    w = Window.orderBy(F.col("month").asc_nulls_first())
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dated = F.col("month").isNotNull()
    running = lambda c: F.when(dated, F.sum(F.when(dated, F.col(c))).over(so_far)).otherwise(F.col(c))
    levels = changes.select(
        "month", F.lead("month").over(w).alias("until"), running("dv").alias("_v"), running("d_present").alias("_present"),
        running("d_active").alias("active_customers"), running("d_valued").alias("_valued"), "new_customers",
        # a sum of nothing but unknown amounts is unknown
        F.when((F.col("new_present") < running("d_present")) | (F.col("new_valued") > 0), F.col("_new")).alias("_new"),
        "_exp", "_con", "_churn",
    ).filter(F.col("_present") > 0).withColumn("_v", F.when(F.col("_valued") > 0, F.col("_v")))
    months = F.when(~dated, F.array(F.col("month"))).otherwise(
        F.sequence(F.col("month"), F.when(dated, F.add_months("until", -1)), F.expr("INTERVAL 1 MONTH"))
    )
    laid = levels.select("*", F.posexplode(months).alias("_at", "mrr_month"))
    once = lambda c: F.when(F.col("_at") == 0, F.col(c)).otherwise(0).cast("bigint").alias(c)
    # a customer of month NULL has no first month and counts neither as new nor as existing
    existing = F.when(dated, F.col("active_customers") - F.when(F.col("_at") == 0, F.col("new_customers")).otherwise(0)).otherwise(0)
    return laid.select(
        "mrr_month", "_v", F.col("active_customers").cast("bigint").alias("active_customers"), *[once(c) for c in ("_new", "_exp", "_con", "_churn")],
        existing.cast("bigint").alias("existing_customers"),
    )


def monthly_aggregation(cls: DataFrame, with_direct_churn: bool = False) -> DataFrame:
    """m11 (and m11b) of the classified purchases: per-month totals, rounded to cents (integers)."""
    return aggregation_of_changes(month_changes(change_events(cls)), with_direct_churn)


def aggregation_of_changes(changes: DataFrame, with_direct_churn: bool = False) -> DataFrame:
    """m11 (and m11b) from month changes."""
    cols = [
        "mrr_month",
        div_round("_v", "12").alias("mrr_c"),
        "active_customers",
        div_round("_v", "12 * active_customers").alias("arpu_c"),
        div_round("_new", "12").alias("new_mrr_c"),
        div_round("_exp", "12").alias("expansion_mrr_c"),
        div_round("_con", "12").alias("contraction_mrr_c"),
        "existing_customers",
    ]
    if with_direct_churn:
        cols.append(div_round("_churn", "12").alias("churned_direct_c"))
    return monthly_totals(changes).select(*cols)


def month_over_month(monthly: DataFrame) -> DataFrame:
    """m12 on integers: previous mrr, churned mrr (residual), churned customers."""
    w = Window.orderBy(F.col("mrr_month").asc_nulls_first())
    prev_mrr = F.lag("mrr_c").over(w)
    prev_active = F.lag("active_customers").over(w)
    return monthly.select(
        "*",
        prev_mrr.alias("previous_mrr_c"),
        prev_active.alias("previous_month_active_customers"),
        (prev_mrr + F.col("new_mrr_c") + F.col("expansion_mrr_c") - F.col("contraction_mrr_c")
         - F.col("mrr_c")).alias("churned_mrr_c"),
        (prev_active - F.col("existing_customers")).alias("churned_customers"),
    )


def publish(mom: DataFrame) -> DataFrame:
    """m13 columns, money in dollars."""
    return mom.select(
        "mrr_month",
        usd("mrr_c").alias("mrr"),
        usd("previous_mrr_c").alias("previous_mrr"),
        usd("new_mrr_c").alias("new_mrr"),
        usd("expansion_mrr_c").alias("expansion_mrr"),
        usd("contraction_mrr_c").alias("contraction_mrr"),
        usd("churned_mrr_c").alias("churned_mrr"),
        "active_customers",
        usd("arpu_c").alias("arpu"),
        "existing_customers",
        "churned_customers",
    )


def subscription_mart(stg: DataFrame) -> DataFrame:
    """m13: the subscription mart (11 columns, one row per month)."""
    return publish(month_over_month(monthly_aggregation(classified(stg))))


# --- standalone views of the intermediate steps ----------------------------------------------

def customer_month_view(stg: DataFrame, step: str) -> DataFrame:
    """m08 / m09 / m10 published in dollars (twelfths / 1200)."""
    cm = customer_months(classified(stg))
    cols = ["mrr_month", "customer"]
    if step in ("m09", "m10"):
        cols.append("is_new_customer_this_month")
    cols.append((F.col("total_mrr") / F.lit(TWELFTHS_TO_USD)).alias("total_mrr"))
    if step == "m10":
        cols.append((F.col("previous_customer_mrr") / F.lit(TWELFTHS_TO_USD)).alias("previous_customer_mrr"))
    return cm.select(*cols)


def monthly_view(stg: DataFrame, direct_churn: bool = False) -> DataFrame:
    """m11 (or m11b) published in dollars."""
    m = monthly_aggregation(classified(stg), with_direct_churn=direct_churn)
    cols = [
        "mrr_month", usd("mrr_c").alias("mrr"), "active_customers", usd("arpu_c").alias("arpu"),
        usd("new_mrr_c").alias("new_mrr"), usd("expansion_mrr_c").alias("expansion_mrr"),
        usd("contraction_mrr_c").alias("contraction_mrr"), "existing_customers",
    ]
    if direct_churn:
        cols.append(usd("churned_direct_c").alias("churned_mrr"))
    return m.select(*cols)


def month_over_month_view(stg: DataFrame) -> DataFrame:
    """m12: m11 plus previous mrr, previous active customers, churned mrr and customers."""
    mom = month_over_month(monthly_aggregation(classified(stg)))
    return mom.select(
        "mrr_month", usd("mrr_c").alias("mrr"), "active_customers", usd("arpu_c").alias("arpu"),
        usd("new_mrr_c").alias("new_mrr"), usd("expansion_mrr_c").alias("expansion_mrr"),
        usd("contraction_mrr_c").alias("contraction_mrr"), "existing_customers",
        usd("previous_mrr_c").alias("previous_mrr"), "previous_month_active_customers",
        usd("churned_mrr_c").alias("churned_mrr"), "churned_customers",
    )


def neighbour_view(stg: DataFrame) -> DataFrame:
    """m02: staging rows + previous/next day and total of the same (customer, product)."""
    h = transaction_history(stg)
    return h.select(
        *D.STAGING_COLUMNS,
        "previous_date",
        usd("_prev_total_c").alias("previous_total_amount"),
        "next_date",
        usd("_next_total_c").alias("next_total_amount"),
    )


def interval_view(stg: DataFrame) -> DataFrame:
    """m03: staging rows + backward and forward interval."""
    return transaction_history(stg).select(*D.STAGING_COLUMNS, "backward_interval", "forward_interval")
