"""Vocabulary of the sales data model.

FIXED VALUES — these literals must equal the source data's vocabulary and the rules of the
models exactly; they are data, not tuning knobs.
"""

from __future__ import annotations

# --- fixed values: customer_status domain -------------------------------------------------
NEW_CUSTOMER = "new customer"
RENEWAL = "existing customer: renewal"
NEW_PRODUCT_USE = "existing customer: new product use"
ADDITIONAL_LICENSES = "existing customer: additional new licenses"

# --- fixed values: license_type domain -----------------------------------------------------
LICENSE_NEW = "New"
LICENSE_RENEW = "Renew"
LICENSE_UPGRADE = "Upgrade"

# --- fixed values: labels produced by the models -------------------------------------------
MONTHLY = "Monthly"
YEARLY = "Yearly"
NEW_CUSTOMER_PATH = "[New Customer]"
UNTRACKED_DISCOUNT = "untracked_discount"

# --- fixed values: billing-interval thresholds (days) and revenue band (percent) -----------
MONTHLY_GAP_MIN_DAYS = 25
MONTHLY_GAP_MAX_DAYS = 45
YEARLY_GAP_MIN_DAYS_EXCLUSIVE = 320
BAND_LOW_PCT = 85
BAND_HIGH_PCT = 115
MONTHS_PER_YEARLY_TERM = 12

# (customer_status, license_type) pairs whose license is rewritten to New during staging.
LICENSE_FIX_PAIRS = (
    (NEW_CUSTOMER, LICENSE_RENEW),
    (NEW_CUSTOMER, LICENSE_UPGRADE),
    (NEW_PRODUCT_USE, LICENSE_RENEW),
)

# The raw sales table.
SALES_COLUMNS = (
    "customer",
    "customer_status",
    "product_code",
    "license_type",
    "processed_date",
    "discount_id",
    "quantity",
    "amount_in_usd",
    "discount_in_usd",
)

SALES_DDL = (
    "customer BIGINT, customer_status STRING, product_code STRING, license_type STRING, "
    "processed_date DATE, discount_id BIGINT, quantity INT, amount_in_usd DOUBLE, "
    "discount_in_usd DOUBLE"
)

STAGING_COLUMNS = (
    "customer",
    "customer_status",
    "product_code",
    "quantity",
    "updated_license_type",
    "processed_date",
    "discount_id",
    "paid_amount_in_usd",
    "updated_discount_in_usd",
    "surcharge_amount_in_usd",
    "total_amount_in_usd",
    "discount_percentage",
)

TRANSACTIONAL_COLUMNS = STAGING_COLUMNS + ("from_path", "to_path", "transition_flag")

SUBSCRIPTION_COLUMNS = (
    "mrr_month",
    "mrr",
    "previous_mrr",
    "new_mrr",
    "expansion_mrr",
    "contraction_mrr",
    "churned_mrr",
    "active_customers",
    "arpu",
    "existing_customers",
    "churned_customers",
)

# Tie rule. The models order windows by columns that do not identify a row; every such
# ORDER BY is completed with the remaining columns in this order so that results are
# deterministic (as a multiset) and equal in Spark and in the SQL oracle.
RAW_TIE_ORDER = (
    "license_type",
    "discount_id",
    "amount_in_usd",
    "discount_in_usd",
    "quantity",
)
STAGING_TIE_ORDER = (
    "updated_license_type",
    "discount_id",
    "paid_amount_in_usd",
    "updated_discount_in_usd",
    "surcharge_amount_in_usd",
    "quantity",
)
