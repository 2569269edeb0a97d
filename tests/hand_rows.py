"""Hand-made sales rows that reach the edges the test tables meet only by chance."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd

from revcurve.functions import domain as D

STATUSES = [D.NEW_CUSTOMER, D.RENEWAL, D.NEW_PRODUCT_USE, D.ADDITIONAL_LICENSES]
LICENSES = ["New", "Renew", "Upgrade"]
COLS = list(D.SALES_COLUMNS)


def _row(c, st, p, lic, d, code, q, amt, disc):
    return dict(zip(COLS, [c, st, p, lic, d, code, q, amt, disc]))


def crafted() -> list[dict]:
    d0 = dt.date(2018, 3, 10)
    rows = []
    # day gaps 24, 25, 45, 46, 320, 321 for one (customer, product)
    day = d0
    for gap in (0, 24, 25, 45, 46, 320, 321):
        day = day + dt.timedelta(days=gap)
        rows.append(_row(1, D.RENEWAL, "P01", "Renew", day, None, 1, 100.0, 0.0))
    # band edges: Upgrade renewal at 0.85x / 1.15x of previous and one cent outside
    for i, amt in enumerate((85.0, 115.0, 84.99, 115.01)):
        base = dt.date(2018, 1, 5) + dt.timedelta(days=400 * i)
        rows.append(_row(2, D.RENEWAL, f"P0{i}", "Renew", base, None, 1, 100.0, 0.0))
        rows.append(_row(2, D.RENEWAL, f"P0{i}", "Upgrade", base + dt.timedelta(days=30), None, 1, amt, 0.0))
    # Upgrade new-product-use against the next purchase
    for i, amt in enumerate((85.0, 115.0, 84.99, 115.01)):
        base = dt.date(2018, 2, 7) + dt.timedelta(days=300 * i)
        rows.append(_row(3, D.NEW_PRODUCT_USE, f"P1{i}", "Upgrade", base, None, 1, amt, 0.0))
        rows.append(_row(3, D.RENEWAL, f"P1{i}", "Renew", base + dt.timedelta(days=35), None, 1, 100.0, 0.0))
    # Upgrade with no neighbour
    rows.append(_row(4, D.RENEWAL, "P05", "Upgrade", dt.date(2019, 6, 1), None, 1, 50.0, 0.0))
    # December and 31st purchases, yearly
    rows.append(_row(5, D.NEW_CUSTOMER, "P06", "New", dt.date(2018, 12, 31), None, 1, 120.0, 0.0))
    rows.append(_row(5, D.RENEWAL, "P06", "Renew", dt.date(2020, 1, 31), None, 1, 120.0, 0.0))
    # a customer with a gap of empty months (monthly, then back after months)
    for m in (1, 2, 3, 8, 9):
        rows.append(_row(6, D.RENEWAL if m > 1 else D.NEW_CUSTOMER, "P07", "Renew", dt.date(2019, m, 3),
                         None, 1, 30.0, 0.0))
    # totals ending in exactly half a cent per month: yearly 0.06 -> 0.5 twelfths
    rows.append(_row(7, D.NEW_CUSTOMER, "P08", "New", dt.date(2018, 5, 5), None, 1, 0.06, 0.0))
    rows.append(_row(8, D.NEW_CUSTOMER, "P08", "New", dt.date(2018, 5, 6), None, 1, 0.18, 0.0))
    # a code whose discounts sum to 0 on zero revenue
    rows.append(_row(9, D.RENEWAL, "P09", "Renew", dt.date(2019, 2, 2), 777, 1, 0.0, 5.0))
    rows.append(_row(9, D.RENEWAL, "P09", "Renew", dt.date(2019, 2, 3), 777, 1, 0.0, -5.0))
    # zero total (percentage NULL), NULL discount, NULL amount
    rows.append(_row(10, D.NEW_CUSTOMER, "P02", "New", dt.date(2018, 8, 8), None, 1, 0.0, 0.0))
    rows.append(_row(10, D.RENEWAL, "P02", "Renew", dt.date(2019, 8, 8), None, 1, 10.0, None))
    rows.append(_row(10, D.RENEWAL, "P03", "Renew", dt.date(2019, 8, 9), None, 1, None, 2.0))
    # NULL discount_id in equal rows (dedup groups NULLs), exact copies
    for _ in range(3):
        rows.append(_row(11, D.NEW_CUSTOMER, "P04", "New", dt.date(2018, 4, 4), None, 1, 40.0, 4.0))
    # NULL keys
    rows.append(_row(None, D.NEW_PRODUCT_USE, "P01", "New", dt.date(2018, 4, 4), None, 1, 10.0, 1.0))
    rows.append(_row(12, D.NEW_PRODUCT_USE, None, "New", dt.date(2018, 4, 4), None, 1, 10.0, 1.0))
    rows.append(_row(12, D.NEW_PRODUCT_USE, "P01", "New", None, None, 1, 10.0, 1.0))
    rows.append(_row(12, None, "P01", "New", dt.date(2018, 4, 5), None, 1, 10.0, 1.0))
    rows.append(_row(12, D.RENEWAL, "P01", None, dt.date(2018, 4, 6), None, 1, 10.0, 1.0))
    # same-day NC + NPU anomaly, repeat NPU, renewal on the first NC day, free renewal
    rows.append(_row(13, D.NEW_CUSTOMER, "P03", "New", dt.date(2018, 6, 1), None, 1, 70.0, 0.0))
    rows.append(_row(13, D.NEW_PRODUCT_USE, "P03", "New", dt.date(2018, 6, 1), None, 1, 70.0, 0.0))
    rows.append(_row(13, D.NEW_PRODUCT_USE, "P03", "Upgrade", dt.date(2018, 6, 1), None, 1, 75.0, 0.0))
    rows.append(_row(13, D.RENEWAL, "P04", "Renew", dt.date(2018, 6, 1), None, 1, 20.0, 0.0))
    rows.append(_row(13, D.NEW_PRODUCT_USE, "P03", "New", dt.date(2018, 9, 1), None, 1, 70.0, 0.0))
    rows.append(_row(13, D.RENEWAL, "P03", "Renew", dt.date(2019, 6, 1), None, 1, 0.0, 70.0))
    # license fixes that make staging rows identical
    rows.append(_row(14, D.NEW_CUSTOMER, "P05", "Renew", dt.date(2018, 7, 7), None, 1, 15.0, 0.0))
    rows.append(_row(14, D.NEW_CUSTOMER, "P05", "New", dt.date(2018, 7, 7), None, 1, 15.0, 0.0))
    rows.append(_row(14, D.NEW_PRODUCT_USE, "P06", "Renew", dt.date(2018, 7, 8), None, 1, 15.0, 0.0))
    rows.append(_row(14, D.NEW_PRODUCT_USE, "P06", "New", dt.date(2018, 7, 8), None, 1, 15.0, 0.0))
    return rows


def random_rows(seed: int, n: int, hot_share: float = 0.3) -> list[dict]:
    """Random rows with NULLs in every column, copies, and one hot customer."""
    rnd = random.Random(seed)

    def maybe(v, p=0.04):
        return None if rnd.random() < p else v

    rows = []
    for _ in range(n):
        c = 999 if rnd.random() < hot_share else rnd.randint(20, 60)
        amt = round(rnd.choice([0, rnd.randint(0, 50000)]) / 100.0, 2)
        disc = round(rnd.choice([0, rnd.randint(-800, 8000), rnd.randint(1, 3000)]) / 100.0, 2)
        r = _row(
            maybe(c),
            maybe(rnd.choice(STATUSES)),
            maybe(f"P{rnd.randint(0, 5):02d}"),
            maybe(rnd.choice(LICENSES)),
            maybe(dt.date(2018, 1, 1) + dt.timedelta(days=rnd.randint(0, 760))),
            rnd.choice([None, None, None, 100 + rnd.randint(0, 4)]),
            rnd.choice([1, 1, 1, 2]),
            maybe(amt),
            maybe(disc),
        )
        rows.append(r)
        if rnd.random() < 0.05:
            rows.append(dict(r))
    return rows


def frame(rows: list[dict]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=COLS)
    df["customer"] = df["customer"].astype("Int64")
    df["discount_id"] = df["discount_id"].astype("Int64")
    df["quantity"] = df["quantity"].astype("Int32")
    df["amount_in_usd"] = df["amount_in_usd"].astype("float64")
    df["discount_in_usd"] = df["discount_in_usd"].astype("float64")
    return df
