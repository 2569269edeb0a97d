"""Exact money arithmetic on integers.

Dollar amounts arrive as DOUBLE. They are turned into BIGINT cents once, after
deduplication, and all sums, comparisons and roundings run on integers, so the result never
depends on floating-point summation order (which differs between tasks, engines and runs).
Recurring revenue is carried in twelfths of a cent: a yearly payment of ``c`` cents is
``c`` twelfths per month, a monthly payment is ``12 * c`` twelfths.

Rounding is half away from zero, as the reporting layer expects. Values are published as
``cents / 100.0``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWELFTHS_PER_CENT = 12


def to_cents(col: str | Column) -> Column:
    """DOUBLE dollars -> BIGINT cents (the only rounding of a double anywhere)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c * 100).cast("bigint")


def usd(cents: str | Column) -> Column:
    """BIGINT cents -> DOUBLE dollars."""
    c = F.col(cents) if isinstance(cents, str) else cents
    return c / F.lit(100.0)


def div_round_sql(num: str, den: str) -> str:
    """Spark SQL text for ``num / den`` on integers, rounded half away from zero.

    NULL when ``den`` is 0 or either side is NULL. ``num`` and ``den`` are SQL expressions of
    BIGINT range; they are doubled as DECIMAL, so no product can overflow. The quotient is BIGINT.
    """
    n, d = f"CAST({num} AS DECIMAL(30, 0))", f"CAST({den} AS DECIMAL(30, 0))"
    return (
        f"CASE WHEN {d} = 0 THEN NULL "
        f"ELSE (CASE WHEN ({n} < 0) <> ({d} < 0) THEN -1 ELSE 1 END) "
        f"* CAST((2 * abs({n}) + abs({d})) div (2 * abs({d})) AS BIGINT) END"
    )


def div_round(num: str, den: str) -> Column:
    """Column form of :func:`div_round_sql`."""
    return F.expr(div_round_sql(num, den))


def twelfths_to_cents(twelfths: str) -> Column:
    """Twelfths of a cent -> cents, half away from zero."""
    return div_round(twelfths, str(TWELFTHS_PER_CENT))
