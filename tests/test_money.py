"""Integer money arithmetic: half-away-from-zero division equals exact decimal rounding."""

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from revcurve.functions.money import div_round, to_cents, twelfths_to_cents, usd


def _expected(num, den):
    if num is None or den is None or den == 0:
        return None
    return int((Decimal(num) / Decimal(den)).quantize(Decimal(1), rounding=ROUND_HALF_UP))


def test_div_round_matches_decimal(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randint(-10**12, 10**12), rnd.choice([0, 1, 2, 3, 12, 24, 100, -7,
                                                         rnd.randint(-10**6, 10**6)]))
             for _ in range(2000)]
    pairs += [(1, 2), (-1, 2), (3, 2), (-3, 2), (5, 10), (-5, 10), (6, 12), (-6, 12), (0, 5),
              (None, 3), (4, None), (7, 0), (2**40 + 6, 12)]
    df = spark.createDataFrame(pairs, "n bigint, d bigint")
    got = df.select("n", "d", div_round("n", "d").alias("r")).collect()
    for row in got:
        assert row["r"] == _expected(row["n"], row["d"]), tuple(row)


def test_cents_and_twelfths(spark):
    df = spark.createDataFrame(
        [(1.005, 6), (0.125, 18), (-0.125, -18), (675.98, 11), (None, None), (0.0, 0)],
        "usd double, tw bigint",
    )
    rows = df.select(to_cents("usd").alias("c"), twelfths_to_cents("tw").alias("t"),
                     usd(F.lit(12345).cast("bigint")).alias("u")).collect()
    assert [r["c"] for r in rows] == [100, 13, -13, 67598, None, 0]
    # 6/12 = 0.5 -> 1; 18/12 = 1.5 -> 2; -1.5 -> -2; 11/12 -> 1
    assert [r["t"] for r in rows] == [1, 2, -2, 1, None, 0]
    assert rows[0]["u"] == 123.45
