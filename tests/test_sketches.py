"""Sketch profiles: error bounds against the exact profile, merging of halves."""

from pyspark.sql import functions as F

from revcurve.operators import profile as P
from revcurve.operators import sketches as S
from revcurve.sources.testdata import sales_from_testdata

from conftest import SF001


def test_profile_is_within_its_error_of_the_exact_one(spark):
    sales = sales_from_testdata(spark, SF001).cache()
    exact = {r["column_name"]: r for r in P.schema_profile(sales).collect()}
    half = F.col("customer") % 2 == 0
    whole = S.sketches(sales)
    both = S.merged(S.sketches(sales.filter(half)), S.sketches(sales.filter(~half)))
    for sketched in (whole, both):
        got = {r["column_name"]: r for r in S.profile(sketched).collect()}
        assert set(got) == set(exact)
        for name, r in got.items():
            assert r["non_null_count"] == exact[name]["non_null_count"] and r["data_type"] == exact[name]["data_type"]
            want = exact[name]["distinct_count"]
            assert abs(r["approx_distinct"] - want) <= max(1, 0.03 * want), name  # four standard errors
    amounts = sorted(r[0] for r in sales.select("amount_in_usd").collect())
    q = {r["column_name"]: r["approx_quantiles"] for r in S.profile(both).collect()}["amount_in_usd"]
    assert q[0] == amounts[0] and q[-1] == amounts[-1]
    rank = sum(a <= q[2] for a in amounts) / len(amounts)
    assert abs(rank - 0.5) < 0.05


def test_empty_columns_and_tables(spark):
    rows = spark.createDataFrame([(None, "a"), (None, None)], "n int, s string")
    got = {r["column_name"]: r for r in S.profile(S.sketches(rows)).collect()}
    assert (got["n"]["non_null_count"], got["n"]["approx_distinct"], got["n"]["approx_quantiles"]) == (0, 0, None)
    assert (got["s"]["non_null_count"], got["s"]["approx_distinct"]) == (1, 1)
    assert [r["non_null_count"] for r in S.profile(S.sketches(rows.limit(0))).collect()] == [0, 0]
