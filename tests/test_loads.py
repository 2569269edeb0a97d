"""CSV loads with rejects, figures observed while writing, mergeable customer sets."""

import pytest
from pyspark.sql import functions as F

from revcurve.functions import domain as D
from revcurve.operators import customer_sets as C
from revcurve.operators import observed as O
from revcurve.operators import profile as P
from revcurve.operators import staging as T
from revcurve.sources.files import read_model, write_model
from revcurve.sources.rejects import TooManyRejects, load_csv

from hand_rows import crafted, frame, random_rows
from test_hand_rows import _spark_sales

HEADER = ",".join(D.SALES_COLUMNS)
GOOD = "1,new customer,P01,New,2019-01-02,,1,10.0,0.5"


@pytest.fixture(scope="module")
def sales(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sales") / "rows")
    write_model(_spark_sales(spark, frame(crafted() + random_rows(5, 300))), path)
    return read_model(spark, path)


def _files(folder, *files):
    folder.mkdir()
    for i, lines in enumerate(files):
        (folder / f"{i}.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    return str(folder)


def test_bad_lines_are_kept_apart_with_their_reason(spark, tmp_path):
    bad_day = GOOD.replace("2019-01-02", "02/01/2019")
    two = bad_day.replace("10.0", "ten")
    short, long = GOOD.rsplit(",", 1)[0], GOOD + ",x"
    quoted = GOOD.replace("P01", '"P,01"')
    path = _files(tmp_path / "in", [GOOD, bad_day, short, GOOD], [long, two, quoted, GOOD.replace("1,new", ",new")])
    load = load_csv(spark, path, str(tmp_path / "out"), max_rejected_share=0.5)
    assert (load.read, load.rejected) == (8, 4)
    assert load.good.count() + load.rejects.count() == load.read
    assert {(r["line"], r["reason"]) for r in load.rejects.collect()} == {
        (bad_day, "unreadable: processed_date"), (two, "unreadable: processed_date, amount_in_usd"),
        (short, "wrong number of columns"), (long, "wrong number of columns"),
    }
    good = load.good.collect()
    assert load.good.columns == list(D.SALES_COLUMNS) and {r["product_code"] for r in good} == {"P01", "P,01"}
    assert {r["customer"] for r in good} == {1, None}


def test_a_load_beyond_the_bound_fails_and_shows_its_rejects(spark, tmp_path):
    path = _files(tmp_path / "in", [GOOD, GOOD + ",x"])
    with pytest.raises(TooManyRejects, match="1 of 2"):
        load_csv(spark, path, str(tmp_path / "out"), max_rejected_share=0.1)
    assert spark.read.parquet(str(tmp_path / "out" / "rejected=true")).count() == 1


def test_a_load_without_rows_or_rejects(spark, tmp_path):
    load = load_csv(spark, _files(tmp_path / "none", []), str(tmp_path / "out0"))
    assert (load.read, load.rejected, load.good.count(), load.rejects.count()) == (0, 0, 0, 0)
    load = load_csv(spark, _files(tmp_path / "good", [GOOD] * 3), str(tmp_path / "out1"), max_rejected_share=0.0)
    assert (load.read, load.rejected, load.good.count()) == (3, 0, 3)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.csv").write_text("customer,quantity\n1,2\n")
    with pytest.raises(ValueError, match="product_code"):
        load_csv(spark, str(tmp_path / "x"), str(tmp_path / "out2"))


def test_renamed_and_extra_columns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(f"extra,{HEADER.replace('customer,', 'client,', 1)}\nq,{GOOD}\nq,{GOOD.replace('1,new', 'one,new')}\n")
    load = load_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), max_rejected_share=0.5, rename={"client": "customer"})
    assert load.good.first()["customer"] == 1 and load.rejects.first()["reason"] == "unreadable: client"


def test_observed_figures_equal_the_queries(spark, sales, tmp_path):
    got = O.write_observed(sales, T.staging_model, str(tmp_path / "stg")).first().asDict()
    want = P.date_range(sales).first().asDict() | P.discount_codes(sales).first().asDict() | P.amount_range(sales).first().asDict()
    want |= P.sub_cent_amounts(sales).first().asDict()
    want["total_transactions"] = P.totals(sales).first()["total_transactions"]
    want["rows_without_code"] = sales.filter("discount_id IS NULL").count()
    assert got == want
    stg = T.staging_model(sales)
    assert read_model(spark, str(tmp_path / "stg")).exceptAll(stg).count() == 0


def test_observed_figures_come_without_a_model_that_reads_the_rows(spark, sales, tmp_path):
    """The figures were waited for without end."""
    want = O.write_observed(sales, T.staging_model, str(tmp_path / "stg")).first()
    other = spark.range(3)
    assert O.write_observed(sales, lambda rows: other, str(tmp_path / "other")).first() == want
    assert read_model(spark, str(tmp_path / "other")).count() == 3


def test_merged_sets_of_two_halves_equal_the_whole(sales):
    old = F.coalesce(F.col("processed_date") < "2019-06-01", F.lit(False))
    parts = C.merged(C.customer_sets(sales.filter(old)), C.customer_sets(sales.filter(~old)))
    halves, whole = C.answers(parts), C.answers(C.customer_sets(sales))
    assert halves.exceptAll(whole).count() == 0 and whole.exceptAll(halves).count() == 0
    for question, one in (("s04", P.by_status(sales)), ("s05", P.by_product(sales)), ("s06", P.by_quantity(sales)), ("s13", P.discount_sign_by_code(sales))):
        got = whole.filter(F.col("question") == question)
        assert sorted(tuple(r)[-2:] for r in got.collect()) == sorted(tuple(r)[-2:] for r in one.collect())


def test_sets_of_wide_and_negative_ids(spark, sales):
    ids = [0, 1, -1, 32767, 32768, 32769, -32768, -32767, 2**40, 2**40 + 1, -(2**40), None, None]
    rows = sales.limit(1).drop("customer").crossJoin(spark.createDataFrame([(i,) for i in ids], "customer bigint"))
    total = C.answers(C.customer_sets(rows.select(*D.SALES_COLUMNS))).filter("question = 's02'").first()
    assert (total["total_records"], total["total_unique_customers"]) == (13, 11)
