"""Archives, pages, vectors, mixing and the pipeline: exact round trips, brute force, edge cases."""

import io
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from revcurve.llm import ann_mih, html_extract, mixing, warc_zip
from revcurve.llm import registry as R

SF001 = "/root/testdata/sf0.001"


# -- 4: WARC -----------------------------------------------------------------------------------
def _reader(data):
    return lambda at, n: data[at : at + n]


@pytest.mark.parametrize("comment", [b"", b"\n", b"PK\x05\x06 not the end"])
def test_zip64_directory(comment):
    members = [("a/b.txt", b"hello"), ("empty", b""), ("ünï", b"x" * 1000)]
    data = warc_zip.zip_package(members, comment)
    found = warc_zip.zip_directory(_reader(data), len(data))
    assert list(found) == [m[0] for m in members]
    for name, content in members:
        at, size, method = found[name]
        start = warc_zip.member_start(_reader(data), at)
        assert method == 0 and data[start : start + size] == content
    if b"PK" not in comment:  # the standard library does not look past a signature in the comment
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None and z.read("a/b.txt") == b"hello"


def test_plain_zip_of_another_writer_and_bad_files():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.writestr(warc_zip.ARCHIVE, b"")
        z.writestr(warc_zip.INDEX, b"")
    data = buffer.getvalue()
    assert list(warc_zip.records(_reader(data), len(data))) == []
    with pytest.raises(ValueError, match="not a ZIP"):
        warc_zip.zip_directory(_reader(b"nothing here"), 12)
    broken = bytearray(warc_zip.zip_package([("a", b"b")]))
    at = broken.rfind(warc_zip.LOCATOR64)
    broken[at : at + 4] = b"XXXX"
    with pytest.raises(ValueError, match="ZIP64 locator"):
        warc_zip.zip_directory(_reader(bytes(broken)), len(broken))
    assert struct.calcsize("<4sQ2H2L4Q") == 56


def test_records_round_trip(spark, tmp_path):
    long = "x\r\n\r\nWARC/1.1 é" * 30
    rows = [(1, "http://a/ b\nc", long, "extra"), (2, None, long, "e"), (3, "u", "short", "e"), (4, "u", "short", "e"), (5, "u", None, "e"),
            (None, "u", long, "e"), (6, "u", "", "e"), (2, None, long, "e"), (0, "z", "y" * 100_000, "e")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string")
    warc_zip.write(pages, str(tmp_path / "w"), package_bytes=2000)
    got = warc_zip.read(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and all(r["verified"] for r in got)
    kinds = sorted((r["page_id"] if r["page_id"] is not None else -1, r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [(-1, "revisit", 1), (0, "response", None), (1, "response", None), (2, "revisit", 1), (2, "revisit", 1),
                     (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None)]
    for r in got:
        want = next((x[2] or "").encode() for x in rows if x[0] == r["page_id"])
        assert r["payload_bytes"] == len(want)
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == want
    warc_zip.write(pages.limit(0), str(tmp_path / "none"))
    assert warc_zip.read(spark, str(tmp_path / "none")).count() == 0


def test_bytes_through_spark_reader_equal_ranged_reads(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "p" * (i * 40)) for i in range(30)], "page_id bigint, url string, html string")
    warc_zip.write(pages, str(tmp_path / "w"))
    files = spark.read.format("binaryFile").load(str(tmp_path / "w")).where("path like '%part-%'").collect()
    got = sorted(int(r["page_id"]) for f in files for r in warc_zip.records(_reader(bytes(f["content"])), f["length"]))
    assert got == list(range(30))


# -- 9: HTML -----------------------------------------------------------------------------------
def test_main_text_of_messy_markup():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>"
        "<header><h1>Site</h1></header><nav>menu</nav><div class='cookie-notice'>accept</div><!-- <p>c</p> -->"
        "<article class=post><h1>A &amp; B</h1><p>one <b>two<br>three\n  four<p>five &eacute;&#233;&#x41; a &lt; b<ul><li>x<li>y</ul>"
        "<form><input value='q'>form</form><div id='comments'><p>reader</p></div><div class=\"share\">s</div><aside>side</aside>"
        "<table><tr><td>c1<td>c2</table></article><footer>foot</footer></body></html>"
    )
    assert html_extract.main_text(page) == "A & B\none two three four\nfive ééA a < b\nx\ny\nc1\nc2"
    assert html_extract.main_text("<p>only<div role=main>body</div>") == "body"
    assert html_extract.main_text("plain text <i>no</i> tags &amp") == "plain text no tags &"
    assert html_extract.main_text("") == "" and html_extract.main_text("<script>never closed") == "" and html_extract.main_text("<p") == "<p"
    assert html_extract.main_text("<div class='header-image loading'><p>x</p></div><p class=leader>kept</p>") == "kept"
    assert html_extract.main_text("<div>" * 3000 + "deep") == "deep"


def test_templates_are_removed_by_recurrence(spark):
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(n))
    rows = []
    for i in range(40):
        rows.append((i, "http://host.a/%d" % i, f"<body><div><p>All about us</p></div><article><p>{words(9)}</p><div><p>Sign up now</p></div><p>{words(5)}</p></article></body>"))
    for i in range(40, 60):  # copies of one page are no template
        rows.append((i, "http://host.b/%d" % i, "<body><article><p>the same page text</p></article></body>"))
    rows += [(60, None, "<p>no host</p>"), (61, "http://host.c/", None), (61, "http://host.c/", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("n_chars", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for i in range(40):
        assert "Sign up" not in got[i] and "All about" not in got[i] and got[i].count("\n") == 1
    assert got[45] == "the same page text" and got[60] == "no host" and got[61] == ""
    assert html_extract.extract(pages).count() == len(rows)
    assert html_extract.extract(pages.limit(0)).count() == 0
    with pytest.raises(ValueError, match="text"):
        html_extract.extract(pages.withColumn("text", F.lit("")))


def test_articles_and_their_wrappers_stay_whatever_their_class():
    text = html_extract.main_text
    assert text("<nav>menu</nav><article class='hentry category-social'><p>whole text</p></article>") == "whole text"
    assert text("<div id=page class=has-sidebar><div class=sidebar>side</div><main><p>whole text</p></main></div>") == "whole text"
    assert text("<body><div class='review-body'><p>only text</p></div><footer>foot</footer></body>") == "only text"
    assert text("<article><div class=share>s</div></article><p>beside</p>") == "beside"
    assert text("<article><p>text</p><div id=comments><article class=comment>reply</article></div></article>") == "text"
    assert text("<div class=sidebar><aside><article>aside</article></aside>side</div><p>text</p>") == "text"
    assert text("<article hidden>gone</article><nav>menu</nav>") == ""


def test_small_hosts_lose_their_menus_but_not_shared_passages(spark):
    page = "<body><div><p>Home News Contact</p></div><div><p>text {0}</p></div></body>"
    rows = [(i, f"http://small/{i}", page.format(i)) for i in range(4)]
    page = "<body><article><p>shared passage</p><p>text {0}</p></article></body>"
    rows += [(30 + i, f"http://article/{i}", page.format(i)) for i in range(4)]
    rows += [(10 + i, f"http://pair/{i}", f"<p>same passage</p><p>text {i}</p>") for i in range(2)]
    rows += [(20 + i, f"http://mid/{i}", f"<p>{'same passage' if i < 3 else i * 100}</p><p>text {i}</p>") for i in range(7)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == [f"text {i}" for i in range(4)]
    assert [got[30 + i] for i in range(4)] == [f"shared passage\ntext {i}" for i in range(4)]
    assert all(got[10 + i] == f"same passage\ntext {i}" for i in range(2))
    assert all(got[20 + i] == f"same passage\ntext {i}" for i in range(3))


def test_html_query(spark):
    got = R.op9_html_templates(spark, SF001).collect()
    assert len(got) == spark.read.parquet(f"{SF001}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) and "<" not in r["text"][:20] for r in got)


# -- 6: neighbours -----------------------------------------------------------------------------
def _exact(ids, x, queries, k):
    out = {}
    for q in np.flatnonzero(queries):
        s = x @ x[q]
        s[q] = -np.inf
        order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[ids[q]] = [(ids[i], s[i]) for i in order]
    return out


@pytest.mark.parametrize("norms", [False, True])
def test_recall_against_brute_force(spark, norms):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms:
        x *= rng.uniform(0.3, 2, (3000, 1))
    ids = np.arange(3000) * 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>")
    got = ann_mih.search(df, F.col("id") % 20 == 0, k=20, block_rows=1100, query_rows=60).toPandas()
    want = _exact(ids, x, ids % 20 == 0, 20)
    assert set(got.query_id) == set(want)
    hits = sum(len(set(g.vec_id) & {i for i, _ in want[q]}) for q, g in got.groupby("query_id"))
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and (np.diff(g.score) <= 0).all() and q not in set(g.vec_id)
        assert np.allclose(g.score, x[g.vec_id.values // 3] @ x[q // 3], atol=1e-12)


def test_isolated_queries_get_all_their_neighbours(spark):
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    centres = unit(rng.normal(size=(30, 24)))
    x = unit(np.concatenate([np.repeat(centres, 100, 0) + 0.02 * rng.normal(size=(3000, 24)), rng.normal(size=(30, 24))]))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = ann_mih.search(df, F.col("id") % 5 == 0, k=20, block_rows=1100, query_rows=400).toPandas()
    assert got.groupby("query_id").size().to_dict() == {i: 20 for i in range(0, 3030, 5)}
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and (np.diff(g.score) <= 0).all() and q not in set(g.vec_id)
    few = ann_mih.search(df.where("vec_id >= 3020"), F.col("id") % 5 == 0, k=20).toPandas()
    assert few.groupby("query_id").size().to_dict() == {3020: 9, 3025: 9}


def test_probing_equals_comparing_all_codes():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << 63, (20000, 1), dtype=np.uint64)
    codes[:40] = codes[0] ^ (np.uint64(1) << rng.integers(0, 63, 40, dtype=np.uint64))[:, None]
    block = ann_mih.Block(codes, 7)
    assert not block.wide
    for q in (0, 5, 100):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[q]).sum(1) <= 7)
        assert block.within(codes[q]).tolist() == want.tolist()


def test_vectors_that_take_no_part(spark):
    good = [(20 * i, [float(i % 3), 1.0, float(i)]) for i in range(6)]
    bad = [(200, None), (220, [0.0, 0.0, 0.0]), (240, [float("nan"), 1.0, 1.0]), (260, [None, 1.0, 2.0]), (280, [float("inf"), 1.0, 0.0]), (300, [1.0]), (None, [1.0, 1.0, 1.0]), (320, [])]
    df = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1))
    got = ann_mih.search(df, F.col("id") % 20 == 0, k=20).collect()
    assert {r["query_id"] for r in got} == {i for i, _ in good} and len(got) == 30
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in (20, 5, 3, 40)], "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann_mih.search(ties, F.col("id") % 20 == 0, k=2).collect()}
    assert got == {(20, 1): 3, (20, 2): 5, (40, 1): 3, (40, 2): 5}
    assert ann_mih.search(ties.limit(0), F.col("id") % 20 == 0).count() == 0
    assert ann_mih.search(ties, F.col("id") > 1000).count() == 0


# -- 8: mixing ---------------------------------------------------------------------------------
def _slow_rates(p, n, targets, ridge, rounds=20000):
    r, eta = np.ones(len(n)), 1 / (1 + ridge)
    for _ in range(rounds):
        s = (p * (n * r)[:, None]).sum(0) / n.sum()
        r = np.maximum(0, r - eta * (p @ (s - targets) + ridge * (r - 1)))
    return r


def test_rates_equal_slow_projected_gradient(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 60)
    n = rng.integers(1, 500, 60)
    targets = [0.7, 0.25, 0.05]
    df = spark.createDataFrame([(i, 1, int(t), row.tolist()) for i, (t, row) in enumerate(zip(n, p, strict=True))], "row bigint, copies bigint, n_tokens bigint, p array<double>")
    got = mixing.fit_rates(df, targets, ridge=0.05, tolerance=1e-6).orderBy("row").toPandas()
    want = _slow_rates(p, n, np.array(targets), 0.05)
    assert np.abs(got.rate - want).max() < 0.02 and (got.rate >= 0).all()


def test_mix_reaches_targets_and_separates_languages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = R.op8_soft_mixing(spark, SF001).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == docs.count()
    p = got[[f"p_{d}" for d in R.MIX_TARGETS]].values
    assert np.allclose(p.sum(1), 1)
    shares = (p * (got.n_tokens * got.rate).values[:, None]).sum(0) / got.n_tokens.sum()
    assert np.abs(shares - list(R.MIX_TARGETS.values())).max() < 0.01
    best = np.array(list(R.MIX_TARGETS))[p.argmax(1)]
    assert (best == got.lang).mean() > 0.95


def test_mixing_edge_cases_and_native_plan(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (3, "aa bb cc", 1.0), (4, "xx yy zz", 1.0), (4, "xx yy zz", 1.0), (None, "aa xx", 1.0), (5, "aa " * 20000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rate double")
    labelled = spark.createDataFrame([(3, "a"), (4, "x"), (4, None), (None, "a"), (5, "odd")], "doc_id bigint, domain string")
    out = mixing.mix(docs, labelled, {"a": 1.0, "x": 3.0})
    got = out.collect()
    assert len(got) == len(rows) and all(r["mix_rate"] >= 0 and abs(sum(r["mix_posterior"].values()) - 1) < 1e-9 for r in got)
    assert {r["mix_tokens"] for r in got if r["doc_id"] in (1, 2)} == {0}
    same = [r["mix_rate"] for r in got if r["doc_id"] == 4]
    assert len(same) == 2 and same[0] == same[1] and {r["mix_tokens"] for r in got if r["doc_id"] == 4} == {3}
    assert set(got[0]["mix_posterior"]) == {"a", "x", "other"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    none = mixing.mix(docs, labelled.limit(0), {"a": 1.0}).collect()
    assert {r["mix_rate"] for r in none} == {1.0}
    assert mixing.mix(docs.limit(0), labelled, {"a": 1.0}).count() == 0
    with pytest.raises(ValueError, match="mix_rate"):
        mixing.mix(docs.withColumn("mix_rate", F.lit(1)), labelled, {"a": 1.0})


# -- pipeline ----------------------------------------------------------------------------------
def test_pipeline(spark):
    import corpus_pipeline

    from revcurve.llm import decontaminate, line_templates, quality_cnn, simhash_variants  # noqa: F401
    from revcurve.llm.common import remainder, store

    docs = spark.read.parquet(f"{SF001}/documents.parquet").withColumn("extra", F.lit("kept"))
    odd = spark.createDataFrame([(None, None, None, None, None, None), (10_000_000, "", "en", "src0", 0, "e")], ", ".join(f"{c} {t}" for c, t in docs.dtypes))
    docs = store(docs.unionByName(odd).unionByName(docs.limit(3)), "test")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    model = quality_cnn.train(docs, labels, remainder("doc_id", 5) != 0)
    accepted = docs.where(quality_cnn.score(model) >= corpus_pipeline.KEEP_QUALITY)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "mixing to target weights"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = store(stage(spark, docs, SF001), "test")
        if k == 0:
            assert sorted(map(repr, after.collect())) == sorted(map(repr, accepted.collect()))
        if k == 1:
            assert after.count() == docs.count() and after.where("n_chars <> char_length(text)").count() == 0
        if k == 2:
            groups = simhash_variants.groups(docs)
            assert after.count() == groups.select("root").distinct().count()
            assert after.join(docs.select("doc_id").distinct(), "doc_id", "left_anti").where("doc_id is not null").count() == 0
        if k == 3:
            found = decontaminate.find(docs, spark.read.parquet(f"{SF001}/benchmark.parquet")).select("doc_id").distinct()
            assert after.count() == docs.join(found, "doc_id", "left_anti").count()
        if k < 4:
            assert after.columns == columns
        docs = after
    assert after.columns == [*columns, "mix_rate", "copy"] and 0 < after.count()
    ran = corpus_pipeline.run(spark, SF001)
    assert ran.columns == [*columns[:-1], "mix_rate", "copy"] and ran.count() > 0
