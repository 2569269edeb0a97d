"""Site templates: every block subtree is counted, and what recurs on a host goes whatever its markup."""

from collections import defaultdict
from urllib.parse import urlparse

from pyspark.sql import functions as F

from revcurve.llm import html_extract as H

SF01 = "/root/testdata/sf0.01"


def _recount(rows, min_pages, outer_share, inner_share, few_pages):
    """host -> templates, counted with plain dictionaries."""
    held, inside, total = defaultdict(lambda: defaultdict(set)), defaultdict(set), defaultdict(set)
    for url, html in rows:
        host = (urlparse(url or "").hostname or "").lower()
        content, outer, inner = H.page_subtrees(html or "")
        total[host].add(content)
        for h in [*outer, *inner]:
            held[host][h].add(content)
        inside[host] |= set(inner)
    out = {}
    for host, subtrees in held.items():
        found = set()
        for h, pages in subtrees.items():
            n, within = len(pages), h in inside[host]
            share = inner_share if within or n < min_pages else outer_share
            if n >= (min_pages if within else min(min_pages, few_pages)) and n >= len(total[host]) * share:
                found.add(h)
        if found:
            out[host] = found
    return out


def test_templates_equal_a_plain_recount(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet").select("page_id", "url", "html")
    menu = "<div class='top'><ul><li>Home</li><li>News</li></ul></div>"
    extra = [(10**6 + i, f"http://made.example/{i}", f"<body>{menu}<nav><p>all pages</p></nav><article><p>text {i}</p></article></body>") for i in range(30)]
    pages = pages.unionByName(spark.createDataFrame(extra, "page_id bigint, url string, html string"))
    rows = [(r["url"], r["html"]) for r in pages.collect()]
    for thresholds in ((8, 0.02, 0.5, 3), (2, 0.01, 0.3, 2)):
        names = ("min_pages", "outer_share", "inner_share", "few_pages")
        got = {r["host"]: set(r["templates"]) for r in H.site_templates(pages, **dict(zip(names, thresholds))).collect()}
        assert got == _recount(rows, *thresholds) and len(got["made.example"]) >= 5


def test_the_host_count_sees_marked_menus(spark):
    """Menus that markup names are counted like all others; on the given pages some recur."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = H.site_templates(pages).select(F.explode("templates").alias("h"), "host")
    assert found.count() > 0


def test_an_article_keeps_title_sections_and_formulas():
    page = (
        "<article><header><h1>Title</h1></header><p>one</p><div class='reviews'><p>The review body text</p></div>"
        "<section id='social'><p>Social policy chapter</p></section><p>x<math><mi>y</mi></math></p></article>"
    )
    assert H.main_text(page) == "Title\none\nThe review body text\nSocial policy chapter\nxy"
    page = "<body><header>Site</header><article><p>a</p><div class=comments>no</div><div class=ad>buy</div><form>f</form><nav>n</nav></article></body>"
    assert H.main_text(page) == "a"
