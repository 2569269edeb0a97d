"""HTML extraction with site template removal.

Every page is parsed into a small element tree. Each element subtree has a hash of its tags
and text; Spark counts, per host, in how many different pages a hash occurs, and subtrees that
recur across many pages of the host are deleted before the text is read (menus, notices and
other templates). All block subtrees with words are counted, whatever their markup. What no count can see, since a
page has it to itself, goes by its markup: elements that HTML or their class or id name as
boilerplate (navigation, header, footer, aside, form, advert, notice, comments, ...). A class or id word drops
neither an ``article`` / ``main`` element nor one that holds it, and within it only replies, adverts and share buttons; an
article's own ``header`` stays. The text comes from the page's ``article`` / ``main`` element when it
has one with text, else from its body; where class and id words would leave a page without text, they
do not count.

A page counts once per host and *content*: copies of one page do not make its text a template.
Inside the main element a subtree is a template only when it recurs in a share ``inner_share``
of the host's different pages, elsewhere in ``outer_share``; both need ``min_pages`` pages. Outside,
``few_pages`` are enough when they are the share ``inner_share``, so small hosts lose their menus too.

Work per run: one pass that emits (host, content, subtree hashes) rows, without text; two
aggregates with map-side partial sums; and one pass over the pages joined with the host's
template hashes (one row per host, repeated for each of :data:`HOST_PARTS` parts of the host's
pages, so a hot host is spread; broadcast by Spark while it is below the session's threshold).

Defined results: null html reads as empty; a page without text gives an empty string; a null
or unparsable url is a host of its own kind (the empty host); repeated rows give repeated
results; other columns are kept out.
"""

from __future__ import annotations

import hashlib
import html as _html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcurve.llm.common import store, text_of

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
DROPPED = RAW | frozenset("head nav header footer aside form button select option input label menu dialog audio video".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "optgroup", "option", "summary"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div article section main body td th blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

HOST_PARTS = 64

_BOILER = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|"
    r"footer|sidebar|side-?bar|aside|widget|related|recommend\w*|share|sharing|social|cookies?|consent|notice|gdpr|popup|modal|"
    r"overlay|newsletter|subscribe|subscription|signup|login|comments?|commentlist|respond|replies|reply|disqus|discussion|reviews?|"
    r"pagination|pager|copyright|disclaimer|skip|hidden|toolbar|tags|paywall|alert)(?:$|[\s_-])",
    re.I,
)
# what class and id words may drop within an article: replies to it, adverts and buttons to share it
_REPLIES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|comments?|commentlist|respond|replies|reply|disqus|share|sharing)(?:$|[\s_-])", re.I
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMED = re.compile(r"\b(?:class|id|role|hidden|aria-hidden|style)\b", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v   -     　]+")


class Node:
    """An element: its tag, whether its markup says boilerplate (``named``: by a class or id word, ``reply``: by one that
    counts within an article too), and children (nodes, text)."""

    __slots__ = ("tag", "boiler", "named", "children", "main", "reply")

    def __init__(self, tag: str, boiler: bool = False, named: bool = False, main: bool = False, reply: bool = False):
        self.tag, self.boiler, self.named, self.main, self.reply, self.children = tag, boiler, named, main, reply, []


def _attributes(tag: str, attrs: str) -> tuple[bool, bool, bool, bool]:
    """(boilerplate by its own markup, by a class or id word, a main element, by a word for replies) for a start tag."""
    main = tag in ("article", "main")
    if tag in DROPPED:
        return True, False, False, False
    if not attrs or not _NAMED.search(attrs):
        return False, False, main, False
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    role = got.get("role", "").strip().lower()
    boiler = role in ROLES or "hidden" in got or got.get("aria-hidden") == "true" or bool(_HIDDEN_STYLE.search(got.get("style", "")))
    names = (got.get("class", ""), got.get("id", ""))
    named = tag not in ("body", "html", "main") and any(map(_BOILER.search, names))
    return boiler, named, (main or role == "main") and not boiler, named and any(map(_REPLIES.search, names))


def parse(text: str) -> Node:
    """Element tree of a page; unclosed and misnested tags are closed the way browsers do."""
    root = Node("#root")
    stack, at, n, some_named = [root], 0, len(text), False
    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            stack[-1].children.append(text[at:])
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        if m[3] is None:
            if m[1]:
                stack[-1].children.append(m[1].replace("&", "&amp;"))
            continue
        tag = m[3].lower()
        if m[2]:
            _close(stack, tag)
            continue
        attrs = m[4]
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            at = end.end() if end else n
            stack[-1].children.append(Node(tag, True))
            continue
        if tag in CLOSES_P:
            _close(stack, "p", SCOPES - {"p"})
        if tag in SIBLINGS:
            _close_siblings(stack, SIBLINGS[tag])
        boiler, named, main, reply = _attributes(tag, attrs)
        if tag == "header" and any(n.main for n in stack):
            boiler = False  # the heading of the article itself
        some_named = some_named or named
        node = Node(tag, boiler, named, main, reply)
        stack[-1].children.append(node)
        if tag not in VOID and not attrs.rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
            stack.append(node)
    if some_named:
        _drop_named(root)
    return root


def _drop_named(root: Node) -> None:
    """Mark what class and id words drop: no main element and none that holds one, within a main element only replies,
    adverts and share buttons, and nothing when no text would be left."""
    order, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        order.append((node, inside))
        if not node.boiler:
            todo.extend((c, inside or node.main) for c in node.children if isinstance(c, Node))
    holds: set[int] = set()
    dropped = []
    for node, inside in reversed(order):
        if not node.boiler and (node.main or any(id(c) in holds for c in node.children if isinstance(c, Node))):
            holds.add(id(node))
        if not node.boiler and (node.reply if inside else node.named and id(node) not in holds):
            dropped.append(node)
    for node in dropped:
        node.boiler = True
    todo = [root]
    while todo:
        node = todo.pop()
        if not node.boiler:
            if any(not isinstance(c, Node) and c.strip() for c in node.children):
                return
            todo.extend(c for c in node.children if isinstance(c, Node))
    for node in dropped:
        node.boiler = False


def _close(stack: list[Node], tag: str, scope: frozenset | set = frozenset()) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in scope:
            return


def _close_siblings(stack: list[Node], tags: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in ("ul", "ol", "dl", "table", "select", "article", "main", "body"):
            return


def _digest(parts: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b"\x00".join(parts), digest_size=8).digest(), "little", signed=True)


def _walk(root: Node):
    """Nodes below the root in document order with whether they stand in a main element."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        yield node, inside
        todo.extend((c, inside or node.main) for c in reversed(node.children) if isinstance(c, Node))


def subtree_hashes(root: Node) -> dict[int, int]:
    """id(node) -> hash of its tag, child hashes and text (white space squeezed), bottom up."""
    order = [n for n, _ in _walk(root)]
    out: dict[int, int] = {}
    for node in reversed(order):
        parts = [node.tag.encode()]
        for c in node.children:
            if isinstance(c, Node):
                parts.append(out[id(c)].to_bytes(8, "little", signed=True))
            elif t := " ".join(c.split()):
                parts.append(t.encode("utf-8", "replace"))
        out[id(node)] = _digest(parts)
    return out


def page_subtrees(page: str) -> tuple[int, list[int], list[int]]:
    """(hash of the page's text blocks, subtree hashes outside and inside its main element).

    All block elements that hold words count, whatever their markup says about them.
    """
    root = parse(page)
    hashes = subtree_hashes(root)
    outer, inner, todo = set(), set(), [(root, False)]
    words: dict[int, bool] = {}
    for node in reversed([n for n, _ in _walk(root)]):
        words[id(node)] = any(words[id(c)] if isinstance(c, Node) else c.strip() for c in node.children)
    while todo:
        node, inside = todo.pop()
        for c in node.children:
            if isinstance(c, Node) and words[id(c)]:
                todo.append((c, inside or c.main))
                if c.tag in BLOCK and c.tag not in ("html", "body") and not c.main:
                    (inner if inside else outer).add(hashes[id(c)])
    return _digest([b.encode("utf-8", "replace") for b in blocks(root, {}, frozenset())]), sorted(outer - inner), sorted(inner)


def blocks(root: Node, hashes: dict[int, int], templates: frozenset[int]) -> list[str]:
    """Text blocks of the main content in page order."""
    mains = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.boiler or (hashes and hashes[id(node)] in templates):
            continue
        if node.main:
            mains.append(node)
        else:
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    found: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            text = _SPACE.sub(" ", _html.unescape("".join(line))).strip(" ")
            if text:
                found.append(text)
            line.clear()

    def read(top: Node) -> None:
        work: list = [top]
        while work:
            x = work.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif x.tag in ("br", "wbr"):
                line.append(" " if x.tag == "br" else "")
            elif not x.boiler and not (hashes and hashes[id(x)] in templates):
                block = x.tag in BLOCK or x is top
                if block:
                    flush()
                    work.append(None)
                work.extend(reversed(x.children))
        flush()

    for top in mains:
        read(top)
    if not found:
        read(root)
    return found


def main_text(page: str, templates: frozenset[int] = frozenset()) -> str:
    """Main text of one page with the given template subtrees deleted."""
    root = parse(page)
    return "\n".join(blocks(root, subtree_hashes(root) if templates else {}, templates))


def host_of(url_col: str = "url") -> Column:
    """Host of a url in lower case, empty when there is none."""
    return F.lower(F.regexp_extract(text_of(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _subtrees(pages: pa.Array) -> pa.Array:
    got = [page_subtrees(t) for t in pages.to_pylist()]
    return pa.StructArray.from_arrays(
        [pa.array([g[0] for g in got], pa.int64())] + [pa.array([g[k] for g in got], pa.list_(pa.int64())) for k in (1, 2)],
        ["content", "outer", "inner"],
    )


def site_templates(pages: DataFrame, min_pages: int = 8, outer_share: float = 0.02, inner_share: float = 0.5, few_pages: int = 3, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(host, templates): the subtree hashes that recur across many different pages of a host."""
    seen = pages.select(
        host_of(url_col).alias("host"),
        F.arrow_udf(_subtrees, "struct<content: bigint, outer: array<bigint>, inner: array<bigint>>")(text_of(html_col)).alias("s"),
    ).select("host", "s.*")
    # one pass emits the subtrees and, as a null hash, the page itself
    rows = seen.select(
        "host", "content",
        F.explode(F.concat(
            F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(False).alias("inside"))),
            F.transform("outer", lambda h: F.struct(h.alias("h"), F.lit(False).alias("inside"))),
            F.transform("inner", lambda h: F.struct(h.alias("h"), F.lit(True).alias("inside"))),
        )).alias("x"),
    ).select("host", "content", "x.*").distinct()
    counts = rows.groupBy("host", "h").agg(F.count("*").alias("pages"), F.max("inside").alias("inside"))
    recurring = store(counts.where((F.col("pages") >= F.when(F.col("inside"), min_pages).otherwise(min(min_pages, few_pages))) | F.col("h").isNull()), "html-subtrees")
    totals = recurring.where(F.col("h").isNull()).select("host", F.col("pages").alias("total"))
    share = F.when(F.col("inside") | (F.col("pages") < min_pages), inner_share).otherwise(outer_share)
    # the share bounds a host's list: each page holds few subtrees, a template many pages
    return (
        recurring.where(F.col("h").isNotNull()).join(totals, "host").where(F.col("pages") >= F.col("total") * share)
        .groupBy("host").agg(F.collect_list("h").alias("templates"))
    )


def _extract(pages: pa.Array, templates: pa.Array) -> pa.Array:
    sets: dict[tuple, frozenset] = {}
    out = []
    for t, h in zip(pages.to_pylist(), templates.to_pylist(), strict=True):
        key = tuple(h or ())
        out.append(main_text(t, sets.setdefault(key, frozenset(key))))
    return pa.array(out, pa.string())


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", **thresholds) -> DataFrame:
    """``pages`` (html column and all others) with ``text``, the main text without site templates."""
    if "text" in pages.columns or "templates" in pages.columns:
        raise ValueError("the input has a column named text or templates; rename it")
    templates = store(site_templates(pages, html_col=html_col, url_col=url_col, **thresholds), "html-templates")
    # the few template rows go to every part of a host, so that a hot host's pages are spread
    spread = templates.select(F.col("host").alias("_host"), "templates", F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1))).alias("_part"))
    part = F.pmod(F.xxhash64(html_col, url_col), F.lit(HOST_PARTS)).cast("int")
    clash = {"_host", "_part"} & set(pages.columns)
    if clash:
        raise ValueError(f"the input has columns named {sorted(clash)}; rename them")
    joined = pages.withColumns({"_host": host_of(url_col), "_part": part}).join(spread, ["_host", "_part"], "left")
    udf = F.arrow_udf(_extract, "string")
    return joined.withColumn("text", udf(text_of(html_col), F.col("templates"))).drop("_host", "_part", "templates")
