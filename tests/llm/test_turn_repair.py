"""Conversation repair: the parser against exhaustive search, the query against a plain loop."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from revcurve.llm import turn_repair as R
from revcurve.llm.registry import damaged, queries

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def _cheapest(rows):
    """Dijkstra over (rows read, last role) in the order of (cost, audit): a plain automaton, no grammar."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit
        if (i, last) in seen:
            continue
        seen.add((i, last))
        for x in "ua":
            if (last, x) in NEXT:
                heapq.heappush(heap, (cost + 5, audit + "I", i, NEXT[last, x]))
        if i == len(rows):
            continue
        initial, fault = rows[i]
        stay = 5 if fault == "truncated" else 0
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last))
        if fault in ("blank", "duplicate"):
            continue
        if (last, initial) in NEXT:
            heapq.heappush(heap, (cost + stay, audit + "K", i + 1, NEXT[last, initial]))
        for x in "ua":
            if (last, x) in NEXT:
                heapq.heappush(heap, (cost + 1 + stay, audit + "R", i + 1, NEXT[last, x]))
    raise AssertionError


def _rows(rnd, n):
    return [(rnd.choice("ssuaauat"), rnd.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(n)]


def test_parser_finds_the_cheapest_edits_and_least_audit():
    table, rnd = R.stacks(), random.Random(7)
    for _ in range(1500):
        rows = _rows(rnd, rnd.randint(0, 12))
        assert R.finish(table, R.parse(table, {0: (0, "")}, rows)) == _cheapest(rows)


def test_stretches_compose():
    table, rnd = R.stacks(), random.Random(8)
    for _ in range(200):
        rows = _rows(rnd, rnd.randint(2, 20))
        cut, joined = rnd.randint(0, len(rows)), {}
        for stack, (cost, audit) in R.parse(table, {0: (0, "")}, rows[:cut]).items():
            for after, (c, a) in R.parse(table, {stack: (0, "")}, rows[cut:]).items():
                R._better(joined, after, (cost + c, audit + a))
        assert R.finish(table, joined) == _cheapest(rows)


def test_unbounded_grammar_is_an_error():
    with pytest.raises(ValueError, match="bounded"):
        R.Stacks((("S", ""), ("S", "N"), ("N", "uNa"), ("N", "ua")))


def _plain(rows):
    """The contract as a loop: rows (conv, turn, role, text) to {conv: result}."""
    out = {}
    text_of = lambda v: " " if v is None else str(v)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        held = []
        for _, turn, role, text in mine:
            role, text = text_of(role), text_of(text)
            hit = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
            if hit == 0:
                continue
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            role = "user" if hit == 4 else role
            held += [(turn, role, text)] * (2 if hit == 3 else 1)
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        kinds, seen = [], set()
        for _, role, text in held:
            solid = re.sub("[\x20\x09-\x0d]+$", "", text)
            kinds.append((role[:1], "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        cost, audit = _cheapest(kinds)
        lines, at, system = [], 0, False
        for c in audit:
            part = "ua"[(len(lines) - system) % 2]
            name = {"u": "user", "a": "assistant"}[part]
            if c == "I":
                lines.append(f"{name}:")
                continue
            _, role, text = held[at]
            at += 1
            if c == "K":
                system = system or not lines and role[:1] == "s"
                lines.append(f"{role}:{text}")
            elif c == "R":
                lines.append(f"{name}:{text}")
        pairs = [a + b for (a, _), (b, _) in zip(kinds, kinds[1:])]
        count = lambda f: sum(k == f for _, k in kinds)
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def _odd_rows():
    rnd = random.Random(4)
    rows = []
    for conv in range(120):
        for turn in range(rnd.randint(1, 9)):
            role = ["user", "assistant"][turn % 2] if rnd.random() < 0.8 else rnd.choice(["system", "tool", "", None, "user"])
            text = rnd.choice(["One. Two!", "no end", "really?", "  \t", "", None, "fin.\n ", "é!", "same."])
            rows.append((conv, None if rnd.random() < 0.05 and turn == 0 else turn * rnd.choice([1, 1, 3]), role, text))
    # equal turns of different rows are left to the tie rule, so keep one row a turn
    rows = list({(r[0], r[1]): r for r in rows}.values())
    return rows + [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (-3, None, "system", "x.")]


@pytest.mark.parametrize("stretch", [1, 3, 4096])
def test_query_columns_equal_a_plain_loop(spark, stretch, monkeypatch, tmp_path):
    rows = _odd_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(R.repair, "__defaults__", (*R.repair.__defaults__[:-1], stretch))
    got = {r["conv_id"]: tuple(r)[1:] for r in queries()["op12_glr_repair"](spark, str(tmp_path)).collect()}
    assert got == _plain(rows)


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in queries()["op12_glr_repair"](spark, sf).collect()}
    assert got == _plain(rows)


def test_long_conversation_repeated_rows_and_clashing_names(spark):
    long = [(1, i, ["user", "assistant"][i % 2], f"text {i}.") for i in range(3000)] + [(2, 5, "user", "again.")] * 2000
    rows = spark.createDataFrame([(*r, "x", 1) for r in long], f"{SCHEMA}, audit string, ordinal int").repartition(6)
    fixed = R.repair(rows, stretch=100)
    got = {r["conv_id"]: r for r in fixed.conversations.collect()}
    assert got[1]["audit"] == "K" * 3000 and got[1]["cost"] == 0
    assert got[2]["duplicate"] == 1999 and got[2]["cost"] == 2 * 2000 and got[2]["audit"] == "D" * 2000
    assert fixed.rows.where("conv_id = 1").orderBy("turn").head(2)[1]["text"] == "text 1."


def test_empty_table(spark):
    fixed = R.repair(damaged(spark.createDataFrame([], SCHEMA)))
    assert fixed.conversations.collect() == [] and fixed.rows.collect() == []
