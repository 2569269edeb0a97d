"""Prefix tries: the Z-fast trie and the query against plain dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from revcurve.llm import prefix_trie as Z
from revcurve.llm.registry import queries, rebuilt

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_two_fattest():
    for a in range(40):
        for e in range(a + 1, 60):
            best = max(range(a + 1, e + 1), key=lambda n: (n & -n, -n))
            assert Z.fattest(a, e) == best


def _sequences(rnd, n, letters="ab", longest=30):
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.6:  # share a prefix with an earlier one
            other = rnd.choice(out)
            s = other[: rnd.randint(0, len(other))]
        else:
            s = ""
        out.append(s + "".join(rnd.choices(letters, k=rnd.randint(0, longest))))
    return out


def test_trie_counts_every_prefix_once():
    rnd = random.Random(3)
    for round_ in range(60):
        start = rnd.choice([0, 0, 5, 1024])
        seqs = [s for s in _sequences(rnd, rnd.randint(1, 60), rnd.choice(["a", "ab", "abc"])) if s]
        trie = Z.Trie()
        batch = [(start, [(0, 0), *[s[: i + 1] for i in range(len(s))]], list(range(len(s) + 1)), (c, 1, c * 3)) for c, s in enumerate(seqs)]
        for lo in range(0, len(batch), 7):
            trie.insert_batch(batch[lo : lo + 7])
        for _, names, _, _ in batch:  # every inserted sequence leaves the trie at its own end
            node, depth = trie.locate(start, names)
            assert depth == trie.end[node] == start + len(names) - 1
        want = defaultdict(list)
        for c, s in enumerate(seqs):
            for i in range(len(s)):
                want[s[: i + 1]].append(c)
        got = {}
        for depth, name, above, at, values in trie.expand():
            assert depth == start + len(name) and at == len(name) and name not in got
            assert above == (name[:-1] or (0, 0))
            got[name] = values
        assert got == {p: (min(m), len(m), 3 * sum(m)) for p, m in want.items()}


def test_lookups_grow_with_the_logarithm_of_the_depth():
    trie, long = Z.Trie(), [("n", i) for i in range(5001)]
    trie.insert_batch([(0, long[:k], [0] * k, (k, 1)) for k in range(2, 5001, 50)])
    trie.lookups = 0
    for k in range(1, 5001, 77):
        trie.locate(0, long[:k])
    assert trie.lookups <= 14 * len(range(1, 5001, 77))


def _plain(rows):
    convs, seqs = defaultdict(list), {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn, role or "", text or ""))
    ordered = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0))] for c, v in convs.items()}
    for c, turns in ordered.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = ordered.get(c - c % 20, [])[:h] + turns[h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(c)
        ends[tuple(s)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, totals = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        leaves = sum(totals[c][0] for c in children[node]) or 1
        saved = (len(members[node]) - 1) * words + sum(totals[c][1] for c in children[node])
        totals[node] = leaves, saved
        out[min(members[node]), len(node)] = (
            min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves, saved,
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
    return out


def _odd_rows():
    rnd, rows = random.Random(9), []
    for conv in [*range(0, 90), 1020, 1021, 1033, 2007]:
        for turn in range(rnd.randint(1, 9)):
            rows.append((conv, None if turn == 0 and rnd.random() < 0.2 else turn * 2, rnd.choice(["user", "user", None, ""]), rnd.choice(["a b", "a b", "c", None, " "])))
    rows += [(conv, 0, "user", "only") for conv in range(200, 240)] + [(None, 1, "user", "lost")]
    return rows


def _query(spark, path):
    rows = queries()["op13_zfast_trie"](spark, str(path)).collect()
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("stretch", [1, 3, 1024])
def test_query_equals_a_plain_trie(spark, tmp_path, monkeypatch, stretch):
    rows = _odd_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(Z.nodes, "__defaults__", (stretch,))
    monkeypatch.setattr(Z, "BATCH", 5)
    assert _query(spark, tmp_path) == _plain(rows)


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _query(spark, sf) == _plain(rows)


def test_nulls_ties_copies_and_clashing_names(spark):
    rows = [(c, None if t == 0 else 1, "user", f"t {t}", 1, 2) for c in range(1000, 1400) for t in (0, 1, 2)]
    turns = Z.symbols(spark.createDataFrame(rows, f"{SCHEMA}, conv int, depth int").repartition(3))
    found = Z.nodes(turns, turns.select("conv")).orderBy("depth").collect()
    assert [r["n_convs"] for r in found] == [400] * 4 and [r["conv"] for r in found] == [1000] * 4  # ties in one order for all copies
    assert found[0]["saved"] == 399 * 6 and found[3]["n_leaves"] == 1 and found[0]["parent"] is None


def test_empty_table(spark):
    turns = Z.symbols(spark.createDataFrame([], SCHEMA))
    assert Z.nodes(rebuilt(turns), turns.select("conv")).collect() == []
