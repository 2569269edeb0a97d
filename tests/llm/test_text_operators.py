"""Operators on texts: brute-force versions, held-out accuracy and defined edge cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from revcurve.llm import common, components, decontaminate, line_templates, ppm, quality_cnn, simhash_variants, toxicity
from revcurve.llm import registry as R

SF001 = "/root/testdata/sf0.001"
EDGE = "doc_id bigint, text string, lang string, score double"
EDGE_ROWS = [
    (1, None, None, 1.0), (2, "", "en", None), (2, "", "en", None), (None, "a b c d e", "en", 2.0), (3, "word " * 30000, None, 0.0),
    (4, "one\ntwo\nthree four five six", "en", 0.0), (5, "naïve ÜBER \t\v x\x00y", "de", 0.0),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


# -- common ------------------------------------------------------------------------------------
def test_words_and_hashes_match_python():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \t\n\v.é") for _ in range(rng.randrange(40))) for _ in range(200)] + ["", " ", "x"]
    data, offsets = common.string_buffers(pa.array(texts))
    starts, ends, rows = common.word_spans(data, offsets)
    got = [[] for _ in texts]
    for a, b, r in zip(starts, ends, rows, strict=True):
        got[r].append(bytes(data[a:b]))
    assert got == [t.encode().split() for t in texts]
    hashes = common.span_hashes(data, starts, ends)
    by_word = {}
    for a, b, h in zip(starts, ends, hashes, strict=True):
        assert by_word.setdefault(bytes(data[a:b]), h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_chunks_cover_every_row_once():
    texts = pa.array(["a" * n for n in (0, 5, 300, 0, 1, 50)] + [None])
    seen = []
    for lo, hi, data, offsets in common.chunks(texts, 64):
        assert len(offsets) == hi - lo + 1 and offsets[-1] == len(data)
        seen += range(lo, hi)
    assert seen == list(range(7))


def test_lookup_table():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    table = common.LookupTable(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and table.maybe(keys).all()
    other = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (table.find(other) == -1).all()
    assert (common.LookupTable(np.zeros(0, np.uint64)).find(other) == -1).all()


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(25)] + [(7, 7), (3, None), (3, 4), (4, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if b is not None:
            parent[find(a)] = find(b)
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert set(got) == set(parent)
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (find(a) == find(b))
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- 1: lines ----------------------------------------------------------------------------------
def test_variable_fields_make_one_template(spark):
    rows = [(i, f"{name} unique first words\nUser {name} logged in from host {i}7.3\nplain {name} own line {name} here") for i, name in enumerate(["ann", "bob", "cy", "dan"])]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id bigint, text string"), depth=1).collect()}
    assert "logged in" in got[0]["text"] and got[0]["n_dropped"] == 0  # the first one stays
    for i in (1, 2, 3):
        assert "logged in" not in got[i]["text"] and "unique" in got[i]["text"] and got[i]["n_dropped"] == 1


def test_lines_edge_cases(spark, edge):
    got = line_templates.drop_recurring(edge)
    assert got.columns == [*edge.columns, "n_dropped"]
    same = sorted(map(repr, got.drop("n_dropped").collect()))
    assert same == sorted(map(repr, edge.collect()))  # nothing recurs in three documents
    assert line_templates.drop_recurring(spark.createDataFrame([], EDGE)).count() == 0
    many = spark.createDataFrame([(i % 3 if i else None, "the same long line here", "x", float(i)) for i in range(6)], EDGE)
    kept = [r["text"] for r in line_templates.drop_recurring(many).collect()]
    assert sorted(kept) == ["", "", "", "", "", "the same long line here"]
    with pytest.raises(ValueError, match="n_dropped"):
        line_templates.drop_recurring(edge.withColumn("n_dropped", F.lit(1)))


# -- 2: PPM ------------------------------------------------------------------------------------
def _trie(texts, order=ppm.ORDER, least=2):
    data, offsets = common.string_buffers(pa.array(texts))
    codes = ppm.windows(common.LOWER[data], offsets)[0]
    levels = []
    for k in range(order + 1):
        keys, n = np.unique(codes & ((1 << 8 * (k + 1)) - 1), return_counts=True)
        levels.append((keys[n >= least], n[n >= least]))
    return ppm.Trie(levels, len(codes), len(texts), (np.array([0]), np.array([len(texts)])), 1, 1), levels, len(codes)


def _slow_probability(levels, total, texts, context, symbol, order):
    """PPM with escape method D and exclusion, straight from the counts."""
    tables = [dict(zip(k.tolist(), n.tolist(), strict=True)) for k, n in levels]
    followers = lambda k, ctx: {c & 255: n for c, n in tables[k].items() if c >> 8 == ctx}
    code = lambda b: int.from_bytes(b, "big")
    p, excluded = 1.0, set()
    for k in range(order, -1, -1):
        ctx = context[len(context) - k :]
        seen = followers(k, code(ctx))
        if not seen:
            continue
        if k == 0:
            n = total
        elif set(ctx) == {ppm.START}:
            n = texts
        else:
            n = tables[k - 1][code(ctx)]
        left = {s: c for s, c in seen.items() if s not in excluded}
        gone = sum(c for s, c in seen.items() if s in excluded)
        room = n - gone
        if symbol in left:
            return p * (left[symbol] - 0.5) / room
        escape = n - sum(seen.values()) + 0.5 * len(left)
        p *= escape / room if escape > 0 else 1.0
        excluded = set(seen)
    return p / max(1, ppm.SYMBOLS - len(excluded))


def test_ppm_equals_slow_version_and_sums_to_one():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["the ", "then ", "other ", "ab", "é", "x", "\n"]) for _ in range(rng.randrange(12))) for _ in range(60)]
    trie, levels, total = _trie(texts)
    probe = ["the other", "zq then", "", "éé the x", "ab\nabxq"]
    data, offsets = common.string_buffers(pa.array(probe))
    codes, _ = ppm.windows(data, offsets)
    got = trie.log_probability(codes)
    for code, value in zip(codes.tolist(), got, strict=True):
        b = code.to_bytes(ppm.ORDER + 1, "big")
        want = np.log10(_slow_probability(levels, total, len(texts), b[:-1], b[-1], ppm.ORDER))
        assert abs(value - want) < 1e-4, (b, value, want)
    for code in codes[:6].tolist():
        every = np.array([(code & ~255) | s for s in range(256) if s != ppm.START])
        assert 0.9 < (10 ** trie.log_probability(every)).sum() < 1.0001


def test_ppm_query_and_baseline(spark, docs):
    got = {r["doc_id"]: r for r in R.op2_ppm(spark, SF001).collect()}
    rows = docs.select("doc_id", "text").collect()
    words = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), None] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for i, ws in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"], r["n_known"]) == (held[i], len(ws), n, sum(counts[w] > 0 for w in ws))
        assert abs(r["base_score"] - sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
    bytes_of = {r["doc_id"]: len((r["text"] or "").encode()) + 1 for r in rows}
    out = [r for r in got.values() if r["held_out"]]
    assert -sum(r["score"] for r in out) / np.log10(2) / sum(bytes_of[r["doc_id"]] for r in out) < 2.6  # bits per byte


def test_ppm_edge_cases(spark, edge):
    model = ppm.train(edge, F.lit(True))
    got = ppm.score(edge.select("doc_id", "text", "lang"), model).collect()
    assert len(got) == len(EDGE_ROWS) and all(r["lm_score"] < 0 for r in got)
    empty = [r for r in got if r["lm_tokens"] == 1]
    assert len(empty) == 3 and len({r["lm_score"] for r in empty}) == 1
    assert ppm.score(spark.createDataFrame([], EDGE).select("doc_id", "text"), model).count() == 0
    untrained = ppm.train(edge, F.lit(False))
    got = ppm.score(edge.select("doc_id", "text"), untrained).where("doc_id = 2").first()
    assert abs(got["lm_score"] + np.log10(ppm.SYMBOLS)) < 1e-9 and got["lm_known"] == 0


def test_ppm_keeps_every_node_and_equals_the_trie_in_memory(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["the ", "then ", "other ", "ab", "é", "x", "\n"]) for _ in range(rng.randrange(12))) for _ in range(60)]
    texts += ["singular zebra quartz"]  # its windows occur once among 2,000 times as many
    texts += ["common words again and again " * 40] * 60
    probe = ["singular zebra quartz", "the other", "zq then", "", "éé the x", "ab\nabxq", "ß unseen 漢"]
    trained = spark.createDataFrame([(t,) for t in texts], "text string")
    asked = spark.createDataFrame(list(enumerate(probe)), "id int, text string")
    trie, levels, symbols = _trie(texts, least=1)
    data, offsets = common.string_buffers(pa.array(probe))
    codes, rows = ppm.windows(common.LOWER[data], offsets)
    want = np.bincount(rows, trie.log_probability(codes), len(probe))
    for keep in (1e-7, 1e-3, 1.0):  # what travels with the model changes no score
        model = ppm.train(trained, F.lit(True), keep=keep)
        got = {r["id"]: r["lm_score"] for r in ppm.score(asked, model).collect()}
        assert np.allclose([got[i] for i in range(len(probe))], want, atol=1e-3), keep
        assert model.nodes.count() == sum(len(k) for k, _ in levels)
    assert len(model.head.window_logs) == 0 and symbols > 60_000


def test_ppm_counts_travel_as_arrays_dealt_by_key():
    texts = ["ab ab ab", "", None, "x" * 700, "the end"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    sent = [b for _ in range(3) for b in ppm._count(iter([batch, batch]), 5)]  # three tasks
    assert sum(b.num_rows for b in sent) <= 3 * 2 * 5  # a row for each task, kind and share, not for each key
    got, table = {}, pa.Table.from_batches(sent)
    for share in range(5):
        own = [b.filter(pa.array([s == share for s in b.column(0).to_pylist()])) for b in table.to_batches()]
        for b in ppm._merge(iter(own)):
            for kind, key, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                assert (kind, key) not in got  # a key has one share
                got[kind, key] = n
    data, offsets = common.string_buffers(pa.array(texts))
    want = {(0, int(k)): 6 * int(n) for k, n in zip(*np.unique(ppm.windows(data, offsets)[0], return_counts=True), strict=True)}
    found = np.append(ppm.words(data, offsets)[0], [ppm.END_WORD] * len(texts))
    want |= {(1, int(k)): 6 * int(n) for k, n in zip(*np.unique(found, return_counts=True), strict=True)}
    assert got == want and max(want.values()) > 255


def test_ppm_tail_of_windows_equals_the_plain_one():
    rng = np.random.default_rng(3)
    rows = np.sort(rng.integers(0, 900, 5000))
    codes = rng.integers(0, 4, 5000) + (int(ppm.STOP) << 48)
    for some in (slice(None), slice(0, 0)):
        for a, b in zip(ppm._window_tail(codes[some], rows[some], 900), ppm._tail(codes[some], rows[some], 900), strict=True):
            assert a.tolist() == b.tolist()
    same_byte = ppm._window_tail(np.array([9, 9]), np.array([5, 261]), 300)  # rows that differ by 256
    assert same_byte[0].tolist() == [9, 9] and same_byte[1].tolist() == [1, 1]


def test_ppm_looks_for_new_windows_in_untrained_rows_only(spark):
    rows = [(i, t) for i, t in enumerate(["the one", "one two", None, "zq unseen", "the two two"])]
    docs = spark.createDataFrame(rows, "id int, text string")
    trained = F.col("id") < 3
    model = ppm.train(docs, trained, keep=1.0)
    want = {r["id"]: r["lm_score"] for r in ppm.score(docs, model).collect()}
    got = {r["id"]: r["lm_score"] for r in ppm.score(docs, model, trained=trained).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


# -- 3: SimHash --------------------------------------------------------------------------------
def _slow_simhash(text, words=3):
    ws = (text or "").encode().lower().split()
    shingles = [b" ".join(ws[i : i + words]) for i in range(len(ws) - words + 1)] or ([b" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_query_equals_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in R.op3_simhash_variants(spark, SF001).collect()}
    want = {r["doc_id"]: _slow_simhash(r["text"]) for r in docs.select("doc_id", "text").collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == want
    ids, fps = np.array(list(want)), np.array(list(want.values()), np.uint64)
    label = ids.copy()
    for _ in range(20):
        for i in range(len(ids)):
            near = np.bitwise_count(fps ^ fps[i]) <= 2
            label[near] = label[near].min()
    assert {i: r["component_id"] for i, r in got.items()} == dict(zip(ids.tolist(), label.tolist(), strict=True))


@pytest.mark.parametrize("heavy", [64, 2])
def test_links_find_every_pair_within_two_bits(spark, monkeypatch, heavy):
    monkeypatch.setattr(simhash_variants, "HEAVY", heavy)
    rng = random.Random(9)
    fps = set()
    for _ in range(8):
        base = rng.getrandbits(64)
        for _ in range(25):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    fps |= {0, 1, 3, 7, (1 << 64) - 1, 1 << 63, (1 << 63) | (1 << 31)}
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    got = {(r["a"], r["b"]) for r in simhash_variants.links(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()}
    assert got == want


def test_simhash_edge_cases(spark, edge):
    kept = simhash_variants.keep_first(edge)
    assert kept.columns == edge.columns
    rows = kept.collect()
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in rows) == [-1, 1, 3, 4, 5]  # texts 1 and 2 are empty
    assert simhash_variants.keep_first(spark.createDataFrame([], EDGE)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c", "x", 1.0), (None, "a b c", "y", 2.0), (None, "a b c", "y", 2.0)], EDGE)
    assert simhash_variants.keep_first(nulls).count() == 1
    assert [r["component"] for r in simhash_variants.groups(nulls).collect()] == [None, None]


# -- 5: toxicity -------------------------------------------------------------------------------
def test_fold_and_match():
    assert toxicity.fold("1D10T idiоt ｉdiot 10 4.0 no!!") == "idiot idiot idiot 10 4.0 no!!"
    lexicon = toxicity.Lexicon({"idiot": 3.0, "scu*": 2.0, "scum": 4.0}, {"dear idiot"}, (-4.0, 2.0, 2.0))
    a = lexicon.automaton()
    assert lexicon.matched("The 1d10t, and scum!", a) == (7.0, 4)
    assert lexicon.matched("My dear idiot; scunner", a) == (2.0, 4)
    assert lexicon.matched("idiots are not matched", a) == (0.0, 4)
    assert lexicon.matched("", a) == (0.0, 0)
    assert toxicity.Lexicon({}).probability(0.0, 0) == 0.0


def _held_out(spark, query, label, modulus, rest):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in rows)
    return [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]


def test_toxicity_held_out_accuracy(spark):
    pairs = _held_out(spark, R.op5_toxicity, "toxic", 3, 1)
    assert np.mean([a == b for a, b in pairs]) > 0.9


def test_classifier_edge_cases(spark, edge):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    lexicon = toxicity.learn(edge, none, F.lit(True))
    assert [r[0] for r in edge.select(toxicity.score(lexicon)).collect()] == [0.0] * len(EDGE_ROWS)
    net = quality_cnn.train(edge, none, F.lit(True))
    assert [r[0] for r in edge.select(quality_cnn.score(net)).collect()] == [1.0] * len(EDGE_ROWS)
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (3, 0, 1), (4, 1, 0), (5, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    net = quality_cnn.train(edge, labels, F.lit(True), steps=5)
    got = [r[0] for r in edge.select(quality_cnn.score(net)).collect()]
    assert len(got) == len(EDGE_ROWS) and all(0 <= s <= 1 for s in got) and got[1] == got[2] == got[0]
    lexicon = toxicity.learn(edge, labels, F.lit(True), min_docs=1)
    assert all(0 <= r[0] <= 1 for r in edge.select(toxicity.score(lexicon)).collect())
    assert spark.createDataFrame([], EDGE).select(quality_cnn.score(net)).count() == 0


# -- 10: quality -------------------------------------------------------------------------------
def test_quality_held_out_accuracy(spark):
    pairs = _held_out(spark, R.op10_quality_cnn, "quality", 5, 0)
    assert np.mean([a == b for a, b in pairs]) > 0.93
    good = [b for a, b in pairs if a == 1]
    assert np.mean(good) > 0.97


def test_gradient_matches_differences():
    rng = np.random.default_rng(4)
    docs = [(rng.integers(0, 256, (k, quality_cnn._SPAN)).astype(np.int16), np.ones(k, np.float32)) for k in (1, 3)]
    y = np.array([1, 0])
    p = quality_cnn.fit(docs, y, steps=3, batch=2)
    p = {k: v.astype(np.float64) for k, v in p.items()}

    def loss(q):
        total = 0
        for (x, fill), t in zip(docs, y, strict=True):
            w = np.lib.stride_tricks.sliding_window_view(x, quality_cnn.WIDTH, axis=1)[:, : 2 * quality_cnn.HALF : quality_cnn.STRIDE]
            conv = (q["E"][w].reshape(-1, quality_cnn.WIDTH * quality_cnn.DIM) @ q["W"]).reshape(len(x), -1, quality_cnn.FILTERS)
            z = quality_cnn._head(q, np.maximum(0, conv.max(1) + q["b"]), fill)
            logit = quality_cnn._combine(q, z, np.array([0]), np.array([len(x)]))[0]
            total += np.logaddexp(0, -logit if t else logit)
        return total / len(docs)

    g = quality_cnn._gradients(p, docs, y)
    for name in ("W", "A", "B", "m", "b"):
        at = tuple(int(rng.integers(n)) for n in p[name].shape)
        for sign in (1,):
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - g[name][at]) < 1e-3


# -- 7: decontamination ------------------------------------------------------------------------
def _slow_distance(item, doc):
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(doc):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (w != x)))
        row = new
    return min(row)


def test_edited_passages_are_found_with_exact_distance(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(9, 90)))) for i in range(40)]
    docs, truth = [], {}
    for d in range(160):
        words = rng.choices(vocabulary, k=rng.randrange(0, 150))
        if d % 2:
            i, passage = items[rng.randrange(40)]
            passage = passage.split()
            for _ in range(rng.randrange(int(0.2 * len(passage)) + 1)):
                at = rng.randrange(len(passage))
                passage[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [passage[at], "zzz"]])
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
            truth[d] = i
        docs.append((d, ", ".join(w.capitalize() for w in words)))
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in got}
    texts, named = dict(docs), dict(items)
    want = set()
    for d, t in texts.items():
        doc = t.lower().replace(",", "").split()
        for i, passage in named.items():
            item = passage.split()
            edits = _slow_distance(item, doc) if (d, i) in found or truth.get(d) == i else None
            if edits is not None and edits <= int(0.2 * len(item)):
                want.add((d, i))
                if (d, i) in found:
                    assert found[d, i] == edits
    assert set(found) <= want and len(set(found) & want) >= 0.9 * len(want)


def test_decontamination_edge_cases(spark, edge):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, "word " * 20), (4, "word " * 20)], "item_id bigint, text string")
    got = decontaminate.find(edge, items).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in got} == {(3, 4, 0)} and len(got) == 2
    clean = decontaminate.keep_clean(edge, items)
    assert clean.columns == edge.columns and clean.count() == len(EDGE_ROWS) - 1
    blocks = decontaminate.find(edge, items, block_bytes=64).collect()
    assert sorted(map(repr, blocks)) == sorted(map(repr, got))
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find(edge, none).count() == 0 and decontaminate.keep_clean(edge, none).count() == len(EDGE_ROWS)
    assert decontaminate.find(spark.createDataFrame([], EDGE), items).count() == 0
