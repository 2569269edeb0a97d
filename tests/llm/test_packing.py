"""Packing: exact ids against the tokenizer, whole coverage, no padding, hot lengths and odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from revcurve.llm import packing as K

WORDS = public_tokenizers.path("word_bpe_49k.json")


def _check_layout(histogram, capacity):
    layout = K.Layout(histogram, capacity)
    held = defaultdict(list)
    for length, n in histogram.items():
        packs, offsets = layout.find(np.full(n, length), np.arange(n))
        for pack, offset in zip(packs.tolist(), offsets.tolist()):
            at = 0
            for start, size, sequence, before in layout.pieces(length, pack, offset):
                assert start == at
                at += size
                held[sequence].append((before, size))
            assert at == length
    assert sorted(held) == list(range(layout.packs))
    for pieces in held.values():
        at = 0
        for before, size in sorted(pieces):
            assert before == at
            at += size
        assert at == capacity or at & (at - 1) == 0
    return layout


def test_layout_places_every_rank_once_without_gaps_or_padding():
    rnd = random.Random(5)
    for capacity in (1, 2, 8, 32):
        for _ in range(40):
            _check_layout({rnd.randint(1, max(1, capacity - 1)): rnd.randint(1, 60) for _ in range(rnd.randint(0, 12))} if capacity > 1 else {}, capacity)
    _check_layout({rnd.randint(1, 2047): rnd.randint(1, 50) for _ in range(200)}, 2048)


def test_steps_grow_with_the_histogram_not_with_the_rows():
    few = {n: 3 for n in range(1, 2048)}
    many = {n: 3_000_000 + n for n in range(1, 2048)}
    assert len(K.place(many)[0]) < 3 * len(K.place(few)[0]) + 4096
    hot = K.Layout({5: 10**9, 1999: 3})
    assert len(hot.steps) < 20 and len(hot.line) < 40


def test_shortest_pack_first_by_hand():
    steps, groups = K.place({5: 2, 3: 2, 2: 1}, 8)
    # 5s open two packs, the 3s fill them, the 2 opens a third
    assert steps == [(5, 0, 2, 0, 0), (3, 0, 2, 0, 5), (2, 0, 1, 2, 0)]
    assert sorted(groups) == [(2, 2, 1), (8, 0, 2)]


def _texts():
    rnd = random.Random(3)
    vocabulary = ["alpha", "Beta's", "l'été", "2024", "ÉCOLE", "naïve", "x" * 40, "日本語", "don't", "<|endoftext|>", "áb", "ΣΑΣ", "\x1c", "a b", "i̇", "İ"]
    texts = [None, "", " ", "\n\t", "one", "<|endoftext|>", "é ́x"]
    texts += [" ".join(rnd.choices(vocabulary, k=rnd.choice([3, 50, 900, 5000]))) for _ in range(40)]
    return texts + ["same words again"] * 300  # a hot length


@pytest.fixture(scope="module")
def packed(spark):
    texts = _texts()
    docs = spark.createDataFrame([(i, t, "left", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, left string, rank int").repartition(5)
    return texts, K.pack(docs, WORDS).collect()


def test_pieces_hold_the_tokenizers_ids(packed):
    from tokenizers import Tokenizer

    texts, rows = packed
    model, pieces = Tokenizer.from_file(WORDS), defaultdict(list)
    for r in rows:
        pieces[r["id"]].append(r)
    assert sorted(pieces) == list(range(len(texts)))
    for i, found in pieces.items():
        want = [*model.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        found.sort(key=lambda r: r["start"])
        got = []
        for r in found:
            assert r["start"] == len(got) and r["doc_tokens"] == len(want)
            got += np.frombuffer(r["ids"], "<u4").tolist()
            assert len(got) == r["start"] + r["length"]
        assert got == want


def test_sequences_are_gapless_and_unpadded(packed):
    _, rows = packed
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(held) == list(range(len(held)))
    for found in held.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    # few documents are cut beyond their whole sequences
    cut = Counter(r["id"] for r in rows if r["length"] < 2048)
    assert sum(n > 1 for n in cut.values()) < 0.2 * len(cut)


def test_empty_table_null_and_repeated_ids(spark):
    schema = "doc_id string, text string"
    assert K.pack(spark.createDataFrame([], schema), WORDS).collect() == []
    rows = K.pack(spark.createDataFrame([(None, "a"), (None, None), ("x", "a b"), ("x", "a b")], schema), WORDS).collect()
    assert sorted(str(r["id"]) for r in rows) == ["None", "None", "x", "x"] or sum(r["length"] for r in rows) == 2 + 1 + 3 + 3


def test_words_survive_a_cleared_cache(monkeypatch):
    monkeypatch.setattr(K, "CACHED_WORDS", 3)
    monkeypatch.setattr(K, "PART_CHARS", 7)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    texts = ["aa bb, cc. dd!? ee) ff\n gg  hh aa's, " * 5 + "été", "", "x,.", ",", "a-.", "5%%% <|endoftext|>.", "c'd, don't! é."]
    words = K.Words(WORDS)
    for text in texts:
        assert np.frombuffer(words.encode(text), "<u2").tolist() == model.encode(text, add_special_tokens=False).ids
    assert len(words) <= 3


def test_closing_signs_and_odd_words_hold_the_tokenizers_ids():
    from tokenizers import Tokenizer

    model, words = Tokenizer.from_file(WORDS), K.Words(WORDS)
    texts = [f"{stem}{signs}" for stem in ["a", "É", "straße", "7", "ŉ", "İ", "×", "é\u0301", "日", "'s", "x<y", "<|endoftext|>", "&"] for signs in [*K.SIGNS, "&&&", ".,###", "'", ".'"]]
    texts += [f"{letter}{sign}" for letter in K.LATIN for sign in ".=#"]
    texts += ["", " ", "\x1c", "\u0085a\u00a0b", "=\u0338", "h\u0331 H\u0331. the The THE", "a\x0bb\x0cc\r\nd", "<|ENDOFTEXT|> <|startoftext|>.", "ba86-22c, 4.5%."]
    want = [model.encode(t, add_special_tokens=False).ids for t in texts]
    for rows in (texts, [""], [" ", ""], texts[::-1]):
        got = words.encode_all(K.pa.array(rows), np.array([1], words.type).tobytes())
        assert [np.frombuffer(ids, words.type).tolist() for ids in got.to_pylist()] == [[*want[texts.index(t)], 1] for t in rows]
    sliced = words.encode_all(K.pa.array(texts)[5:90][3:])
    assert [np.frombuffer(ids, words.type).tolist() for ids in sliced.to_pylist()] == want[8:90]


def test_no_word_of_letters_is_encoded_alone_or_twice(monkeypatch):
    whole, plain = [], []
    words = K.Words(WORDS)
    real_whole, real_plain = words._whole, words._plain
    monkeypatch.setattr(words, "_whole", lambda w: whole.append(w) or real_whole(w))
    monkeypatch.setattr(words, "_plain", lambda some: plain.append(some) or real_plain(some))
    monkeypatch.setattr(K, "CACHED_WORDS", 6)
    words.encode("thing&&& parché. ça, naïve### thing parché The")
    assert not set("".join(whole)) & set(K.LATIN)
    assert [sorted(some) for some in plain] == [sorted(["thing", "parché", "ça", "naïve", "The"])]
    words.encode("one two three thing. four parché")  # the cache is full: what is needed again is kept
    words.encode("one two three four thing parché")
    assert sorted(w for some in plain[1:] for w in some) == ["four", "one", "three", "two"]


def test_rows_are_tokenised_together_up_to_a_size_and_long_ones_alone(monkeypatch):
    monkeypatch.setattr(K, "PART_CHARS", 10)
    texts = ["a" * n for n in (4, 6, 1, 0, 25, 0, 9, 2, 11)]
    batch = K.pa.RecordBatch.from_arrays([K.pa.array(range(len(texts))), K.pa.array(texts)], names=["id", "text"])
    assert [part.column(0).to_pylist() for part in K._parts(batch)] == [[0, 1], [2, 3], [4], [5, 6], [7], [8]]
    assert [part.column(0).to_pylist() for part in K._parts(batch[2:5])] == [[2, 3], [4]]
    assert not list(K._parts(batch[:0]))


def test_query_digest(spark):
    from revcurve.llm.registry import queries

    sf = "/root/testdata/sf0.001"
    rows = queries()["op11_spf_packing"](spark, sf).collect()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {d: np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    assert {r["doc_id"] for r in rows} == set(texts)
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
