"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

Texts are sequences of words (lower-cased runs of letters, digits and non-ASCII bytes). A CGK
random walk reads a window with a pointer that, at each step, emits the word under it and moves
on or stays by a random bit of (step, word): strings at a small edit distance meet again
after an edit, so their walks differ in few positions. Each hash table samples
:data:`SAMPLED` positions of a walk; equal samples make a candidate. The number of tables per
window length is what reaches ``target_recall`` on edited copies of the items themselves at the
largest edit distance allowed, and a candidate counts only after an exact word edit distance
(the item against any part of the document around the window) of at most ``max_edits`` of its length.

Windows are item-sized: an item of n words is read by windows of n rounded down to a multiple
of 8 words (at most 64), from its beginning, its end and every 64 words between. Every window of
every document is considered; one that holds too few words of the benchmark, or too few of its
rare words (at most :data:`RARE` times in the block), to reach the edit bound with any item of
its length cannot match and is not walked.

Items are read in blocks of at most ``block_bytes``, each held by every task; the documents are
scanned once per block and never shuffled. The result has a row for each document and item found.

Defined results: null texts read as empty; items of fewer than ``min_words`` words never match;
repeated items and repeated documents each give their rows; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcurve.llm.common import LOWER, LookupTable, chunks, mix64, span_hashes, text_of, word_spans

SAMPLED = 4
TABLES_PER_WALK = 16
LONGEST = 64
MOST_WALKS = 24
RARE = (2, 10)
_BREAKS = np.ones(256, bool)
_BREAKS[48:58] = _BREAKS[65:91] = _BREAKS[97:123] = _BREAKS[128:] = False
MATCH = "struct<item: int, edits: int, first_word: int>"


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per row) of a run of texts."""
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets, _BREAKS)
    return span_hashes(low, starts, ends), np.bincount(rows, minlength=len(offsets) - 1)


def window_length(n: int) -> int:
    """Words of the windows that read an item of ``n`` words."""
    return n if n < 16 else min(LONGEST, n // 8 * 8)


def anchors(n: int) -> list[int]:
    """Where the windows stand in an item of ``n`` words."""
    size = window_length(n)
    return sorted({*range(0, n - size + 1, LONGEST), 0, n - size})


def walk_tables(size: int, walk: int, n_symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random parts of a walk: coins (step, symbol), sampled steps (table, k), codes (k, symbol)."""
    rng = np.random.default_rng([20240615, size, walk])
    steps = max(SAMPLED, int(1.8 * size))
    coins = rng.integers(0, 2, (steps, n_symbols), dtype=np.uint8)
    sampled = np.stack([np.sort(rng.choice(steps, SAMPLED, replace=False)) for _ in range(TABLES_PER_WALK)])
    return coins, sampled, rng.integers(0, 1 << 63, (SAMPLED, n_symbols), dtype=np.uint64)


def walk_keys(laid: np.ndarray, at: np.ndarray, size: int, walk: int, tables: tuple) -> np.ndarray:
    """(tables, windows) keys of CGK walk ``walk`` over the windows that begin at ``at``.

    ``laid`` goes on for 2 * size symbols after the last window. A walk of 1.8 * size steps reads
    about 0.9 * size words.
    """
    coins, sampled, codes = tables
    due: list[list[tuple[int, int]]] = [[] for _ in coins]
    for t, k in np.ndindex(sampled.shape):
        due[sampled[t, k]].append((t, k))
    labels = (np.arange(len(sampled), dtype=np.uint64) + np.uint64(walk * len(sampled) + 1)) << np.uint64(40)
    keys = np.repeat(mix64(labels)[:, None], len(at), 1)
    pointer = at.astype(np.int64)
    for step in range(int(sampled.max()) + 1):
        symbol = laid[pointer]
        for t, k in due[step]:
            keys[t] += codes[k][symbol]
        pointer += coins[step][symbol]
    return keys


def edit_distances(items: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least word edit distance of each item (row) to any part of its region, and where that part ends."""
    count, m = regions.shape
    ramp = np.arange(m + 1)
    row = np.zeros((count, m + 1), np.int64)  # a part may begin anywhere
    for i in range(items.shape[1]):
        cost = np.empty_like(row)
        cost[:, 0] = i + 1
        cost[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (regions != items[:, i : i + 1]))
        row = np.minimum.accumulate(cost - ramp, axis=1) + ramp
    return row.min(1), row.argmin(1)


class Index:
    """The benchmark's windows in hash tables, for one block of items."""

    def __init__(self, texts: list[str], max_edits: float, target_recall: float, min_words: int):
        self.max_edits = max_edits
        data = pa.array(texts, pa.string())
        self.items: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        for _, _, d, o in chunks(data):
            h, n = words_of(d, o)
            hashes += np.split(h, np.cumsum(n)[:-1])
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.lookup = LookupTable(self.vocabulary)
        self.items = [(np.searchsorted(self.vocabulary, h) + 1).astype(np.int32) for h in hashes]
        counts = np.bincount(np.concatenate(self.items), minlength=len(self.vocabulary) + 1) if self.items else np.zeros(1, int)
        symbols = np.arange(len(counts)) > 0
        self.kinds = [symbols, *(symbols & (counts <= most) for most in RARE)]  # all words of the block, and its rare ones
        by_size: dict[int, list[tuple[int, int]]] = {}
        for i, item in enumerate(self.items):
            if len(item) >= min_words:
                for at in anchors(len(item)):
                    by_size.setdefault(window_length(len(item)), []).append((i, at))
        self.classes = []
        for size, places in sorted(by_size.items()):
            longest = max(len(self.items[i]) for i, _ in places if len(self.items[i]) < 2 * LONGEST) if size < LONGEST else LONGEST + 15
            segments = np.stack([self.items[i][at : at + size] for i, at in places])
            need = [int(kind[segments].sum(1).min()) - int(max_edits * longest) for kind in self.kinds]
            laid, at = self._laid([self.items[i][p:] for i, p in places], 2 * size)
            walks = self._walks(size, [self.items[i][p:] for i, p in places], target_recall)
            tables = []
            for w in range(walks):
                parts = walk_tables(size, w, len(self.vocabulary) + 1)
                flat = walk_keys(laid, at, size, w, parts).reshape(-1)
                unique, first = np.unique(flat, return_inverse=True)
                order = np.argsort(first, kind="stable")
                tables.append((parts, LookupTable(unique), np.concatenate([[0], np.cumsum(np.bincount(first, minlength=len(unique)))]), order % len(places)))
            self.classes.append((size, [max(1, need[0]), *need[1:]], np.array(places), tables))

    @staticmethod
    def _laid(rows: list[np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbol rows one after another with ``gap`` empty symbols after each, and where each begins."""
        lengths = np.array([len(r) + gap for r in rows])
        return np.concatenate([np.pad(r, (0, gap)) for r in rows]), np.cumsum(lengths) - lengths

    def _walks(self, size: int, rows: list[np.ndarray], target: float, copies: int = 256) -> int:
        """Walks needed so that edited copies of the windows share a table key with ``target`` probability."""
        rng = np.random.default_rng([20240616, size])
        whole = [rows[i][: 2 * size] for i in rng.integers(len(rows), size=copies)]
        edited = []
        for source in whole:
            row = source.tolist()
            for _ in range(int(self.max_edits * size)):
                at, kind = int(rng.integers(min(size, len(row)) or 1)), rng.integers(3)
                fresh = int(rng.integers(len(self.vocabulary) + 1))
                if kind == 0 and row:
                    row[at] = fresh
                elif kind == 1:
                    row.insert(at, fresh)
                elif row:
                    del row[at]
            edited.append(np.array(row, np.int32))
        found = np.zeros(copies, bool)
        for walk in range(MOST_WALKS):
            parts = walk_tables(size, walk, len(self.vocabulary) + 1)
            a, b = (walk_keys(*self._laid(x, 2 * size), size, walk, parts) for x in (whole, edited))
            found |= (a == b).any(0)
            if found.mean() >= target:
                return walk + 1
        return MOST_WALKS

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[dict[int, tuple[int, int]]]:
        """For each text of a run: item -> (edits, first word of the best place)."""
        hashes, n_words = words_of(data, offsets)
        out: list[dict[int, tuple[int, int]]] = [{} for _ in n_words]
        if not self.classes or not len(hashes):
            return out
        symbols = (self.lookup.find(hashes) + 1).astype(np.int32)  # 0: not a word of the benchmark
        gap = 2 * LONGEST
        begin = np.cumsum(n_words + gap) - n_words
        laid = np.zeros(int((n_words + gap).sum()) + gap, np.int32)
        laid[np.arange(len(symbols)) + np.repeat(begin - (np.cumsum(n_words) - n_words), n_words)] = symbols
        sums = [np.concatenate([[0], np.cumsum(kind[laid], dtype=np.int32)]) for kind in self.kinds]
        for size, need, places, tables in self.classes:
            enough = [total[size:] - total[:-size] >= least for total, least in zip(sums, need, strict=True) if least > 0]
            at = np.flatnonzero(np.logical_and.reduce(enough))
            for lo in range(0, len(at), 1 << 15):
                self._search_windows(laid, at[lo : lo + (1 << 15)], size, places, tables, begin, n_words, out)
        return out

    def _search_windows(self, laid, at, size, places, tables, begin, n_words, out) -> None:
        pairs = []
        for walk, (parts, lookup, first, order) in enumerate(tables):
            keys = walk_keys(laid, at, size, walk, parts)
            table, hit = np.nonzero(lookup.maybe(keys))
            row = lookup.find(keys[table, hit])
            hit, row = hit[row >= 0], row[row >= 0]
            if len(hit):
                count = first[row + 1] - first[row]
                slot = np.repeat(first[row] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                pairs.append(np.unique(np.repeat(hit, count) * len(places) + order[slot]))
        if not pairs:
            return
        found = np.unique(np.concatenate(pairs))
        start, place = at[found // len(places)], places[found % len(places)]
        item = place[:, 0]
        # one region per item and neighbourhood: starts that agree up to the edits allowed share it
        origin = start - place[:, 1]
        lengths = np.array([len(self.items[i]) for i in item])
        slack = (self.max_edits * lengths).astype(int) + 8
        cell = np.unique(np.column_stack([item, origin // 8]), axis=0, return_index=True)[1]
        for n in np.unique(lengths[cell]):
            for part in np.array_split(cell[lengths[cell] == n], max(1, int((lengths[cell] == n).sum()) // 2000)):
                reach = int(slack[part[0]]) + 8
                span = np.arange(-reach, n + reach)
                spot = origin[part][:, None] // 8 * 8 + span
                row = np.searchsorted(begin, start[part], "right") - 1
                inside = (spot >= begin[row][:, None]) & (spot < (begin + n_words)[row][:, None])
                region = np.where(inside, laid[np.clip(spot, 0, len(laid) - 1)], -1)
                edits, end = edit_distances(np.stack([self.items[i] for i in item[part]]), region)
                good = edits <= int(self.max_edits * n)
                for k in np.flatnonzero(good):
                    r = int(row[k])
                    first_word = max(0, int(spot[k, 0] + end[k] - n - begin[r]))
                    best = (int(edits[k]), first_word)
                    i = int(item[part[k]])
                    out[r][i] = min(best, out[r].get(i, best))


def matches(index: Index, text_col: str = "text") -> Column:
    """Column of the items found in the whole text: array of (item number, edits, first word)."""

    @F.arrow_udf(f"array<{MATCH}>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item", pa.int32()), ("edits", pa.int32()), ("first_word", pa.int32())]))
        for arr in batches:
            rows: list[list[tuple]] = []
            for _, _, data, offsets in chunks(arr, 1 << 19):
                rows += [[(i, *x) for i, x in sorted(r.items())] for r in index.search(data, offsets)]
            yield pa.array(rows, kind)

    return found(text_of(text_col))


def indexes(items: DataFrame, text_col: str, id_col: str, max_edits: float, target_recall: float, min_words: int, block_bytes: int) -> list[tuple[Index, list]]:
    """(index, item ids) for each block of items; a block holds about ``block_bytes`` of text."""
    rows = items.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    out = []
    for b in range(n):
        got = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).orderBy("id", "text").collect()
        out.append((Index([r["text"] for r in got], max_edits, target_recall, min_words), [r["id"] for r in got]))
    return out


def find(
    docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
    max_edits: float = 0.2, target_recall: float = 0.95, min_words: int = 8, block_bytes: int = 8 << 20,
) -> DataFrame:
    """(doc_id, item_id, edits, item_words, first_word): each document and benchmark item it holds.

    ``edits`` is the exact word edit distance, at most ``max_edits`` of the item's words.
    """
    parts = []
    id_type = items.schema[item_id].dataType
    for index, ids in indexes(items, item_text, item_id, max_edits, target_recall, min_words, block_bytes):
        found = docs.select(F.col(id_col).alias("doc_id"), F.explode(matches(index, text_col)).alias("m"))
        names = docs.sparkSession.createDataFrame(
            [(i, x, len(index.items[i])) for i, x in enumerate(ids)], f"item int, item_id {id_type.simpleString()}, item_words int"
        )  # a block's ids: bounded like the block
        parts.append(
            found.select("doc_id", "m.*").join(F.broadcast(names), "item").select("doc_id", "item_id", "edits", "item_words", "first_word")
        )
    return reduce(DataFrame.unionByName, parts)


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text: str = "text", item_id: str = "item_id", max_edits: float = 0.2, target_recall: float = 0.95, min_words: int = 8, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    for index, _ in indexes(items, item_text, item_id, max_edits, target_recall, min_words, block_bytes):
        docs = docs.where(F.size(matches(index, text_col)) == 0)
    return docs
