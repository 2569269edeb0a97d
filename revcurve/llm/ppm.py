"""LM scoring by prediction by partial matching (PPM) over bytes.

The model is a byte-context trie of order :data:`ORDER`, pretrained on the training texts: for
every context of up to ORDER bytes, how often each byte follows. A symbol is coded in the
longest context that the trie knows; when the context has not seen it, an escape (method D: half a
count of every symbol seen) leads to
the next shorter context, where the symbols of the longer one are excluded; below order 0 all
remaining symbols are equally likely. The trie's levels are kept as tables of (context, symbol)
codes, so whole batches of positions are looked up at once; as counts of longer contexts are never
larger than those of their suffixes, the excluded mass is one number per context and is
worked out once.

Counting covers every byte of every training text: tasks merge their (ORDER + 1)-byte windows
before the shuffle, deal them by key and send each share as arrays, which the task that gets the share merges;
shorter contexts are sums of longer ones. Nothing is cut: every node that
occurs once stays, so the model grows with the text. All levels lie in stored tables (a node's code
carries its level), joined only where a key has at most 256 rows: nodes with their suffix, contexts
with their parent.

A window's probability depends on the window alone. Windows with at least the share ``keep`` of all
training symbols travel with their probabilities (at most 1 / keep of them); the others are counted per
text and meet theirs in a join. Those that training has not seen are worked out once each, level
by level. ``keep`` moves work between broadcast and join and does not change a result.

The baseline is a word unigram model with add-one smoothing; word counts cover all training
tokens and are exact (words are known by 64-bit hashes). Words with at least the share
``keep_words`` of all tokens travel with the model (at most 1 / keep_words of them), the others
meet their counts in the same join.

Defined results: null text reads as empty; an empty text is one end symbol and one end token. A-Z
are lower-cased. Repeated rows give repeated results; with no training text every symbol is
equally likely and every word unknown. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcurve.llm.common import LOWER, LookupTable, chunks, mix64, share, shared, span_hashes, store, text_of, word_spans
from revcurve.operators.neighbours import slice_count

ORDER = 6
SYMBOLS = 255  # all bytes but START
START, STOP = 0xFE, 0xFF  # neither byte occurs in UTF-8 text
END_WORD = 0
MERGE_ROWS = 1 << 20
SHARE_BYTES = 16 << 20  # input files for each share of the counted keys
COUNTS = "kind tinyint, key bigint, n bigint"
SHARES = "share int, kind tinyint, keys binary, n binary, large binary"


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of every symbol with its ORDER predecessors, row of each) of lower-cased texts and their ends."""
    n = np.diff(offsets)
    total = len(data) + len(n) * (ORDER + 1)
    stream = np.full(total, START, np.uint8)
    first = offsets[:-1] + np.arange(len(n)) * (ORDER + 1) + ORDER  # where each text begins in the stream
    place = np.arange(len(data)) + np.repeat(first - offsets[:-1], n)
    stream[place] = data
    stream[first + n] = STOP
    is_symbol = np.ones(total, bool)
    is_symbol[(first[:, None] - np.arange(1, ORDER + 1)).reshape(-1)] = False
    # every eight bytes that end in a symbol, the first of them cut off
    eight = np.ndarray((total,), ">i8", np.concatenate([np.full(7, START, np.uint8), stream]), strides=(1,))
    return eight[is_symbol].astype(np.int64) & ((1 << 8 * (ORDER + 1)) - 1), np.repeat(np.arange(len(n)), n + 1)


def words(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of lower-cased texts."""
    starts, ends, rows = word_spans(low, offsets)
    return span_hashes(low, starts, ends).view(np.int64), rows


class _Counter:
    """Merged counts of int64 keys."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, keys: np.ndarray) -> None:
        self.add_counted(*np.unique(keys, return_counts=True))

    def add_counted(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.rows += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.concatenate([p[0] for p in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([p[1] for p in self.parts])[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.parts = [(keys[first], np.add.reduceat(counts, first))] if len(keys) else []
        self.rows = len(first)
        return self.parts[0] if self.parts else (keys, counts)


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of ``values``, cut at ``ends`` (numbers of values)."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _shares(kind: int, keys: np.ndarray, n: np.ndarray, shares: int) -> pa.RecordBatch:
    """SHARES: the counts dealt by key; a count takes one byte, one of 255 or more stands in ``large`` as well."""
    share_of = (mix64(keys.view(np.uint64)) % np.uint64(shares)).astype(np.int32 if shares > 1 << 15 else np.int16)
    order = np.argsort(share_of, kind="stable")
    keys, n = keys[order], n[order]
    sizes, big = np.bincount(share_of, minlength=shares), n >= 255
    larges = np.bincount(share_of[order][big], minlength=shares)
    used = np.flatnonzero(sizes)
    ends, large_ends = np.cumsum(sizes)[used], np.cumsum(larges)[used]
    return pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), kind, np.int8)), _binary(keys, ends),
         _binary(np.minimum(n, 255).astype(np.uint8), ends), _binary(n[big], large_ends)],
        ["share", "kind", "keys", "n", "large"],
    )


def _count(batches: Iterator[pa.RecordBatch], shares: int) -> Iterator[pa.RecordBatch]:
    """SHARES: windows (kind 0) and words (kind 1) of a task's texts."""
    counters = (_Counter(), _Counter())

    def flush(kind: int) -> Iterator[pa.RecordBatch]:
        keys, n = counters[kind].merged()
        for lo in range(0, len(keys), 1 << 21):
            yield _shares(kind, keys[lo : lo + (1 << 21)], n[lo : lo + (1 << 21)], shares)
        counters[kind].parts, counters[kind].rows = [], 0

    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column(0)):
            low = LOWER[data]
            counters[0].add(windows(low, offsets)[0])
            found = words(low, offsets)[0]
            counters[1].add(np.concatenate([found, np.full(hi - lo, END_WORD, np.int64)]))
            for kind in (0, 1):
                if counters[kind].rows > 2 * MERGE_ROWS:
                    counters[kind].merged()
                    if counters[kind].rows > MERGE_ROWS:
                        yield from flush(kind)
    for kind in (0, 1):
        yield from flush(kind)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTS: each key of a task's shares once."""
    counters, held = (_Counter(), _Counter()), [MERGE_ROWS, MERGE_ROWS]
    for batch in batches:
        kinds = batch.column(1).to_pylist()
        for kind, keys, small, large in zip(kinds, *(batch.column(c) for c in (2, 3, 4)), strict=True):
            n = np.frombuffer(small.as_buffer(), np.uint8).astype(np.int64)
            n[n == 255] = np.frombuffer(large.as_buffer(), np.int64)
            counters[kind].add_counted(np.frombuffer(keys.as_buffer(), np.int64), n)
            if counters[kind].rows > 2 * held[kind]:
                counters[kind].merged()
                held[kind] = max(MERGE_ROWS, counters[kind].rows)
    for kind, counter in enumerate(counters):
        keys, n = counter.merged()
        for lo in range(0, len(keys), 1 << 18):
            part = keys[lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), pa.array(part), pa.array(n[lo : lo + (1 << 18)])], ["kind", "key", "n"])


class Trie:
    """Trie levels in memory with their log probabilities (base 10): what the stored tables are tested against."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], symbols: int, texts: int, vocabulary: tuple[np.ndarray, np.ndarray], tokens: int, distinct: int):
        self.levels, self.contexts = [], []
        log = lambda x: np.log10(np.maximum(x, 1e-300))
        built = []
        for k, (codes, counts) in enumerate(levels):  # k: context length
            order = np.argsort(codes)
            codes, counts = codes[order], counts[order].astype(np.float64)
            context = codes >> 8
            names, at = np.unique(context, return_inverse=True)
            kept, q = np.bincount(at, counts, len(names)), np.bincount(at, minlength=len(names)).astype(float)
            if k == 0:
                n = np.full(len(names), float(symbols))
            else:
                below_codes, below_counts = built[k - 1][0], built[k - 1][1]
                spot = np.minimum(np.searchsorted(below_codes, names), len(below_codes) - 1)
                start = (1 << 8 * k) // 255 * START if k else 0
                n = np.where(names == start, float(texts), below_counts[spot])
            n = np.maximum(n, kept)
            built.append((codes, counts, names, n, q, kept, at))
        self.empty = not len(built) or not len(built[0][0])
        for k, (codes, counts, names, n, q, kept, at) in enumerate(built):
            seen = log(counts - 0.5) - log(n)[at]
            escape = log(n - kept + 0.5 * q) - log(n)
            if k == 0:
                rest = np.maximum(1, SYMBOLS - q)
                lower, lower_escape = log(rest), np.zeros(len(names))
            else:
                # one level down with this context's symbols excluded
                b_codes, b_counts, b_names, b_n, b_q, b_kept, _ = built[k - 1]
                suffix = codes & ((1 << 8 * k) - 1)
                same = b_counts[np.searchsorted(b_codes, suffix)]
                gone = np.bincount(at, same, len(names))
                below = np.searchsorted(b_names, names & ((1 << 8 * (k - 1)) - 1))
                rest_n, rest_q = np.maximum(0, b_n[below] - gone), np.maximum(0, b_q[below] - q)
                lower = log(rest_n)
                left = b_n[below] - b_kept[below] + 0.5 * rest_q
                lower_escape = np.where(left > 0, log(left), 0) - np.where(left > 0, lower, 0)
            self.levels.append((LookupTable(codes.view(np.uint64)), seen.astype(np.float32), log(counts - 0.5).astype(np.float32)))
            self.contexts.append((LookupTable(names.view(np.uint64)), escape.astype(np.float32), lower.astype(np.float32), lower_escape.astype(np.float32)))

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of every window's last symbol after the ones before it."""
        out = np.zeros(len(codes))
        if self.empty:
            return out - np.log10(SYMBOLS)
        codes = codes.view(np.uint64)
        left = np.arange(len(codes))
        lower = np.full(len(codes), np.nan, np.float32)  # log of the remaining mass below a context that was left
        lower_escape = np.zeros(len(codes), np.float32)
        for k in range(len(self.levels) - 1, -1, -1):
            here = codes[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            table, seen, log_count = self.levels[k]
            row = table.find(here)
            hit = row >= 0
            came = ~np.isnan(lower)
            got = row[hit]
            out[left[hit]] += np.where(came[hit], log_count[got] - lower[hit], seen[got])
            if hit.all():
                return out
            miss = ~hit
            left, here, came = left[miss], here[miss], came[miss]
            contexts, escape, below, below_escape = self.contexts[k]
            at = contexts.find(here >> np.uint64(8))
            known = at >= 0
            out[left] += np.where(came, lower_escape[miss], np.where(known, escape[at], 0))
            lower = np.where(known, below[at], np.nan).astype(np.float32)
            lower_escape = np.where(known, below_escape[at], 0).astype(np.float32)
        out[left] -= np.where(np.isnan(lower), np.log10(SYMBOLS), lower)
        return out


def _tail(keys: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different keys of each row in row order, how often each, how many a row has)."""
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])) if len(keys) else np.zeros(0, int)
    return keys[new], np.diff(np.append(new, len(keys))), np.bincount(rows[new], minlength=n_rows)


def _window_tail(codes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_tail` of windows in row order: their seven bytes leave one for the row, so 256 rows are one plain sort."""
    codes = codes.view(np.uint64) | ((rows & 255).astype(np.uint64) << np.uint64(56))
    cuts = np.searchsorted(rows, np.arange(0, n_rows + 256, 256))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        codes[lo:hi].sort()
    first = np.ones(len(codes), bool)
    first[1:] = codes[1:] != codes[:-1]
    first[cuts[cuts < len(codes)]] = True
    new = np.flatnonzero(first)
    return (codes[new] & np.uint64((1 << 56) - 1)).view(np.int64), np.diff(np.append(new, len(codes))), np.bincount(rows[new], minlength=n_rows)


class Head:
    """The frequent windows with their log probabilities (base 10), and the frequent words."""

    def __init__(self, frequent: tuple[np.ndarray, np.ndarray], vocabulary: tuple[np.ndarray, np.ndarray], tokens: int, distinct: int):
        self.window_table, self.window_logs = LookupTable(frequent[0].view(np.uint64)), frequent[1]
        self.word_table, self.word_counts = LookupTable(vocabulary[0].view(np.uint64)), vocabulary[1].astype(np.int64)
        self.divisor = float(tokens + distinct + 1)

    def score(self, arr: pa.Array) -> pa.StructArray:
        """n_tokens, known, base and score of what travels with the model, and the other words and windows with their counts."""
        n_tokens, known, base, score, tails = [], [], [], [], ([], [])
        logs = np.append(self.window_logs, 0.0)  # the last one is for windows that are not here
        for _, _, data, offsets in chunks(arr):
            low, n_rows = LOWER[data], len(offsets) - 1
            codes, rows = windows(low, offsets)
            at = self.window_table.find(codes.view(np.uint64))
            score.append(np.add.reduceat(logs[at], offsets[:-1] + np.arange(n_rows)))
            miss = at < 0
            tails[0].append(_window_tail(codes[miss], rows[miss], n_rows))
            found, word_rows = words(low, offsets)
            found = np.concatenate([found, np.full(n_rows, END_WORD, np.int64)])
            word_rows = np.concatenate([word_rows, np.arange(n_rows)])
            at = self.word_table.find(found.view(np.uint64))
            hit = at >= 0
            n_tokens.append(np.bincount(word_rows, minlength=n_rows))
            known.append(np.bincount(word_rows[hit], minlength=n_rows))
            base.append(np.bincount(word_rows[hit], np.log10((self.word_counts[at[hit]] + 1) / self.divisor), n_rows))
            tails[1].append(_tail(found[~hit], word_rows[~hit], n_rows))
        cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        lists = []
        for parts in tails:
            offsets = pa.array(np.concatenate([[0], np.cumsum(cat([p[2] for p in parts], np.int64))]).astype(np.int32))
            lists += [pa.ListArray.from_arrays(offsets, pa.array(cat([p[0] for p in parts], np.int64))), pa.ListArray.from_arrays(offsets, pa.array(cat([p[1] for p in parts], np.int32)))]
        return pa.StructArray.from_arrays(
            [pa.array(cat(n_tokens, np.int64)), pa.array(cat(known, np.int64)), pa.array(cat(base, float)), pa.array(cat(score, float)), *lists],
            ["n_tokens", "known", "base", "score", "windows", "windows_n", "words", "words_n"],
        )


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.toArrow()
    return got[0].to_numpy(), got[1].to_numpy()


# A node's code holds its level (context length) above its level + 1 bytes; a context's name its length above its bytes.
def _level(code: Column) -> Column:
    return F.shiftright(code, 56)


def _bytes(code: Column) -> Column:
    return code.bitwiseAND(F.lit((1 << 56) - 1))


def _nodes(code: str) -> Column:
    """The nodes of a window on all levels, as an array."""
    return F.array(*[F.col(code).bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).bitwiseOR(F.lit(k << 56)) for k in range(ORDER + 1)])


def _with_level(code: Column, level: Column) -> Column:
    return code + level.cast("bigint") * F.lit(1 << 56)


def _context(node: Column) -> Column:
    """The name of a node's context."""
    return _with_level(F.shiftright(_bytes(node), 8), _level(node))


def _shorter(code: Column, n: Column) -> Column:
    """A node or context one level down, of ``n`` bytes."""
    masks = F.array(*[F.lit((1 << 8 * k) - 1).cast("bigint") for k in range(ORDER + 2)])
    return _with_level(code.bitwiseAND(F.element_at(masks, (n + 1).cast("int"))), _level(code) - 1)


def _contexts(nodes: DataFrame) -> DataFrame:
    """(name, n, escape, lower, lower_escape) of every context: see :class:`Trie`; as nothing is cut, the symbols seen hold all of n."""
    node = F.col("node")
    same = nodes.select(F.col("node").alias("suffix"), F.col("n").alias("same"))
    named = nodes.withColumn("suffix", F.when(_level(node) > 0, _shorter(node, _level(node)))).join(same, "suffix", "left")
    stats = store(named.groupBy(_context(node).alias("name")).agg(F.sum("n").alias("n"), F.count("*").alias("q"), F.sum("same").alias("gone")), "ppm-contexts")
    name = F.col("name")
    parent = stats.select(name.alias("parent"), F.col("n").alias("parent_n"), F.col("q").alias("parent_q"))
    joined = stats.withColumn("parent", F.when(_level(name) > 0, _shorter(name, _level(name) - 1))).join(parent, "parent", "left")
    log = lambda x: F.log10(F.greatest(x, F.lit(1e-300)))
    top = _level(name) == 0
    left = F.greatest(F.lit(0), F.col("parent_q") - F.col("q")) * 0.5
    rest = F.greatest(F.lit(0), F.col("parent_n") - F.col("gone")).cast("double")
    return joined.select(
        "name", "n", (F.log10(F.col("q") * 0.5) - F.log10("n")).alias("escape"),
        F.when(top, F.log10(F.greatest(F.lit(1), SYMBOLS - F.col("q")))).otherwise(log(rest)).alias("lower"),
        F.when(top | (left <= 0), 0.0).otherwise(log(left) - log(rest)).alias("lower_escape"),
    )


class Model:
    """A trained model: the broadcast part, and the stored words, trie nodes, contexts and window probabilities."""

    def __init__(self, head: Head, counts: DataFrame, nodes: DataFrame, contexts: DataFrame, seen: DataFrame, tokens: int, distinct: int):
        self.head, self.counts, self.nodes, self.contexts, self.seen, self.tokens, self.distinct = head, counts, nodes, contexts, seen, tokens, distinct


def train(docs: DataFrame, train_rows: Column, text_col: str = "text", keep: float = 1e-7, keep_words: float = 2.5e-7) -> Model:
    """Count the training texts and build the model; ``keep`` and ``keep_words`` bound what is broadcast of it."""
    texts = docs.where(train_rows).select(text_of(text_col).alias("text"))
    shares = slice_count(docs, SHARE_BYTES)
    dealt = texts.mapInArrow(lambda batches: _count(batches, shares), SHARES).repartitionById(shares, "share")
    counts = store(dealt.mapInArrow(_merge, COUNTS), "ppm-counts")
    words_of = counts.where("kind = 1").select("key", "n")
    totals = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()}
    tokens, distinct = (totals[1]["n"], totals[1]["distinct"]) if 1 in totals else (0, 0)
    symbols = totals[0]["n"] if 0 in totals else 0
    nodes = store(counts.where("kind = 0").select(F.explode(_nodes("key")).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("n")), "ppm-nodes")
    contexts = store(_contexts(nodes), "ppm-contexts")
    whole = nodes.where(_level(F.col("node")) == ORDER).withColumn("name", _context(F.col("node")))
    seen = store(
        whole.join(contexts.select("name", F.col("n").alias("of")), "name")
        .select(_bytes(F.col("node")).alias("key"), (F.log10(F.col("n") - 0.5) - F.log10("of")).alias("log"), "n"),
        "ppm-seen",
    )
    frequent = _arrays(seen.where(F.col("n") >= max(1.0, keep * symbols)).select("key", "log"))
    vocabulary = _arrays(words_of.where(F.col("n") >= max(1.0, keep_words * tokens)).select("key", "n"))
    return Model(Head(frequent, vocabulary, tokens, distinct), words_of, nodes, contexts, seen.select("key", "log"), tokens, distinct)


def unseen(keys: DataFrame, model: Model) -> DataFrame:
    """(key, log): log probability of each different window of ``keys`` (column ``key``) that training has not seen.

    Every suffix of the windows meets its node and its context once; the levels are then put together
    from the shortest up, each join on a suffix that at most 256 longer codes share.
    """
    node, level = F.col("node"), _level(F.col("node"))
    asked = keys.select(F.explode(_nodes("key")).alias("node")).distinct().withColumn("name", _context(node))
    info = store(
        asked.join(model.nodes.select("node", F.log10(F.col("n") - 0.5).alias("log_n")), "node", "left")
        .join(model.contexts, "name", "left")
        .select("node", "log_n", F.log10("n").alias("log_of"), "escape", "lower", "lower_escape"),
        "ppm-unseen",
    )
    # after: what follows an escape from this known context; start: all, when no longer context was known
    below = None
    for k in range(ORDER + 1):
        here = info.where(level == k)
        if below is None:
            after, fallback = -F.col("lower"), F.lit(-float(np.log10(SYMBOLS)))
        else:
            here = here.withColumn("suffix", _shorter(node, F.lit(k))).join(below, "suffix")
            after = F.when(F.col("b_log_n").isNotNull(), F.col("b_log_n") - F.col("lower")).otherwise(F.col("lower_escape") + F.col("b_after"))
            fallback = F.col("b_start")
        start = (
            F.when(F.col("log_n").isNotNull(), F.col("log_n") - F.col("log_of"))
            .when(F.col("escape").isNotNull(), F.col("escape") + after).otherwise(fallback)
        )
        here = here.select("node", "log_n", after.alias("after"), start.alias("start"))
        below = here.select(node.alias("suffix"), F.col("log_n").alias("b_log_n"), F.col("after").alias("b_after"), F.col("start").alias("b_start"))
    return here.select(_bytes(node).alias("key"), F.col("start").alias("log"))


def score(docs: DataFrame, model: Model, text_col: str = "text", trained: Column | None = None) -> DataFrame:
    """``docs`` without its text, with lm_tokens, lm_known, lm_base and lm_score (log10 probabilities).

    ``trained`` is true only for rows whose texts the model was trained on: no window of theirs is new to it.
    """
    clash = {"lm_tokens", "lm_known", "lm_base", "lm_score", "lm_row", "lm_trained"} & set(docs.columns)
    if clash:
        raise ValueError(f"the input has columns named {sorted(clash)}; rename them")
    sent = share(docs.sparkSession, model.head)
    lists = ", ".join(f"{kind}: array<bigint>, {kind}_n: array<int>" for kind in ("windows", "words"))

    @F.arrow_udf(f"struct<n_tokens: bigint, known: bigint, base: double, score: double, {lists}>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        head = shared(sent)
        for arr in batches:
            yield head.score(arr)

    rest = [c for c in docs.columns if c != text_col]
    known = F.lit(False) if trained is None else F.coalesce(trained, F.lit(False))
    scored = store(
        docs.select(*rest, known.alias("lm_trained"), F.monotonically_increasing_id().alias("lm_row"), measure(text_of(text_col)).alias("m")), "ppm-scores"
    )

    def tail(kind: int, name: str) -> DataFrame:
        pairs = scored.select("lm_row", F.explode(F.arrays_zip(F.col(f"m.{name}").alias("key"), F.col(f"m.{name}_n").alias("times"))).alias("t"))
        return pairs.select("lm_row", F.lit(kind).alias("kind"), "t.key", "t.times")

    new = store(scored.where(~F.col("lm_trained")).select(F.explode("m.windows").alias("key")).distinct().join(model.seen, "key", "left_anti"), "ppm-new")
    divisor = F.lit(model.head.divisor)
    values = model.seen.unionByName(unseen(new, model)).withColumn("kind", F.lit(0)).unionByName(
        model.counts.select("key", F.log10((F.col("n") + 1) / divisor).alias("log"), F.lit(1).alias("kind"))
    )
    is_word, value = F.col("kind") == 1, F.coalesce("log", F.log10(F.lit(1) / divisor))
    sums = tail(0, "windows").unionByName(tail(1, "words")).join(values, ["key", "kind"], "left").groupBy("lm_row").agg(
        F.sum(F.when(is_word, F.col("times") * value)).alias("base"), F.sum(F.when(is_word & F.col("log").isNotNull(), F.col("times"))).alias("known"),
        F.sum(F.when(~is_word, F.col("times") * F.col("log"))).alias("score"),
    )
    none = F.lit(0.0)
    return scored.join(sums, "lm_row", "left").select(
        *rest, F.col("m.n_tokens").alias("lm_tokens"), (F.col("m.known") + F.coalesce("known", F.lit(0))).alias("lm_known"),
        (F.col("m.base") + F.coalesce("base", none)).alias("lm_base"), (F.col("m.score") + F.coalesce("score", none)).alias("lm_score"),
    )
