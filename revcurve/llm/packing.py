"""Packing of token sequences: shortest pack first over the length histogram.

Documents are tokenised once, and their ids stored. A document longer than a sequence gives whole sequences;
what is left of it (shorter than a sequence) is packed:

1. Spark counts the lengths; the histogram has fewer entries than a sequence has tokens, whatever the input.
2. On the histogram, lengths are placed longest first, each into the pack that is filled least (shortest
   pack first), opening as many packs as a length needs where none has room. Packs that look alike are one
   group with a count, so a length held by a billion documents is a few steps.
3. Packs that would be padded are filled up: the least filled of them are taken apart, and their documents,
   cut where needed, fill the others. What is left, under one sequence, is laid out in sequences of a power
   of two tokens, which are not padded. So no sequence is padded, and few documents are cut.
4. Packs go back to documents by rank, their row's number among all rows of its length: the steps give each
   rank its pack. A rank is the row's count within its own task plus the counts of earlier tasks, added per
   (task, length); no group is sorted or gathered.

The stored ids are bucketed by task, so the counts reach them without moving them: what is shuffled is one
row per (task, length). The layout is sent to the tasks by value; it grows with the number of steps on
the histogram, not with the documents.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revcurve.llm.common import share, shared, text_of
from revcurve.operators.neighbours import BUCKET, SLICE, slice_count, store_slices

CAPACITY = 2048
END = 1
CACHED_WORDS = 200_000  # words whose ids a Python worker remembers, and as many older ones; only speed depends on it
PART_CHARS = 8 << 20  # texts are tokenised together up to this size; a longer one in parts that end before white space
MODEL_WORDS = 10_000  # words that go to the model at once
SPACE = " \t\n\r\x0b\x0c"
SIGNS = ".,;:!?%$)#&*+-/=@^_~"  # closing signs of words; none of them begins a contraction
LATIN = "".join(c for c in map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x180)]) if c.isalpha() and len(c.lower()) == 1)
PLAIN = re.compile(f"[{LATIN}]+")
BORDERS = pa.array([*LATIN, *"0123456789"])  # signs behind these are encoded apart
OUT_BYTES = 8 << 20
_RANK_BITS = 44


class Words(dict):
    """Ids of words, encoded when they are asked for first.

    No token spans ASCII white space, so a text's ids are those of its words. Nor does one span the border
    between a Latin letter or ASCII digit and ASCII signs behind it, so a word and its closing signs are encoded
    apart. Words of plain Latin letters go to the tokenizer's model directly, many at once, with the normalised form of
    each letter looked up: the model marks a word's last token. All others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        size = self.tokenizer.get_vocab_size()
        self.type = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(size, bool)
        if suffix:
            self.last[[i for token, i in self.model.get_vocab().items() if token.endswith(suffix)]] = True
        self.letters = {ord(c): self._form(c) for c in LATIN}
        probe = [LATIN, LATIN[::-1], LATIN[::3], "Naïve", "straße", "Œuvre", *LATIN]
        if not suffix or None in self.letters.values() or self._plain(probe) != [self._whole(w) for w in probe]:
            self.letters = {}  # not a tokenizer that treats letters one by one

    def _form(self, letter: str) -> str | None:
        """What the model sees of a letter; None if it is more than one piece."""
        text = self.tokenizer.normalizer.normalize_str(letter) if self.tokenizer.normalizer else letter
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(text) if self.tokenizer.pre_tokenizer else [(text, None)]
        return pieces[0][0] if len(pieces) == 1 else None

    def _plain(self, words: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast([" ".join(words).translate(self.letters)], add_special_tokens=False)[0].ids
        ids = np.array(found, self.type)
        ends = ((np.flatnonzero(self.last[ids]) + 1) * self.type.itemsize).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.type).tobytes()

    def look_up(self, words: list[str]) -> list[bytes]:
        """The ids of each of ``words``, which are distinct."""
        found = [*map(self.get, words)]
        missing = [word for word, ids in zip(words, found) if ids is None]
        if missing:
            again = [*map(self.older.get, missing)]
            new = [word for word, ids in zip(missing, again) if ids is None]
            plain = [w for w in new if w.isalpha() and PLAIN.fullmatch(w)] if self.letters else []
            learnt: dict[str, bytes] = {}
            for at in range(0, len(plain), MODEL_WORDS):
                some = plain[at : at + MODEL_WORDS]
                learnt.update(zip(some, self._plain(some), strict=True))
            again = [learnt.get(w) or self._whole(w) if ids is None else ids for w, ids in zip(missing, again)]
            if len(self) + len(missing) > CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self.update(islice(zip(missing, again), CACHED_WORDS))
            rest = iter(again)
            found = [next(rest) if ids is None else ids for ids in found]
        return found

    def encode_all(self, texts: pa.StringArray, end: bytes = b"") -> pa.BinaryArray:
        """The ids of each text, in ``type``, and ``end``."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        stems = pc.ascii_rtrim(distinct, SIGNS)
        apart = pc.and_not(pc.is_in(pc.utf8_slice_codeunits(stems, -1), BORDERS), pc.match_substring(distinct, "<"))
        stem_bytes = pc.binary_length(pc.if_else(apart, stems, distinct)).to_numpy()
        begin = np.frombuffer(distinct.buffers()[1], np.int32)[: len(distinct) + 1]
        borders = np.empty(2 * len(distinct) + 1, np.int32)  # stem and signs of each word, in the words' own bytes
        borders[::2], borders[1::2] = begin, begin[:-1] + stem_bytes
        parts = pa.StringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders), distinct.buffers()[2]).dictionary_encode()

        found = pa.array(self.look_up(parts.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(parts.indices)
        ids = pa.concat_arrays([_spans(found, slice(None, None, 2)), pa.array([end], pa.binary())])
        ends = words.offsets.to_numpy()  # ``end`` goes behind the last word of each text
        taken = ids.take(pa.array(np.insert(coded.indices.to_numpy(), ends[1:], len(ids) - 1)))
        return _spans(taken, ends + np.arange(len(ends)))

    def encode(self, text: str) -> bytes:
        """The ids of a text, in ``type``."""
        out, at = [], 0
        while at < len(text):
            end = min(at + PART_CHARS, len(text))
            while end < len(text) and text[end] not in SPACE:
                end += 1
            out.append(self.encode_all(pa.array([text[at:end]]))[0].as_py())
            at = end
        return out[0] if len(out) == 1 else b"".join(out)


def _spans(values: pa.BinaryArray, borders: slice | np.ndarray) -> pa.BinaryArray:
    """Neighbouring ``values`` as one, between those at ``borders``; nothing is copied."""
    offsets = np.ascontiguousarray(np.frombuffer(values.buffers()[1], np.int32)[: len(values) + 1][borders])
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), values.buffers()[2]])


_WORDS: dict[str, Words] = {}


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of (id, text) in parts of at most PART_CHARS bytes of text; a longer text is alone."""
    ends, lo = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(), dtype=np.int64), 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + PART_CHARS, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _tokenise(path: str, capacity: int, end_id: int):
    """Tasks: (id, text) to (id, ids, n_tokens, left, rank in task, whole sequences before in task, task)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORDS.get(path) or _WORDS.setdefault(path, Words(path))
        end = np.array([end_id], words.type).tobytes()
        seen, whole, task = np.zeros(capacity, np.int64), 0, TaskContext.get().partitionId()
        for batch in batches:
            for rows in _parts(batch):
                texts = rows.column(1)
                ids = words.encode_all(texts.cast(pa.string()), end) if len(texts) > 1 else pa.array([words.encode(texts[0].as_py()) + end], pa.binary())
                n = pc.binary_length(ids).to_numpy().astype(np.int64) // words.type.itemsize
                left, ranks, before = n % capacity, np.empty(len(n), np.int64), np.empty(len(n), np.int64)
                for i, (length, count) in enumerate(zip(left.tolist(), (n // capacity).tolist())):
                    ranks[i], before[i] = seen[length], whole
                    seen[length] += 1
                    whole += count
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), ids, pa.array(n), pa.array(left.astype(np.int32)), pa.array(ranks),
                     pa.array(before), pa.array(np.full(len(ids), task, np.int32))],
                    names=["id", "ids", "n_tokens", "left", "rank", "whole_before", SLICE],
                )

    return run


# -- the histogram ------------------------------------------------------------------------------
# Packs are numbered as they are opened, and a group of packs that look alike is a range of numbers, also after
# it was split; so a step on the histogram is one record, whatever the number of rows it places.


def _unpadded(used: int, capacity: int) -> bool:
    return used & (used - 1) == 0 or used == capacity


def place(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], list[tuple]]:
    """Shortest pack first over ``histogram`` (length below ``capacity``: number of rows).

    Steps (length, first rank, packs, first pack, offset): the row of rank ``first + t * packs + j`` is in pack
    ``first pack + j`` at ``offset + t * length``. Groups (used, first pack, packs): all packs, by tokens used.
    """
    steps, groups, packs = [], [], 0
    open_: list[tuple] = []  # (used, first pack, packs), least filled first
    for length in sorted(histogram, reverse=True):
        first, left = 0, histogram[length]
        while left:
            if open_ and open_[0][0] + length <= capacity:
                used, pack, count = heapq.heappop(open_)
            else:
                used, pack, count = 0, packs, -(-left // (capacity // length))
                packs += count
            if left < count:
                heapq.heappush(open_, (used, pack + left, count - left))
                count = left
            times = min((capacity - used) // length, left // count)  # layers, while these packs are the least filled
            if open_:
                times = min(times, max(0, open_[0][0] - used) // length + 1)
            steps.append((length, first, count, pack, used))
            first, left, used = first + times * count, left - times * count, used + times * length
            if used + 1 > capacity:
                groups.append((used, pack, count))
            else:
                heapq.heappush(open_, (used, pack, count))
    return steps, groups + open_


class Layout:
    """Where each (length, rank) goes: its packs, and how packs that would be padded are filled up.

    Padded packs are filled up without listing pieces: the least filled ones are laid end to end as one
    *stream* of tokens, the room of the others as one line of the same measure, and token x of the stream goes to
    place x of the line. What is left of the stream, under one sequence, goes to new packs of a power of two.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        steps, groups = place(histogram, capacity)
        steps.sort()
        self.steps = np.array(steps, np.int64).reshape(-1, 5)
        self.keys = (self.steps[:, 0] << _RANK_BITS) + self.steps[:, 1]
        kept = [g for g in groups if _unpadded(g[0], capacity)]
        short = sorted((g for g in groups if not _unpadded(g[0], capacity)), reverse=True)
        room, have, taken = sum(n * (capacity - used) for used, _, n in short), 0, []
        while have < room:
            used, pack, n = short.pop()
            k = min(n, -(-(room - have) // capacity))
            taken.append((pack, k, used, have))
            room, have = room - k * (capacity - used), have + k * used
            if k < n:
                short.append((used, pack + k, n - k))
        taken.sort()
        self.taken = np.array(taken, np.int64).reshape(-1, 4)  # first pack, packs, used, place in the stream
        self.gone = np.concatenate([[0], np.cumsum(self.taken[:, 1])])  # packs taken apart before each range
        line, at = [], 0
        for used, pack, n in short:
            line.append((at, capacity - used, self._number(pack), used))
            at += n * (capacity - used)
        new = sum(n for _, _, n in kept) + sum(n for _, _, n in short)
        for power in reversed(range(capacity.bit_length())):
            if have - room >> power & 1:
                line.append((at, 1 << power, new, 0))
                at, new = at + (1 << power), new + 1
        self.line = np.array(line, np.int64).reshape(-1, 4)  # place, room of one pack, first sequence, offset
        self.packs = new

    def _number(self, pack: int) -> int:
        """A kept pack's number among the kept ones (no group is taken apart in its middle)."""
        return pack - int(self.gone[np.searchsorted(self.taken[:, 0], pack, "right")])

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pack, offset) of each row, before packs are taken apart."""
        step = self.steps[np.searchsorted(self.keys, (lengths << _RANK_BITS) + ranks, "right") - 1]
        times, pack = np.divmod(ranks - step[:, 1], step[:, 2])
        return step[:, 3] + pack, step[:, 4] + times * lengths

    def pieces(self, length: int, pack: int, offset: int) -> list[tuple[int, int, int, int]]:
        """(start, size, sequence, offset) of the pieces of a row that :meth:`find` put at (pack, offset)."""
        i = int(np.searchsorted(self.taken[:, 0], pack, "right")) - 1
        if i < 0 or pack >= self.taken[i, 0] + self.taken[i, 1]:
            return [(0, length, self._number(pack), offset)]
        first, _, used, place_ = self.taken[i].tolist()
        at, out, start = place_ + (pack - first) * used + offset, [], 0
        while start < length:
            begin, room, sequence, before = self.line[np.searchsorted(self.line[:, 0], at, "right") - 1].tolist()
            which, within = divmod(at - begin, room)
            size = min(length - start, room - within)
            out.append((start, size, sequence + which, before + within))
            start, at = start + size, at + size
        return out


def _cut(sent, type_: str, capacity: int):
    """Tasks: stored rows with their global ranks to pieces."""
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, whole = shared(sent)
        rows: list[tuple] = []
        sources: list[int] = []
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            n, left, rank, first = (col[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_tokens", "left", "rank", "first"))
            (packs, offsets), held = layout.find(left, rank), 0
            for i, raw in enumerate(col["ids"]):
                ids = np.frombuffer(raw.as_buffer(), type_).astype("<u4")
                total = int(n[i])
                cuts = [(s, capacity, int(first[i]) + s // capacity, 0) for s in range(0, total - capacity + 1, capacity)]
                if left[i]:
                    base = total - int(left[i])
                    for start, size, sequence, offset in layout.pieces(int(left[i]), int(packs[i]), int(offsets[i])):
                        cuts.append((base + start, size, whole + sequence, offset))
                for start, size, sequence, offset in cuts:
                    rows.append((start, size, ids[start : start + size].tobytes(), total, sequence, offset))
                    sources.append(i)
                held += ids.nbytes
                if held > OUT_BYTES:
                    yield _batch(names, col["id"], sources, rows)
                    rows, sources, held = [], [], 0
            if rows:
                yield _batch(names, col["id"], sources, rows)
                rows, sources = [], []

    return run


def _batch(names: list[str], ids: pa.Array, sources: list[int], rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.binary() if i == 2 else pa.int64()) for i, c in enumerate(zip(*rows))]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(sources, pa.int64())), *columns], names=names)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: (id, start, length, ids, doc_tokens, sequence_id, offset).

    ``tokenizer`` is the path of a file of the tokenizers library that every executor has, whose tokens
    do not span white space (as a pre-tokenizer that drops white space ensures); ``capacity`` is a power of two.
    ``ids`` are a piece's ids as little-endian unsigned 32-bit integers; ``end_id`` closes each document.

    A null text is empty: one piece, the closing id. An empty table gives no pieces. Ids of ``id_col``
    are only carried along: null and repeated ones are rows like others. Other columns of ``docs`` do not
    matter, whatever their names. Very long texts are tokenised in parts and cut into whole sequences.
    """
    assert capacity & (capacity - 1) == 0
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    tokens = source.mapInArrow(
        _tokenise(tokenizer, capacity, end_id),
        f"id {id_type}, ids binary, n_tokens bigint, left int, rank bigint, whole_before bigint, {SLICE} int",
    )
    stored = store_slices(tokens, slice_count(docs))

    per_task = stored.groupBy(BUCKET, SLICE, "left").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("n_tokens") / capacity)).cast("bigint").alias("whole")
    )
    histogram = {r["left"]: r["n"] for r in per_task.groupBy("left").agg(F.sum("n").alias("n")).collect()}
    histogram.pop(0, None)
    layout = Layout(histogram, capacity)

    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    wholes = per_task.groupBy(SLICE).agg(F.sum("whole").alias("whole"))
    whole = wholes.agg(zero(F.sum("whole"))).first()[0]
    wholes = wholes.select(SLICE, zero(F.sum("whole").over(earlier(Window.orderBy(SLICE)))).alias("whole"))  # one row per task
    ranks = per_task.select(
        BUCKET, SLICE, F.struct("left", zero(F.sum("n").over(earlier(Window.partitionBy("left").orderBy(SLICE))))).alias("rank")
    ).groupBy(BUCKET, SLICE).agg(F.map_from_entries(F.collect_list("rank")).alias("ranks"))  # at most one for each length
    by_length = F.transform(F.sequence(F.lit(0), F.lit(capacity - 1)), lambda n: zero(F.try_element_at("ranks", n)))
    bases = ranks.join(wholes, SLICE).groupBy(BUCKET).agg(
        F.map_from_entries(F.collect_list(F.struct(SLICE, F.struct(by_length.alias("ranks"), F.col("whole").alias("whole"))))).alias("_bases")
    )  # one row for each bucket, which is the partitioning of the stored rows
    base = F.col("_bases")[F.col(SLICE)]
    ranked = stored.join(bases.hint("shuffle_hash"), BUCKET, "left").select(
        "id", "ids", "n_tokens", "left", (F.col("rank") + base["ranks"][F.col("left")]).alias("rank"), (F.col("whole_before") + base["whole"]).alias("first")
    )
    type_ = Words(tokenizer).type.str
    return ranked.mapInArrow(
        _cut(share(spark, (layout, int(whole))), type_, capacity),
        f"id {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint",
    )
