"""Prefix trie of conversations: which openings they share, by Z-fast tries.

A conversation is the sequence of its turns (role, text). Every distinct sequence of first d turns is a node.

1. A turn becomes a 128-bit hash that depends on its place; a prefix is named by the exclusive or of its turns'
   hashes, a running total that the range-partitioned scan computes for conversations of any length.
2. Conversations, cut into stretches of ``stretch`` turns, are spread over tasks; a task inserts them, in
   batches of distinct sequences, into Z-fast tries. Such a trie holds only compacted nodes (where sequences
   part or end). A node covers the depths (a, e] of the edge above it and is found by the hash of its prefix at
   the one depth in (a, e] that is divisible by the largest power of two. So a fat binary search, probing
   two-fattest depths, finds the node where a conversation leaves the trie with about log2(turns) lookups.
3. Each task adds its members up the compacted tree and expands the edges to one row per depth. Spark adds
   these rows by node: an opening shared by a third of all conversations is one row per task.
4. Sums over subtrees need no walk. Each node is owned by its smallest member, so the nodes that a conversation
   owns are the end of its own path, and the sum over a node's subtree is the sum of what its members own, less
   what its owner owns above the node. The members' sums are gathered by the same tries.

Names are 128-bit hashes; equal names are taken for equal prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcurve.llm.common import store, text_of
from revcurve.operators.neighbours import ordered_neighbours

STRETCH = 1024
BATCH = 2048  # sequences inserted at a time
TASK_TURNS = 1 << 20  # a task's tries are expanded and begun anew beyond this number of turns
WORD = r"[^\x20\x09-\x0D]+"


def fattest(a: int, e: int) -> int:
    """The number in (a, e] that is divisible by the largest power of two."""
    return e & -1 << (a ^ e).bit_length() - 1


class Trie:
    """Z-fast tries over named prefixes, one for each prefix that inserted sequences start from.

    A sequence is (depth of its start, names) with the start's name first. ``values`` are summed over the
    members of a node, but the first, which is the smallest.
    """

    def __init__(self):
        self.handles: dict[tuple, int] = {}  # (two-fattest depth, name there): node
        self.roots: dict[tuple, int] = {}
        # by node: the edge covers depths (above, end]; the sequence it came with; node above; first name below: node
        self.above, self.end, self.sequence, self.parent, self.below, self.values = [], [], [], [], [], []
        self.lookups = 0

    def _node(self, above: int, end: int, sequence: tuple, parent: int) -> int:
        node = len(self.end)
        for column, value in zip((self.above, self.end, self.sequence, self.parent, self.below, self.values), (above, end, sequence, parent, {}, None)):
            column.append(value)
        if parent >= 0:
            self._hang(node, parent)
        return node

    def _name(self, node: int, depth: int):
        return self.sequence[node][1][depth - self.sequence[node][0]]

    def _hang(self, node: int, parent: int) -> None:
        self.parent[node], self.above[node] = parent, self.end[parent]
        self.below[parent][self._name(node, self.above[node] + 1)] = node
        handle = fattest(self.above[node], self.end[node])
        self.handles[handle, self._name(node, handle)] = node

    def _common(self, node: int, start: int, names: list, lo: int, hi: int) -> int:
        """The largest depth in [lo, hi] to which the node agrees with the names; it does at ``lo``."""
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self._name(node, mid) == names[mid - start] else (lo, mid - 1)
        return lo

    def locate(self, start: int, names: list) -> tuple[int, int]:
        """The exit node of a sequence and the depth to which the trie holds it."""
        top = start + len(names) - 1
        node = self.roots.get((start, names[0]))
        if node is None:
            node = self.roots[start, names[0]] = self._node(start, start, (start, names), -1)
        lo, hi = start, top
        while lo < hi:
            depth = fattest(lo, hi)
            self.lookups += 1
            found = self.handles.get((depth, names[depth - start]))
            if found is None:
                hi = depth - 1
            elif self.end[found] <= top and self._name(found, self.end[found]) == names[self.end[found] - start]:
                node, lo = found, self.end[found]
            else:
                return found, self._common(found, start, names, depth, min(self.end[found], top))
        if lo < top and (child := self.below[node].get(names[lo + 1 - start])) is not None:
            return child, self._common(child, start, names, lo + 1, min(self.end[child], top))
        return node, lo

    def insert(self, start: int, names: list, data, values: tuple) -> None:
        """Add a sequence; ``data`` is carried for its expansion, one entry for each name."""
        top = start + len(names) - 1
        node, depth = self.locate(start, names)
        if depth < self.end[node]:  # part the edge
            parent, lower = self.parent[node], node
            node = self._node(self.above[lower], depth, self.sequence[lower], parent)
            self._hang(lower, node)
        if depth < top:
            node = self._node(depth, top, (start, names, data), node)
        self.values[node] = _added(self.values[node], values)

    def insert_batch(self, batch: Iterable[tuple]) -> None:
        """Add (start, names, data, values); equal sequences of a batch are joined first."""
        distinct: dict[tuple, tuple] = {}
        for start, names, data, values in batch:
            key = (start, len(names), names[0], names[-1])
            held = distinct.get(key)
            distinct[key] = (start, names, data, values if held is None else _added(held[3], values))
        for sequence in distinct.values():
            self.insert(*sequence)

    def expand(self) -> Iterator[tuple]:
        """(depth, name, name above, data, values) of every depth of every edge."""
        for node in sorted(range(len(self.end)), key=lambda n: -self.end[n]):
            values, parent = self.values[node], self.parent[node]
            if parent < 0:
                continue
            self.values[parent] = _added(self.values[parent], values)
            start, names, data = self.sequence[node]
            for depth in range(self.above[node] + 1, self.end[node] + 1):
                at = depth - start
                yield depth, names[at], names[at - 1], data[at], values


def _added(a: tuple | None, b: tuple) -> tuple:
    return b if a is None else (min(a[0], b[0]), *[x + y for x, y in zip(a[1:], b[1:])])


_NODES = pa.schema([(c, pa.int64()) for c in ("depth", "p1", "p2", "q1", "q2", "words", "conv", "n", "saved", "leaves")])


def _insert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns (conv, stretch, depth, p1, p2, q1, q2, words, saved, leaves), sorted, to partial nodes."""

    def expanded(trie: Trie) -> Iterator[pa.RecordBatch]:
        held = []
        for depth, name, above, words, values in trie.expand():
            held.append((depth, *name, *above, words, *values))
            if len(held) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=_NODES)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=_NODES)

    trie, turns, waiting, key = Trie(), 0, [], None
    start, names, data, values = 0, [], [], ()
    for batch in batches:
        for conv, stretch, depth, p1, p2, q1, q2, words, saved, leaves in zip(*[c.to_pylist() for c in batch.columns]):
            if (conv, stretch) != key:
                if key is not None:
                    waiting.append((start, names, data, values))
                    if len(waiting) == BATCH or turns > TASK_TURNS:
                        trie.insert_batch(waiting)
                        waiting = []
                        if turns > TASK_TURNS:
                            yield from expanded(trie)
                            trie, turns = Trie(), 0
                key, start, names, data, values = (conv, stretch), depth - 1, [(q1, q2)], [0], (conv, 1, saved, leaves)
            names.append((p1, p2))
            data.append(words)
            turns += 1
    if key is not None:
        trie.insert_batch([*waiting, (start, names, data, values)])
        yield from expanded(trie)


def _members(turns: DataFrame) -> DataFrame:
    """Nodes with their smallest member, number of members and sums of the members' ``saved`` and ``leaves``."""
    ordered = turns.repartition("conv", "stretch").sortWithinPartitions("conv", "stretch", "depth")
    partial = ordered.select("conv", "stretch", "depth", "p1", "p2", "q1", "q2", "words", "saved", "leaves").mapInArrow(
        _insert, ", ".join(f"{f.name} bigint" for f in _NODES)
    )
    return partial.groupBy("depth", "p1", "p2").agg(
        F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("words").alias("words"), F.min("conv").alias("conv"),
        F.sum("n").alias("n"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"),
    )


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p1, p2, conv), sorted, to (p1, p2, sha256 of the comma-joined convs); only the digest's state is held."""
    schema, key, state, held = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("ends", pa.string())]), None, None, []
    for batch in batches:
        for p1, p2, conv in zip(*[c.to_pylist() for c in batch.columns]):
            if (p1, p2) != key:
                if key is not None:
                    held.append((*key, state.hexdigest()))
                key, state = (p1, p2), hashlib.sha256(str(conv).encode())
            else:
                state.update(f",{conv}".encode())
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, state.hexdigest()), schema)], schema=schema)


def symbols(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns (conv, place, h1, h2, words) of every conversation, in the order of ``turn`` (NULL first).

    A NULL role or text is empty; rows of one turn follow role and a hash of the text; rows without a
    conversation id take no part. Other columns are left out, whatever their names.
    """
    base = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), text_of(role).alias("role"),
        F.xxhash64(text_of(role), text_of(text)).alias("h1"), F.xxhash64(F.lit(11), text_of(text), text_of(role)).alias("h2"),
        F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint").alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    return ordered_neighbours(base, ["conv"], ["turn", "role", "h1", "row"], count_before="place").select("conv", "place", "h1", "h2", "words")


def nodes(turns: DataFrame, convs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The trie of ``turns`` (conv, place, h1, h2, words; places from 0 without gaps) and ``convs`` (conv).

    (conv, depth, parent, n_convs, n_children, n_leaves, saved, ends) per node: ``conv`` its smallest member,
    ``parent`` that of the node above (NULL for the root), ``saved`` the sum over its subtree of (members - 1) x words
    of the last turn, ``ends`` the SHA-256 of the comma-joined members that end there. Conversations
    without turns are members of the root alone; without conversations there is no node.
    """
    depth = F.col("place") + 1
    keyed = turns.select(
        "conv", depth.alias("depth"), "words", F.xxhash64(depth, "h1", "h2").alias("k1"), F.xxhash64(F.lit(13), depth, "h2", "h1").alias("k2")
    )
    named = store(ordered_neighbours(
        keyed, ["conv"], ["depth"], lead={"next": "depth"}, running={"p1": ("xor", "k1"), "p2": ("xor", "k2")}
    ).select(
        "conv", F.floor((F.col("depth") - 1) / stretch).alias("stretch"), "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("k1")).alias("q1"),
        F.col("p2").bitwiseXOR(F.col("k2")).alias("q2"), "words", F.col("next").isNull().alias("last"),
    ), "trie-turns")
    zero = F.lit(0).cast("bigint")
    found = store(_members(named.withColumn("saved", zero).withColumn("leaves", zero)).drop("saved", "leaves"), "trie-nodes")

    # the nodes' children, and what each conversation owns
    children = found.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("children"))
    linked = found.join(children, ["depth", "p1", "p2"], "left").select(
        *found.columns, F.coalesce("children", zero).alias("children"), ((F.col("n") - 1) * F.col("words")).alias("own")
    )
    linked = store(ordered_neighbours(linked, ["conv"], ["depth"], running={"upto": ("sum", "own")}), "trie-owned")
    owned = linked.groupBy("conv").agg(F.sum("own").alias("saved"), F.count_if(F.col("children") == 0).alias("leaves"))
    sums = _members(
        named.join(owned, "conv", "left").withColumn("saved", F.coalesce("saved", zero)).withColumn("leaves", F.coalesce("leaves", zero))
    ).select("depth", "p1", "p2", "saved", "leaves")
    parents = linked.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent"))

    at_end = named.where("last").select("p1", "p2", "conv")
    turnless = convs.select("conv").distinct().join(at_end.select("conv"), "conv", "left_anti").select(zero.alias("p1"), zero.alias("p2"), "conv")
    ends = at_end.unionByName(turnless).repartition("p1", "p2").sortWithinPartitions("p1", "p2", "conv").mapInArrow(
        _ends, "p1 bigint, p2 bigint, ends string"
    )

    top, members = convs.agg(F.min("conv"), F.count_distinct("conv")).first()  # the root's row
    root = linked.agg(
        F.count_if(F.col("depth") == 1).alias("children"), F.count_if(F.col("children") == 0).alias("leaves"), F.sum("own").alias("saved"),
    ).where(F.lit(members > 0)).select(
        F.lit(top).cast("bigint").alias("conv"), zero.alias("depth"), F.lit(None).cast("bigint").alias("parent"), zero.alias("p1"), zero.alias("p2"),
        F.lit(members).cast("bigint").alias("n_convs"), F.col("children").alias("n_children"),
        F.greatest("leaves", F.lit(1)).cast("bigint").alias("n_leaves"), F.coalesce("saved", zero).alias("saved"),
    )
    inner = linked.join(sums, ["depth", "p1", "p2"]).join(parents, ["depth", "q1", "q2"], "left").select(
        "conv", "depth", F.coalesce("parent", F.lit(top).cast("bigint")).alias("parent"), "p1", "p2", F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") - F.col("upto") + F.col("own")).alias("saved"),
    )
    return root.unionByName(inner).join(ends, ["p1", "p2"], "left").select(
        "conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends")
    )
