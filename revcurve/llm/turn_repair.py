"""Repair of conversation structure: generalised LR parsing of the roles with weighted edits.

A conversation should be ``(s?(ua)+)?`` in the initials of its roles (system, user, assistant). Each row may be
kept (K, 0), given another role (R, 1) or deleted (D, 2), and rows with empty text may be inserted anywhere
(I, 5); a row that ends in the middle of a sentence adds 5 if it stays, a blank or repeated row must go. The
repair is the cheapest edit sequence, of equal ones the one whose initials come first in ASCII.

The parser runs all LR stacks of the role grammar at once. Stacks are nodes (state, node below) of one graph
that shares their lower parts; a row's edits shift its own initial, a new one or none, and stacks that become
equal are merged to the smaller (cost, initials of the edits). The grammar is left-recursive, so there are only
a handful of stacks, whatever the length of a conversation.

That makes a conversation a product of small tables: a stretch of its rows is fully described by the cheapest
edits from every stack before it to every stack after it. Rows are numbered by the range-partitioned scan, cut
into stretches of ``stretch`` rows that are parsed in parallel, and each conversation then only folds its
stretches, so one that holds a third of all rows is spread over as many tasks as it has stretches.

Rows of one conversation follow their turn (NULLs first); rows of one turn follow role and a hash of the text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcurve.llm.common import store
from revcurve.operators.neighbours import ordered_neighbours

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}  # what a row can be turned into, or be inserted as
# s?(ua)+ or nothing, left-recursive: the productions of the role grammar
GRAMMAR = (("C", ""), ("C", "T"), ("C", "sT"), ("T", "ua"), ("T", "Tua"))
STRETCH = 4096
SPACE = " \t\n\x0b\x0c\r"
MAX_STACKS = 64


class Stacks:
    """The LR stacks of a grammar as nodes (state, node below), and the moves between them.

    ``productions`` are (left, right) with one character a symbol; the first left side is the start symbol
    and does not occur on a right side. A grammar whose stacks grow without end is an error.
    """

    def __init__(self, productions=GRAMMAR):
        start = productions[0][0]
        self.productions = [("'", start), *productions]
        lefts = {left for left, _ in productions}
        self.terminals = sorted({c for _, right in productions for c in right} - lefts)
        self._follow(lefts, start)
        states, self.goto = [self._close({(0, 0)}, lefts)], []
        for items in states:  # grows while it is read
            moves: dict[str, set] = {}
            for rule, dot in items:
                right = self.productions[rule][1]
                if dot < len(right):
                    moves.setdefault(right[dot], set()).add((rule, dot + 1))
            row = {}
            for symbol in sorted(moves):
                closed = self._close(moves[symbol], lefts)
                if closed not in states:
                    states.append(closed)
                row[symbol] = states.index(closed)
            self.goto.append(row)
        self.done = [[self.productions[r] for r, dot in sorted(items) if dot == len(self.productions[r][1])] for items in states]
        self.start = start
        self.nodes, self.ids = [(0, -1)], {(0, -1): 0}
        self.moves: dict[int, dict[str, tuple[int, ...]]] = {}
        live = [0]
        for node in live:  # grows while it is read
            self.moves[node] = {t: self._shift(node, t) for t in self.terminals}
            live += [n for found in self.moves[node].values() for n in found if n not in live]
            if len(live) > MAX_STACKS:
                raise ValueError("the stacks of this grammar are not bounded")
        self.live = live
        self.accepted = {n for n in live if self._accepts(n)}

    def _close(self, items: set, lefts: set) -> frozenset:
        items, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            right = self.productions[rule][1]
            if dot < len(right) and right[dot] in lefts:
                new = {(i, 0) for i, (left, _) in enumerate(self.productions) if left == right[dot]} - items
                items |= new
                todo += new
        return frozenset(items)

    def _follow(self, lefts: set, start: str) -> None:
        empty, first = set(), {left: set() for left in lefts}
        self.follow = {left: set() for left in lefts} | {"'": {"$"}}
        for _ in range(4 * len(self.productions) * (len(self.terminals) + 2)):  # more rounds than there can be changes
            for left, right in self.productions:
                begin = set()
                for c in right:
                    begin |= first.get(c, {c})
                    if c not in empty:
                        break
                else:
                    if left in lefts:
                        empty.add(left)
                if left in lefts:
                    first[left] |= begin
                after = set(self.follow[left])
                for c in reversed(right):
                    if c in lefts:
                        self.follow[c] |= after
                        after = (after if c in empty else set()) | first[c]
                    else:
                        after = {c}

    def _node(self, state: int, below: int) -> int:
        if (state, below) not in self.ids:
            self.ids[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self.ids[state, below]

    def spelled(self, node: int) -> str:
        """The symbols of a stack; a state is entered by one symbol only."""
        entered = {state: symbol for row in self.goto for symbol, state in row.items()}
        out = ""
        while node:
            state, node = self.nodes[node]
            out = entered[state] + out
        return out

    def _reduced(self, node: int, ahead: set) -> list[int]:
        """The node and all it reduces to before one of the symbols ``ahead``."""
        found = [node]
        for n in found:  # grows while it is read
            for left, right in self.done[self.nodes[n][0]]:
                if left == "'" or not self.follow[left] & ahead:
                    continue
                below = n
                for _ in right:
                    below = self.nodes[below][1]
                target = self.goto[self.nodes[below][0]].get(left)
                if target is not None and (new := self._node(target, below)) not in found:
                    found.append(new)
        return found

    def _shift(self, node: int, terminal: str) -> tuple[int, ...]:
        target = self.goto[self.nodes[node][0]].get(terminal)
        if target is None:
            return ()
        found = self._reduced(self._node(target, node), set(self.terminals))
        # a stack that shifts nothing is of no use once it is reduced
        return tuple(n for n in found if n == found[-1] or set(self.goto[self.nodes[n][0]]) & set(self.terminals))

    def _accepts(self, node: int) -> bool:
        return any(self.nodes[n] == (self.goto[0][self.start], 0) for n in self._reduced(node, {"$"}))


@functools.lru_cache(maxsize=8)
def stacks(productions=GRAMMAR) -> Stacks:
    return Stacks(productions)


def _better(front: dict, node: int, value: tuple) -> bool:
    if node not in front or value < front[node]:
        front[node] = value
        return True
    return False


def _inserted(table: Stacks, front: dict) -> dict:
    """``front`` and all stacks that insertions lead to."""
    front, todo = dict(front), list(front)
    while todo:
        node = todo.pop()
        cost, audit = front[node]
        for terminal in ROLES:
            todo += [n for n in table.moves[node].get(terminal, ()) if _better(front, n, (cost + INSERT, audit + "I"))]
    return front


def parse(table: Stacks, front: dict[int, tuple[int, str]], rows: Iterable[tuple[str, str]]) -> dict[int, tuple[int, str]]:
    """(cost, audit) of every stack after ``rows`` of (role initial, fault), from the stacks ``front``.

    ``fault`` is "" or one of "blank", "duplicate", "truncated".
    """
    for initial, fault in rows:
        before, front = _inserted(table, front), {}
        stay = TRUNCATED if fault == "truncated" else 0
        for node, (cost, audit) in before.items():
            _better(front, node, (cost + DELETE, audit + "D"))
            if fault in ("blank", "duplicate"):
                continue
            for n in table.moves[node].get(initial, ()):
                _better(front, n, (cost + KEEP + stay, audit + "K"))
            for terminal in ROLES:
                for n in table.moves[node].get(terminal, ()):
                    _better(front, n, (cost + REROLE + stay, audit + "R"))
    return front


def finish(table: Stacks, front: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The best (cost, audit) that ends a conversation."""
    return min(v for n, v in _inserted(table, front).items() if n in table.accepted)


# -- tasks --------------------------------------------------------------------------------------


def _runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first ``keys`` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield key, rows


def _out(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _first(batches: Iterable[pa.RecordBatch]) -> tuple[pa.DataType | None, Iterator[pa.RecordBatch]]:
    """The type of the first column (None without rows) and all batches."""
    batches = iter(batches)
    first = next(batches, None)
    return (None, batches) if first is None else (first.schema.field(0).type, (b for part in ([first], batches) for b in part))


def _parse_stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, stretch, ordinal, initial, fault), sorted, to (conv, stretch, before, after, cost, audit)."""
    type_, batches = _first(batches)
    schema = pa.schema([
        ("conv", type_ or pa.null()), ("stretch", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()),
        ("audit", pa.string()),
    ])
    table = stacks()

    def found():
        for (conv, stretch), rows in _runs(batches, 2):
            rows = [(initial, fault) for _, _, _, initial, fault in rows]
            for before in table.live if stretch else table.live[:1]:
                for after, (cost, audit) in parse(table, {before: (0, "")}, rows).items():
                    yield conv, stretch, before, after, cost, audit

    yield from _out(found(), schema)


def _lines(pieces: list[str], size: int, system: bool) -> Iterator[tuple[int, str, str, str, int]]:
    """(ordinal, action, role initial, inserted initials, repaired rows before) of every row, and of the end if rows are inserted there."""
    emitted = begin = ordinal = 0
    inserted = ""
    for number, piece in enumerate(pieces):
        ordinal = number * size
        for c in piece:
            role = "" if c == "D" else "s" if system and not emitted else "ua"[(emitted - system) % 2]
            emitted += bool(role)
            if c == "I":
                inserted += role
                continue
            yield ordinal, c, role, inserted, begin
            ordinal, inserted, begin = ordinal + 1, "", emitted
    if inserted:
        yield ordinal, "", "", inserted, begin


def _fold(size: int):
    """Stretches of conversations, sorted, to one row with cost and audit (ordinal -1) and one decision a row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_, batches = _first(batches)
        schema = pa.schema([
            ("conv", type_ or pa.null()), ("ordinal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("role", pa.string()),
            ("inserted", pa.string()), ("before", pa.int64()),
        ])
        table = stacks()

        def found():
            for (conv,), rows in _runs(batches, 1):
                front: dict[int, tuple] = {0: (0, ())}  # stack: (cost, audit of each stretch)
                new: dict[int, tuple] = {}
                at = rows[0][1]
                for _, stretch, before, after, cost, audit in rows:
                    if stretch != at:
                        at, front, new = stretch, new, {}
                    if before in front:
                        _better(new, after, (front[before][0] + cost, (*front[before][1], audit)))
                ends = []
                for node, (cost, pieces) in new.items():
                    for n, (c, tail) in _inserted(table, {node: (0, "")}).items():
                        if n in table.accepted:
                            ends.append((cost + c, (*pieces[:-1], pieces[-1] + tail), "s" in table.spelled(n)))
                cost, pieces, system = min(ends)
                yield conv, -1, cost, "".join(pieces), "", "", 0
                for ordinal, action, role, inserted, before in _lines(pieces, size, system):
                    yield conv, ordinal, 0, action, role, inserted, before

        yield from _out(found(), schema)

    return run


# -- the operator -------------------------------------------------------------------------------


class Repair(NamedTuple):
    """``conversations``: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for each that has rows;
    ``rows``: the repaired rows (conv, turn, role, text), turns from 0."""

    conversations: DataFrame
    rows: DataFrame


def faults(text: Column) -> tuple[Column, Column]:
    """(blank, truncated): no character but white space; the last such one does not end a sentence."""
    solid = F.rtrim(text, F.lit(SPACE))
    return F.length(solid) == 0, ~F.right(solid, F.lit(1)).isin(".", "!", "?")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", stretch: int = STRETCH) -> Repair:
    """Repair all conversations of ``rows``.

    A NULL role or text counts as one space (a row without text is blank); NULL conversation ids are one
    conversation; NULL turns come first and count for no gap. Rows equal in all columns are repeated
    rows: all but the first are duplicates. An empty role has no initial and cannot be kept. An empty table
    gives empty results. Other columns are left out, whatever their names.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    base = rows.select(F.struct(F.col(conv).alias("id")).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"))
    blank, truncated = faults(F.col("text"))
    base = base.select(
        "*", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), truncated.alias("cut"),
        F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), "text", "role").alias("h2"),
        F.monotonically_increasing_id().alias("row"),  # splits the many copies of one row over slices
    )
    placed = ordered_neighbours(
        base, ["conv"], ["turn", "role", "h1", "row"], lag={"last_turn": "turn", "last_initial": "initial"}, count_before="ordinal",
    )

    firsts = placed.groupBy("conv", "h1", "h2").agg(F.min("ordinal").alias("first"))
    narrow = placed.select("conv", "ordinal", "turn", "last_turn", "initial", "last_initial", "blank", "cut", "h1", "h2").join(firsts, ["conv", "h1", "h2"])
    kind = F.when(F.col("blank"), "blank").when(F.col("ordinal") > F.col("first"), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    faulty = narrow.withColumn("fault", kind)
    counts = faulty.groupBy("conv").agg(
        F.coalesce(
            F.max("turn") - F.min("turn") + 1 - F.count_if(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last_turn"))), F.lit(0)
        ).cast("bigint").alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count_if((F.col("ordinal") > 0) & ~F.concat("last_initial", "initial").isin("su", "ua", "au")).alias("illegal"),
    )
    id_type = base.schema["conv"].dataType["id"].dataType.simpleString()
    stretches = faulty.select(F.col("conv.id").alias("conv"), F.floor(F.col("ordinal") / stretch).alias("stretch"), "ordinal", "initial", "fault")
    parsed = stretches.repartition("conv", "stretch").sortWithinPartitions("conv", "stretch", "ordinal").mapInArrow(
        _parse_stretches, f"conv {id_type}, stretch bigint, before int, after int, cost bigint, audit string"
    )
    folded = store(parsed.repartition("conv").sortWithinPartitions("conv", "stretch").mapInArrow(
        _fold(stretch), f"conv {id_type}, ordinal bigint, cost bigint, audit string, role string, inserted string, before bigint"
    ), "repairs")

    keyed = folded.select(F.struct(F.col("conv").alias("id")).alias("conv"), *folded.columns[1:])
    conversations = counts.join(keyed.where("ordinal = -1").select("conv", "cost", "audit"), "conv").select(
        F.col("conv.id").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )
    made = lambda initial: F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[initial]
    new_rows = F.transform(F.split("inserted", ""), lambda c: F.struct(made(c).alias("role"), F.lit("").alias("text")))
    own = F.array(F.struct(F.when(F.col("action") == "K", F.col("own_role")).otherwise(made(F.col("new_role"))).alias("role"), F.col("text")))
    decided = keyed.where("ordinal >= 0").select("conv", "ordinal", F.col("audit").alias("action"), F.col("role").alias("new_role"), "inserted", "before")
    decided = decided.where("action <> 'D' OR inserted <> ''")
    texts = placed.select("conv", "ordinal", F.col("role").alias("own_role"), "text")
    joined = decided.join(texts, ["conv", "ordinal"], "left").select(
        "conv", "before",
        F.posexplode(F.concat(
            F.when(F.col("inserted") != "", new_rows).otherwise(F.array().cast("array<struct<role:string,text:string>>")),
            F.when(F.col("action").isin("K", "R"), own).otherwise(F.array().cast("array<struct<role:string,text:string>>")),
        )).alias("at", "line"),
    )
    repaired = joined.select(
        F.col("conv.id").alias(conv), (F.col("before") + F.col("at")).alias("turn"), F.col("line.role").alias("role"), F.col("line.text").alias("text")
    )
    return Repair(conversations, repaired)


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    type_, batches = _first(batches)
    schema = pa.schema([("conv", type_ or pa.null()), ("sha256", pa.string())])

    def found():
        conv, state = None, None
        for batch in batches:
            for id_, _, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or id_ != conv:
                    if state is not None:
                        yield conv, state.hexdigest()
                    conv, state = id_, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
        if state is not None:
            yield conv, state.hexdigest()

    yield from _out(found(), schema)


def digests(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, sha256) of the ``role:text`` lines of each repaired conversation.

    A digest is one chain over all of a conversation's text, so its rows stream through one task, sorted;
    only the state of the digest is held.
    """
    id_type = rows.schema[conv].dataType.simpleString()
    source = rows.select(F.col(conv).alias("conv"), "turn", "role", "text")
    return source.repartition("conv").sortWithinPartitions("conv", "turn").mapInArrow(_digest, f"conv {id_type}, sha256 string")
