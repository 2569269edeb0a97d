"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes by learned rotations (iterative quantisation: :data:`ROTATIONS`
independent rotations, each fitted on a bounded sample to put sample vectors close to the corners
of the cube). A code is cut into substrings of 16 bits. Two codes within Hamming radius r share at
least one substring within r // m bits (pigeonhole over m substrings), so probing all substring
values within that distance in every substring table retrieves every code within r; the Hamming
distance is then checked and the survivors are ranked by inner products of the original vectors
in double precision.

The radius is not guessed: for a bounded set of calibration queries the exact nearest vectors
among all rows are found, and r is the Hamming distance that covers the share ``target_recall`` of
them. When the radius is so wide that the probes would touch most of a table, the block's
codes are compared directly, which gives the same codes. Queries that find fewer than k rows within
the radius (all rows when there are fewer) are asked again with a wider one, at last with all bits, so every query gets its k rows.

Inner products are searched as angles: vectors are scaled by the largest norm and extended
by the component that brings them to the unit sphere (queries get zero there).

Work: candidates and queries are dealt to a grid of (candidate block, query block) cells of
bounded size, so no task holds more than ``block_rows`` candidates and ``query_rows`` queries; each cell
keeps k rows per query, and a second aggregate keeps the k best over the cells.

Defined results: null vectors and those that are zero or hold null or non-finite components take
no part, nor do vectors whose length is not the most frequent one (ties: the longer). A query never finds its own row;
other rows with the same id or vector count. Ties go to the smaller id. Fewer than k candidates
give fewer rows; an empty table gives none. Rows with a null id take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revcurve.llm.common import share, shared, store

ROTATIONS = 4
SUBSTRING = 16
OUT = "query_id bigint, vec_id bigint, score double"


class Codes:
    """Learned rotations: original vectors to packed binary codes."""

    def __init__(self, sample: np.ndarray, norm: float, rounds: int = 25, seed: int = 11):
        self.norm = norm
        x = self._extended(sample)
        self.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        rng = np.random.default_rng(seed)
        self.rotations = []
        for _ in range(ROTATIONS):
            r = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
            for _ in range(rounds if len(x) else 0):  # nearest corners, then the rotation nearest to them
                u, _, v = np.linalg.svd(np.sign((x - self.mean) @ r).T @ (x - self.mean))
                r = (u @ v).T
            self.rotations.append(r)
        self.bits = -(-x.shape[1] * ROTATIONS // 64) * 64

    def _extended(self, x: np.ndarray) -> np.ndarray:
        scaled = x / self.norm
        rest = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))
        return np.column_stack([scaled, rest])

    def encode(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Packed codes (rows, bits / 64) as uint64."""
        e = np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))]) if query else self._extended(x)
        bits = np.concatenate([(e - self.mean) @ r > 0 for r in self.rotations], 1)
        bits = np.pad(bits, ((0, 0), (0, self.bits - bits.shape[1])))
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _near_values(distance: int) -> np.ndarray:
    """All substring masks of at most ``distance`` bits."""
    values = np.arange(1 << SUBSTRING, dtype=np.uint32)
    return values[np.bitwise_count(values) <= distance].astype(np.uint16)


class Block:
    """Substring tables over the codes of one candidate block."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, self.radius = codes, radius
        self.parts = codes.view(np.uint16).reshape(len(codes), -1)
        m = self.parts.shape[1]
        self.masks = _near_values(min(SUBSTRING, radius // m))
        self.wide = m * len(self.masks) * 8 > len(codes)  # probing would cost more than comparing all codes
        self.tables = []
        if not self.wide:
            for s in range(m):
                order = np.argsort(self.parts[:, s], kind="stable")
                starts = np.searchsorted(self.parts[order, s], np.arange((1 << SUBSTRING) + 1))
                self.tables.append((order, starts))

    def within(self, query: np.ndarray) -> np.ndarray:
        """Rows whose code is within the radius of the query's code."""
        rows = None
        if not self.wide:
            found = []
            values = query.view(np.uint16)
            for s, (order, starts) in enumerate(self.tables):
                probe = (self.masks ^ values[s]).astype(np.int64)
                lo, hi = starts[probe], starts[probe + 1]
                full = hi > lo
                found += [order[a:b] for a, b in zip(lo[full].tolist(), hi[full].tolist(), strict=True)]
            rows = np.unique(np.concatenate(found)) if found else np.zeros(0, int)
        codes = self.codes if rows is None else self.codes[rows]
        near = np.flatnonzero(np.bitwise_count(codes ^ query).sum(1, dtype=np.int32) <= self.radius)
        return near if rows is None else rows[near]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _best(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best per query: largest score, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query_ids))
    q = query_ids[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """((id, v, row) of the rows that take part, their length); ``row`` tells rows apart."""
    v = F.col(vec_col).cast("array<double>")
    rows = df.where(F.col(id_col).isNotNull() & v.isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    dim = sizes["n"] if sizes else 0
    return rows.where(F.size("v") == dim).withColumn("row", F.monotonically_increasing_id()), dim


def search(
    df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", target_recall: float = 0.97,
    sample_rows: int = 4000, calibration: int = 64, block_rows: int = 20000, query_rows: int = 2000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row where ``queries`` holds (on column ``id``).

    ``sample_rows`` bounds the rows the rotations are learned on, ``calibration`` the queries the
    radius is measured with (against all rows); both are the first by a hash of the id.
    """
    spark = df.sparkSession
    found, dim = vectors(df, id_col, vec_col)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not dim:
        return empty
    rows = store(found, "ann-vectors")
    by_hash = [F.xxhash64("id"), "id", "row"]
    norm = math.sqrt(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0])
    sample = np.array([r["v"] for r in rows.orderBy(*by_hash).limit(sample_rows).collect()])
    codes = Codes(sample, norm)
    wanted = rows.where(queries)
    total, asked = rows.count(), wanted.count()
    if not asked:
        return empty
    probes = wanted.orderBy(*by_hash).limit(calibration).collect()
    radius = _radius(rows, codes, np.array([p["v"] for p in probes]), np.array([p["row"] for p in probes]), k, target_recall, dim)

    n_blocks = -(-total // block_rows)
    spread = lambda n: F.pmod(F.xxhash64("id", "row", F.lit(3)), F.lit(n)).cast("int")

    def within(radius: int, left: DataFrame, n_left: int) -> DataFrame:
        """(query_row, rank, vec_id, score): the k best within the radius for the queries in ``left``."""
        q_blocks = -(-n_left // query_rows)
        candidates = rows.select("id", "row", "v", spread(n_blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("part"), F.lit(False).alias("asks"))
        asking = left.select("id", "row", "v", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), spread(q_blocks).alias("part"), F.lit(True).alias("asks"))
        sent = share(spark, (codes, radius))

        def cell(table: pa.Table) -> pa.Table:
            codes, radius = shared(sent)
            asks = table["asks"].combine_chunks().to_numpy(zero_copy_only=False)
            ids, row = table["id"].to_numpy(), table["row"].to_numpy()
            x = _matrix(table["v"].combine_chunks(), dim)
            c, q = np.flatnonzero(~asks), np.flatnonzero(asks)
            out_q, out_i, out_s = [], [], []
            if len(c) and len(q):
                block = Block(codes.encode(x[c]), radius)
                for at, code in zip(q, codes.encode(x[q], True), strict=True):
                    near = c[block.within(code)]
                    near = near[row[near] != row[at]]
                    score = np.einsum("ij,ij->i", x[near], np.broadcast_to(x[at], (len(near), dim)))
                    best = _best(np.zeros(len(near), int), ids[near], score, k)
                    out_q.append(np.full(len(best), row[at]))
                    out_i.append(ids[near[best]])
                    out_s.append(score[best])
            cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            return pa.table({"query_row": cat(out_q, np.int64), "vec_id": cat(out_i, np.int64), "score": cat(out_s, float)})

        cells = candidates.unionByName(asking).groupBy("block", "part").applyInArrow(cell, "query_row bigint, vec_id bigint, score double")
        # at most k rows per query and cell
        rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
        return store(cells.withColumn("rank", rank).where(F.col("rank") <= k), "ann-found")

    wanted_rows = min(k, total - 1)
    left, n_left, step, parts = wanted, asked, max(1, codes.bits // 32), []
    while n_left and wanted_rows:
        top = within(radius, left, n_left)
        full = top.where(F.col("rank") == wanted_rows).select("query_row")
        parts.append(top.join(full, "query_row", "left_semi"))
        left = store(left.join(full, left["row"] == full["query_row"], "left_anti"), "ann-left")
        n_left, radius, step = left.count(), min(codes.bits, radius + step), 2 * step  # all bits reach every row
    if not parts:
        return empty
    names = wanted.select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    return reduce(DataFrame.unionByName, parts).join(names, "query_row").select("query_id", "rank", "vec_id", "score")


def _radius(rows: DataFrame, codes: Codes, probes: np.ndarray, own: np.ndarray, k: int, target: float, dim: int) -> int:
    """Hamming distance that covers ``target`` of the probes' exact k nearest among all rows."""
    probe_codes = codes.encode(probes, True)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, row = _matrix(b.column("v"), dim), b.column("row").to_numpy()
            if not len(x):
                continue
            scores = probes @ x.T
            scores[row[None, :] == own[:, None]] = -np.inf
            bits = codes.encode(x)
            take = min(k, len(x))
            top = np.argpartition(-scores, take - 1, axis=1)[:, :take]
            probe = np.repeat(np.arange(len(probes)), take)
            top = top.reshape(-1)
            apart = np.bitwise_count(bits[top] ^ probe_codes[probe]).sum(1, dtype=np.int32)
            real = np.isfinite(scores[probe, top])
            yield pa.RecordBatch.from_arrays(
                [pa.array(probe[real].astype(np.int32)), pa.array(scores[probe, top][real]), pa.array(apart[real])], ["probe", "score", "apart"]
            )

    found = rows.select("row", "v").mapInArrow(nearest, "probe int, score double, apart int")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score")))
    got = [r["apart"] for r in found.withColumn("rank", rank).where(F.col("rank") <= k).select("apart").collect()]
    return int(np.quantile(got, target, method="higher")) if got else codes.bits
