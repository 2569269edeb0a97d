"""Shared helpers: stored tables, label splits and vectorised access to Arrow text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revcurve.plans.session import ensure_checkpoint_dir

CHUNK_BYTES = 1 << 20


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back (cuts the lineage)."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by :func:`store`; only once nothing reads it any more."""
    delete_folder(df.sparkSession, df.stored_path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`new_folder` through Hadoop's file system."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hp, True)


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast a bounded value by value; tasks read it with :func:`shared`."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(sent: Broadcast) -> object:
    """The value of :func:`share`, inside a task."""
    return cloudpickle.loads(sent.value)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the column's text, modulo ``modulus``; a null column counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def text_of(column: str = "text") -> Column:
    """The column as text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def labelled_sample(labels: DataFrame, label: str, train: Column, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``per_class`` ids of each label value 0 / 1, the first by a hash of the id.

    Rows with a null id or label take no part; an id labelled twice counts with its larger
    label. The result has at most ``2 * per_class`` rows whatever the input.
    """
    rows = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & train)
        .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    parts = [
        rows.where(F.col("y") == y).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(per_class)
        for y in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow text column, nulls as empty; offsets index into bytes."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(arr: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``max_bytes``: (first, end, bytes, offsets).

    A row is never cut; one longer than ``max_bytes`` is a run of its own.
    """
    data, offsets = string_buffers(arr)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ``breaks``) of all rows of a run: (start, end, row). A word never crosses a row's end."""
    n = len(data)
    solid = ~breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.zeros(n, bool)
    if n:
        after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


_RNG = np.random.default_rng(20240611)
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (spans must not overlap), the same in every process."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total) - np.repeat(first, lengths)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()) - 1, _BASE, np.uint64)]), dtype=np.uint64)
    picked = data[np.repeat(starts - first, lengths) + np.arange(total)]
    sums = np.add.reduceat(BYTE_CODE[picked] * powers[within], first)
    return mix64(sums ^ lengths.astype(np.uint64))


class LookupTable:
    """Open-addressing table from uint64 keys to row numbers, probed for whole arrays."""

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys, np.uint64)
        size = 1 << max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.slots = np.full(size, -1, np.int32)
        self.keys = keys
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several keys for one slot the last stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that are not in the table (a sparse bitmap; few others are True)."""
        if not hasattr(self, "sparse"):
            self.sparse_shift = np.uint64(max(0, 64 - max(16, (len(self.keys) * 64).bit_length())))
            self.sparse = np.zeros(1 << (64 - int(self.sparse_shift)), bool)
            self.sparse[self.keys >> self.sparse_shift] = True
        return self.sparse[keys >> self.sparse_shift]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 where the key is not in the table."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        at = self._home(keys)
        row = self.slots[at]
        hit = (row >= 0) & (self.keys[row] == keys)
        out[hit] = row[hit]
        left = np.flatnonzero((row >= 0) & ~hit)
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            row = self.slots[at]
            hit = (row >= 0) & (self.keys[row] == keys[left])
            out[left[hit]] = row[hit]
            go = (row >= 0) & ~hit
            left, at = left[go], at[go]
        return out
