"""SimHash near-duplicates by deletion-variant signatures.

A text's 64-bit SimHash is taken over its word shingles (lower-cased, 3 words by default). To
find all pairs within 2 differing bits, a fingerprint is cut into 2 segments of 32 bits: of two
fingerprints at most 2 bits apart, one segment differs by at most one bit. Each segment is
indexed by its one-wildcard variants (one bit masked out); fingerprints that share a variant and
hold different bits at the wildcard differ there by exactly that bit, and are verified on the
other segment. Fingerprints with an equal segment meet under the segment itself and are verified
likewise. A variant held by more than :data:`HEAVY` fingerprints is cut once more by parts of
the other segment, one of which must be equal (differences left: 1 of 2 parts, or 2 of 3), so
that large families of near copies are not paired in full.

Equal fingerprints are one node, whatever the number of documents behind it, so a group of
copies costs one row. Links become components by repeated minimum-label rounds over stored
tables (:mod:`revcurve.llm.components`); no text, fingerprint list or link set reaches the driver.

Defined results: null text reads as empty; a text without words has fingerprint zero, which links
like any other; fewer words than a shingle make one shingle of all of them. Repeated rows give
repeated results. Rows with a null id get a component but never name one; a component of
null ids only is null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcurve.llm.common import IS_SPACE, LOWER, chunks, drop_stored, store, text_of, word_spans
from revcurve.llm.components import connected_components

SEED = 42
HEAVY = 64
_LOW32 = (1 << 32) - 1


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every shingle, shingles per row) of a run of texts."""
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets)
    n_rows = len(offsets) - 1
    per_row = np.bincount(rows, minlength=n_rows)
    lengths = ends - starts
    joined = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    solid = low[~IS_SPACE[low]]
    joined[np.arange(len(solid)) + np.repeat(np.arange(len(lengths)), lengths)] = solid
    first = np.cumsum(lengths + 1) - (lengths + 1)
    last = first + lengths
    counts = np.where(per_row == 0, 0, np.maximum(1, per_row - words + 1))
    row_word = np.cumsum(per_row) - per_row
    at = np.repeat(row_word - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    to = np.minimum(at + words, np.repeat(row_word + per_row, counts)) - 1
    buf, digest = joined.tobytes(), xxhash.xxh64_intdigest
    got = [digest(buf[a:b], SEED) for a, b in zip(first[at].tolist(), last[to].tolist(), strict=True)]
    return np.array(got, np.uint64), counts


def fingerprints(texts: pa.Array, words: int = 3) -> np.ndarray:
    """SimHash of every text as uint64."""
    out = np.zeros(len(texts), np.uint64)
    for lo, hi, data, offsets in chunks(texts, 1 << 19):
        hashes, counts = shingle_hashes(data, offsets, words)
        full = np.flatnonzero(counts)
        if not len(full):
            continue
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.int64)
        on = (2 * votes > counts[full][:, None]).astype(np.uint8)
        out[lo + full] = np.packbits(on, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprint(text_col: str = "text", words: int = 3) -> Column:
    """Column of the 64-bit SimHash (as a signed long) of the whole text."""

    @F.arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield pa.array(fingerprints(arr, words).view(np.int64), pa.int64())

    return simhash(text_of(text_col))


def _variants(fps: DataFrame) -> DataFrame:
    """(key, side, fp): the 2 segments of each fingerprint and their 32 one-wildcard variants each.

    ``key`` packs which segment, which wildcard (32: none) and the masked segment; ``side`` is
    the bit at the wildcard (null: none).
    """
    seg = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(_LOW32))]
    cells = []
    for s in (0, 1):
        cells.append(F.struct((F.lit((s * 64 + 32) << 32) + seg[s]).alias("key"), F.lit(None).cast("int").alias("side")))
        for p in range(32):
            cells.append(F.struct(
                (F.lit((s * 64 + p) << 32) + seg[s].bitwiseAND(F.lit(_LOW32 ^ (1 << p)))).alias("key"),
                F.shiftright(seg[s], p).bitwiseAND(F.lit(1)).cast("int").alias("side"),
            ))
    # one narrow row becomes 66: spread the few files of a small table over all tasks first
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    return spread.select("fp", F.explode(F.array(*cells)).alias("v")).select("v.key", "v.side", "fp")


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Distinct pairs (a < b as signed longs) of the distinct fingerprints ``fp`` at most 2 bits apart."""
    if not 0 <= max_bits <= 2:
        raise ValueError("two segments with one wildcard reach 2 bits")
    shared = store(
        _variants(fps).groupBy("key").agg(F.count("*").alias("n"), F.sum("side").alias("ones"))
        .where((F.col("n") > 1) & (F.col("ones").isNull() | ((F.col("ones") > 0) & (F.col("ones") < F.col("n")))))
        .select("key", (F.col("n") > HEAVY).alias("heavy")),
        "simhash-keys",
    )
    held = _variants(fps).join(shared, "key")
    # which part of the other segment a heavy variant is cut by: 2 parts (wildcard) or 3 (none)
    other = F.when(F.shiftright("key", 38) == 0, F.col("fp").bitwiseAND(F.lit(_LOW32))).otherwise(F.shiftrightunsigned("fp", 32))
    part = lambda n, lo, bits: F.struct(F.lit(n).alias("part"), F.shiftright(other, lo).bitwiseAND(F.lit((1 << bits) - 1)).alias("value"))
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("value")))
    cut = (
        F.when(~F.col("heavy"), whole)
        .when(F.col("side").isNull(), F.array(part(1, 0, 11), part(2, 11, 11), part(3, 22, 10)))
        .otherwise(F.array(part(4, 0, 16), part(5, 16, 16)))
    )
    rows = store(
        held.withColumn("cut", F.explode(cut)).select("key", "side", "fp", "cut.part", "cut.value"), "simhash-variants"
    )
    x, y = rows.alias("x"), rows.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "part", "value")]
    meet = ((F.col("x.side") == 0) & (F.col("y.side") == 1)) | (
        F.col("x.side").isNull() & F.col("y.side").isNull() & (F.col("x.fp") < F.col("y.fp"))
    )
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits
    found = x.join(y, same[0] & same[1] & same[2] & meet & near).select(
        F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")
    )
    out = store(found.distinct(), "simhash-links")
    for t in (shared, rows):
        drop_stored(t)
    return out


def groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, row_hash, copies, fp, component): one row per different input row.

    ``row_hash`` is a hash of all columns (it tells rows of one id apart), ``copies`` how many
    equal rows there are, ``component`` the smallest id of the row's group.
    """
    marked = docs.select(F.col(id_col).alias("id"), F.xxhash64(*docs.columns).alias("row_hash"), fingerprint(text_col, words).alias("fp"))
    rows = store(marked.groupBy("id", "row_hash", "fp").agg(F.count("*").alias("copies")), "simhash-rows")
    nodes = store(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    near = links(nodes.select("fp"), max_bits)
    roots = connected_components(near).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    of = store(named.join(least, "root").select("fp", "root", "component"), "simhash-components")
    drop_stored(near)
    return rows.join(of, "fp")


def keep_first(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id (nulls last)."""
    found = groups(docs, text_col, id_col, words, max_bits)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row_hash"), F.col("copies")))
    kept = found.groupBy("root").agg(first.alias("k")).select(
        F.col("k.id").alias("_id"), F.col("k.row_hash").alias("_hash"), (F.col("k.copies") > 1).alias("_again")
    )
    marked = docs.withColumn("_hash", F.xxhash64(*docs.columns))
    same = marked[id_col].eqNullSafe(kept["_id"]) & (marked["_hash"] == kept["_hash"])
    rows = marked.join(kept, same).select(*[marked[c] for c in docs.columns], kept["_hash"], kept["_again"])
    once = rows.where(~F.col("_again"))
    again = rows.where("_again").dropDuplicates([id_col, "_hash"])
    return once.unionByName(again).drop("_hash", "_again")
