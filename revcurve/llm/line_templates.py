"""Line dedup with a log-template tree.

Lines are parsed like log messages: tokens that hold a digit become ``<*>``, then a tree of fixed
depth leads from the token count over the first ``depth`` tokens to a leaf. Within a leaf, a
token that stands at its place in lines of fewer than ``min_docs`` documents is a variable field and becomes
``<*>`` too; a template is what remains. Lines whose template keeps at least the share
``similarity`` of its tokens and occurs in at least ``min_docs`` documents are dropped,
except for the template's first line (smallest id, then place), so what a group of copies
says is kept once.

Everything is counted over all documents by distributed aggregates on 64-bit hashes; only lines
of leaves that enough documents share are shuffled as text (a bounded bitmap built from all such
leaves thins the lines beforehand; the join that follows is exact). A line that a third of
all documents hold adds one row per task to its counts; the joins that lead back to its places
can be split by AQE.

Defined results: null text reads as empty (no line is dropped); lines of fewer than
``min_tokens`` tokens are never dropped; a document all of whose lines go has an empty text;
rows that are equal in every column count as one document and get equal results; rows that
share an id but differ otherwise are different documents; a null id sorts last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcurve.llm.common import drop_stored, store, text_of

DEPTH = 3
MIN_DOCS = 3
MIN_TOKENS = 3
SIMILARITY = 0.75
BITMAP_BITS = 24


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(*docs.columns).alias("row"), text_of(text_col).alias("text"))


def _lines(keyed: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """(id, row, pos, masked, n, leaf, line): every line of enough tokens with its place in the tree."""
    split = keyed.select("id", "row", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    trimmed = split.select("id", "row", "pos", F.trim("raw").alias("raw"))
    masked = F.when(F.col("raw").rlike("[0-9]"), F.regexp_replace("raw", r"\S*[0-9]\S*", "<*>")).otherwise(F.col("raw"))
    n = F.length("raw") - F.length(F.replace("raw", F.lit(" "))) + 1
    return (
        trimmed.select("id", "row", "pos", masked.alias("masked"), n.alias("n")).where((F.col("n") >= min_tokens) & (F.col("masked") != ""))
        .withColumn("leaf", F.xxhash64("n", F.substring_index("masked", " ", depth)))
        .withColumn("line", F.xxhash64("n", "masked"))
    )


def _bitmap(leaves: DataFrame) -> np.ndarray:
    """Bits of all leaf hashes, gathered as at most 2 ** BITMAP_BITS / 64 words."""
    bucket = F.shiftrightunsigned("leaf", 64 - BITMAP_BITS)
    words = leaves.groupBy(F.shiftrightunsigned(bucket, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(leaf, {64 - BITMAP_BITS}) & 63 AS int))")).alias("bits")
    )
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out


def _maybe(bitmap: np.ndarray) -> Column:
    """False only for leaves that are not in the bitmap."""

    @F.arrow_udf("boolean")
    def maybe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            bucket = arr.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
            yield pa.array((bitmap[bucket >> np.uint64(6)].view(np.uint64) >> (bucket & np.uint64(63))) & np.uint64(1) == 1)

    return maybe("leaf")


def recurring(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", depth: int = DEPTH, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, row, drop): for each document with lines to drop, their places (from 0)."""
    keyed = _keyed(docs, text_col, id_col)
    places = store(_lines(keyed, depth, min_tokens).select("id", "row", "pos", "leaf", "line"), "lines")
    leaves = store(
        places.select("leaf", "id", "row").distinct().groupBy("leaf").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("leaf"),
        "leaves",
    )
    # the different lines of those leaves, with the number of documents that hold each
    held = places.join(leaves, "leaf", "left_semi").select("leaf", "line", "id", "row").distinct()
    counted = held.groupBy("leaf", "line").agg(F.count("*").alias("docs"))
    texts = (
        _lines(keyed, depth, min_tokens).select("leaf", "line", "n", "masked").where(_maybe(_bitmap(leaves)))
        .join(leaves, "leaf", "left_semi").groupBy("leaf", "line").agg(F.min("n").alias("n"), F.min("masked").alias("masked"))
    )
    tokens = store(
        texts.join(counted, ["leaf", "line"])
        .select("leaf", "line", "n", "docs", F.posexplode(F.split("masked", " ")).alias("at", "token"))
        .select("leaf", "line", "n", "docs", F.xxhash64("at", "token").alias("token")),
        "line-tokens",
    )
    constant = tokens.groupBy("leaf", "token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("leaf", "token")
    template = (
        tokens.join(constant, ["leaf", "token"]).groupBy("leaf", "line").agg(
            F.min("n").alias("n"), F.count("*").alias("kept"), F.bit_xor("token").alias("mix")
        )
        .where(F.col("kept") >= F.col("n") * similarity)
        .select("leaf", "line", F.xxhash64("leaf", "kept", "mix").alias("template"))
    )
    found = store(places.join(template, ["leaf", "line"]).select("template", "id", "row", "pos"), "template-places")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"), F.col("pos")))
    documents = found.groupBy("template", "id", "row").agg(F.min("pos").alias("pos"))
    dropped = documents.groupBy("template").agg(F.count("*").alias("docs"), first.alias("first")).where(F.col("docs") >= min_docs)
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row") == F.col("first.row")) & (F.col("pos") == F.col("first.pos"))
    out = store(
        found.join(dropped.select("template", "first"), "template").where(~is_first)
        .groupBy("id", "row").agg(F.collect_list("pos").alias("drop")),
        "line-drops",
    )
    for t in (places, leaves, tokens, found):
        drop_stored(t)
    return out


def _without(texts: pa.Array, drops: pa.Array) -> pa.Array:
    out = []
    for text, drop in zip(texts.to_pylist(), drops.to_pylist(), strict=True):
        if text is not None:
            gone = set(drop or ())
            text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)
        out.append(text)
    return pa.array(out, pa.string())


def drop_recurring(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **parameters) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text_col``, and ``n_dropped``, their number."""
    if "n_dropped" in docs.columns:
        raise ValueError("the input has a column named n_dropped; rename it")
    drops = recurring(docs, text_col, id_col, **parameters).select(F.col("id").alias("_id"), F.col("row").alias("_row"), F.col("drop").alias("_drop"))
    marked = docs.withColumn("_row2", F.xxhash64(*docs.columns))
    joined = marked.join(drops, marked[id_col].eqNullSafe(drops["_id"]) & (marked["_row2"] == drops["_row"]), "left")
    changed = F.arrow_udf(_without, "string")(F.when(F.col("_drop").isNotNull(), F.col(text_col)), F.col("_drop"))
    text = F.when(F.col("_drop").isNotNull(), changed).otherwise(F.col(text_col)).alias(text_col)
    columns = [text if c == text_col else marked[c] for c in docs.columns]
    return joined.select(*columns, F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("bigint").alias("n_dropped"))
