"""Training-corpus pipeline: five stages over ``documents``, each one operator of ``revcurve.llm``.

Every stage takes all that its predecessor kept and returns the columns of ``documents``; the last
one adds the fitted rate and the number of the copy. :func:`run` writes each stage's result as
Parquet in the shared folder and reads it again as the next stage's input.

Nulls: a null text counts as empty everywhere; a null id has no label, sorts last among near
duplicates, and stays otherwise. Repeated rows are near duplicates of each other. Extra columns
go through unchanged (their names must not be those an operator adds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcurve.llm import decontaminate, line_templates, mixing, quality_cnn, simhash_variants
from revcurve.llm.common import drop_stored, remainder, store
from revcurve.llm.registry import MIX_TARGETS

KEEP_QUALITY = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches :data:`KEEP_QUALITY`."""
    model = quality_cnn.train(docs, _table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return docs.where(quality_cnn.score(model) >= KEEP_QUALITY)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; ``n_chars`` follows the text."""
    columns = [F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return line_templates.drop_recurring(docs).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (3-word shingles, at most 2 bits apart)."""
    return simhash_variants.keep_first(docs, words=3, max_bits=2)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says (its floor, one more by a hash draw), with ``mix_rate`` and ``copy``."""
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(_table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id")
    rated = mixing.mix(docs, labelled, MIX_TARGETS).withColumn("_copies", mixing.copies("mix_rate", "doc_id"))
    copy = F.explode(F.when(F.col("_copies") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    return rated.withColumn("copy", copy).select(*docs.columns, "mix_rate", "copy")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
]

# The stages learn a network and iterate, which SQL cannot express; they are tested in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``documents`` that the stages keep, in the last stage's columns."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            drop_stored(before)
        before = docs
    return docs
