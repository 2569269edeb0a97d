"""Queries of the subpackage: one per operator, over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcurve.llm import ann_mih, decontaminate, html_extract, line_templates, mixing, packing, ppm, prefix_trie, quality_cnn, simhash_variants, toxicity, turn_repair, warc_zip
from revcurve.llm.common import new_folder, remainder, store
from revcurve.operators.ranges import explode_range


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_ann_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return ann_mih.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and its exact edit distance."""
    return decontaminate.find(
        _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text")
    )


MIX_TARGETS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rates that bring the expected language shares to :data:`MIX_TARGETS`.

    The domains are languages; they are learned from the documents of the labelled table.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = _table(spark, sf_dir, "labels").select("doc_id").join(docs.select("doc_id", F.col("lang").alias("domain")), "doc_id")
    mixed = mixing.mix(docs.select("doc_id", "text"), labelled, MIX_TARGETS)
    return mixed.select(
        "doc_id", F.col("mix_tokens").alias("n_tokens"), *[F.col("mix_posterior")[d].alias(f"p_{d}") for d in MIX_TARGETS],
        F.col("mix_rate").alias("rate"), mixing.copies("mix_rate", "doc_id").alias("copies"),
    )


def op9_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, site templates removed."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select(
        "page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars")
    )


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels are learned where crc32(doc_id) mod 5 is not 0."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality_cnn.train(docs, labels, remainder("doc_id", 5) != 0)
    return docs.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), quality_cnn.score(model).alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs across documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_dropped")


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM and unigram log10 probabilities of every document; trained where crc32(doc_id) mod 7 is not 2."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trained = remainder("doc_id", 7) != 2
    model = ppm.train(docs, trained)
    return ppm.score(docs, model, trained=trained).select(
        "doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), F.col("lm_tokens").alias("n_tokens"), F.col("lm_known").alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), F.col("lm_base").alias("base_score"), F.col("lm_score").alias("score"),
    )


def op3_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document and the group it belongs to at 2 or fewer differing bits."""
    found = simhash_variants.groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return explode_range(found, F.lit(1), F.col("copies"), "copy").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page as a WARC record into ZIP packages, then reads the packages back."""
    folder = new_folder(spark, "warc")
    warc_zip.write(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    found = warc_zip.read(spark, folder, payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels are learned where crc32(doc_id) mod 3 is not 1."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels, remainder("doc_id", 3) != 1)
    return docs.select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), toxicity.score(lexicon).alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op11_spf_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    found = packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), 2048, 1)
    return found.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows damaged by crc32(``conv_id:turn``) mod 20: 0 drops a row, 1 empties its text, 2 takes its
    sentence ends, 3 repeats it, 4 makes its role user. A null column counts as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    kept = rows.where(hit != 0).select(
        "conv_id", "turn", F.when(hit == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
        F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return kept.drop("copy")


def op12_glr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, the cheapest repair and the digest of the repaired rows."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = turn_repair.repair(damaged(rows))
    key = F.struct("conv_id").alias("conv")
    whole = rows.select(key).distinct()
    found = fixed.conversations.select(key, *[c for c in fixed.conversations.columns if c != "conv_id"])
    hashed = turn_repair.digests(fixed.rows).select(F.struct(F.col("conv").alias("conv_id")).alias("conv"), "sha256")
    out = whole.join(found, "conv", "left").join(hashed, "conv", "left")
    return out.select(
        "conv.conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations whose first crc32(id) mod 4 turns are those of conversation id - id mod 20 (at most 3 each)."""
    share, base = F.crc32(F.col("conv").cast("string")) % 4, F.col("conv") - F.col("conv") % 20
    heads = turns.where((F.col("conv") % 20 == 0) & (F.col("place") < 3)).withColumnRenamed("conv", "base")
    held = heads.groupBy("base").agg(F.count(F.lit(1)).alias("held"))
    convs = turns.where("place = 0").select("conv", base.alias("base"), share.alias("share"))
    borrowed = convs.join(heads, "base").where(F.col("place") < F.col("share")).select(*turns.columns)
    own = turns.select("*", base.alias("base"), share.alias("share")).where(F.col("place") >= F.col("share")).join(held, "base", "left")
    place = F.least("share", F.coalesce("held", F.lit(0).cast("bigint"))) + F.col("place") - F.col("share")
    return borrowed.unionByName(own.withColumn("place", place).select(*turns.columns))


def op13_zfast_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = store(prefix_trie.symbols(rows), "conversation-turns")
    found = prefix_trie.nodes(rebuilt(turns), turns.where("place = 0").select("conv"))
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The operators' queries by name."""
    return {"op1_line_templates": op1_line_templates, "op2_ppm": op2_ppm, "op3_simhash_variants": op3_simhash_variants, "op4_warc_zip": op4_warc_zip, "op5_toxicity": op5_toxicity, "op6_ann_mih": op6_ann_mih, "op7_decontaminate": op7_decontaminate, "op8_soft_mixing": op8_soft_mixing, "op9_html_templates": op9_html_templates, "op10_quality_cnn": op10_quality_cnn, "op11_spf_packing": op11_spf_packing, "op12_glr_repair": op12_glr_repair, "op13_zfast_trie": op13_zfast_trie}


OP4_SQL = """
WITH rows AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, sha256(coalesce(html, '')) AS digest FROM pages
), firsts AS (
    SELECT digest, min(page_id) AS first FROM rows WHERE octet_length(payload) >= 100 GROUP BY digest
)
SELECT page_id, octet_length(payload) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to,
       true AS verified
FROM rows LEFT JOIN firsts USING (digest)
"""


OP1_SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents
), raw AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs
), lines AS (
    SELECT doc_id, pos, length(trim(raw)) - length(replace(trim(raw), ' ', '')) + 1 AS n,
           CASE WHEN regexp_matches(raw, '[0-9]') THEN regexp_replace(trim(raw), '\S*[0-9]\S*', '<*>', 'g') ELSE trim(raw) END AS masked
    FROM raw
), placed AS (
    SELECT *, array_to_string(string_split(masked, ' ')[1:3], ' ') AS opening FROM lines WHERE n >= 3 AND masked <> ''
), leaves AS (
    SELECT n, opening FROM placed GROUP BY n, opening HAVING count(DISTINCT doc_id) >= 3
), held AS (
    SELECT n, opening, masked, count(DISTINCT doc_id) AS docs FROM placed SEMI JOIN leaves USING (n, opening) GROUP BY n, opening, masked
), tokens AS (
    SELECT n, opening, masked, docs, unnest(string_split(masked, ' ')) AS token, generate_subscripts(string_split(masked, ' '), 1) AS place FROM held
), constant AS (
    SELECT n, opening, place, token FROM tokens GROUP BY n, opening, place, token HAVING sum(docs) >= 3
), templates AS (
    SELECT n, opening, masked, string_agg(place || ':' || token, ' ' ORDER BY place) AS template
    FROM tokens JOIN constant USING (n, opening, place, token) GROUP BY n, opening, masked HAVING count(*) >= 0.75 * n
), found AS (
    SELECT n, opening, template, doc_id, pos FROM placed JOIN templates USING (n, opening, masked)
), dropped AS (
    SELECT n, opening, template, min(doc_id) AS first FROM found GROUP BY n, opening, template HAVING count(DISTINCT doc_id) >= 3
), firsts AS (
    SELECT n, opening, template, doc_id, min(pos) AS pos
    FROM found JOIN dropped USING (n, opening, template) WHERE doc_id = first GROUP BY n, opening, template, doc_id
), gone AS (
    SELECT doc_id, pos FROM found SEMI JOIN dropped USING (n, opening, template)
    WHERE (doc_id, pos) NOT IN (SELECT (doc_id, pos) FROM firsts)
)
SELECT doc_id, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN raw END, chr(10) ORDER BY r.pos), '') AS text, count(g.pos) AS n_dropped
FROM raw r LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op1_line_templates": OP1_SQL, "op4_warc_zip": OP4_SQL}
