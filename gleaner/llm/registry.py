"""Queries of the training-data operators, each over its whole tables, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.chat import DIGEST_SQL, chat_digests, control_conversation, format_chats
from gleaner.llm.common import table
from gleaner.llm.embedding_dedup import embedding_groups
from gleaner.llm.fill_in_middle import MIDDLE_SQL, fill_in_middle, restored
from gleaner.llm.license_scan import license_scan
from gleaner.llm.line_dedup import LINES_SQL, drop_repeated_lines
from gleaner.llm.mixing import mix_sizes
from gleaner.llm.pii import pii_report
from gleaner.llm.quality_classifier import quality_scores
from gleaner.llm.quality_rules import quality_rules
from gleaner.llm.sentencepiece_nbest import decoded, encode_texts
from gleaner.llm.simhash import simhash_groups
from gleaner.llm.spelling import EVERY, SPELLING_SQL, spelling_groups
from gleaner.llm.url_filter import url_filter


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded documents; round_trip tells that a document's ids decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")
    encoded = encode_texts(docs)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "score", "ids", "nbest", (F.sha2(decoded(spark), 256) == F.col("digest")).alias("round_trip"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(format_chats(turns.unionByName(control_conversation(spark))))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"), every=EVERY)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_simhash_near_dedup, op3_quality_rules, op4_embedding_near_dedup, op5_sentencepiece, op6_source_mixing, op7_pii, op8_chat_formatting, op9_url_filter, op10_license_scan, op11_line_dedup, op12_spelling_variants, op13_fill_in_middle)}

#: All pairs: for the small tables only.
EMBEDDING_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reached AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), named AS (SELECT vec_id, least(vec_id, coalesce(min(b), vec_id)) AS component_id FROM embeddings LEFT JOIN reached ON a = vec_id GROUP BY vec_id),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM named LEFT JOIN counted ON a = vec_id
"""

ORACLES: dict[str, str] = {"op4_embedding_near_dedup": EMBEDDING_SQL, "op8_chat_formatting": DIGEST_SQL, "op11_line_dedup": LINES_SQL, "op12_spelling_variants": SPELLING_SQL, "op13_fill_in_middle": MIDDLE_SQL}
