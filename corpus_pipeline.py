"""The corpus pipeline: quality, near-duplicates, personal data, mixing and tokenization, one stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.common import cut, table
from gleaner.llm.mixing import mixed_documents
from gleaner.llm.pii import masked_documents
from gleaner.llm.quality_classifier import good_documents
from gleaner.llm.sentencepiece_nbest import encode_texts
from gleaner.llm.shingle_dedup import one_of_each_shingle_group


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the table labels, rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, Jaccard 0.8) one document stays, that with the smallest doc_id."""
    return one_of_each_shingle_group(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data gives way to its kind in brackets."""
    return masked_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each reading of a document by the mix, cut to the words that it takes."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids, score and N best segmentations in place of the text."""
    return encode_texts(docs)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_copy), ("personal_data", mask_personal_data), ("mixing", mix_sources), ("sentencepiece", encode)]

#: A fitted model, a piece lattice and fingerprints are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each stage's result is cut before the next one reads it, often more than once."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
