"""A training corpus from ``documents``: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.llm.byte_bpe import with_digests
from threadloom.llm.jaccard_join import keep_one
from threadloom.llm.language_id import fit_on_documents, identify
from threadloom.llm.mixing import mixed_documents
from threadloom.llm.pii import redact
from threadloom.session import stage_table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; those without letters or with a narrow margin go."""
    found = identify(docs, fit_on_documents(docs), lang_out="__lang", score_out="__score", rejected_out="__rejected")
    return found.where("not __rejected").select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    return keep_one(docs, width=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, such as <EMAIL>; ``n_chars`` follows the text."""
    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: none to three times."""
    return mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens and the digests of ids and decoded bytes."""
    return with_digests(docs)


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_near_copies),
    ("pii", without_personal_data),
    ("mixing", mixed_sources),
    ("byte_bpe", encoded),
]
# Compression, expectation-maximisation and BPE have no SQL: the stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
