"""The training-data pipeline: stages over documents, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgspark.llm.common import cut, read_table
from msgspark.llm.decontaminate import clean_documents
from msgspark.llm.packing import pack, token_pieces
from msgspark.llm.queries import word_bpe
from msgspark.llm.secrets import redact
from msgspark.llm.simhash import one_of_each_group
from msgspark.llm.toxicity import fit, scored_rows

THRESHOLD = 0.3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under THRESHOLD stay; the grammar is fitted on these documents' labels. Null and empty texts score low and stay; repeated rows share their fate; other columns pass unchanged."""
    grammar = fit(docs, read_table(spark, sf_dir, "labels"))
    return scored_rows(docs, grammar).where(F.col("value") < THRESHOLD).select("row.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least doc_id. Null texts and texts without words are one group; of repeated rows one stays; other columns pass unchanged."""
    return one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go. Null and empty texts stay; repeated rows share their fate; other columns pass unchanged."""
    return clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, with n_chars, where there is such a column, of its new text. Null texts stay null; other columns pass unchanged."""
    masked = redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens. Null and empty texts are the end mark alone; repeated rows are packed each; only doc_id and text are read."""
    return pack(token_pieces(docs, word_bpe()))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_dedup", simhash_stage),
    ("decontamination", decontamination_stage),
    ("secret_masking", secrets_stage),
    ("packing", packing_stage),
]

#: The stages use learned weights, fingerprints and a tokenizer, which SQL has not; tests/llm/test_pipeline.py compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
