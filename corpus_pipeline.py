"""A cleaning pipeline over the documents table: five stages, each a call of one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import read_table, written
from lectern.llm.minhash import drop_near_duplicates
from lectern.llm.mixing import mix
from lectern.llm.packing import pack_documents
from lectern.llm.pii import redact
from lectern.llm.toxicity import drop_toxic

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents predicted to be toxic go."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels")).select(DOCUMENT_COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of documents linked by five-word shingles at similarity 0.8, the one with the smallest id stays."""
    return drop_near_duplicates(docs, size=5, percent=80).select(DOCUMENT_COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: personal data in each text give way to their kinds; n_chars follows."""
    return redact(docs).select(DOCUMENT_COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: each document appears as often as its source's rate tells; the rows of a repeated one are equal."""
    return mix(docs).select(DOCUMENT_COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: where each piece of each document lies in which bin."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL expresses neither the learned classifier nor whatever follows it; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
