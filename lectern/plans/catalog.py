"""All queries over the driver's tables, one or more for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.operators import keyword, rank
from lectern.plans import adapters, q_context, q_library, q_retrieval, q_structure

MODULES = (q_library, q_structure, q_retrieval, q_context)
QUERIES = {name: f for m in MODULES for name, f in m.Q.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.O.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten passages for each benchmark query by its informative terms, with their documents."""
    chunks, postings, _, terms = q_retrieval.keyword_parts(spark, sf_dir)
    top = keyword.keyword_topk(terms, postings, 10)
    hits = rank.hydrate_hits(top, chunks, adapters.library(spark, sf_dir), adapters.pages(spark, sf_dir).drop("text"))
    return hits.select("query_id", "rank", "chunk_id", "document_id", "title", "author", "page_start", "label_start", "hits", "score", "text")
