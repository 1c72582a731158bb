"""Approximate nearest neighbours by robust-pruned graphs over shards (operator 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm.common import read_table, written
from lectern.operators.graph_index import BEAM, SHARD_ROWS, build_graphs, search_graphs, usable

K = 10


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of each query's k nearest found by Euclidean distance.

    Both inputs are (vec_id, embedding). Equal vectors are one, with the k + 1 smallest of their ids, of which no answer
    needs more. A hash of the smallest id deals the distinct vectors to shards of bounded size, so that a
    cluster of any size is spread evenly; a task builds one shard's graph, and each block of queries is answered
    on each graph by beam search. Each query's best of all shards are merged, nearest first, ties to the smaller
    vec_id; distances are of the original components in double precision. Vectors that are null, empty, zero or hold
    null or non-finite components take no part, on either side; nor do null ids. Vectors meet only others of their width.
    Fewer than k candidates: all of them. A query's own id is no candidate. Rows that repeat an id hold the same vector.
    """
    good = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda c: c + F.lit(0.0)).alias("v"))
    asked = queries.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("v")).dropDuplicates(["query_id"])
    # ranks up to a bound are cut before the shuffle, so a vector with many copies costs a few rows a task
    least = good.withColumn("n", F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    distinct = written(least.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("key", F.get("ids", F.lit(0))))
    graphs = written(build_graphs(distinct.select("key", "v"), distinct.count(), shard_rows))
    # with one id that may be the query's own, k ids can't lie in more than k + 1 vectors
    found = search_graphs(graphs, asked, k + 1, beam).join(distinct.select("key", "ids"), "key")
    found = found.select("query_id", F.explode("ids").alias("vec_id"), F.col("distance").alias("score")).where("vec_id <> query_id").distinct()
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return nearest(e, e.where("vec_id % 100 = 0"))
