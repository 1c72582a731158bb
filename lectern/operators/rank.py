"""Fusion of the retrieval legs: union, hydration, scores, collapse of neighbours, diversity, facets."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.operators import keyword, vector
from lectern.operators.joins import few, written

BOOST, PENALTY, FREE_HITS = 0.015, 0.006, 2
BANDS = (0.50, 0.57, 0.63, 0.69, 0.75)


def union_candidates(by_vector: DataFrame, by_keyword: DataFrame) -> DataFrame:
    """(query_id, chunk_id, vector_rank, keyword_rank), either rank null."""
    return by_vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank")).join(by_keyword.select("query_id", "chunk_id", F.col("rank").alias("keyword_rank")), ["query_id", "chunk_id"], "full_outer")


def hydrate_hits(candidates: DataFrame, chunks: DataFrame, docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates with passage, document and printed page labels; texts are joined only here, for the few candidates."""
    c = candidates.join(chunks, "chunk_id").join(docs.select("document_id", "title", "author"), "document_id")
    label = lambda side: pages.select("document_id", F.col("page").alias(f"page_{side}"), F.col("label").alias(f"label_{side}"))
    return c.join(label("start"), ["document_id", "page_start"], "left").join(label("end"), ["document_id", "page_end"], "left")


def score_hits(hits: DataFrame, boost: float = BOOST, mode: str = "hybrid") -> DataFrame:
    score = -F.coalesce("keyword_rank", F.lit(1_000_000_000)).cast("double") if mode == "keyword" else F.coalesce("similarity", F.lit(0.0)) + F.lit(boost) * F.coalesce("coverage", F.lit(0.0))
    return hits.withColumn("score", score)


def collapse_adjacent(hits: DataFrame) -> DataFrame:
    """Hits without those within one place of a better kept hit of the same document and query.

    Greedy in order of score, as a fold over each (query, document)'s own few candidates.
    """
    order = F.transform(F.sort_array(F.collect_list(F.struct(-F.col("score"), F.col("chunk_id"), F.col("ordinal").alias("ordinal")))), lambda x: x["ordinal"])
    kept = F.aggregate("o", F.array().cast("array<int>"), lambda acc, x: F.when(F.exists(acc, lambda k: F.abs(k - x) <= 1), acc).otherwise(F.concat(acc, F.array(x))))
    keep = hits.withColumn("ordinal", F.col("ordinal").cast("int")).groupBy("query_id", "document_id").agg(order.alias("o")).select("query_id", "document_id", F.explode(kept).alias("ordinal"))
    best = W.partitionBy("query_id", "document_id", "ordinal").orderBy(F.desc("score"), "chunk_id")
    return hits.join(keep, ["query_id", "document_id", "ordinal"], "left_semi").withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def diversify(hits: DataFrame, limit: int, penalty: float = PENALTY) -> DataFrame:
    """Where a query has more than ``limit`` hits, those of a document beyond its first three count less and less."""
    n = F.row_number().over(W.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "chunk_id")) - 1
    total = F.count("*").over(W.partitionBy("query_id"))
    less = F.when(total > limit, penalty * F.greatest(n - FREE_HITS, F.lit(0))).otherwise(0.0)
    return hits.withColumn("adjusted", F.col("score") - less)


def ranked(hits: DataFrame, limit: int, by: str = "adjusted") -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(by), F.desc("score"), "chunk_id"))
    return hits.withColumn("place", place).where(F.col("place") <= limit)


def relevance_band(similarity: Column) -> Column:
    """0 to 5: how many thresholds are reached."""
    return sum((similarity >= b).cast("int") for b in BANDS)


def via(vector_rank: Column, keyword_rank: Column) -> Column:
    return F.when(vector_rank.isNotNull() & keyword_rank.isNotNull(), "meaning + words").when(vector_rank.isNotNull(), "meaning").otherwise("words")


def hit_facets(hits: DataFrame) -> DataFrame:
    """(query_id, document_id, hits, documents): hits per document, and documents per query."""
    n = hits.groupBy("query_id", "document_id").agg(F.count("*").alias("hits"))
    return n.withColumn("documents", F.count("*").over(W.partitionBy("query_id")))


def keyword_leg(queries: DataFrame, chunks: DataFrame, scope: DataFrame | None = None, analyzer: str = "simple", postings: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The keyword leg's hits (query_id, chunk_id, rank), terms and matches.

    Postings are met once, at the queries' words; frequencies, hits and coverage come from these matches.
    """
    postings = keyword.build_postings(chunks, analyzer) if postings is None else postings
    kw = keyword.keyword_queries(queries)
    owners = chunks.select("chunk_id", "document_id")
    asked = written(keyword.query_terms(kw, analyzer))
    matches = written(keyword.matches_of(asked, postings))
    terms = written(keyword.informative_terms(asked, matches, chunks.agg(F.count("*").alias("n"))))
    hits = keyword.keyword_hits(terms, matches)
    if scope is not None:
        hits = hits.join(owners, "chunk_id").join(scope.select("query_id", "document_id"), ["query_id", "document_id"], "left_semi").drop("document_id")
    words = keyword.top_k(hits, keyword.CANDIDATES, F.desc("hits"), F.asc("chunk_id")).select("query_id", "chunk_id", "rank")
    if kw.where("mode = 'web'").limit(1).count():
        words = words.unionByName(keyword.cover_topk(kw, postings, keyword.CANDIDATES, scope, owners).select("query_id", "chunk_id", "rank"))
    return words, terms, matches


def hybrid_candidates(queries: DataFrame, chunks: DataFrame, mode: str = "hybrid", scope: DataFrame | None = None, analyzer: str = "simple", index: DataFrame | None = None,
                      postings: DataFrame | None = None, leg: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Candidates of both legs with similarity, coverage and ranks.

    An ``index`` (vector.graph_index) serves searches that have no scope; others are exact. A ``leg`` is the keyword_leg of the same search, found before. Without a usable vector on
    either side, similarity is null and counts as 0. queries (query_id, query, qvec); chunks (chunk_id, document_id, ordinal, text, embedding); scope (query_id, document_id).
    """
    none = "query_id long, chunk_id long, rank int"
    spark = queries.sparkSession
    found = spark.createDataFrame([], none) if mode == "keyword" else vector.knn_ann(queries.select("query_id", "qvec"), index) if index is not None and scope is None else vector.knn_exact(queries.select("query_id", "qvec"), chunks, scope=scope)
    if mode == "vector":
        c = union_candidates(found, spark.createDataFrame([], none)).withColumn("coverage", F.lit(0.0))
    else:
        words, terms, matches = leg or keyword_leg(queries, chunks, scope, analyzer, postings)
        web = keyword.keyword_queries(queries).where("mode = 'web'").select("query_id", F.lit(True).alias("web"))
        # both legs are found once; coverage is told of the candidates alone
        legs = written(union_candidates(found, words))
        c = legs.join(keyword.term_coverage(legs, terms, matches), ["query_id", "chunk_id"], "left").join(web, "query_id", "left")
        c = c.withColumn("coverage", F.when(F.col("web"), F.col("keyword_rank").isNotNull().cast("double")).otherwise(F.coalesce("coverage", F.lit(0.0)))).drop("web")
    c = c.join(chunks.select("chunk_id", "document_id", "ordinal", "embedding"), "chunk_id").join(queries.select("query_id", "qvec"), "query_id")
    return c.withColumn("similarity", F.round(vector.cosine(F.col("qvec"), F.col("embedding")), vector.DECIMALS)).drop("qvec", "embedding")


def requests(queries: DataFrame) -> DataFrame:
    """What hybrid_search asks of the ``queries``: their first 1000 characters, and nothing if these are blank."""
    return queries.withColumn("query", F.substring("query", 1, 1000)).where(F.trim("query") != "")


def hybrid_search(queries: DataFrame, chunks: DataFrame, mode: str = "hybrid", scope: DataFrame | None = None, limit: int = 20, boost: float = BOOST, collapse: bool = True,
                  spread: bool | None = None, analyzer: str = "simple", index: DataFrame | None = None, postings: DataFrame | None = None, leg: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, chunk_id, document_id, similarity, coverage, ranks, score, place) for all queries in one job.

    ``limit`` is clamped to 1..50, queries are cut at 1000 characters, empty ones have no hits; results are spread over documents unless scoped.
    """
    limit = max(1, min(50, limit))
    q = requests(queries)
    hits = score_hits(hybrid_candidates(q, chunks, mode, scope, analyzer, index, postings, leg), boost, mode)
    if collapse:
        hits = collapse_adjacent(hits)
    hits = diversify(hits, limit) if (scope is None if spread is None else spread) else hits.withColumn("adjusted", F.col("score"))
    return ranked(hits, limit)


def search_modes(queries: DataFrame, chunks: DataFrame, modes: tuple[str, ...] = ("vector", "keyword", "hybrid"), limit: int = 20, boost: float = BOOST, analyzer: str = "simple", postings: DataFrame | None = None) -> DataFrame:
    """The hits of hybrid_search in each of the modes (variant), for whole queries: the cut of a request is none of an evaluation.

    The legs of the other modes are those of the hybrid one, so candidates are found once and written.
    """
    limit = max(1, min(50, limit))
    q = queries.where(F.trim("query") != "")
    c = written(hybrid_candidates(q, chunks, "hybrid", None, analyzer, None, postings))
    of = {"vector": c.where("vector_rank is not null").withColumn("coverage", F.lit(0.0)), "keyword": c.where("keyword_rank is not null"), "hybrid": c}
    found = [ranked(diversify(collapse_adjacent(score_hits(of[m], boost, m)), limit), limit).withColumn("variant", F.lit(m)) for m in modes]
    return functools.reduce(DataFrame.unionByName, found)
