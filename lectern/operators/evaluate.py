"""Evaluation: page accuracy of passages, retrieval quality, and a sweep of the keyword boost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import normalize_for_match
from lectern.operators import rank


def page_accuracy(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(chunk_id, reason): ok, missing, starts or ends elsewhere; a passage is sought in its pages and one on either side.

    Pages are joined by key (one row for each page wanted), normalised once, and put end to end once for all passages of the same pages, of which a page has many.
    """
    span = ["document_id", "page_start", "page_end"]
    wanted = chunks.select(*span).distinct().select(*span, F.explode(F.sequence(F.col("page_start") - 1, F.col("page_end") + 1)).alias("page"))
    texts = pages.select("document_id", "page", normalize_for_match(F.col("text")).alias("norm"))
    got = wanted.join(texts, ["document_id", "page"]).groupBy(*span).agg(F.sort_array(F.collect_list(F.struct("page", "norm"))).alias("p"))
    got = chunks.select("chunk_id", *span, normalize_for_match(F.col("text")).alias("norm")).join(got, span)
    whole = F.array_join(F.transform("p", lambda x: x["norm"]), " ")
    got = got.withColumn("whole", F.concat(F.lit(" "), whole, F.lit(" "))).withColumn("at", F.expr("instr(whole, concat(' ', norm, ' '))"))
    # offset of each page's end; instr counts from 1, and one space stands before the first page and between pages
    ends = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<struct<page: int, n: int>>)").alias("out")),
                       lambda a, x: F.struct((a["n"] + F.length(x["norm"]) + 1).alias("n"), F.concat(a["out"], F.array(F.struct(x["page"].cast("int").alias("page"), (a["n"] + F.length(x["norm"]) + 1).alias("n")))).alias("out")), lambda a: a["out"])
    got = got.withColumn("ends", ends)
    on = lambda pos: F.get(F.filter("ends", lambda e: e["n"] >= pos), F.lit(0))["page"]
    first, last = on(F.col("at")), on(F.col("at") + F.length("norm") - 1)
    reason = F.when(F.col("norm") == "", "empty").when(F.col("at") == 0, "missing").when(first != F.col("page_start"), "starts elsewhere").when(last != F.col("page_end"), "ends elsewhere").otherwise("ok")
    return got.select("chunk_id", reason.alias("reason"))


def accuracy_report(checks: DataFrame) -> DataFrame:
    return checks.groupBy("reason").agg(F.count("*").alias("n"))


def answer_ranks(hits: DataFrame, chunks: DataFrame, cases: DataFrame, most: int = 10) -> DataFrame:
    """(variant, query_id, place): the first hit, among ten, of a case's book (null: any) that holds all its needles; null without one."""
    texts = hits.where(F.col("place") <= most).join(chunks.select("chunk_id", normalize_for_match(F.col("text")).alias("norm")), "chunk_id")
    want = cases.select("query_id", "book", F.transform("needles", normalize_for_match).alias("needles"))
    good = texts.join(want, "query_id").where((F.col("book").isNull() | (F.col("book") == F.col("document_id"))) & F.forall("needles", lambda n: F.col("norm").contains(n)))
    best = good.groupBy("variant", "query_id").agg(F.min("place").alias("place"))
    # the variants compared are a handful; the cases are of any number and stay where they are
    return cases.select("query_id").crossJoin(F.broadcast(hits.select("variant").distinct())).join(best, ["variant", "query_id"], "left")


def retrieval_eval(ranks: DataFrame) -> DataFrame:
    """Per variant: cases, hit@1, hit@5, MRR and the queries outside the first five (ids by number, comma-joined; ``retrieval_misses`` has them as rows)."""
    p = F.col("place")
    return ranks.groupBy("variant").agg(F.count("*").alias("cases"), F.count_if(p == 1).alias("hit1"), F.count_if(p <= 5).alias("hit5"), F.avg(F.coalesce(1 / p, F.lit(0.0))).alias("mrr"),
                                        F.array_join(F.sort_array(F.collect_list(F.when(p.isNull() | (p > 5), F.col("query_id")))).cast("array<string>"), ",").alias("misses"))


def retrieval_misses(ranks: DataFrame) -> DataFrame:
    """(variant, query_id, place) of the cases that are not answered among the first five."""
    return ranks.where(F.col("place").isNull() | (F.col("place") > 5)).select("variant", "query_id", "place")


def boost_sweep(candidates: DataFrame, boosts: list[float], limit: int = 10) -> DataFrame:
    """Hits of each boost (variant): candidates are scored once, then ranked for every boost."""
    spark = candidates.sparkSession
    b = spark.createDataFrame([(f"boost {x:g}", float(x)) for x in boosts], "variant string, boost double")
    scored = candidates.join(F.broadcast(b)).withColumn("score", F.col("similarity") + F.col("boost") * F.coalesce("coverage", F.lit(0.0)))
    keyed = scored.withColumn("case_id", F.col("query_id")).withColumn("query_id", F.struct("variant", "case_id"))
    hits = rank.ranked(rank.diversify(rank.collapse_adjacent(keyed), limit), limit)
    return hits.withColumn("query_id", F.col("case_id")).drop("case_id", "boost")
