"""The driver's tables as the engine's tables: each adapter as DataFrames and, for the oracle, as a SQL view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import word_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines: five to a page, four pages to a part, every twentieth a heading."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("seq", "raw"))
    d = d.select("document_id", "seq", F.trim("raw").alias("text")).where("text <> ''")
    page = (F.floor(F.col("seq") / 5) + 1).cast("int")
    return d.select("document_id", "seq", "text", page.alias("page"), (F.lit(700.0) - 14 * (F.col("seq") % 5)).alias("y"), (F.col("seq") % 20 == 0).alias("heading"),
                    F.concat(F.lit("Part "), F.floor(page / 4).cast("string")).alias("chapter"), F.lit(None).cast("string").alias("continues"))


PARAGRAPHS = """paragraphs as (
  select document_id, seq, text, (seq // 5 + 1)::int as page, 700.0::double - 14 * (seq % 5) as y, seq % 20 = 0 as heading,
    'Part ' || ((seq // 5 + 1) // 4) as chapter
  from (select doc_id as document_id, (i - 1)::int as seq, trim(parts[i], ' ') as text
        from (select doc_id, string_split(text, chr(10)) as parts from documents where text is not null) s, unnest(range(1, len(parts) + 1)) as r(i)) p
  where text <> '')"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One passage per paragraph."""
    p = paragraphs(spark, sf_dir)
    return p.select((F.col("document_id") * 1_000_000_000 + F.col("seq")).alias("chunk_id"), "document_id", F.col("seq").alias("ordinal"), F.col("page").alias("page_start"), F.col("page").alias("page_end"),
                    "chapter", "text", word_count(F.col("text")).alias("word_count"))


CHUNKS = PARAGRAPHS + """,
chunks as (select document_id * 1000000000 + seq as chunk_id, document_id, seq as ordinal, page as page_start, page as page_end, chapter, text,
    len(regexp_extract_all(text, '\\S+'))::bigint as word_count from paragraphs)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts; every third page has a printed label."""
    p = paragraphs(spark, sf_dir).groupBy("document_id", "page").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("s"))
    return p.select("document_id", "page", F.when(F.col("page") % 3 == 0, F.concat(F.lit("p"), F.col("page").cast("string"))).alias("label"), F.array_join(F.transform("s", lambda x: x["text"]), "\n\n").alias("text"))


PAGES = """pages_t as (select document_id, page, case when page % 3 = 0 then 'p' || page end as label, string_agg(text, chr(10) || chr(10) order by seq) as text
  from paragraphs group by document_id, page)"""


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library rows: status from the quality label, tags from language and source."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    lab = lab.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    first = F.get(F.split("text", "\n"), F.lit(0))
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("document_id"), F.substring(F.coalesce(first, F.lit("")), 1, 60).alias("title"),
        F.when(F.col("doc_id") % 4 > 0, F.concat_ws(" ", "lang", "source")).alias("author"), F.array("lang", "source").alias("tags"),
        F.when(F.col("quality") == 1, "ready").when(F.col("quality") == 0, "failed").otherwise("queued").alias("status"),
        F.when(F.col("doc_id") % 7 > 0, F.ceil(F.col("n_chars") / 400).cast("int")).alias("page_count"), F.ceil(F.col("n_chars") / 90).cast("int").alias("chunk_count"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60).alias("created_at"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.lit(False).alias("metadata_edited"), F.lit(None).cast("string").alias("description"))


LIBRARY = """library as (
  select d.doc_id as document_id, substr(coalesce(string_split(text, chr(10))[1], ''), 1, 60) as title,
    case when d.doc_id % 4 > 0 then lang || ' ' || source end as author, [lang, source] as tags,
    case q.quality when 1 then 'ready' when 0 then 'failed' else 'queued' end as status,
    case when d.doc_id % 7 > 0 then ceil(n_chars / 400)::int end as page_count, ceil(n_chars / 90)::int as chunk_count,
    (timestamp '2023-11-14 22:13:20' + interval (d.doc_id * 60) second) as created_at, sha256(text) as sha256, false as metadata_edited, null::varchar as description
  from documents d left join (select doc_id, max(quality) as quality from labels group by doc_id) q on d.doc_id = q.doc_id)"""


def queries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): each benchmark text, whole."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("query"))


QUERIES_T = "queries_t as (select item_id::bigint as query_id, text as query from benchmark)"


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"
