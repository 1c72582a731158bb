"""Grounding context for batches of threads: catalogue, history, passage registry, page passages, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions.text import page_label, word_count
from lectern.operators.joins import written

OUTLINE_ENTRIES, SCOPED_BOOKS = 80, 3


def build_catalog(docs: DataFrame, scope: DataFrame | None = None, outline: str | None = None) -> DataFrame:
    """(document_id, ref, title, author, listing): documents with passages as B1, B2 ... by author, title.

    The number is a rank over the whole library, so it takes two passes: ranks within ranges of the order, then the
    ranges' offsets. Contents (``outline``, an array of (title, page, level)) are listed only for scopes of up to 3 documents.
    """
    d = docs.where(F.coalesce("chunk_count", F.lit(0)) > 0)
    if scope is not None:
        d = d.join(scope.select("document_id").distinct(), "document_id", "left_semi")
    d = numbered(d, F.coalesce("author", F.lit("")), F.col("title"), F.col("document_id"))
    d = d.withColumn("ref", F.concat(F.lit("B"), F.col("n").cast("string")))
    line = F.concat_ws("", F.lit("["), "ref", F.lit("] "), "title", F.coalesce(F.concat(F.lit(" — "), F.when(F.col("author") != "", F.col("author"))), F.lit("")),
                       F.coalesce(F.concat(F.lit(" ("), F.col("page_count").cast("string"), F.lit(" pages)")), F.lit("")))
    if outline is not None and scope is not None:
        entries = F.transform(F.slice(outline, 1, OUTLINE_ENTRIES), lambda e: F.concat(F.lit("\n"), F.repeat(F.lit("  "), F.least(e["level"], F.lit(2)) + 1), e["title"], F.lit(" (p. "), e["page"].cast("string"), F.lit(")")))
        small = F.lit(scope.select("document_id").distinct().limit(SCOPED_BOOKS + 1).count() <= SCOPED_BOOKS)
        line = F.concat(line, F.when(small, F.array_join(F.coalesce(entries, F.array().cast("array<string>")), "")).otherwise(""))
    return d.select("document_id", "ref", "title", "author", line.alias("listing"))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df plus n: 1, 2, ... in the order, without bringing all rows to one task.

    The ranges are written once: made twice, adaptive execution may join them into fewer by other bounds, and ranks and offsets would not be of the same ranges.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = lambda rows: rows.select("*", *[c.alias(n) for n, c in zip(names, order)])
    ranged = written(keyed(df).repartitionByRange(*[F.col(c) for c in names]).drop(*names).withColumn("_p", F.spark_partition_id()))
    # all of a range's rows have one number, so that a window by it needs ranks only within the range
    local = keyed(ranged).withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*names)))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    # one row per range: as many as there are partitions
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return local.join(F.broadcast(before), "_p").withColumn("n", F.col("_r") + F.col("_before")).drop("_p", "_r", "_before", *names)


def contextual_query(turns: DataFrame, short: int = 12) -> DataFrame:
    """turns (thread_id, turn, question) plus search_query: a follow-up of under 12 words goes with the question before it."""
    before = F.lag("question").over(W.partitionBy("thread_id").orderBy("turn"))
    follow = before.isNotNull() & (word_count(F.col("question")) < short)
    return turns.withColumn("search_query", F.when(follow, F.concat(before, F.lit("\n"), F.col("question"))).otherwise(F.col("question")))


def history_window(turns: DataFrame, cited: DataFrame, keep: int = 6) -> tuple[DataFrame, DataFrame]:
    """The last turns of each thread, and the passages that these cited (of one id the latest turn's)."""
    last = turns.withColumn("_n", F.row_number().over(W.partitionBy("thread_id").orderBy(F.desc("turn")))).where(F.col("_n") <= keep).drop("_n")
    passages = cited.join(last.select("thread_id", "turn"), ["thread_id", "turn"])
    return last, passages.groupBy("thread_id", "passage_id").agg(F.max_by("source_key", "turn").alias("source_key"), F.max("turn").alias("turn"))


def register_passages(retrieved: DataFrame) -> DataFrame:
    """(thread_id, source_key, passage_id) from (thread_id, seq, source_key, forced_id).

    A source's first appearance counts. Carried ids come first in seq and are kept; of sources that carry the same id the first keeps
    it. All others are numbered in order after the largest number kept.
    """
    first = retrieved.groupBy("thread_id", "source_key").agg(F.min("seq").alias("seq"), F.min_by("forced_id", "seq").alias("forced_id"))
    owner = W.partitionBy("thread_id", "forced_id").orderBy("seq")
    first = first.withColumn("kept", F.col("forced_id").isNotNull() & (F.row_number().over(owner) == 1))
    num = F.when(F.col("kept"), F.expr("try_cast(substring(forced_id, 2) as bigint)"))
    largest = F.coalesce(F.max(num).over(W.partitionBy("thread_id")), F.lit(0))
    fresh = F.sum(F.when(F.col("kept"), 0).otherwise(1)).over(W.partitionBy("thread_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return first.withColumn("_m", largest).withColumn("_f", fresh).select("thread_id", "source_key", F.when(F.col("kept"), F.col("forced_id")).otherwise(F.concat(F.lit("P"), (F.col("_m") + F.col("_f")).cast("string"))).alias("passage_id"))


def with_sources(rows: DataFrame, docs: DataFrame, pages: DataFrame) -> DataFrame:
    label = lambda side: pages.select("document_id", F.col("page").alias(f"page_{side}"), F.col("label").alias(f"label_{side}"))
    return rows.join(docs.select("document_id", "title", "author"), "document_id").join(label("start"), ["document_id", "page_start"], "left").join(label("end"), ["document_id", "page_end"], "left")


def restore_passages(refs: DataFrame, chunks: DataFrame, docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Passages of carried references (thread_id, passage_id, chunk_id or document_id and page), texts from the tables alone; unknown ones are dropped."""
    cols = ["thread_id", "passage_id", "kind", "document_id", "page_start", "page_end", "chapter", "text", "title", "author", "label_start", "label_end"]
    by_chunk = with_sources(refs.where("chunk_id is not null").select("thread_id", "passage_id", "chunk_id").join(chunks.select("chunk_id", "document_id", "page_start", "page_end", "chapter", "text"), "chunk_id"), docs, pages).withColumn("kind", F.lit("chunk"))
    wanted = refs.where("chunk_id is null").select("thread_id", "passage_id", "document_id", "page")
    asked = wanted.select(F.xxhash64("thread_id", "passage_id").alias("request_id"), "thread_id", "passage_id", "document_id", F.col("page").alias("from_page"), F.col("page").alias("to_page"))
    by_page = page_passages(asked, pages, docs, chunks).join(asked.select("request_id", "thread_id", "passage_id"), "request_id").withColumn("kind", F.lit("page"))
    return by_chunk.select(cols).unionByName(by_page.select(cols))


def page_passages(requests: DataFrame, pages: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages with text of each request (request_id, document_id, from_page, to_page) as passages.

    Their chapter is that of the document's last passage that begins by the range's end: an as-of lookup by maximum.
    """
    wanted = requests.select("request_id", "document_id", F.explode(F.sequence("from_page", "to_page")).alias("page"))
    rows = wanted.join(pages, ["document_id", "page"]).where(F.trim("text") != "")
    # a document's last passage of each page, then the running last of these pages, met by the requests at their ends: rows are pages and requests, never pairs of them
    last = chunks.groupBy("document_id", F.col("page_start").alias("page")).agg(F.max_by(F.struct("chapter"), "ordinal").alias("c"))
    line = last.select("document_id", "page", F.lit(0).alias("turn"), "c", F.lit(None).cast("long").alias("request_id")).unionByName(requests.select("document_id", F.col("to_page").alias("page"), F.lit(1).alias("turn"), F.lit(None).cast(last.schema["c"].dataType).alias("c"), F.col("request_id").cast("long").alias("request_id")))
    seen = F.last("c", ignorenulls=True).over(W.partitionBy("document_id").orderBy("page", "turn").rowsBetween(W.unboundedPreceding, 0))
    chapter = line.withColumn("c", seen).where("turn = 1 and c is not null").select("request_id", F.col("c.chapter").alias("chapter"))
    rows = rows.join(chapter, "request_id", "left").join(docs.select("document_id", "title", "author"), "document_id")
    return rows.select("request_id", "document_id", F.col("page").alias("page_start"), F.col("page").alias("page_end"), "chapter", "text", "title", "author", F.col("label").alias("label_start"), F.col("label").alias("label_end"))


def escaped(c: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


def passage_block(ref: str = "ref") -> Column:
    """A passage as it is shown: its attributes and its text; physical pages too where printed labels differ."""
    attr = lambda name, value: F.concat(F.lit(f'{name}="'), value, F.lit('"'))
    start, end = F.col("page_start").cast("string"), F.col("page_end").cast("string")
    differs = F.coalesce(F.col("label_start") != start, F.lit(False)) | F.coalesce(F.col("label_end") != end, F.lit(False))
    some = lambda c: F.when(F.col(c) != "", escaped(F.col(c)))
    attrs = F.concat_ws(" ", attr("id", F.col("passage_id")), attr("book", F.coalesce(F.col(ref), F.lit("?"))), attr("title", escaped(F.col("title"))), attr("author", some("author")),
                        attr("pages", page_label(F.col("page_start"), F.col("page_end"), F.col("label_start"), F.col("label_end"))),
                        F.when(differs, attr("pdf_pages", F.when(start == end, start).otherwise(F.concat_ws("-", start, end)))), attr("chapter", some("chapter")))
    return F.concat(F.lit("<passage "), attrs, F.lit(">\n"), F.col("text"), F.lit("\n</passage>"))


def assemble_context(passages: DataFrame, catalog: DataFrame, questions: DataFrame) -> DataFrame:
    """(thread_id, context): listings of the thread's books, earlier passages, new passages, question.

    passages (thread_id, passage_id, is_new and a passage's columns), questions (thread_id, question).
    """
    p = passages.join(catalog.select("document_id", "ref", "listing"), "document_id", "left").withColumn("block", passage_block()).withColumn("no", F.expr("try_cast(substring(passage_id, 2) as bigint)"))
    blocks = lambda cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("no", "block")))), lambda x: x["block"]), "\n\n")
    books = F.array_join(F.transform(F.sort_array(F.collect_set(F.struct(F.expr("cast(substring(ref, 2) as bigint)"), "listing"))), lambda x: x["listing"]), "\n")
    t = p.groupBy("thread_id").agg(books.alias("books"), blocks(~F.col("is_new")).alias("earlier"), blocks(F.col("is_new")).alias("new"))
    part = lambda head, c: F.when(F.col(c) != "", F.concat(F.lit(f"{head}\n"), F.col(c)))
    t = questions.join(t, "thread_id", "left")
    return t.select("thread_id", F.concat_ws("\n\n", part("BOOKS", "books"), part("EARLIER PASSAGES", "earlier"), part("PASSAGES", "new"), F.concat(F.lit("QUESTION\n"), "question")).alias("context"))


MOST_REFS, MOST_CHARS, LIMITS, USUAL_LIMIT = 50, 500, (1, 12), 8


def resolve_requests(requests: DataFrame, catalog: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(request_id, kind, query, documents, unknown, limit, error) from (request_id, thread_id, kind, query, refs, limit, and for reads start_page, end_page).

    A search has 1 to 500 characters, a request at most 50 refs and a limit from 1 to 12 (8 if absent), a read pages from 1 on; whatever breaks a rule is refused with
    the first rule that it breaks, and has no documents. Refs are trimmed and upper-cased; unknown ones are
    told; if all are unknown that is an error. Without refs the thread's scope (thread_id, documents) holds.
    """
    r = requests
    for c in ("start_page", "end_page"):
        if c not in r.columns:
            r = r.withColumn(c, F.lit(1))
    search = F.col("kind") == "search"
    limit = F.coalesce("limit", F.lit(USUAL_LIMIT))
    rules = ((search & ~F.length(F.trim(F.coalesce("query", F.lit("")))).between(1, MOST_CHARS), f"query must have 1 to {MOST_CHARS} characters"),
             (F.size(F.coalesce("refs", F.array().cast("array<string>"))) > MOST_REFS, f"at most {MOST_REFS} books"), (~limit.between(*LIMITS), f"limit must be {LIMITS[0]} to {LIMITS[1]}"),
             (~search & ~((F.coalesce("start_page", F.lit(0)) >= 1) & (F.coalesce("end_page", F.lit(0)) >= 1)), "pages begin at 1"))
    r = r.withColumns({"refs": F.coalesce("refs", F.array().cast("array<string>")), "limit": limit, "broken": F.coalesce(*[F.when(bad, said) for bad, said in rules])})
    each = r.where("broken is null").select("request_id", F.explode("refs").alias("raw")).select("request_id", F.upper(F.trim("raw")).alias("ref")).distinct()
    met = each.join(catalog.select("ref", "document_id"), "ref", "left")
    listed = lambda c, cond: F.array_join(F.sort_array(F.collect_list(F.when(cond, c))), ",")
    known = met.groupBy("request_id").agg(listed(F.col("document_id").cast("string"), F.col("document_id").isNotNull()).alias("documents"), listed(F.col("ref"), F.col("document_id").isNull()).alias("unknown"))
    out = r.join(known, "request_id", "left")
    if scope is not None:
        out = out.join(scope.select("thread_id", F.col("documents").alias("_inherited")), "thread_id", "left")
    else:
        out = out.withColumn("_inherited", F.lit(None).cast("string"))
    own = F.coalesce(F.when(F.size("refs") > 0, F.col("documents")).otherwise(F.col("_inherited")), F.lit(""))
    nothing = F.col("broken").isNull() & (F.size("refs") > 0) & (F.coalesce("documents", F.lit("")) == "")
    return out.select("request_id", "kind", "query", F.when(F.col("broken").isNull(), own).otherwise("").alias("documents"), F.coalesce("unknown", F.lit("")).alias("unknown"), "limit", F.when(nothing, "no such books").otherwise(F.col("broken")).alias("error"))
