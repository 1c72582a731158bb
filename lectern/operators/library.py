"""The library of documents: intake, listing, patches, counts, and the queue of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions.text import JUNK_AUTHOR, JUNK_TITLE, metadata_from_file_name
from lectern.operators.joins import few, written


def dedupe_by_hash(incoming: DataFrame, existing: DataFrame, id_col: str = "document_id", hash_col: str = "sha256") -> DataFrame:
    """incoming plus duplicate and winner_id: content in the library already, or earlier (smaller id) in the batch."""
    first = incoming.groupBy(hash_col).agg(F.min(id_col).alias("_batch"))
    known = existing.groupBy(hash_col).agg(F.min(id_col).alias("_known"))
    winners = first.join(known, hash_col, "left").select(hash_col, F.coalesce("_known", "_batch").alias("winner_id"))
    return incoming.join(winners, hash_col, "left").withColumn("duplicate", F.coalesce(F.col("winner_id") != F.col(id_col), F.lit(False)))


def replace_documents(target: DataFrame, incoming: DataFrame, id_col: str = "document_id") -> DataFrame:
    """All rows of the incoming documents anew; applied twice, the same."""
    return target.join(incoming.select(id_col).distinct(), id_col, "left_anti").unionByName(incoming)


def filter_library(docs: DataFrame, text: str | None = None, tag: str | None = None, status: str = "all") -> DataFrame:
    out = docs
    if text and text.strip():
        t = text.strip().lower()
        out = out.where(F.lower("title").contains(t) | F.lower(F.coalesce("author", F.lit(""))).contains(t) | F.exists("tags", lambda x: x.contains(t)))
    if tag:
        out = out.where(F.array_contains("tags", tag))
    return out if status == "all" else out.where((F.col("status") == "ready") if status == "ready" else (F.col("status") != "ready"))


def surname_key(author: Column) -> Column:
    """Last word and full name in lower case, unless the name has a comma; empty authors last."""
    a = F.trim(F.coalesce(author, F.lit("")))
    parts = F.split(a, r"\s+")
    return F.when(a == "", "￿").otherwise(F.lower(F.when((F.size(parts) > 1) & ~a.contains(","), F.concat(F.element_at(parts, -1), F.lit(" "), a)).otherwise(a)))


def library_order(key: str) -> list[Column]:
    """Ascending keys of one of the orders recent, title, author and length; names compare as a reader expects (accents and case last), ties go by id."""
    last = F.lit((1 << 63) - 1)
    by = {"recent": [F.coalesce(-F.unix_micros(F.col("created_at").cast("timestamp")), last)], "title": [F.collate("title", "UNICODE")],
          "author": [F.collate(surname_key(F.col("author")), "UNICODE"), F.collate("title", "UNICODE")], "length": [-F.coalesce("page_count", F.lit(0))]}
    return [*by[key], F.col("document_id")]


def sort_library(docs: DataFrame, key: str = "recent") -> DataFrame:
    return docs.orderBy(*library_order(key))


def list_documents(docs: DataFrame) -> DataFrame:
    return docs.orderBy(F.desc("created_at"), "document_id")


def lookup(docs: DataFrame, requests: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Rows of the requested ids (text); ids that are no numbers find nothing and raise nothing."""
    wanted = requests.where(F.col("request").rlike(r"^\d{1,18}$")).select(F.col("request").cast("long").alias(id_col)).distinct()
    return docs.join(wanted, id_col, "left_semi")


def page_range(pages: DataFrame, requests: DataFrame, max_span: int = 20) -> DataFrame:
    """Pages of each request (request_id, document_id, from_page, to_page): from at least 1, to at most from + max_span."""
    low = F.greatest(F.col("from_page"), F.lit(1))
    r = requests.select("request_id", "document_id", low.alias("lo"), F.greatest(low, F.least("to_page", low + max_span)).alias("hi"))
    # one row per page wanted makes it a join on keys, whatever the number of requests
    wanted = r.select("request_id", "document_id", F.explode(F.sequence("lo", "hi")).alias("page"))
    return wanted.join(pages, ["document_id", "page"])


def choose_metadata(df: DataFrame) -> DataFrame:
    """df plus chosen_title, chosen_author from file_name, info_title, info_author, typographic_title.

    A file name with an author wins; then embedded data that isn't junk, typography, the file name. Edited rows keep theirs.
    """
    name = metadata_from_file_name(F.col("file_name"))
    t, a = F.col("info_title"), F.col("info_author")
    info_title = F.when(F.length(t).between(3, 200) & ~t.rlike(JUNK_TITLE), t)
    info_author = F.when((F.length(a) > 0) & (F.length(a) <= 120) & ~a.rlike(JUNK_AUTHOR), a)
    named = name["author"].isNotNull()
    title = F.when(named, name["title"]).otherwise(F.coalesce(info_title, F.col("typographic_title"), name["title"]))
    author = F.when(named, name["author"]).otherwise(info_author)
    return df.withColumns({"chosen_title": F.when(F.col("metadata_edited"), F.col("title")).otherwise(title), "chosen_author": F.when(F.col("metadata_edited"), F.col("author")).otherwise(author)})


def apply_patches(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """docs with each patch's fields that are set (patches: document_id, set_fields array, title, author, description, tags)."""
    p = patches.select("document_id", *[F.col(c).alias(f"p_{c}") for c in ("set_fields", "title", "author", "description", "tags")])
    has = lambda f: F.coalesce(F.array_contains("p_set_fields", f), F.lit(False))
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    tags = F.array_distinct(F.filter(F.transform(F.coalesce("p_tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != ""))
    out = docs.join(p, "document_id", "left").withColumns({
        "title": F.when(has("title"), F.coalesce(filled("p_title"), F.lit("Untitled"))).otherwise(F.col("title")),
        "author": F.when(has("author"), filled("p_author")).otherwise(F.col("author")),
        "description": F.when(has("description"), filled("p_description")).otherwise(F.col("description")),
        "tags": F.when(has("tags"), tags).otherwise(F.col("tags")),
        "metadata_edited": F.col("metadata_edited") | has("title") | has("author")})
    return out.select(docs.columns)


def library_stats(docs: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return docs.agg(F.count("*").alias("volumes"), total("page_count").alias("pages"), total("chunk_count").alias("passages"))


def all_tags(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def status_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("status") != "ready").alias("attention"))


def classify_text_coverage(pages: DataFrame, least: float = 0.1, least_chars: int = 25) -> DataFrame:
    """Per document: pages, pages with text, status needs_ocr (none, or under a tenth) or ready, and a note on empty pages."""
    chars = F.length(F.regexp_replace("text", r"\s", ""))
    c = pages.groupBy("document_id").agg(F.count("*").alias("page_count"), F.count_if(chars >= least_chars).alias("text_pages"))
    scan = (F.col("text_pages") == 0) | (F.col("text_pages") / F.col("page_count") < least)
    empty = F.col("page_count") - F.col("text_pages")
    return c.withColumns({"status": F.when(scan, "needs_ocr").otherwise("ready"), "note": F.when(~scan & (empty > 0), F.concat(empty.cast("string"), F.lit(" of "), F.col("page_count").cast("string"), F.lit(" pages have no text")))})


# --- the queue of work ---

def enqueue(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """New (document_id, kind) jobs: each once, unless one is pending already."""
    pending = jobs.where("status = 'pending'").select("document_id", "kind").distinct()
    return requests.select("document_id", "kind").dropDuplicates().join(pending, ["document_id", "kind"], "left_anti").withColumns({"status": F.lit("pending"), "attempts": F.lit(0)})


def classify_jobs(jobs: DataFrame, now: Column, stale: str = "15 minutes", most: int = 3) -> DataFrame:
    """jobs plus claimable, its place among the claimable (oldest first), and what recovery after a crash makes of it."""
    running = F.col("status") == "running"
    claim = (F.col("status") == "pending") | (running & (F.col("started_at") < now - F.expr(f"interval {stale}")) & (F.col("attempts") < most))
    recovered = F.when(running & (F.col("attempts") < most), "pending").when(running, "failed").otherwise(F.col("status"))
    reason = F.when(running & (F.col("attempts") >= most), "Interrupted too many times").otherwise(F.col("error"))
    return jobs.withColumns({"claimable": claim, "recovered_status": recovered, "recovered_error": reason})


def claim_oldest(jobs: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """The oldest claimable jobs: a bounded top-k, kept per partition before the rows meet."""
    return classify_jobs(jobs, now).where("claimable").orderBy("created_at", "job_id").limit(limit)


#: States in which work on a document is over; the last two have been processed.
FAILED, FINISHED = "failed", ("ready", "needs_ocr")


def settled(state: DataFrame) -> DataFrame:
    """What a status makes of the other fields: failed and finished documents have no stage, finished ones all of their progress, which else is clamped to 0..1."""
    over = F.col("status").isin(FAILED, *FINISHED)
    progress = F.when(F.col("status").isin(*FINISHED), 1.0).when(F.col("progress").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "progress")))
    return state.select("document_id", "status", F.when(~over, F.col("stage")).alias("stage"), progress.alias("progress"), "detail", "updated_at")


def document_status(events: DataFrame) -> DataFrame:
    """Latest state of each document from lifecycle events (document_id, ts, seq, status, stage, progress, detail).

    The last event tells status, stage and progress, as ``settled`` reads them; a null detail leaves the one before.
    """
    at = F.struct("ts", "seq")
    seen = F.struct(F.when(F.col("detail").isNotNull(), at).alias("at"), "detail")
    latest = [F.max_by(c, at).alias(c) for c in ("status", "stage", "progress")]
    return settled(events.groupBy("document_id").agg(*latest, F.max(F.when(F.col("detail").isNotNull(), seen))["detail"].alias("detail"), F.max("ts").alias("updated_at")))


def stalled(docs: DataFrame, now: Column, after: str = "45 seconds") -> DataFrame:
    return docs.where(F.col("status").isin("queued", "processing") & (F.col("updated_at") < now - F.expr(f"interval {after}")))


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame, links: dict[str, tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """Each table without the rows that belong to the documents ``ids(document_id)``, directly or through other tables.

    ``links`` tells for each dependent table its parent and the column that both share; tables that it does not name hang on document_id.
    The keys that go are found table by table from the documents down (only keys of rows that go are joined), and a table
    is then cut by an anti join on its own link; null keys belong to nothing and stay. Keys too many to broadcast are
    hashed by partition, so that a task holds keys that go and never sorts the rows of a table.
    """
    links = {name: (None, "document_id") for name in tables} | (links or {})
    gone: dict[tuple[str | None, str], DataFrame] = {(None, "document_id"): written(ids.select("document_id").where("document_id is not null").distinct())}

    def keys(parent: str | None, column: str) -> DataFrame:
        if (parent, column) not in gone:
            rows = tables[parent].join(keys(*links[parent]), links[parent][1], "left_semi")
            gone[parent, column] = written(rows.select(column).where(F.col(column).isNotNull()).distinct())
        return few(gone[parent, column], many="shuffle_hash")

    return {name: t.join(keys(*links[name]), links[name][1], "left_anti") for name, t in tables.items()}


def reprocess(docs: DataFrame, jobs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents reset to queued, and the jobs that this adds."""
    again = ids.select("document_id", F.lit(True).alias("_again")).distinct()
    hit = F.coalesce("_again", F.lit(False))
    out = docs.join(again, "document_id", "left").withColumns({
        "status": F.when(hit, "queued").otherwise(F.col("status")), "stage": F.when(hit, "queued").otherwise(F.col("stage")),
        "progress": F.when(hit, 0.0).otherwise(F.col("progress")), "detail": F.when(~hit, F.col("detail"))}).drop("_again")
    return out, enqueue(jobs, ids.select("document_id", F.lit("ingest").alias("kind")))


UNEXPECTED = "ended unexpectedly"


def fold_turns(events: DataFrame) -> DataFrame:
    """Answer events -> one row per turn: its searches and reads, notes, answer, checks and error.

    Text before a later round is a note, text of the last round the answer, unless the done event brings the whole answer. Of the final checks (cited and unknown sources,
    quotations verified, tokens used) those are given that the events have columns for; they are the done event's. A turn with neither done nor error ended unexpectedly.
    """
    before = W.partitionBy("turn_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    e = events.withColumn("round_no", F.sum(F.when(F.col("type") == "turn", 1).otherwise(0)).over(before))
    last = F.max("round_no").over(W.partitionBy("turn_id"))
    e = e.withColumn("last_round", last)
    ordered = lambda cond, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("seq", value.alias("v"))))), lambda x: x["v"]), "")
    text, done = F.col("type") == "text", F.col("type") == "done"
    trail = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("type").isin("search", "read"), F.struct("seq", F.concat_ws(":", "type", "query").alias("v"))))), lambda x: x["v"]), "|")
    ended = F.max(F.col("type").isin("done", "error"))
    final = lambda c: F.max_by(c, F.when(done, F.col("seq")))
    checks = [final(c).alias(c) for c in ("cited", "unknown", "verified", "input_tokens", "output_tokens") if c in events.columns]
    return e.groupBy("turn_id").agg(
        F.count_if(F.col("type") == "search").alias("searches"), F.count_if(F.col("type") == "read").alias("reads"), trail.alias("trail"),
        ordered(text & (F.col("round_no") < F.col("last_round")), F.col("text")).alias("notes"), F.coalesce(final("text"), ordered(text & (F.col("round_no") == F.col("last_round")), F.col("text"))).alias("answer"),
        F.coalesce(F.max(F.when(F.col("type") == "error", F.coalesce("error", F.lit("error")))), F.when(~ended, UNEXPECTED)).alias("error"), *checks)
