"""Queries of groups A, B, L and M: files, library, scalar columns, counts, and work that arrives over time."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import keyword as K
from lectern.operators import library as L
from lectern.operators import rank
from lectern.plans import adapters as A
from lectern.sources.scratch import scratch_path
from lectern.sources import buckets, files
from lectern.streaming import jobs as S
from lectern.streaming import stateful

Q, O = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f
    return add


LIB = A.with_(A.LIBRARY)


def loud(c):
    """Upper case; ß, whose capital engines don't agree on, as ss."""
    return F.upper(F.replace(c, F.lit("ß"), F.lit("ss")))


@query("a1_scan_files")
def _(spark, d):
    return files.scan_files(spark, f"{d}/documents.parquet", b"PAR1").select("name", "size", "sha256", "accepted", "reason")


@query("a2_dedupe_by_hash", LIB + """, e as (select sha256, min(document_id) as known from library where document_id % 10 = 0 group by sha256),
i as (select * from library where document_id % 10 <> 0), b as (select sha256, min(document_id) as batch from i group by sha256)
select document_id, coalesce(known, batch) as winner_id, coalesce(coalesce(known, batch) <> document_id, false) as duplicate from i left join e on i.sha256 = e.sha256 left join b on i.sha256 = b.sha256""")
def _(spark, d):
    lib = A.library(spark, d)
    return L.dedupe_by_hash(lib.where("document_id % 10 <> 0"), lib.where("document_id % 10 = 0")).select("document_id", "winner_id", "duplicate")


@query("a3_replace_documents", LIB + """select document_id, title, 'old' as version from library where document_id % 3 <> 0
union all select document_id, reverse(title), 'new' from library where document_id % 3 = 0""")
def _(spark, d):
    lib = A.library(spark, d).select("document_id", "title")
    new = lib.where("document_id % 3 = 0").select("document_id", F.reverse("title").alias("title"), F.lit("new").alias("version"))
    return L.replace_documents(lib.withColumn("version", F.lit("old")), new)


@query("a3_replace_on_disk", O["a3_replace_documents"])
def _(spark, d):
    path = scratch_path(spark)
    lib = A.library(spark, d).select("document_id", "title")
    buckets.replace_in_buckets(lib.withColumn("version", F.lit("old")), path)
    new = lib.where("document_id % 3 = 0").select("document_id", F.reverse("title").alias("title"), F.lit("new").alias("version"))
    buckets.replace_in_buckets(new, path)
    return buckets.read_buckets(spark, path, new.schema)


@query("a4_read_cases", "select text as query, null::varchar as book, text as needle from benchmark")
def _(spark, d):
    path = scratch_path(spark)
    rows = A.table(spark, d, "benchmark").select(F.col("text").alias("query"), F.lit(None).cast("string").alias("book"), F.array("text").alias("needles"))
    # one JSON array per file, of the cases of one bucket
    arrays = rows.groupBy(F.pmod(F.xxhash64("query"), F.lit(16)).alias("bucket")).agg(F.to_json(F.collect_list(F.struct("query", "book", "needles"))).alias("value"))
    arrays.write.partitionBy("bucket").text(path)
    return files.read_cases(spark, path).select("query", "book", F.element_at("needles", 1).alias("needle"))


def answer_events(spark, d):
    """A conversation is a turn: a user's rows are searches, the others text or the end of a round. Four of five end with their checks, one in seven with the whole answer."""
    c = A.table(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "search").otherwise(F.when(F.col("turn") % 4 == 1, "turn").otherwise("text"))
    at = lambda seq: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn_id") * 60 + seq)
    none = {"cited": "array<string>", "unknown": "array<string>", "verified": "array<boolean>", "input_tokens": "long", "output_tokens": "long"}
    base = c.select(F.col("conv_id").alias("turn_id"), F.col("turn").cast("long").alias("seq"), kind.alias("type"), F.when(kind == "text", F.col("text")).alias("text"), F.when(kind == "search", F.col("text")).alias("query"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    k = F.col("turn_id")
    done = c.groupBy(F.col("conv_id").alias("turn_id")).agg((F.max("turn") + 1).cast("long").alias("seq")).where("turn_id % 5 <> 0").select(
        "turn_id", "seq", F.lit("done").alias("type"), F.when(k % 7 == 1, F.concat(F.lit("In short: "), k.cast("string"))).alias("text"), F.lit(None).cast("string").alias("query"),
        F.when(k % 3 == 0, F.array(F.lit("P1"), F.lit("P2"))).otherwise(F.array(F.lit("P3"))).alias("cited"), F.when(k % 4 == 1, F.array(F.lit("P99"))).otherwise(F.array().cast("array<string>")).alias("unknown"),
        F.array(F.lit(True), k % 2 == 0).alias("verified"), (k * 10 + 7).alias("input_tokens"), F.col("seq").alias("output_tokens"))
    return base.unionByName(done).withColumns({"error": F.lit(None).cast("string"), "at": at(F.col("seq"))})


EVENTS = """with ev as (select conv_id as turn_id, turn::bigint as seq, case when role = 'user' then 'search' when turn % 4 = 1 then 'turn' else 'text' end as type, text as raw from conversations),
done as (select conv_id as turn_id, (max(turn) + 1)::bigint as seq, 'done' as type, case when conv_id % 7 = 1 then 'In short: ' || conv_id end as raw from conversations where conv_id % 5 <> 0 group by conv_id),
events_t as (select turn_id, seq, type, case when type in ('text', 'done') then raw end as text, case when type = 'search' then raw end as query, null::varchar as error,
  case when type = 'done' then case when turn_id % 3 = 0 then 'P1,P2' else 'P3' end end as cited, case when type = 'done' then case when turn_id % 4 = 1 then 'P99' else '' end end as unknown,
  case when type = 'done' then 'true,' || (turn_id % 2 = 0)::varchar end as verified, case when type = 'done' then turn_id * 10 + 7 end as input_tokens, case when type = 'done' then seq end as output_tokens,
  turn_id * 60 + seq as at_s from (select * from ev union all select * from done))
"""


@query("a5_write_read_events", EVENTS + "select turn_id, seq, type, text, query from events_t")
def _(spark, d):
    path = scratch_path(spark)
    files.write_events(answer_events(spark, d), path)
    return files.read_events(spark, path).select("turn_id", "seq", "type", "text", "query")


@query("b1_filter_library", LIB + "select document_id from library where (contains(lower(title), 'th') or contains(lower(coalesce(author, '')), 'th') or len(list_filter(tags, lambda t: contains(t, 'th'))) > 0) and list_contains(tags, 'en') and status <> 'ready'")
def _(spark, d):
    return L.filter_library(A.library(spark, d), " TH ", "en", "attention").select("document_id")


@query("b2_sort_library")
def _(spark, d):
    """The order is a rank over the whole library, so it is numbered in ranges."""
    from lectern.operators.context import numbered

    return numbered(A.library(spark, d), L.surname_key(F.col("author")), F.col("title"), F.col("document_id")).select("document_id", F.col("n").alias("place"))


O["b2_sort_library"] = LIB + """select document_id, row_number() over (order by case when trim(coalesce(author, '')) = '' then chr(65535) else
  lower(case when contains(author, ' ') and not contains(author, ',') then string_split(author, ' ')[-1] || ' ' || author else author end) end, title, document_id) as place from library"""


@query("b2_sort_orders", LIB + "select document_id, row_number() over (order by created_at desc, document_id) as recent, row_number() over (order by coalesce(page_count, 0) desc, document_id) as length from library")
def _(spark, d):
    """Places in the orders that every engine agrees on; the two by names have unit tests."""
    from lectern.operators.context import numbered

    lib = A.library(spark, d)
    recent, length = (numbered(lib, *L.library_order(key)).select("document_id", F.col("n").alias(key)) for key in ("recent", "length"))
    return recent.join(length, "document_id")


@query("b3_list_documents", LIB + "select document_id, title, author, status, epoch(created_at)::bigint as created from library where document_id % 2 = 0")
def _(spark, d):
    lib = A.library(spark, d)
    asked = lib.select(F.when(F.col("document_id") % 2 == 0, F.col("document_id").cast("string")).otherwise("no id").alias("request"))
    return L.list_documents(L.lookup(lib, asked)).select("document_id", "title", "author", "status", F.unix_timestamp("created_at").alias("created"))


@query("b4_page_range", A.with_(A.PARAGRAPHS, A.PAGES) + """, r as (select doc_id as request_id, doc_id as document_id, (doc_id % 5 - 1)::int as f, (doc_id % 40)::int as t from documents),
w as (select request_id, document_id, greatest(f, 1) as lo, greatest(greatest(f, 1), least(t, greatest(f, 1) + 20)) as hi from r)
select request_id, page, text from w join pages_t using (document_id) where page between lo and hi""")
def _(spark, d):
    r = A.table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.col("doc_id").alias("document_id"), (F.col("doc_id") % 5 - 1).cast("int").alias("from_page"), (F.col("doc_id") % 40).cast("int").alias("to_page"))
    return L.page_range(A.pages(spark, d), r).select("request_id", "page", "text")


NORM = r"trim(regexp_replace(regexp_replace(translate(strip_accents(lower({0})), '‘’‚‛′`', ''''''''''''''), '(\p{{L}})-\s+(\p{{L}})', '\1\2', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query("b5_normalize_for_match", "select doc_id, " + NORM.format("text") + " as norm from documents")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.normalize_for_match(F.col("text")).alias("norm"))


@query("b6_word_count_lead_excerpt", r"""select doc_id, len(regexp_extract_all(text, '\S+'))::bigint as words,
case when len(regexp_split_to_array(text, '\s+')) <= 45 then text else array_to_string(regexp_split_to_array(text, '\s+')[1:45], ' ') || ' …' end as lead from documents""")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), T.lead_excerpt(F.col("text")).alias("lead"))


TIDY = r"""case when length({l}) > 3 and {l} = upper({l}) and not regexp_matches({l}, '^[IVXLCDM]+$') then
  array_to_string(list_transform(string_split(lower({t}), ' '), lambda w, i: case when regexp_matches(w, '^[ivxlcdm]+[.,]?$') then upper(w)
    when i > 1 and w in ('a','an','and','as','at','by','for','from','in','of','on','or','the','to','with') then w else upper(substr(w, 1, 1)) || substr(w, 2) end), ' ') else {t} end"""


def tidy_sql(c: str) -> str:
    t = rf"regexp_replace(trim(regexp_replace({c}, '\s+', ' ', 'g')), '[.:]+$', '')"
    return TIDY.format(t=t, l=rf"regexp_replace({t}, '[^\p{{L}}]', '', 'g')")


@query("b7_tidy_title", LIB + ", s as (select document_id, case when document_id % 2 = 0 then upper(replace(title, 'ß', 'ss')) else title end as t from library) select document_id, " + tidy_sql("t") + " as title from s")
def _(spark, d):
    lib = A.library(spark, d)
    return lib.select("document_id", T.tidy_title(F.when(F.col("document_id") % 2 == 0, loud(F.col("title"))).otherwise(F.col("title"))).alias("title"))


FILE = "case document_id % 3 when 0 then replace(title, ' ', '_') || ' by ' || coalesce(author, 'x') || '.pdf' when 1 then lower(replace(title, ' ', '-')) || '.pdf' else title || '.pdf' end"
META = r"""(select *, trim(regexp_replace(regexp_replace(regexp_replace({f}, '^.*/', ''), '(.)\.[^.]*$', '\1'), '[_\s]+', ' ', 'g')) as base from {s})"""


def file_name():
    c = F.col
    return F.when(c("document_id") % 3 == 0, F.concat(F.replace("title", F.lit(" "), F.lit("_")), F.lit(" by "), F.coalesce("author", F.lit("x")), F.lit(".pdf"))).when(
        c("document_id") % 3 == 1, F.concat(F.lower(F.replace("title", F.lit(" "), F.lit("-"))), F.lit(".pdf"))).otherwise(F.concat("title", F.lit(".pdf")))


NAMED = r"""case when regexp_matches(base, '(?i)^(.+?)\s+by\s+(.+)$') then trim(regexp_extract(base, '(?i)^(.+?)\s+by\s+(.+)$', 1)) else
  upper(replace(substr(p, 1, 1), 'ß', 'ss')) || substr(p, 2) end as f_title, case when regexp_matches(base, '(?i)^(.+?)\s+by\s+(.+)$') then trim(regexp_extract(base, '(?i)^(.+?)\s+by\s+(.+)$', 2)) end as f_author"""
NAMES = f", f as (select *, {FILE} as file_name from library), b as {META.format(f='file_name', s='f')}, n as (select *, case when regexp_matches(base, '[a-z]-[a-z]') and not contains(base, ' ') then replace(base, '-', ' ') else base end as p from b), m as (select *, {NAMED} from n)"


@query("b8_metadata_from_file_name", LIB + NAMES + " select document_id, f_title as title, f_author as author from m")
def _(spark, d):
    m = T.metadata_from_file_name(file_name())
    return A.library(spark, d).select("document_id", m["title"].alias("title"), m["author"].alias("author"))


@query("b9_choose_metadata", LIB + NAMES + r""", i as (select *, case document_id % 5 when 0 then 'Untitled 3' when 1 then title end as it, case document_id % 4 when 0 then 'admin' else author end as ia, case when document_id % 2 = 0 then upper(replace(title, 'ß', 'ss')) end as tt from m)
select document_id, case when document_id % 11 = 0 then title when f_author is not null then f_title else coalesce(case when length(it) between 3 and 200 and not regexp_matches(it, '(?i)^(untitled|microsoft word|document\d*|title|none|null)\b|\.(docx?|pdf|indd|tex|dvi|rtf|odt|qxd|p65)$') then it end, tt, f_title) end as chosen_title,
case when document_id % 11 = 0 then author when f_author is not null then f_author else case when length(ia) > 0 and length(ia) <= 120 and not regexp_matches(ia, '(?i)^(user|admin|administrator|owner|unknown|author|anonymous|none|null|\d+)$') then ia end end as chosen_author from i""")
def _(spark, d):
    k = F.col("document_id")
    lib = A.library(spark, d).withColumns({"file_name": file_name(), "metadata_edited": k % 11 == 0, "info_title": F.when(k % 5 == 0, "Untitled 3").when(k % 5 == 1, F.col("title")),
                                           "info_author": F.when(k % 4 == 0, "admin").otherwise(F.col("author")), "typographic_title": F.when(k % 2 == 0, loud(F.col("title")))})
    return L.choose_metadata(lib).select("document_id", "chosen_title", "chosen_author")


@query("b10_embedding_text", A.with_(A.LIBRARY, A.CHUNKS) + """select chunk_id, concat_ws(', ', case when author <> '' then author end, case when title <> '' then title end) || ' — ' || string_split(chapter, ' › ')[-1] || chr(10) || chr(10) || text as embedded from chunks join library using (document_id)""")
def _(spark, d):
    c = A.chunks(spark, d).join(A.library(spark, d).select("document_id", "title", "author"), "document_id")
    return c.select("chunk_id", T.embedding_text(F.col("title"), F.col("author"), F.col("chapter"), F.col("text")).alias("embedded"))


@query("b11_reference_labels", A.with_(A.LIBRARY, A.CHUNKS) + r""", c as (select *, title || ' › ' || case when document_id % 2 = 0 then 'II' else chapter end as path, case when page_end % 3 = 0 then 'p' || page_end end as le from chunks join library using (document_id)),
t as (select *, trim(string_split(regexp_replace(title, '[:;—]', chr(1), 'g'), chr(1))[1]) as st from c), u as (select *, upper(replace(substr(regexp_replace(st, '(?i)^(a selection from|selections from|the complete|the collected)\s+(the\s+)?', ''), 1, 1), 'ß', 'ss')) || substr(regexp_replace(st, '(?i)^(a selection from|selections from|the complete|the collected)\s+(the\s+)?', ''), 2) as s2 from t)
select chunk_id, case when page_start::varchar = coalesce(le, page_end::varchar) then 'p. ' || page_start else 'pp. ' || page_start || '–' || coalesce(le, page_end::varchar) end as label,
case when length(string_split(path, ' › ')[-1]) <= 6 then string_split(path, ' › ')[-2] || ' · ' || string_split(path, ' › ')[-1] else string_split(path, ' › ')[-1] end as leaf,
case when length(s2) > 34 then regexp_replace(substr(s2, 1, 34), '\s+\S*$', '') || '…' else s2 end as short from u""")
def _(spark, d):
    c = A.chunks(spark, d).join(A.library(spark, d).select("document_id", "title"), "document_id")
    path = F.concat("title", F.lit(" › "), F.when(F.col("document_id") % 2 == 0, "II").otherwise(F.col("chapter")))
    end = F.when(F.col("page_end") % 3 == 0, F.concat(F.lit("p"), F.col("page_end").cast("string")))
    return c.select("chunk_id", T.page_label(F.col("page_start"), F.col("page_end"), F.lit(None).cast("string"), end).alias("label"), T.chapter_leaf(path).alias("leaf"), T.short_title(F.col("title")).alias("short"))


@query("b12_relevance_band", """with e as (select vec_id, embedding[1] * embedding[1] * 40 as s from embeddings)
select vec_id, ((s >= 0.5)::int + (s >= 0.57)::int + (s >= 0.63)::int + (s >= 0.69)::int + (s >= 0.75)::int) as band, case when vec_id % 3 = 0 and vec_id % 2 = 0 then 'meaning + words' when vec_id % 3 = 0 then 'meaning' else 'words' end as via from (select vec_id, (embedding[1]::double * embedding[1]::double * 40) as s from embeddings)""")
def _(spark, d):
    e = A.table(spark, d, "embeddings")
    x = F.get("embedding", F.lit(0)).cast("double")
    return e.select("vec_id", rank.relevance_band(x * x * 40).alias("band"), rank.via(F.when(F.col("vec_id") % 3 == 0, F.col("vec_id")), F.when(F.col("vec_id") % 2 == 0, F.col("vec_id"))).alias("via"))


@query("b13_apply_patches", LIB + """, p as (select document_id as id, case when document_id % 4 = 0 then ['title', 'tags'] else ['author', 'description'] end as f, case when document_id % 8 = 0 then '  ' else ' New ' || title end as t, case when document_id % 6 = 0 then ' ' else 'Someone' end as a, ' a note ' as ds from library where document_id % 2 = 0)
select document_id, case when list_contains(f, 'title') then case when trim(t) = '' then 'Untitled' else trim(t) end else title end as title, case when list_contains(f, 'author') then nullif(trim(a), '') else author end as author,
case when list_contains(f, 'description') then 'a note' end as description, case when list_contains(f, 'tags') then 'x,' || lang2 else lang2 || ',' || tags[2] end as tags, f is not null as metadata_edited from (select *, tags[1] as lang2 from library) l left join p on p.id = l.document_id""")
def _(spark, d):
    lib = A.library(spark, d)
    k = F.col("document_id")
    p = lib.where(k % 2 == 0).select("document_id", F.when(k % 4 == 0, F.array(F.lit("title"), F.lit("tags"))).otherwise(F.array(F.lit("author"), F.lit("description"))).alias("set_fields"),
                                     F.when(k % 8 == 0, "  ").otherwise(F.concat(F.lit(" New "), "title")).alias("title"), F.when(k % 6 == 0, " ").otherwise("Someone").alias("author"), F.lit(" a note ").alias("description"),
                                     F.array(F.lit(" X"), F.get("tags", F.lit(0)), F.lit(""), F.lit("x")).alias("tags"))
    return L.apply_patches(lib, p).select("document_id", "title", "author", "description", F.array_join("tags", ",").alias("tags"), "metadata_edited")


@query("l1_library_stats", LIB + "select count(*) as volumes, coalesce(sum(page_count), 0)::bigint as pages, coalesce(sum(chunk_count), 0)::bigint as passages from library")
def _(spark, d):
    return L.library_stats(A.library(spark, d))


@query("l2_all_tags", LIB + "select distinct unnest(tags) as tag from library")
def _(spark, d):
    return L.all_tags(A.library(spark, d))


@query("l3_status_counts", LIB + "select status, count(*) as n, count_if(status <> 'ready')::bigint as attention from library group by status")
def _(spark, d):
    return L.status_counts(A.library(spark, d))


# --- work that arrives over time; jobs and lifecycle events from the events table ---

NOW = "timestamp '2024-01-08 00:00:00'"


def jobs(spark, d):
    e = A.table(spark, d, "events")
    k = F.col("event_id")
    return e.select(k.alias("job_id"), F.col("user_id").alias("document_id"), F.lit("ingest").alias("kind"), F.when(k % 4 == 0, "pending").when(k % 4 == 1, "running").when(k % 4 == 2, "done").otherwise("failed").alias("status"),
                    (k % 5).cast("int").alias("attempts"), F.col("ts").alias("created_at"), F.when(k % 4 == 1, F.col("ts") + F.expr("interval 1 minute")).alias("started_at"), F.lit(None).cast("string").alias("error"))


JOBS = """jobs_t as (select event_id as job_id, user_id as document_id, 'ingest' as kind, case event_id % 4 when 0 then 'pending' when 1 then 'running' when 2 then 'done' else 'failed' end as status, (event_id % 5)::int as attempts, ts as created_at,
  case when event_id % 4 = 1 then ts + interval 1 minute end as started_at from events)"""


@query("m3_enqueue", A.with_(JOBS) + """, p as (select distinct document_id, kind from jobs_t where status = 'pending' and document_id % 3 > 0), r as (select distinct document_id, case when job_id % 5 = 0 then 'refresh' else kind end as kind from jobs_t)
select document_id, kind, 'pending' as status, 0 as attempts from r where (document_id, kind) not in (select document_id, kind from p)""")
def _(spark, d):
    """Requests of two kinds; two documents of three have a pending job of one of them."""
    j = jobs(spark, d)
    requests = j.select("document_id", F.when(F.col("job_id") % 5 == 0, "refresh").otherwise(F.col("kind")).alias("kind"))
    return L.enqueue(j.where("document_id % 3 > 0"), requests).select("document_id", "kind", "status", "attempts")


@query("m4_classify_jobs", A.with_(JOBS) + f"""select job_id, status = 'pending' or (status = 'running' and started_at < {NOW} - interval 15 minute and attempts < 3) as claimable,
case when status = 'running' then case when attempts < 3 then 'pending' else 'failed' end else status end as recovered_status, case when status = 'running' and attempts >= 3 then 'Interrupted too many times' end as recovered_error from jobs_t""")
def _(spark, d):
    return L.classify_jobs(jobs(spark, d), F.expr(NOW)).select("job_id", F.coalesce("claimable", F.lit(False)).alias("claimable"), "recovered_status", "recovered_error")


def lifecycle(spark, d):
    e = A.table(spark, d, "events")
    k = F.col("event_id")
    status = F.when(k % 3 == 0, "queued").when(k % 3 == 1, "processing").when(k % 2 == 0, "failed").otherwise("ready")
    return e.select(F.col("user_id").alias("document_id"), F.col("ts").cast("timestamp").alias("ts"), k.alias("seq"), status.alias("status"), F.col("event_type").alias("stage"),
                    (F.col("value") / 100 - 0.2).alias("progress"), F.when(k % 4 == 0, F.concat(F.lit("detail "), k.cast("string"))).alias("detail"))


LIFE = """life as (select user_id as document_id, ts, event_id as seq, case when event_id % 3 = 0 then 'queued' when event_id % 3 = 1 then 'processing' when event_id % 2 = 0 then 'failed' else 'ready' end as status, event_type as stage, value / 100 - 0.2 as progress, case when event_id % 4 = 0 then 'detail ' || event_id end as detail from events),
last as (select *, row_number() over (partition by document_id order by ts desc, seq desc) as n from life), det as (select document_id, detail, row_number() over (partition by document_id order by ts desc, seq desc) as n from life where detail is not null),
state as (select l.document_id, l.status, case when l.status in ('queued', 'processing') then l.stage end as stage, case when l.status = 'ready' then 1.0 else greatest(0.0, least(1.0, l.progress)) end as progress, det.detail, l.ts as updated_at from last l left join det on det.document_id = l.document_id and det.n = 1 where l.n = 1)"""
STATE = "document_id, status, stage, round(progress, 6) as progress, detail, epoch_us(updated_at) as updated"


def state_columns(df):
    return df.select("document_id", "status", "stage", F.round("progress", 6).alias("progress"), "detail", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated"))


@query("m5_document_status", A.with_(LIFE) + f"select {STATE} from state")
def _(spark, d):
    return state_columns(L.document_status(lifecycle(spark, d)))


@query("m6_stalled", A.with_(LIFE) + f"select {STATE} from state where status in ('queued', 'processing') and updated_at < (select max(ts) from events) - interval 45 second")
def _(spark, d):
    state = L.document_status(lifecycle(spark, d))
    now = A.table(spark, d, "events").agg(F.max("ts").alias("now"))
    return state_columns(L.stalled(state.join(F.broadcast(now)), F.col("now")))


@query("m6_stalled_stream", O["m6_stalled"])
def _(spark, d):
    base = scratch_path(spark)
    lifecycle(spark, d).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("document_id long, ts timestamp, seq long, status string, stage string, progress double, detail string").parquet(f"{base}/in")
    out = stateful.stalled_stream(stream)
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return state_columns(spark.read.schema(stateful.STALLED).parquet(f"{base}/out"))


@query("m7_delete_documents", A.with_(A.LIBRARY, A.CHUNKS, A.PAGES, JOBS) + """, left_c as (select * from chunks where document_id % 3 <> 0), lj as (select * from jobs_t where document_id % 3 <> 0)
select 'documents' as kind, document_id as key, 1::bigint as n from library where document_id % 3 <> 0 union all select 'chunks', chunk_id, 1 from left_c union all select 'pages', document_id, count(*) from pages_t where document_id % 3 <> 0 group by 2
union all select 'postings', chunk_id, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '' and w not in (""" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + """)))::bigint as n from left_c where n > 0
union all select 'jobs', job_id, 1 from lj union all select 'attempts', job_id, attempts from lj where attempts > 0""")
def _(spark, d):
    """Documents with their pages, passages, postings and jobs, and what hangs on the jobs."""
    lib, c, j = A.library(spark, d), A.chunks(spark, d), jobs(spark, d)
    attempts = j.where("attempts > 0").select("job_id", F.explode(F.sequence(F.lit(1), "attempts")).alias("attempt"))
    tables = {"documents": lib.select("document_id"), "chunks": c.select("chunk_id", "document_id"), "pages": A.pages(spark, d).select("document_id", "page"), "postings": K.build_postings(c), "jobs": j.select("job_id", "document_id"), "attempts": attempts}
    left = L.delete_documents(tables, lib.where("document_id % 3 = 0"), {"postings": ("chunks", "chunk_id"), "attempts": ("jobs", "job_id")})
    keys = {"documents": "document_id", "chunks": "chunk_id", "pages": "document_id", "postings": "chunk_id", "jobs": "job_id", "attempts": "job_id"}
    parts = [left[name].groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "key", "n") for name, key in keys.items()]
    return functools.reduce(DataFrame.unionByName, parts)


@query("m8_reprocess", A.with_(LIFE, JOBS) + """select document_id, case when document_id % 2 = 0 then 'queued' else status end as status, case when document_id % 2 = 0 then 'queued' else stage end as stage, round(case when document_id % 2 = 0 then 0 else progress end, 6)::double as progress, case when document_id % 2 <> 0 then detail end as detail,
(document_id % 2 = 0 and document_id not in (select document_id from jobs_t where status = 'pending')) as enqueued from state""")
def _(spark, d):
    state = L.document_status(lifecycle(spark, d))
    docs, new = L.reprocess(state, jobs(spark, d), state.where("document_id % 2 = 0"))
    return docs.join(new.select("document_id", F.lit(True).alias("e")), "document_id", "left").select("document_id", "status", "stage", F.round("progress", 6).alias("progress"), "detail", F.coalesce("e", F.lit(False)).alias("enqueued"))


@query("m9_fold_turns", EVENTS + """, r as (select *, sum(case when type = 'turn' then 1 else 0 end) over (partition by turn_id order by seq) as rn from events_t), l as (select *, max(rn) over (partition by turn_id) as lr from r)
select turn_id, count_if(type = 'search')::bigint as searches, count_if(type = 'read')::bigint as reads, coalesce(string_agg(type || ':' || query, '|' order by seq) filter (type in ('search', 'read')), '') as trail,
coalesce(string_agg(text, '' order by seq) filter (type = 'text' and rn < lr), '') as notes, coalesce(max(text) filter (type = 'done'), string_agg(text, '' order by seq) filter (type = 'text' and rn = lr), '') as answer, case when not bool_or(type in ('done', 'error')) then 'ended unexpectedly' end as error, max(cited) as cited, max(unknown) as unknown, max(verified) as verified, max(input_tokens) as input_tokens, max(output_tokens) as output_tokens from l group by turn_id""")
def _(spark, d):
    return folded_columns(L.fold_turns(answer_events(spark, d)))


def folded_columns(turns):
    lists = {c: F.when(F.col(c).isNotNull(), F.array_join(F.col(c).cast("array<string>"), ",")) for c in ("cited", "unknown", "verified")}
    return turns.withColumns(lists)


@query("m1_stream_ingest", LIB + "select min(document_id) as document_id, sha256 from library where sha256 is not null group by sha256")
def _(spark, d):
    base = scratch_path(spark)
    A.library(spark, d).select("document_id", "title", "sha256").where("sha256 is not null").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("document_id long, title string, sha256 string").parquet(f"{base}/in")
    S.stream_ingest(stream, f"{base}/out", f"{base}/check").awaitTermination()
    return S.latest_documents(spark.read.parquet(f"{base}/out/rows")).select("document_id", "sha256")


#: Two deliveries of files: those of all documents, of which every tenth is no file of the kind wanted; then some changed and some again.
FILES = """with f as (select doc_id, case when doc_id % 10 > 0 then '%PDF-' else '' end || text || chr(10) as body from documents where text is not null),
g as (select doc_id, '%PDF-' || reverse(text) || chr(10) as body from documents where text is not null and doc_id % 7 = 0 and doc_id % 10 > 0 union all select doc_id, body from f where doc_id % 7 <> 0 and doc_id % 5 = 1 and doc_id % 10 > 0),
a as (select doc_id as document_id, sha256(body) as sha256 from f where doc_id % 10 > 0), own as (select sha256, min(document_id) as owner from a group by 1),
b as (select doc_id as document_id, sha256(body) as sha256 from g), free as (select own.* from own left join b on b.document_id = owner where b.sha256 is null or b.sha256 = own.sha256),
win as (select sha256, coalesce(max(owner), min(document_id)) as winner from b left join free using (sha256) group by 1)
"""


@query("m1_ingest_files", FILES + """select owner as document_id, sha256, 'document' as kind from own where owner not in (select document_id from b) union all select document_id, sha256, 'document' from b join win using (sha256) where winner = document_id
union all select doc_id, sha256(body), 'reject' from f where doc_id % 10 = 0""")
def _(spark, d):
    base, k = scratch_path(spark), F.col("document_id")
    t = A.table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("document_id"), "text")
    first = t.select("document_id", F.concat(F.when(k % 10 > 0, "%PDF-").otherwise(""), "text").alias("body"))
    changed = t.where((k % 7 == 0) & (k % 10 > 0)).select("document_id", F.concat(F.lit("%PDF-"), F.reverse("text")).alias("body"))
    again = first.where((k % 7 != 0) & (k % 5 == 1) & (k % 10 > 0))
    document = F.regexp_extract("path", "document_id=([0-9]+)", 1).cast("long")
    for n, files_ in enumerate((first, changed.unionByName(again))):
        name = F.concat(F.lit("document_id="), F.col("document_id").cast("string"), F.lit(".txt"))
        files.write_files(files_.select(name.alias("name"), F.concat("body", F.lit("\n")).cast("binary").alias("body")), f"{base}/inbox/delivery={n}")
        S.ingest_files(spark, f"{base}/inbox", f"{base}/out", f"{base}/check", document, glob="*.txt").awaitTermination()
    rejects = spark.read.schema("document_id long, sha256 string").parquet(f"{base}/out/rejects").withColumn("kind", F.lit("reject"))
    return S.latest_documents(spark.read.parquet(f"{base}/out/rows")).select("document_id", "sha256", F.lit("document").alias("kind")).unionByName(rejects.select("document_id", "sha256", "kind"))


@query("m2_stream_dedupe", LIB + "select sha256 from library where sha256 is not null group by sha256")
def _(spark, d):
    base = scratch_path(spark)
    A.library(spark, d).select("document_id", "sha256", F.current_timestamp().alias("ts")).where("sha256 is not null").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("document_id long, sha256 string, ts timestamp").parquet(f"{base}/in")
    S.stream_dedupe(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("sha256")


@query("m2_first_documents", LIB + "select sha256, min(document_id) as document_id from library where sha256 is not null group by sha256")
def _(spark, d):
    """Three deliveries, one batch each; contents of the first are remembered in the last."""
    base = scratch_path(spark)
    lib = A.library(spark, d).select("document_id", "sha256")
    of = F.floor(F.col("document_id") / F.col("third"))
    cut = lib.join(F.broadcast(lib.agg(F.floor(F.max("document_id") / 3 + 1).alias("third"))))
    for n in range(3):
        cut.where(of == n).select("document_id", "sha256").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("document_id long, sha256 string").parquet(f"{base}/in")
        S.first_documents(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("sha256 string, document_id long").parquet(f"{base}/out")


@query("m5_document_status_stream", A.with_(LIFE) + f"select {STATE} from state")
def _(spark, d):
    base = scratch_path(spark)
    lifecycle(spark, d).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("document_id long, ts timestamp, seq long, status string, stage string, progress double, detail string").parquet(f"{base}/in")

    def put(batch, n):
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/n={n}")

    S.document_status_stream(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out").drop("n")
    newest = out.groupBy("document_id").agg(F.max("batch").alias("batch"))
    return state_columns(out.join(newest, ["document_id", "batch"], "left_semi"))


@query("m9_fold_turns_stream", O["m9_fold_turns"] + " having bool_or(type in ('done', 'error')) or max(at_s) + 600 < (select max(at_s) from events_t)")
def _(spark, d):
    """Of the turns that have not been ended those are told that have been silent for ten minutes when the events end."""
    base = scratch_path(spark)
    answer_events(spark, d).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(files.EVENTS).parquet(f"{base}/in")
    out = stateful.fold_turns_stream(stream)
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return folded_columns(spark.read.schema(stateful.TURN).parquet(f"{base}/out"))
