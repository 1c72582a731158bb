"""Queries of groups I and J: grounding context and audit of answers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions import text as T
from lectern.operators import audit as J
from lectern.operators import context as C
from lectern.operators import quotes as G
from lectern.plans import adapters as A
from lectern.plans.q_library import NORM

Q, O = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f
    return add


CAT = A.LIBRARY + """, cat as (select *, row_number() over (order by coalesce(author, ''), title, document_id) as n from library where coalesce(chunk_count, 0) > 0),
catalog as (select document_id, 'B' || n as ref, title, author, '[B' || n || '] ' || title || coalesce(' — ' || nullif(author, ''), '') || coalesce(' (' || page_count || ' pages)', '') as listing from cat)"""


@query("i1_build_catalog", A.with_(CAT) + "select * from catalog")
def _(spark, d):
    return C.build_catalog(A.library(spark, d))


@query("i1_scoped_catalog", A.with_(A.LIBRARY, A.PARAGRAPHS) + """, sc as (select document_id from library where coalesce(chunk_count, 0) > 0 order by document_id limit 3),
ol as (select document_id, string_agg(chr(10) || repeat('  ', least((seq // 20 % 4)::int, 2) + 1) || text || ' (p. ' || page || ')', '' order by seq) as contents from (select *, row_number() over (partition by document_id order by seq) as n from paragraphs where heading) where n <= 80 group by 1),
cat as (select l.*, row_number() over (order by coalesce(author, ''), title, document_id) as n from library l semi join sc using (document_id))
select document_id, 'B' || n as ref, title, author, '[B' || n || '] ' || title || coalesce(' — ' || nullif(author, ''), '') || coalesce(' (' || page_count || ' pages)', '') || coalesce(contents, '') as listing from cat left join ol using (document_id)""")
def _(spark, d):
    """Three documents in scope, with their contents: the headings of their lines."""
    lib, p = A.library(spark, d), A.paragraphs(spark, d).where("heading")
    outline = p.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text", "page"))), lambda x: F.struct(x["text"].alias("title"), x["page"].alias("page"), (F.floor(x["seq"] / 20) % 4).cast("int").alias("level"))).alias("outline"))
    scope = lib.where("coalesce(chunk_count, 0) > 0").select("document_id").orderBy("document_id").limit(3)
    return C.build_catalog(lib.join(outline, "document_id", "left"), scope, "outline")


def turns(spark, d):
    """A user's row and the answer after it are a turn."""
    c = A.table(spark, d, "conversations")
    q = c.where("role = 'user'").select(F.col("conv_id").alias("thread_id"), F.col("turn").cast("int").alias("turn"), F.col("text").alias("question"))
    return q


TURNS = "turns as (select conv_id as thread_id, turn::int as turn, text as question from conversations where role = 'user')"


@query("i2_contextual_query", A.with_(TURNS) + r", l as (select *, lag(question) over (partition by thread_id order by turn) as p from turns) select thread_id, turn, case when p is not null and len(regexp_extract_all(question, '\S+')) < 12 then p || chr(10) || question else question end as search_query from l")
def _(spark, d):
    return C.contextual_query(turns(spark, d)).select("thread_id", "turn", "search_query")


def cited(spark, d):
    t = turns(spark, d)
    return t.select("thread_id", "turn", F.explode(F.array(F.lit(1), F.lit(2))).alias("i")).select("thread_id", "turn", F.concat(F.lit("P"), ((F.col("turn") + F.col("i")) % 3).cast("string")).alias("passage_id"), (F.col("thread_id") * 100 + F.col("turn") * 3 + F.col("i")).cast("string").alias("source_key"))


CITED = "cited as (select thread_id, turn, 'P' || ((turn + i) % 3) as passage_id, (thread_id * 100 + turn * 3 + i)::varchar as source_key from turns, unnest([1, 2]) as r(i))"


@query("i3_history_window", A.with_(TURNS, CITED) + ", l as (select * from (select *, row_number() over (partition by thread_id order by turn desc) as n from turns) where n <= 2) select c.thread_id, c.passage_id, arg_max(c.source_key, c.turn) as source_key, max(c.turn) as turn from cited c join l on l.thread_id = c.thread_id and l.turn = c.turn group by 1, 2")
def _(spark, d):
    return C.history_window(turns(spark, d), cited(spark, d), 2)[1]


def retrieved(spark, d):
    """Sources that a thread meets: some again, some with carried ids, of which some clash."""
    c = A.table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("thread_id"), F.col("turn").cast("long").alias("seq"), (F.col("turn") % 4 + F.col("conv_id") % 2).cast("string").alias("source_key"), F.when(F.col("turn") < 2, F.concat(F.lit("P"), (F.col("conv_id") % 3 + 1).cast("string"))).alias("forced_id"))


@query("i4_register_passages", """with r as (select conv_id as thread_id, turn::bigint as seq, (turn % 4 + conv_id % 2)::varchar as source_key, case when turn < 2 then 'P' || (conv_id % 3 + 1) end as forced_id from conversations),
f as (select * from (select *, row_number() over (partition by thread_id, source_key order by seq) as n from r) where n = 1), k as (select *, forced_id is not null and row_number() over (partition by thread_id, forced_id order by seq) = 1 as kept from f),
m as (select *, coalesce(max(case when kept then substr(forced_id, 2)::int end) over (partition by thread_id), 0) as mx, sum(case when kept then 0 else 1 end) over (partition by thread_id order by seq rows unbounded preceding) as fr from k)
select thread_id, source_key, case when kept then forced_id else 'P' || (mx + fr) end as passage_id from m""")
def _(spark, d):
    return C.register_passages(retrieved(spark, d))


def refs(spark, d):
    c = A.chunks(spark, d).where("ordinal = 0 or ordinal = 7")
    return c.select(F.col("document_id").alias("thread_id"), F.concat(F.lit("P"), (F.col("ordinal") + 1).cast("string")).alias("passage_id"), F.when(F.col("ordinal") == 0, F.col("chunk_id")).alias("chunk_id"), "document_id", F.col("page_start").alias("page"))


ALL = A.with_(A.LIBRARY, A.CHUNKS, A.PAGES).rstrip()
RESTORED = """, rs as (select c.document_id as thread_id, 'P' || (ordinal + 1) as passage_id, case when ordinal = 0 then 'chunk' else 'page' end as kind, c.document_id, page_start, page_end,
  case when ordinal = 0 then c.chapter else (select arg_max(x.chapter, x.page_start::bigint * 1000000000 + x.ordinal) from chunks x where x.document_id = c.document_id and x.page_start <= c.page_start) end as chapter,
  case when ordinal = 0 then c.text else p.text end as text, l.title, l.author, p.label as label_start, p.label as label_end
  from chunks c join library l on l.document_id = c.document_id left join pages_t p on p.document_id = c.document_id and p.page = c.page_start where ordinal in (0, 7))"""


def restored(spark, d):
    return C.restore_passages(refs(spark, d), A.chunks(spark, d), A.library(spark, d), A.pages(spark, d))


@query("i5_restore_passages", ALL + RESTORED + " select * from rs")
def _(spark, d):
    return restored(spark, d)


@query("i6_page_passages", ALL + """, rq as (select doc_id as request_id, doc_id as document_id, 2 as f, 4 as t from documents), ch as (select request_id, arg_max(chapter, page_start::bigint * 1000000000 + ordinal) as chapter from rq join chunks using (document_id) where page_start <= t group by 1)
select request_id, p.page as page_start, ch.chapter, p.text, l.title, p.label as label_start from rq join pages_t p on p.document_id = rq.document_id and p.page between f and t join library l on l.document_id = rq.document_id left join ch using (request_id)""")
def _(spark, d):
    rq = A.table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.col("doc_id").alias("document_id"), F.lit(2).alias("from_page"), F.lit(4).alias("to_page"))
    return C.page_passages(rq, A.pages(spark, d), A.library(spark, d), A.chunks(spark, d)).select("request_id", "page_start", "chapter", "text", "title", "label_start")


ESC = "replace(replace(replace({0}, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;')"


@query("i7_assemble_context", A.with_(CAT, A.CHUNKS, A.PAGES).rstrip() + RESTORED + f""", bl as (select rs.*, c.listing, c.ref, substr(passage_id, 2)::bigint as no, '<passage id="' || passage_id || '" book="' || coalesce(c.ref, '?') || '" title="' || {ESC.format('rs.title')} || '"' || coalesce(' author="' || {ESC.format('rs.author')} || '"', '')
 || ' pages="p. ' || coalesce(label_start, page_start::varchar) || '"' || case when label_start <> page_start::varchar then ' pdf_pages="' || page_start || '"' else '' end || coalesce(' chapter="' || {ESC.format('chapter')} || '"', '') || '>' || chr(10) || rs.text || chr(10) || '</passage>' as block from rs left join catalog c using (document_id)),
ag as (select thread_id, max(listing) as books, string_agg(block, chr(10) || chr(10) order by no) filter (kind = 'chunk') as earlier, string_agg(block, chr(10) || chr(10) order by no) filter (kind = 'page') as newer from bl group by 1)
select l.document_id as thread_id, concat_ws(chr(10) || chr(10), 'BOOKS' || chr(10) || books, 'EARLIER PASSAGES' || chr(10) || earlier, 'PASSAGES' || chr(10) || newer, 'QUESTION' || chr(10) || 'What of ' || l.title || '?') as context from library l left join ag on ag.thread_id = l.document_id""")
def _(spark, d):
    lib = A.library(spark, d)
    p = restored(spark, d).withColumn("is_new", F.col("kind") == "page")
    q = lib.select(F.col("document_id").alias("thread_id"), F.concat(F.lit("What of "), "title", F.lit("?")).alias("question"))
    return C.assemble_context(p, C.build_catalog(lib), q)


REQ = """rq as (select conv_id * 1000 + turn as request_id, conv_id as thread_id, case when role = 'user' then 'search' else 'read' end as kind, case when turn % 5 = 4 then '' else text end as query,
  case when turn % 8 = 7 then list_transform(range(1, 52), lambda i: 'B' || i) when turn % 4 = 0 then [' b' || (conv_id + 1), 'B99999999'] when turn % 4 = 1 then ['X9'] when turn % 4 = 2 then []::varchar[] end as refs, case when turn % 3 = 0 then (turn + 7)::int end as lim, turn - 1 as first from conversations)"""


@query("i8_resolve_requests", A.with_(CAT, REQ) + """, br as (select *, case when kind = 'search' and length(trim(query)) not between 1 and 500 then 'query must have 1 to 500 characters' when len(refs) > 50 then 'at most 50 books'
  when coalesce(lim, 8) not between 1 and 12 then 'limit must be 1 to 12' when kind = 'read' and first < 1 then 'pages begin at 1' end as broken from rq),
e as (select distinct request_id, upper(trim(unnest(refs))) as ref from br where broken is null), m as (select e.*, c.document_id from e left join catalog c using (ref)),
k as (select request_id, coalesce(string_agg(document_id::varchar, ',' order by document_id::varchar) filter (document_id is not null), '') as documents, coalesce(string_agg(ref, ',' order by ref) filter (document_id is null), '') as unknown from m group by 1)
select request_id, kind, query, case when broken is not null then '' when len(refs) > 0 then documents else thread_id::varchar end as documents, coalesce(unknown, '') as unknown, coalesce(lim, 8) as "limit",
coalesce(broken, case when len(refs) > 0 and documents = '' then 'no such books' end) as error from br left join k using (request_id)""")
def _(spark, d):
    c = A.table(spark, d, "conversations")
    none = F.expr("cast(array() as array<string>)")
    t = F.col("turn")
    refs_ = F.when(t % 8 == 7, F.transform(F.sequence(F.lit(1), F.lit(51)), lambda i: F.concat(F.lit("B"), i.cast("string")))).when(t % 4 == 0, F.array(F.concat(F.lit(" b"), (F.col("conv_id") + 1).cast("string")), F.lit("B99999999"))).when(t % 4 == 1, F.array(F.lit("X9"))).when(t % 4 == 2, none)
    r = c.select((F.col("conv_id") * 1000 + t).alias("request_id"), F.col("conv_id").alias("thread_id"), F.when(F.col("role") == "user", "search").otherwise("read").alias("kind"),
                 F.when(t % 5 == 4, "").otherwise(F.col("text")).alias("query"), refs_.alias("refs"), F.when(t % 3 == 0, (t + 7).cast("int")).alias("limit"), (t - 1).alias("start_page"), (t + 1).alias("end_page"))
    scope = c.select(F.col("conv_id").alias("thread_id"), F.col("conv_id").cast("string").alias("documents")).distinct()
    return C.resolve_requests(r, C.build_catalog(A.library(spark, d)), scope)


# --- answers: one for each document, its first line cited and quoted, rightly and wrongly; all its lines are the thread's passages ---

def passages(spark, d):
    p = A.paragraphs(spark, d)
    return p.select(F.col("document_id").alias("thread_id"), F.concat(F.lit("P"), (F.col("seq") + 1).cast("string")).alias("passage_id"), "text")


def answers(spark, d):
    t = A.table(spark, d, "documents").where("text is not null")
    w = F.split(F.regexp_replace("text", '["“”\\[\\]<>]', ""), r"\s+")
    real = F.array_join(F.slice(w, 1, 5), " ")
    return t.select(F.col("doc_id").alias("answer_id"), F.col("doc_id").alias("thread_id"), F.concat(
        F.lit('As said [P1][P7] "'), real, F.lit('" and [P2; P9] “'), F.array_join(F.slice(w, 1, 3), " "), F.lit(" ... "), F.array_join(F.slice(w, 7, 3), " "), F.lit('” <synthesis>on p. 42 and pages 10–12'), F.when(F.col("doc_id") % 2 == 0, "</synthesis> <outside>never ").otherwise(""), F.lit(' "an invented sentence of no book" '), F.when(F.col("doc_id") % 3 == 0, "[P3, P2]</outside>").otherwise("<synth")).alias("text"))


ANSWERS = A.PARAGRAPHS + r""",
ps as (select document_id as thread_id, 'P' || (seq + 1) as passage_id, text from paragraphs),
aw as (select doc_id, regexp_split_to_array(regexp_replace(text, '["“”\[\]<>]', '', 'g'), '\s+') as w from documents where text is not null),
answers as (select doc_id as answer_id, doc_id as thread_id, 'As said [P1][P7] "' || array_to_string(w[1:5], ' ') || '" and [P2; P9] “' || array_to_string(w[1:3], ' ') || ' ... ' || array_to_string(w[7:9], ' ') || '” <synthesis>on p. 42 and pages 10–12' ||
  case when doc_id % 2 = 0 then '</synthesis> <outside>never ' else '' end || ' "an invented sentence of no book" ' || case when doc_id % 3 = 0 then '[P3, P2]</outside>' else '<synth' end as text from aw)"""
CITES = r"""ci as (select answer_id, thread_id, flatten(list_transform(regexp_extract_all(text, '\[((?:P\d+)(?:\s*[,;]\s*P\d+)*)\]', 1), lambda g: regexp_split_to_array(g, '\s*[,;]\s*'))) as ids from answers)"""
QUOTES = r"""qu as (select answer_id, thread_id, list_filter(list_transform(regexp_extract_all(text, '[“"]([^“”"]{12,}?)[”"]', 1), lambda q: trim(q)), lambda q: len(regexp_split_to_array(q, '\s+')) >= 4) as qs from answers)"""


@query("j1_extract_citations", A.with_(ANSWERS, CITES) + "select answer_id, array_to_string(ids, ',') as ids from ci")
def _(spark, d):
    return answers(spark, d).select("answer_id", F.array_join(T.extract_citations(F.col("text")), ",").alias("ids"))


@query("j2_page_mentions", A.with_(ANSWERS) + r"select answer_id, array_to_string(regexp_extract_all(text, '(?i)\b(?:pp?\.|pages?)\s*[\divxlc]+(?:\s*[–-]\s*[\divxlc]+)?\b'), ',') as mentions from answers")
def _(spark, d):
    return answers(spark, d).select("answer_id", F.array_join(T.page_mentions(F.col("text")), ",").alias("mentions"))


CHECKED = ", ce as (select answer_id, thread_id, ids[i] as passage_id, min(i - 1)::int as pos from ci, unnest(range(1, len(ids) + 1)) as r(i) group by 1, 2, 3), cc as (select answer_id, pos, ce.passage_id, p.thread_id is not null as known from ce left join ps p on p.thread_id = ce.thread_id and p.passage_id = ce.passage_id)"


@query("j3_check_citations", A.with_(ANSWERS, CITES).rstrip() + CHECKED + " select * from cc")
def _(spark, d):
    return J.check_citations(answers(spark, d), passages(spark, d))


@query("j4_extract_quotes", A.with_(ANSWERS, QUOTES) + "select answer_id, array_to_string(qs, '|') as quotes from qu")
def _(spark, d):
    return answers(spark, d).select("answer_id", F.array_join(T.extract_quotes(F.col("text")), "|").alias("quotes"))


VERIFIED = r""", qe as (select answer_id, thread_id, (i - 1)::int as pos, qs[i] as quote from qu, unnest(range(1, len(qs) + 1)) as r(i)),
qf as (select *, list_filter(list_transform(regexp_split_to_array(regexp_replace(quote, '\[[^\]]*\]', '…', 'g'), '\s*(?:\.\s?\.\s?\.|…)\s*'), lambda f: """ + NORM.format("f") + r"""), lambda f: len(string_split(f, ' ')) >= 2) as fs from qe),
hit as (select answer_id, pos, p.passage_id from qf join ps p using (thread_id) where len(fs) > 0 and len(list_filter(fs, lambda f: not contains(""" + NORM.format("p.text") + r""", f))) = 0),
fo as (select answer_id, pos, string_agg(distinct passage_id, ',' order by passage_id) as found_in from hit group by 1, 2), qv as (select answer_id, pos, quote, found_in is not null as verified, coalesce(found_in, '') as found_in from qe left join fo using (answer_id, pos))"""


@query("j5_check_quotes", A.with_(ANSWERS, QUOTES).rstrip() + VERIFIED + " select * from qv")
def _(spark, d):
    return J.check_quotes(answers(spark, d), passages(spark, d))


@query("j5_library_quotes", A.with_(ANSWERS, A.CHUNKS.removeprefix(A.PARAGRAPHS + ",\n"), QUOTES).rstrip() + VERIFIED.split(",\nhit as")[0] + r""",
nm as materialized (select chunk_id, """ + NORM.format("text") + r""" as n from chunks), df as (select distinct fs from qf where len(fs) > 0),
lf as (select fs, count(*) as passages, min(chunk_id) as first_passage from df join nm on contains(n, fs[1]) and len(list_filter(fs, lambda f: not contains(n, f))) = 0 group by 1)
select answer_id, pos, quote, passages is not null as verified, coalesce(passages, 0) as passages, first_passage from qf left join lf using (fs)""")
def _(spark, d):
    """The same quotations in all documents."""
    return G.check_library_quotes(answers(spark, d), A.chunks(spark, d).select(F.col("chunk_id").alias("passage_id"), "text"))


@query("j6_segment_answer", A.with_(ANSWERS) + r""", p as (select answer_id, string_split(regexp_replace(regexp_replace(text, '(?i)</?[a-z]*$', ''), '<(/?)(synthesis|outside)>', chr(1) || '\1\2' || chr(2), 'g'), chr(1)) as parts from answers),
e as (select answer_id, i, parts[i] as part from p, unnest(range(1, len(parts) + 1)) as r(i)), k as (select answer_id, i, case when not contains(part, chr(2)) or part like '/%' then 'text' else string_split(part, chr(2))[1] end as kind, case when contains(part, chr(2)) then substr(part, instr(part, chr(2)) + 1) else part end as body from e),
n as (select *, case when lag(kind) over w is not distinct from kind then 0 else 1 end as nw from k where trim(regexp_replace(body, '\s', '', 'g')) <> '' window w as (partition by answer_id order by i)), g as (select *, sum(nw) over (partition by answer_id order by i rows unbounded preceding) - 1 as pos from n)
select answer_id, pos::bigint as pos, kind, string_agg(body, '' order by i) as body from g group by 1, 2, 3""")
def _(spark, d):
    return J.segment_answer(answers(spark, d))


@query("j7_link_citations")
def _(spark, d):
    return answers(spark, d).select("answer_id", T.link_citations(F.col("text")).alias("linked"))


O["j7_link_citations"] = A.with_(ANSWERS) + r"""select answer_id, replace(replace(replace(replace(replace(text, '[P1]', '[P1](cite:P1)'), '[P7]', '[P7](cite:P7)'), '[P2; P9]', '[P2](cite:P2)[P9](cite:P9)'), '[P3, P2]', '[P3](cite:P3)[P2](cite:P2)'), '', '') as linked from answers"""


@query("j8_audit_summary", A.with_(ANSWERS, CITES, QUOTES).rstrip() + CHECKED + VERIFIED + r""", c as (select answer_id, count_if(known)::bigint as cited, count_if(not known)::bigint as unknown from cc group by 1), q as (select answer_id, count_if(verified)::bigint as verified, count(*) as quotes from qv group by 1), n as (select thread_id, count(*) as consulted from ps group by 1)
select a.answer_id, coalesce(cited, 0) as cited, coalesce(unknown, 0) as unknown, coalesce(verified, 0) as verified, coalesce(quotes, 0) as quotes, coalesce(consulted, 0) as consulted, len(regexp_extract_all(text, '(?i)\b(?:pp?\.|pages?)\s*[\divxlc]+(?:\s*[–-]\s*[\divxlc]+)?\b'))::bigint as mentions, coalesce(consulted, 0) - coalesce(cited, 0) as uncited
from answers a left join c using (answer_id) left join q using (answer_id) left join n on n.thread_id = a.thread_id""")
def _(spark, d):
    return J.audit_summary(answers(spark, d), passages(spark, d))


#: Each target is part of its page here, so that it covers the place where it stands first; chains of windows have unit tests.
LOCATED = A.with_(A.PARAGRAPHS).rstrip() + f""",
sp as (select document_id, page, seq, replace({NORM.format("text")}, ' ', '') as t, replace({NORM.format("text || coalesce(' ' || after, '')")}, ' ', '') as target
  from (select *, lead(text) over (partition by document_id, page order by seq) as after from paragraphs)),
ends as (select *, sum(length(t)) over (partition by document_id, page order by seq) as b from sp),
whole as (select document_id, page, string_agg(t, '' order by seq) as t from sp group by 1, 2),
pos as (select document_id, page, seq, instr(w.t, target) - 1 as lo, length(target) as n from sp join whole w using (document_id, page) where length(target) >= 8)
"""


@query("j9_locate_passage", LOCATED + "select p.document_id * 1000000000 + p.seq as target_id, e.seq::bigint as idx from pos p join ends e using (document_id, page) where lo >= 0 and b - length(t) < lo + n and lo < b")
def _(spark, d):
    """A page's lines are spans; each line, together with the one after it on its page if there is one, is sought in its page."""
    p = A.paragraphs(spark, d).withColumn("page_key", F.struct("document_id", "page"))
    spans = p.select("page_key", F.col("seq").cast("long").alias("idx"), "text")
    after = F.lead("text").over(W.partitionBy("page_key").orderBy("seq"))
    return J.locate_passage(spans, p.select((F.col("document_id") * 1_000_000_000 + F.col("seq")).alias("target_id"), "page_key", F.concat_ws(" ", "text", after).alias("text")))
