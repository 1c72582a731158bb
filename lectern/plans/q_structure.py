"""Queries of groups C and D: document structure and passages."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lectern.functions import text as T
from lectern.functions.text import tidy_title
from lectern.operators import library as L
from lectern.operators import passages as P
from lectern.operators import structure as S
from lectern.plans import adapters as A
from lectern.plans.q_library import tidy_sql

Q, O = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f
    return add


def lines(spark, d):
    """Lines of the documents' paragraphs, with a running header (the source) and a page number on each page."""
    p = A.paragraphs(spark, d)
    k = F.col("seq")
    body = p.select("document_id", "page", k.alias("seq"), "text", (F.lit(72.0) + F.when(k % 7 == 3, 20.0).otherwise(0.0)).alias("x"),
                    (F.lit(72.0) + F.when(k % 7 == 3, 20.0).otherwise(0.0) + 5.0 * F.length("text")).alias("x_end"), (F.col("y") - F.when(k % 5 >= 3, 12.0).otherwise(0.0)).alias("y"), F.when(F.col("heading"), 16.0).otherwise(10.0).alias("size"))
    pages = p.select("document_id", "page").distinct().join(A.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source"), "document_id")
    head = pages.select("document_id", "page", (F.col("page") * 5 - 5).cast("int").alias("n"), F.concat(F.lit("Running "), "source").alias("h"), F.col("page").cast("string").alias("t"))
    top = head.select("document_id", "page", (F.col("n") - 1_000_000).alias("seq"), F.col("h").alias("text"), F.lit(72.0).alias("x"), F.lit(150.0).alias("x_end"), F.lit(760.0).alias("y"), F.lit(9.0).alias("size"))
    low = head.select("document_id", "page", (F.col("n") + 1_000_000).alias("seq"), F.col("t").alias("text"), F.lit(300.0).alias("x"), F.lit(310.0).alias("x_end"), F.lit(30.0).alias("y"), F.lit(9.0).alias("size"))
    return body.unionByName(top).unionByName(low)


LINES = A.PARAGRAPHS + """,
pg as (select distinct p.document_id, p.page, d.source from paragraphs p join documents d on d.doc_id = p.document_id),
lines as (select document_id, page, seq, text, 72.0::double + case when seq % 7 = 3 then 20 else 0 end as x, 72.0::double + case when seq % 7 = 3 then 20 else 0 end + 5.0 * length(text) as x_end,
    y - case when seq % 5 >= 3 then 12 else 0 end as y, case when heading then 16.0::double else 10.0::double end as size from paragraphs
  union all select document_id, page, page * 5 - 5 - 1000000, 'Running ' || source, 72.0, 150.0, 760.0, 9.0 from pg
  union all select document_id, page, page * 5 - 5 + 1000000, page::varchar, 300.0, 310.0, 30.0, 9.0 from pg)"""
BODY = """bw as (select document_id, round(size * 2) / 2 as k, sum(length(text)) as w, min(page * 10000000 + seq) as first_at from lines group by all),
body as (select document_id, arg_max(k, w * 100000000000 - first_at) as body_size from bw group by document_id)"""
#: Paragraphs of the body lines alone (no header or number), as the structure steps make them.
PARAS = """bl as (select * from lines where abs(seq) < 900000),
bbw as (select document_id, round(size * 2) / 2 as k, sum(length(text)) as w, min(page * 10000000 + seq) as first_at from bl group by all),
bb as (select document_id, arg_max(k, w * 100000000000 - first_at) as body_size from bbw group by document_id),
l1 as (select bl.*, body_size, size >= 1.2 * body_size and length(text) <= 160 and regexp_matches(text, '\\p{L}') as heading from bl join bb using (document_id)),
l2 as (select *, lag(y) over w as p_y, lag(x_end) over w as p_x_end, lag(text) over w as p_text, lag(heading) over w as p_heading, lag(y) over w - y as gap from l1 window w as (partition by document_id, page order by seq)),
st as (select document_id, page, list_sort(list(x) filter (not heading))[(count(*) filter (not heading)) // 2 + 1] as m_left, arg_min(x, seq) as x_first, greatest(coalesce(max(x_end) filter (not heading), 0), 0) as right_, list_sort(list(gap) filter (gap > 0 and gap < 3 * size))[(count(*) filter (gap > 0 and gap < 3 * size)) // 2 + 1] as m_gap from l2 group by all),
l3 as (select l2.*, coalesce(nullif(m_left, 0), x_first) as left_, coalesce(nullif(m_gap, 0), body_size * 1.3) as line_gap, right_ from l2 join st using (document_id, page)),
l4 as (select *, case when p_text is null then 1 when (heading <> p_heading or gap < -size or gap > line_gap * 1.45 or (x > left_ + size * 0.8 and x < left_ + size * 8 and not heading) or (right_ > 0 and p_x_end < right_ - size * 2.5 and regexp_matches(p_text, '[.!?:;"''”’)\\]]$')))
  and not (not heading and not p_heading and gap >= -size and gap < line_gap * 2.5 and regexp_matches(text, '^\\p{Ll}') and not regexp_matches(p_text, '[.!?:;"''”’)\\]]$')) then 1 else 0 end as start_ from l3),
l5 as (select *, sum(start_) over (partition by document_id, page order by seq rows unbounded preceding) as para from l4),
l6 as (select *, lead(text) over (partition by document_id, page, para order by seq) as nxt from l5),
l7 as (select *, case when nxt is not null and ((regexp_matches(text, '\\p{L}[-­]$') and regexp_matches(nxt, '^\\p{Ll}')) or text like '%­') then substr(text, 1, length(text) - 1) when nxt is not null then text || ' ' else text end as piece from l6),
paras as (select document_id, page, min(seq) as seq, trim(regexp_replace(string_agg(piece, '' order by seq), '\\s+', ' ', 'g')) as text, arg_min(y, seq) as y, arg_min(heading, seq) as heading from l7 group by document_id, page, para)"""


def body_lines(spark, d):
    return lines(spark, d).where(F.abs("seq") < 900_000)


def paras(spark, d):
    return S.build_paragraphs(body_lines(spark, d))


@F.pandas_udf(ArrayType(IntegerType()))
def starts(lengths: pd.Series) -> pd.Series:
    """Where each of a line's words begins, from their lengths."""
    return lengths.map(lambda n: np.cumsum(n + 1) - n - 1)


@query("c1_assemble_lines")
def _(spark, d):
    p = A.paragraphs(spark, d)
    words = p.select("document_id", "page", F.col("seq").alias("line"), "y", "heading", F.split("text", " ").alias("ws"))
    words = words.withColumn("before", starts(F.transform("ws", F.length)))
    words = words.select("document_id", "page", "line", "y", "heading", F.size("ws").alias("n"), F.posexplode(F.arrays_zip(F.col("ws").alias("str"), F.col("before"))).alias("i", "w")).select("*", "w.str", "w.before").drop("w")
    size = F.when(F.col("heading"), 16.0).otherwise(10.0)
    items = words.select("document_id", "page", (F.col("line") * 100_000 + F.col("i")).alias("seq"), "str", (F.lit(72.0) + 5.0 * F.col("before")).alias("x"), "y", size.alias("size"), (5.0 * F.length("str")).alias("width"), (F.col("i") == F.col("n") - 1).alias("eol"))
    return S.assemble_lines(items)


O["c1_assemble_lines"] = A.with_(A.PARAGRAPHS) + r"""select document_id, page, (row_number() over (partition by document_id, page order by seq) - 1)::int as seq, trim(regexp_replace(text, '\s+', ' ', 'g')) as text, 72.0::double as x,
72.0::double + 5.0 * length(text) as x_end, y, case when heading then 16.0::double else 10.0::double end as size from paragraphs"""


@query("c2_body_size", A.with_(LINES, BODY) + "select * from body")
def _(spark, d):
    return S.body_size(lines(spark, d))


@query("c3_strip_running_lines", A.with_(LINES, BODY) + r""", t as (select *, row_number() over (partition by document_id, page order by y desc, seq) as tp, row_number() over (partition by document_id, page order by y, seq desc) as lo, trim(regexp_replace(regexp_replace(lower(text), '\d+', '#', 'g'), '\s+', ' ', 'g')) as k from lines),
n as (select document_id, count(distinct page) as n from lines group by 1), c as (select document_id, k, count(distinct page) as c from t where tp <= 2 or lo <= 2 group by 1, 2)
select document_id, page, seq, text from t join body using (document_id) join n using (document_id) left join c using (document_id, k)
where not ((tp <= 2 or lo <= 2) and size < 1.2 * body_size and (regexp_matches(text, '(?i)^[\s\-–—|.·•]*(?:page\s*)?(?:\d{1,4}|[ivxlcdm]{1,7})[\s\-–—|.·•]*$') or (length(text) <= 120 and coalesce(c, 0) >= greatest(3, ceil(n * 0.04)))))""")
def _(spark, d):
    return S.strip_running_lines(lines(spark, d)).select("document_id", "page", "seq", "text")


@query("c4_build_paragraphs", A.with_(LINES, PARAS) + "select document_id, page, seq, text, y, heading from paras where text <> ''")
def _(spark, d):
    return paras(spark, d)


@query("c5_page_texts", A.with_(LINES, PARAS) + r"""select document_id, page, string_agg(text, chr(10) || chr(10) order by seq) as text, length(regexp_replace(string_agg(text, '' order by seq), '\s', '', 'g')) as char_count, length(regexp_replace(string_agg(text, '' order by seq), '\s', '', 'g')) < 25 as empty from paras where text <> '' group by 1, 2""")
def _(spark, d):
    return S.page_texts(paras(spark, d))


@query("c6_mark_continuations", A.with_(LINES, PARAS) + r""", n as (select *, lag(text) over w as pt, lag(page) over w as pp, lag(heading) over w as ph, lead(text) over w as nt, lead(page) over w as np, lead(heading) over w as nh from paras where text <> '' window w as (partition by document_id order by page, seq))
select document_id, page, seq, case when np <> page and not heading and not nh and regexp_matches(text, '\p{L}[-­]$') and regexp_matches(nt, '^\p{Ll}') then substr(text, 1, length(text) - 1) else text end as text,
case when pp <> page and not heading and not ph then case when regexp_matches(pt, '\p{L}[-­]$') and regexp_matches(text, '^\p{Ll}') then 'nospace' when not regexp_matches(pt, '[.!?:;"''”’)\]…]$') and (regexp_matches(text, '^[\p{Ll},;)\]’”]') or not regexp_matches(right(pt, 40), '[.!?]')) then 'space' end end as continues from n""")
def _(spark, d):
    return S.mark_continuations(paras(spark, d)).select("document_id", "page", "seq", "text", "continues")


def outline_nodes(spark, d):
    """A tree per nation: the nation, its market segments, its customers."""
    c = A.table(spark, d, "customer").join(A.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    doc = F.col("c_nationkey").cast("long").alias("document_id")
    none = F.lit(None).cast("string")
    roots = c.select(doc, F.lit("r").alias("node_id"), none.alias("parent_id"), F.col("n_name").alias("title"), F.lit(1).alias("page"), F.lit(None).cast("double").alias("y")).distinct()
    mid = c.select(doc, F.col("c_mktsegment").alias("node_id"), F.lit("r").alias("parent_id"), F.col("c_mktsegment").alias("title"), (F.length("c_mktsegment") * 3).alias("page"), F.lit(700.0).alias("y")).distinct()
    leaf = c.select(doc, F.col("c_custkey").cast("string").alias("node_id"), F.col("c_mktsegment").alias("parent_id"), F.col("c_name").alias("title"), (F.col("c_custkey") % 90 + 1).cast("int").alias("page"), F.round("c_acctbal").alias("y"))
    return roots.unionByName(mid).unionByName(leaf)


@query("c7_flatten_outline", "with recursive c as (select c_nationkey::bigint as document_id, n_name, c_mktsegment, c_custkey, c_name, c_acctbal from customer join nation on c_nationkey = n_nationkey), nodes as (select distinct document_id, 'r' as node_id, null::varchar as parent_id, n_name as title0, 1::bigint as page, null::double as y from c union all select distinct document_id, c_mktsegment, 'r', c_mktsegment, length(c_mktsegment) * 3, 700.0 from c union all select document_id, c_custkey::varchar, c_mktsegment, c_name, c_custkey % 90 + 1, round(c_acctbal) from c), nd as (select *, " + tidy_sql("title0") + """ as title from nodes),
walk as (select document_id, node_id, page, y, 0 as level, [title] as path from nd where parent_id is null union all select n.document_id, n.node_id, n.page, n.y, w.level + 1, list_append(w.path, n.title) from walk w join nd n on n.document_id = w.document_id and n.parent_id = w.node_id)
select document_id, node_id, page::int as page, coalesce(y, 1e9) as y, greatest(level - 1, 0)::int as level, array_to_string(case when len(path) > 1 then (path[2:])[-2:] else path end, ' › ') as label from walk""")
def _(spark, d):
    return S.flatten_outline(outline_nodes(spark, d)).withColumn("y", F.least("y", F.lit(1e9)))


def heading_paragraphs(spark, d):
    """Paragraphs of which some begin like headings of units or run in."""
    p = A.paragraphs(spark, d)
    k = F.col("seq")
    text = F.when(k % 9 == 4, F.concat(F.lit("Chapter "), (k % 12).cast("string"), F.lit(" "), F.substring("text", 1, 30))).when(k % 31 == 7, F.concat(F.lit("OF THE THINGS.—"), "text")).otherwise(F.col("text"))
    return p.withColumn("text", text)


HP = A.PARAGRAPHS + """, hp as (select document_id, seq, page, y, heading, case when seq % 9 = 4 then 'Chapter ' || (seq % 12) || ' ' || substr(text, 1, 30) when seq % 31 = 7 then 'OF THE THINGS.—' || text else text end as text from paragraphs)"""
HEADS = HP + r""",
h1 as (select *, not heading and length(text) <= 80 and (regexp_matches(text, '(?i)^(chapter|book|part|section|letter|canto|act|scene|lecture|essay)\s+([ivxlcdm]+|\d+|[a-z]+)\b') or regexp_matches(text, '^(?:[\p{Lu}\d.''’]+\s+){0,3}(?:BOOK|CHAPTER|PART|SECTION|INTRODUCTION|PREFACE|PROLOGUE|EPILOGUE|APPENDIX|CONCLUSION|AFTERWORD|FOREWORD|LETTER|LECTURE)(?:\s+[\p{Lu}\d.''’]+){0,3}$')) as pat from hp),
h2 as (select *, case when not heading and not pat then regexp_extract(text, '^((?:[A-Z][A-Z''’,;\-]*\s+){2,}[A-Z][A-Z''’,;\-]*)[.:]?\s*[—–]\s*\S', 1) else '' end as run_in, heading and coalesce((lag(heading) over w or lag(pat) over w) and lag(page) over w = page, false) as joins_ from h1 window w as (partition by document_id order by page, seq)),
h3 as (select *, sum(case when (heading or pat) and not joins_ then 1 else 0 end) over (partition by document_id order by page, seq rows unbounded preceding) as island from h2),
h4 as (select *, row_number() over (partition by document_id, island order by page, seq) - 1 as n from h3 where heading or pat),
h5 as (select document_id, page, island, n // 3 as g, min(seq) as seq, arg_min(y, seq) as y, string_agg(text, ' — ' order by seq) as label from h4 group by 1, 2, 3, 4),
h6 as (select document_id, page, seq, y + 20 as y, 0 as level, """ + tidy_sql("label") + """ as label from h5 where length(label) <= 160 union all select document_id, page, seq, y + 20, 1, """ + tidy_sql("run_in") + """ from h2 where run_in <> ''),
heads as (select * exclude (n) from (select *, count(*) over (partition by document_id, page) as n from h6) where n <= 4)"""


def heads(spark, d):
    return S.detect_headings(heading_paragraphs(spark, d))


@query("c8_detect_headings", A.with_(HEADS) + "select document_id, page, seq, y, level, label from heads")
def _(spark, d):
    return heads(spark, d)


def own_outline(spark, d):
    """An outline of the documents' own: an entry at every twentieth page for documents with an even id."""
    p = A.paragraphs(spark, d).where("document_id % 2 = 0 and seq % 5 = 0 and page % 20 = 1")
    return p.select("document_id", "page", F.lit(690.0).alias("y"), F.lit(0).alias("level"), F.concat(F.lit("Top › Entry "), F.col("page").cast("string")).alias("label"))


OWN = "own as (select document_id, page, 690.0::double as y, 0 as level, 'Top › Entry ' || page as label from paragraphs where document_id % 2 = 0 and seq % 5 = 0 and page % 20 = 1)"


@query("c9_choose_outline", A.with_(HEADS, OWN) + """, o as (select *, count(*) over (partition by document_id) as k from own), h as (select document_id, page, y, level, label, count(*) over (partition by document_id) as k from heads)
select document_id, page, y, level, label, 'pdf' as source from o where k >= 2 union all select document_id, page, y, level, label, 'headings' from h where k >= 2 and document_id not in (select document_id from o where k >= 2)""")
def _(spark, d):
    return S.choose_outline(own_outline(spark, d), heads(spark, d))


@query("c10_refine_outline", A.with_(HEADS, OWN) + r""", pc as (select document_id, max(page) as page_count from paragraphs group by 1), o as (select *, lead(page) over w as n_page, lead(y) over w as n_y from own join pc using (document_id) window w as (partition by document_id order by page, y desc, label)),
i as (select o.document_id, h.page, h.y, o.level + 1 as level, string_split(o.label, ' › ')[-1] || ' › ' || h.label as label, count(*) over (partition by o.document_id, o.page, o.y, o.label) as k from o join heads h on h.document_id = o.document_id and (o.page < h.page or (o.page = h.page and o.y > h.y)) and (n_page is null or h.page < n_page or (h.page = n_page and h.y > n_y)) where coalesce(n_page, page_count + 1) - o.page >= 15)
select * from own union all select document_id, page, y, level, label from i where k >= 2""")
def _(spark, d):
    n = A.paragraphs(spark, d).groupBy("document_id").agg(F.max("page").alias("page_count"))
    return S.refine_outline(own_outline(spark, d), heads(spark, d), n)


@query("c11_assign_chapters", A.with_(HEADS) + """, m as (select *, row_number() over (partition by document_id order by page, y desc, label) as no from heads),
r as (select p.document_id, p.seq, max(m.no) as no from hp p left join m on m.document_id = p.document_id and (m.page < p.page or (m.page = p.page and m.y + 2 >= p.y)) group by 1, 2)
select r.document_id, r.seq, m.label as chapter from r left join m on m.document_id = r.document_id and m.no = r.no""")
def _(spark, d):
    return S.assign_chapters(heading_paragraphs(spark, d), heads(spark, d)).select("document_id", "seq", "chapter")


@query("c12_typographic_title", A.with_(LINES, BODY) + r""", l as (select *, row_number() over (partition by document_id, page order by seq) as n from lines where page <= 3), b as (select document_id, page, n as b_n, size as b_size, row_number() over (partition by document_id order by size desc, page, seq) as r from l where length(text) <= 120 and regexp_matches(text, '\p{L}{3}')),
c as (select b.* from b join body using (document_id) where r = 1 and b_size >= 1.3 * body_size), f as (select l.document_id, l.n, l.text, min(case when abs(size - b_size) < 0.5 then 1 else 0 end) over (partition by l.document_id order by l.n rows unbounded preceding) as ok from l join c on l.document_id = c.document_id and l.page = c.page and l.n >= b_n and l.n < b_n + 4),
g as (select document_id, string_agg(text, ' ' order by n) as t from f where ok = 1 group by 1) select document_id, """ + tidy_sql("t") + " as title from g")
def _(spark, d):
    return S.typographic_title(lines(spark, d))


@query("c13_classify_text_coverage", A.with_(A.PARAGRAPHS, A.PAGES) + r""", t as (select document_id, case when (document_id + page) % 3 = 0 or document_id % 5 = 0 then '' else text end as text from pages_t), c as (select document_id, count(*) as page_count, count_if(length(regexp_replace(text, '\s', '', 'g')) >= 25)::bigint as text_pages from t group by 1)
select *, case when text_pages = 0 or text_pages / page_count < 0.1 then 'needs_ocr' else 'ready' end as status, case when not (text_pages = 0 or text_pages / page_count < 0.1) and page_count > text_pages then (page_count - text_pages) || ' of ' || page_count || ' pages have no text' end as note from c""")
def _(spark, d):
    p = A.pages(spark, d).withColumn("text", F.when(((F.col("document_id") + F.col("page")) % 3 == 0) | (F.col("document_id") % 5 == 0), "").otherwise(F.col("text")))
    return L.classify_text_coverage(p)


def sentences_sql(text, rows, name="ss"):
    """The sentences of ``text`` of ``rows`` as the list ``name``: the parts between possible ends, put together again where there is none."""
    q = lambda pattern: pattern.replace("'", "''")
    bare = "rtrim(translate(x, chr(9) || chr(10) || chr(12) || chr(13), '    '))"
    goes_on = f"regexp_matches(coalesce(ps[i + 1], ''), '{q(T.GOES_ON)}') or (regexp_matches({bare}, '{q(T.FULL_STOP)}') and (regexp_matches(coalesce(ps[i + 1], ''), '{q(T.LOWER_NEXT)}') or regexp_matches({bare}, '{q(T.NAMED_NEXT)}')))"
    return f"""select *, list_filter(list_transform(string_split(array_to_string(list_transform(ps, lambda x, i: x || case when {goes_on} then '' else chr(1) end), ''), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') as {name}
  from (select *, string_split(regexp_replace({text}, '{q(T.STOP)}', '\\1' || chr(2), 'g'), chr(2)) as ps from {rows})"""


UNITS = A.PARAGRAPHS + ",\nsu as (" + sentences_sql("text", "paragraphs") + r"""),
sv as (select *, case when heading then [text] else flatten(list_transform(ss, lambda s: case when len(regexp_split_to_array(s, '\s+')) <= 340 then [s] else list_transform(range(0, len(regexp_split_to_array(s, '\s+')), 340), lambda i: array_to_string(regexp_split_to_array(s, '\s+')[i + 1:i + 340], ' ')) end)) end as us from su),
units as (select document_id, seq, (i - 1)::int as idx, us[i] as text, len(regexp_extract_all(us[i], '\S+'))::bigint as words, page, chapter, heading or i = 1 as paragraph_start, heading, false as glue from sv, unnest(range(1, len(us) + 1)) as r(i))"""


@query("d1_sentence_units", A.with_(UNITS) + "select * from units")
def _(spark, d):
    return P.sentence_units(A.paragraphs(spark, d))


#: What d1_hard_sentences puts after words, by their number: ends of sentences, and what only looks like one.
HARD = {7: "Dr.", 11: "J.", 13: "5 p.m. in", 17: "St.", 19: "3.4", 23: "e.g.", 29: "etc., and", 31: "they said... so", 37: "end?” He", 41: "“No!” Ünder", 43: "終わり。次は！ Und", 47: "Well... Then", 53: "U.S.A. law", 59: "wait — why? no"}


@query("d1_hard_sentences", "with w as (select item_id, regexp_split_to_array(text, '\\s+') as w from benchmark), t as (select item_id, array_to_string(list_transform(w, lambda x, i: x || case i % 61 "
       + " ".join(f"when {n} then ' {words}'" for n, words in HARD.items()) + " else '' end), ' ') as text from w), s as (" + sentences_sql("text", "t") + ") select item_id, (i - 1)::int as idx, ss[i] as sentence from s, unnest(range(1, len(ss) + 1)) as r(i)")
def _(spark, d):
    """Benchmark texts with abbreviations, initials, numbers, ellipses, closing quotes and ideographic stops among their words."""
    put = lambda n: functools.reduce(lambda rest, x: F.when(n == x[0], F.lit(" " + x[1])).otherwise(rest), HARD.items(), F.lit(""))
    words = F.transform(F.split("text", r"\s+"), lambda x, i: F.concat(x, put((i + 1) % 61)))
    b = A.table(spark, d, "benchmark").select("item_id", F.array_join(words, " ").alias("text"))
    return b.select("item_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence"))


#: One passage of every chapter run for each step of the recursion: the rules of packing as searches in lists, each unit's place counted from 0.
PACKED = A.with_(UNITS).replace("with ", "with recursive ", 1).rstrip() + r""",
un as (select *, row_number() over (partition by document_id order by seq, idx) as unit, lag(chapter) over (partition by document_id order by seq, idx) as before from units),
ur as (select *, sum(case when unit > 1 and chapter is not distinct from before then 0 else 1 end) over (partition by document_id order by unit) as run from un),
uc as (select *, sum(words) over (partition by document_id, run order by unit) as so_far from ur),
rn as materialized (select document_id, run, count(*)::int as n, any_value(chapter) as chapter, list(words order by unit) as w, list_concat([0], list(so_far order by unit)) as s,
  list(paragraph_start order by unit) as st, list(heading order by unit) as hd, list(text order by unit) as tx, list(page order by unit) as pg from uc group by 1, 2),
cut as (
  select document_id, run, -1 as k, 0::bigint as nf, 0::bigint as nx, 0::bigint as f, 0::bigint as o, 0::bigint as past, -1 as lead, 0::hugeint as size, 0::hugeint as adds, false as tail from rn
  union all
  select document_id, run, k + 1, case when past < n and hd[past + 1] and s[past + 1] - s[o + 1] >= 40 then past
      else least(past, greatest(f, past - 2, coalesce(list_max(list_filter(range(0, past), lambda i: hd[i + 1])) + 1, 0), list_min(list_filter(range(0, past + 1), lambda i: s[i + 1] >= s[past + 1] - 45)))) end,
    past, f, o, past, case when tail then lead else k + 1 end, case when tail then size + mine else s[past + 1] - s[f + 1] end, case when tail then mine else s[past + 1] - s[f + 1] end, tail
  from (select *, k >= 0 and mine < 40 and size + mine <= 380 as tail
        from (select *, s[past + 1] - s[o + 1] as mine
              from (select c.document_id, c.run, c.k, c.nf as f, c.nx as o, c.lead, c.size, r.n, r.w, r.s, r.hd,
                      coalesce(list_min(list_filter(range(c.nx + 1, r.n), lambda j: (r.hd[j + 1] and r.s[j + 1] - r.s[c.nx + 1] >= 40) or r.s[j + 1] - r.s[c.nf + 1] + r.w[j + 1] > 340
                        or (r.st[j + 1] and r.s[j + 1] - r.s[c.nf + 1] >= 250) or r.s[j + 1] - r.s[c.nf + 1] >= 287.5)), r.n) as past
                    from cut c join rn r on r.document_id = c.document_id and r.run = c.run where c.nx < r.n)))),
pc as (select c.document_id, c.run, c.lead, c.k, c.adds, r.chapter, list_min(r.pg[c.f + 1:c.past]) as low, list_max(r.pg[c.f + 1:c.past]) as high,
    trim(array_to_string(list_transform(range(case when c.tail then c.o else c.f end, c.past), lambda i: case when i = case when c.tail then c.o else c.f end then '' when r.st[i + 1] then chr(10) || chr(10) else ' ' end || r.tx[i + 1]), ''), ' ') as text
  from cut c join rn r on r.document_id = c.document_id and r.run = c.run where c.k >= 0)
"""


@query("d2_d3_pack_chunks", PACKED + """select document_id, (row_number() over (partition by document_id order by run, lead) - 1)::int as ordinal, string_agg(text, ' ' order by k) as text, arg_min(low, k) as page_start, max(high) as page_end,
arg_min(chapter, k) as chapter, sum(adds)::bigint as word_count from pc group by document_id, run, lead""")
def _(spark, d):
    return P.pack_chunks(P.sentence_units(A.paragraphs(spark, d))).select("document_id", "ordinal", "text", "page_start", "page_end", "chapter", "word_count")


@query("d4_number_chunks", A.with_(A.CHUNKS) + "select document_id, page_start as page, ordinal as line, (row_number() over (partition by document_id order by page_start, ordinal) - 1)::int as number from chunks")
def _(spark, d):
    c = A.chunks(spark, d).select("document_id", F.col("page_start").alias("chapter_run"), F.col("ordinal").alias("seq"))
    return P.number_chunks(c).select("document_id", F.col("chapter_run").alias("page"), F.col("seq").alias("line"), F.col("ordinal").alias("number"))


@query("d5_chunk_stats", A.with_(A.CHUNKS) + "select document_id, count(*) as n, min(word_count) as least, round(avg(word_count))::bigint as average, max(word_count) as most from chunks group by 1")
def _(spark, d):
    return P.chunk_stats(A.chunks(spark, d))
