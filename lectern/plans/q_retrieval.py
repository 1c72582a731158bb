"""Queries of groups E to H and K: embedding, keyword and vector retrieval, fusion, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import evaluate as E
from lectern.operators import keyword as K
from lectern.operators import rank as R
from lectern.operators import vector as V
from lectern.operators.joins import written
from lectern.plans import adapters as A
from lectern.plans.q_library import NORM
from lectern.sources.scratch import scratch_path

Q, O = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f
    return add


def quoted(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


POSTINGS = A.with_(A.CHUNKS, A.QUERIES_T).rstrip() + f""",
tok as (select chunk_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') as ws from chunks),
postings as (select chunk_id, ws[i] as lexeme, (i - 1)::int as pos from tok, unnest(range(1, len(ws) + 1)) as r(i) where ws[i] not in ({quoted(K.STOP_WORDS)})),
kws as (select query_id, query, list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(query), '[^\\p{{L}}\\p{{N}}''\\s-]', ' ', 'g'), '\\s+'), lambda w: regexp_replace(w, '^[''-]+|[''-]+$', '', 'g')), lambda w: length(w) > 1 and w not in ({quoted(K.REQUEST_WORDS)})) as ws from queries_t),
kw as (select query_id, case when len(ws) > 0 then array_to_string(ws, ' ') end as text, case when len(ws) > 0 then 'or' end as mode from kws),
qt as (select distinct query_id, w as lexeme from (select query_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) as w from kw) where w <> '' and w not in ({quoted(K.STOP_WORDS)})),
dfs as (select lexeme, count(distinct chunk_id) as df from postings where lexeme in (select lexeme from qt) group by 1),
terms as (select query_id, lexeme, df from qt join dfs using (lexeme) where df <= (select greatest(25, ceil(count(*) * 0.04)) from chunks)),
kn as (select query_id, chunk_id, count(*) as hits from postings join terms using (lexeme) group by 1, 2),
ktop as (select query_id, chunk_id, hits, rank from (select *, row_number() over (partition by query_id order by hits desc, chunk_id)::int as rank from kn) where rank <= 60)"""


def keyword_parts(spark, d, analyzer="simple"):
    chunks, q = A.chunks(spark, d), A.queries_table(spark, d)
    kw = K.keyword_queries(q)
    asked = written(K.query_terms(kw, analyzer))
    matches = written(K.matches_of(asked, K.build_postings(chunks, analyzer)))
    return chunks, matches, kw, written(K.informative_terms(asked, matches, chunks.agg(F.count("*").alias("n"))))


@query("f1_build_postings", POSTINGS + " select * from postings")
def _(spark, d):
    return K.build_postings(A.chunks(spark, d))


@query("f1_build_postings_english")
def _(spark, d):
    return K.build_postings(A.chunks(spark, d), "english")


@query("f2_keyword_queries", POSTINGS + " select query_id, text, mode from kw")
def _(spark, d):
    return K.keyword_queries(A.queries_table(spark, d))


@query("f3_informative_terms", POSTINGS + " select query_id, lexeme, df from terms")
def _(spark, d):
    return keyword_parts(spark, d)[3]


@query("f4_keyword_topk", POSTINGS + " select query_id, chunk_id, hits, round(hits / (hits + 1), 6) as score, rank from ktop")
def _(spark, d):
    _, postings, _, terms = keyword_parts(spark, d)
    return K.keyword_topk(terms, postings).select("query_id", "chunk_id", "hits", F.round("score", 6).alias("score"), "rank")


def phrase_queries(spark, d):
    """Each benchmark text as one phrase."""
    q = A.table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), K.tokens(F.col("text")).alias("w"))
    return q.select("query_id", F.concat(F.lit('"'), F.array_join("w", " "), F.lit('"')).alias("query"))


@query("f5_phrase_topk", POSTINGS + f""", pq as (select item_id::bigint as query_id, list_filter(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: w not in ({quoted(K.STOP_WORDS)})) as ws from benchmark),
pw as (select query_id, ws[i] as lexeme, i - 1 as off, len(ws) as n from pq, unnest(range(1, len(ws) + 1)) as r(i)), po as (select query_id, n, chunk_id, pos - off as st, count(distinct off) as m from postings join pw using (lexeme) group by 1, 2, 3, 4),
ph as (select query_id, chunk_id, count(*) as hits from po where m = n group by 1, 2) select * from (select *, row_number() over (partition by query_id order by hits desc, chunk_id)::int as rank from ph) where rank <= 60""")
def _(spark, d):
    return K.phrase_topk(K.keyword_queries(phrase_queries(spark, d)), stored_postings(spark, d))


def cover_queries(spark, d):
    """All of each benchmark text, by fives of its words: a phrase of two and two more words, but not the fifth."""
    q = A.table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.filter(K.tokens(F.col("text")), lambda w: w != "or").alias("w"))
    five = lambda i: F.format_string('"%s %s" %s %s -%s', *[F.get("w", 5 * i + j) for j in range(5)])
    fives = F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 5).cast("int") - 1), five)
    return q.where("size(w) >= 5").select("query_id", F.array_join(fives, " or ").alias("query"))


@query("f5_cover_topk", POSTINGS + f""", bw as (select item_id::bigint as query_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w not in ('', 'or')) as w from benchmark),
fv as (select query_id, i as alt, w[5 * i + 1:5 * i + 5] as v from bw, unnest(range(0, len(w) // 5)) as r(i)),
pt as (select query_id, alt, 1 as part, false as negated, list_filter(v[1:2], lambda x: x not in ({quoted(K.STOP_WORDS)})) as ws from fv union all
  select query_id, alt, j - 1, j = 5, list_filter([v[j]], lambda x: x not in ({quoted(K.STOP_WORDS)})) from fv, unnest([3, 4, 5]) as r(j)),
pn as (select * from pt where len(ws) > 0), p1 as (select query_id, alt, part, negated, len(ws) as size, ws[i] as lexeme, i - 1 as off from pn, unnest(range(1, len(ws) + 1)) as r(i)),
pl as materialized (select query_id, alt, part, negated, size, chunk_id, pos - off as start from postings join p1 using (lexeme) group by all having count(distinct off) = size),
nd as (select query_id, alt, count(*) as need from pn where not negated group by 1, 2),
ok as (select query_id, alt, chunk_id from (select query_id, alt, chunk_id, count(distinct part) as have from pl where not negated group by 1, 2, 3) join nd using (query_id, alt) where have = need and (query_id, alt, chunk_id) not in (select query_id, alt, chunk_id from pl where negated)),
x as materialized (select query_id, alt, chunk_id, part, start, size from pl semi join ok using (query_id, alt, chunk_id) where not negated),
pt_ as (select distinct query_id, alt, chunk_id, start from x),
lt as (select x.query_id, x.alt, x.chunk_id, x.start, y.part as other, max(struct_pack(s := y.start, z := y.size)) as l from pt_ x join x y on x.query_id = y.query_id and x.alt = y.alt and x.chunk_id = y.chunk_id and y.start <= x.start group by all),
cv as (select query_id, alt, chunk_id, start, min(l.s) as b, max(l.s + l.z) as e, sum(l.z) as z from lt join nd using (query_id, alt) group by query_id, alt, chunk_id, start, need having count(*) = need),
fc as (select * from cv qualify row_number() over (partition by query_id, alt, chunk_id, b order by start) = 1),
ds as (select query_id, alt, chunk_id, count(*) as covers, round(sum(1 / (1 + greatest(0, e - b - z))), 9) as density from fc group by 1, 2, 3),
bs as (select query_id, chunk_id, max(struct_pack(density, covers)) as m from ds group by 1, 2)
select query_id, chunk_id, m.covers as covers, round(m.density / (1 + m.density), 6)::double as score, rank from (select *, row_number() over (partition by query_id order by m.density desc, chunk_id)::int as rank from bs) where rank <= 60""")
def _(spark, d):
    return K.cover_topk(K.keyword_queries(cover_queries(spark, d)), stored_postings(spark, d)).withColumn("score", F.round("score", 6))


def stored_postings(spark, d):
    """Postings written once, as an index is: phrases look them up several times."""
    return written(K.build_postings(A.chunks(spark, d)))


@query("f6_term_coverage", POSTINGS + """, nt as (select query_id, count(*) as n_terms from terms group by 1), hv as (select k.query_id, k.chunk_id, count(distinct p.lexeme) as have from ktop k join postings p using (chunk_id) join terms t on t.query_id = k.query_id and t.lexeme = p.lexeme group by 1, 2)
select query_id, chunk_id, round(coalesce(have / n_terms, 0), 6)::double as coverage from ktop left join hv using (query_id, chunk_id) left join nt using (query_id)""")
def _(spark, d):
    _, postings, _, terms = keyword_parts(spark, d)
    return K.term_coverage(K.keyword_topk(terms, postings), terms, postings).withColumn("coverage", F.round("coverage", 6))


@query("f7_highlight", POSTINGS + r""", qw as (select query_id, list(lexeme) as ts from terms group by 1),
hw as (select query_id, chunk_id, text, ts, regexp_split_to_array(text, '\s+') as ws from ktop join chunks using (chunk_id) join qw using (query_id) where rank <= 10),
hm as (select *, list_transform(ws, lambda w: list_contains(ts, regexp_replace(lower(w), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))) as hit from hw),
ha as (select *, list_filter(range(0, len(ws)), lambda i: hit[i + 1]) as places, list_transform(range(1, len(ws) + 1), lambda i: case when hit[i] then chr(1) || ws[i] || chr(2) else ws[i] end) as marked from hm),
hf as (select *, greatest(coalesce(places[1], 0) - 19, 0) as a from ha),
hn as (select *, list_filter(places, lambda i: i >= a + 38)[1] as later from hf)
select query_id, chunk_id, case when len(places) = 0 then case when len(ws) <= 45 then text else array_to_string(ws[1:45], ' ') || ' …' end
  else array_to_string(marked[a + 1:a + 38], ' ') || case when later is null then '' else ' … ' || array_to_string(marked[greatest(later - 19, a + 38) + 1:greatest(later - 19, a + 38) + 38], ' ') end end as headline from hn""")
def _(spark, d):
    chunks, postings, _, terms = keyword_parts(spark, d)
    hits = K.keyword_topk(terms, postings, 10).join(chunks.select("chunk_id", "text"), "chunk_id")
    return K.highlight(hits, terms).select("query_id", "chunk_id", "headline")


def vectors(spark, d):
    return A.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("document_id"), F.col("vec_id").cast("int").alias("ordinal"), "embedding")


def vector_queries(spark, d):
    """Every fiftieth vector asks."""
    return vectors(spark, d).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec"))


COS = "list_cosine_similarity(list_transform(q.embedding, lambda v: v::double), list_transform(c.embedding, lambda v: v::double))"


@query("g1_cosine", f"select q.vec_id as query_id, c.vec_id as chunk_id, round({COS}, 6) as similarity from embeddings q join embeddings c on q.label = c.label and q.vec_id % 50 = 0")
def _(spark, d):
    v = vectors(spark, d)
    q = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "document_id", F.col("embedding").alias("qvec"))
    return V.cosines(q, v, "document_id").withColumn("similarity", F.round("similarity", 6))


KNN = f"vs as (select q.vec_id as query_id, c.vec_id as chunk_id, {COS} as similarity from embeddings q cross join embeddings c where q.vec_id % 50 = 0), vtop as (select * from (select *, row_number() over (partition by query_id order by similarity desc, chunk_id)::int as rank from vs) where rank <= 60)"


@query("g2_knn_exact", "with " + KNN + " select query_id, chunk_id, round(similarity, 6) as similarity, rank from vtop")
def _(spark, d):
    return V.knn_exact(vector_queries(spark, d), vectors(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query("g2_knn_exact_scoped", f"select query_id, chunk_id, rank from (select q.vec_id as query_id, c.vec_id as chunk_id, row_number() over (partition by q.vec_id order by {COS} desc, c.vec_id)::int as rank from embeddings q join embeddings c on c.label = q.label where q.vec_id % 50 = 0) where rank <= 60")
def _(spark, d):
    v = vectors(spark, d)
    scope = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "document_id")
    return V.knn_exact(vector_queries(spark, d), v, scope=scope).select("query_id", "chunk_id", "rank")


@query("g3_knn_ann")
def _(spark, d):
    return V.knn_ann(vector_queries(spark, d), V.graph_index(vectors(spark, d), f"{scratch_path(spark)}/graphs"), 10)


@query("g3_recall", f"select count(*) as n, true as enough from (select q.vec_id, row_number() over (partition by q.vec_id order by {COS} desc, c.vec_id) as rank from embeddings q cross join embeddings c where q.vec_id % 50 = 0) where rank <= 10")
def _(spark, d):
    """How many of the exact ten nearest of all queries there are, and whether the index finds nine tenths of them."""
    q, v = vector_queries(spark, d), vectors(spark, d)
    r = V.recall(V.knn_ann(q, V.graph_index(v, f"{scratch_path(spark)}/graphs"), 10), V.knn_exact(q, v, 10))
    return r.select("n", (F.col("found") >= 0.9 * F.col("n")).alias("enough"))


#: The fitted embedder's weights: (pl, wt) of the places that passages have, and what all others weigh.
WEIGHTS = """fw as materialized (select h % 262144 as pl, count(distinct id) as df from p_h group by 1), fn as (select count(*) as n from chunks),
wt as materialized (select pl, round(8 * log2((n + 1) / (df + 1)))::bigint as weight from fw, fn), w0 as (select round(8 * log2(n + 1))::bigint as most from fn)"""


def embedded(name, rows, weighted=False):
    """The hashing embedder in SQL: name_v (id, place, v) of the rows (id, text), and name_n (id, nn), the squared lengths. Weighted: by WEIGHTS, which name p follows."""
    if weighted:
        return embedded(name, rows).replace("sum(case when h >= 2147483648 then 1 else -1 end)::double as n from {0}_h".format(name), "sum(case when h >= 2147483648 then 1 else -1 end * coalesce(weight, most))::double as n from {0}_h left join wt on pl = h % 262144, w0".format(name)).replace(
            f"{name}_c as (", (WEIGHTS + ",\n" if name == "p" else "") + f"{name}_c as (", 1)
    return f"""{name}_h as (select id, ('0x' || substr(md5(w), 1, 8))::bigint as h from (select id, unnest(regexp_split_to_array(lower(text), '\\s+')) as w from ({rows})) where w <> ''),
{name}_c as (select id, h % 256 as place, sum(case when h >= 2147483648 then 1 else -1 end)::double as n from {name}_h group by 1, 2),
{name}_v as materialized (select id, place, (n / sqrt(sum(n * n) over (partition by id)))::float::double as v from {name}_c qualify sum(n * n) over (partition by id) > 0),
{name}_n as (select id, sum(v * v) as nn from {name}_v group by 1)"""


def components(df, key, column):
    """(key, place, value) of the components other than 0."""
    rows = df.select(key, F.posexplode(column).alias("place", "value")).where("value <> 0")
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 5))


@query("e1_embed_passages", A.with_(A.CHUNKS, embedded("p", "select chunk_id as id, text from chunks")) + "select id as chunk_id, place::int as place, round(v, 5) as value from p_v where v <> 0")
def _(spark, d):
    return components(V.embed_passages(A.chunks(spark, d).select("chunk_id", "text")), "chunk_id", "embedding")


@query("e2_embed_queries", A.with_(A.QUERIES_T, embedded("q", "select query_id as id, 'query: ' || query as text from queries_t")) + "select id as query_id, place::int as place, round(v, 5) as value from q_v where v <> 0")
def _(spark, d):
    return components(V.embed_queries(A.queries_table(spark, d)), "query_id", "qvec")


@query("e3_validate_vectors", "select case when embedding is null then 'null' when len(embedding) <> 64 then 'width' when abs(sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double))) - 1) > 1e-3 then 'norm' else 'ok' end as kind, count(*) as n from (select case when vec_id % 9 = 0 then embedding[1:32] else embedding end as embedding from embeddings) group by 1")
def _(spark, d):
    v = vectors(spark, d)
    return V.validate_vectors(v.withColumn("embedding", F.when(F.col("chunk_id") % 9 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))), 64)


# --- fusion: vectors as passages; the keyword leg ranks passages of the query's own label by number ---

LEG2 = "k as (select q.vec_id as query_id, c.vec_id as chunk_id, row_number() over (partition by q.vec_id order by c.vec_id desc)::int as rank from embeddings q join embeddings c on c.label = q.label where q.vec_id % 50 = 0), ktop as (select * from k where rank <= 60)"
HITS = "with " + KNN + ", " + LEG2 + f""", u as (select query_id, chunk_id, v.rank as vector_rank, ktop.rank as keyword_rank from vtop v full join ktop using (query_id, chunk_id)),
h as (select u.*, c.label::bigint as document_id, c.vec_id::int as ordinal, round({COS}, 6) as similarity, (c.vec_id % 4) / 4 as coverage from u join embeddings c on c.vec_id = u.chunk_id join embeddings q on q.vec_id = u.query_id),
s as (select *, similarity + 0.015 * coverage as score from h)"""


def second_leg(spark, d):
    """The last passages of a label are the same for all of its queries, so they are found once a label."""
    v = vectors(spark, d)
    q = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "document_id")
    last = K.top_k(v.select(F.col("document_id").alias("query_id"), "chunk_id"), 60, F.desc("chunk_id")).withColumnRenamed("query_id", "document_id")
    return q.join(last, "document_id").select("query_id", "chunk_id", "rank")


def candidates(spark, d):
    v = vectors(spark, d)
    u = R.union_candidates(V.knn_exact(vector_queries(spark, d), v), second_leg(spark, d))
    h = u.join(v, "chunk_id").join(vector_queries(spark, d), "query_id")
    return h.withColumn("similarity", F.round(V.cosine(F.col("qvec"), F.col("embedding")), 6)).withColumn("coverage", (F.col("chunk_id") % 4) / 4).drop("qvec", "embedding")


@query("h1_union_candidates", HITS + " select * from u")
def _(spark, d):
    return R.union_candidates(V.knn_exact(vector_queries(spark, d), vectors(spark, d)), second_leg(spark, d))


@query("h2_hydrate_hits", POSTINGS.replace("with ", "with " + A.LIBRARY + ", ", 1) + ", " + A.PAGES + """ select query_id, chunk_id, title, author, page_start, ps.label as label_start, pe.label as label_end, c.text from ktop join chunks c using (chunk_id) join library l on l.document_id = c.document_id
left join pages_t ps on ps.document_id = c.document_id and ps.page = c.page_start left join pages_t pe on pe.document_id = c.document_id and pe.page = c.page_end""")
def _(spark, d):
    chunks, postings, _, terms = keyword_parts(spark, d)
    return R.hydrate_hits(K.keyword_topk(terms, postings), chunks, A.library(spark, d), A.pages(spark, d).drop("text")).select("query_id", "chunk_id", "title", "author", "page_start", "label_start", "label_end", "text")


@query("h3_score_hits", HITS + " select query_id, chunk_id, round(score, 6) as score from s")
def _(spark, d):
    return R.score_hits(candidates(spark, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


#: The fold over each group's hits in order of score, as list_reduce over the list of kept places.
COLLAPSED = HITS + """, g as (select query_id, document_id, list(ordinal order by score desc, chunk_id) as os from s group by 1, 2),
kp as (select query_id, document_id, unnest(list_reduce(list_transform(os, lambda o: [o]), lambda acc, x: case when len(list_filter(acc, lambda k: abs(k - x[1]) <= 1)) > 0 then acc else list_concat(acc, x) end)) as ordinal from g),
c as (select s.* from s join kp using (query_id, document_id, ordinal))"""


@query("h4_collapse_adjacent", COLLAPSED + " select query_id, chunk_id from c")
def _(spark, d):
    return R.collapse_adjacent(R.score_hits(candidates(spark, d))).select("query_id", "chunk_id")


DIVERSE = ", n as (select *, row_number() over (partition by query_id, document_id order by score desc, chunk_id) - 1 as n, count(*) over (partition by query_id) as total from c), dv as (select *, score - case when total > 20 then 0.006 * greatest(n - 2, 0) else 0 end as adjusted from n), pl as (select * from (select *, row_number() over (partition by query_id order by adjusted desc, score desc, chunk_id)::int as place from dv) where place <= 20)"


@query("h5_diversify", COLLAPSED + DIVERSE + " select query_id, chunk_id, round(adjusted, 6) as adjusted from dv")
def _(spark, d):
    return R.diversify(R.collapse_adjacent(R.score_hits(candidates(spark, d))), 20).select("query_id", "chunk_id", F.round("adjusted", 6).alias("adjusted"))


@query("h6_rank_fused", COLLAPSED + DIVERSE + " select query_id, chunk_id, place from pl")
def _(spark, d):
    return R.ranked(R.diversify(R.collapse_adjacent(R.score_hits(candidates(spark, d))), 20), 20).select("query_id", "chunk_id", "place")


def embedded_chunks(spark, d):
    return V.embed_passages(A.chunks(spark, d).select("chunk_id", "document_id", "ordinal", "text"))


def index(spark, d):
    """Passages with vectors, and postings, written once as an index is."""
    path = scratch_path(spark)
    embedded_chunks(spark, d).write.parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    K.build_postings(chunks).write.parquet(f"{path}/postings")
    return chunks, spark.read.parquet(f"{path}/postings")


def search(spark, d, mode="hybrid", scoped=False):
    """All benchmark texts sought among all passages; scoped: in the documents of one source for each. A search by vectors alone needs no postings."""
    chunks, postings = index(spark, d) if mode != "vector" else (written(embedded_chunks(spark, d)), None)
    q = V.embed_queries(A.queries_table(spark, d), prefix="")
    scope = None
    if scoped:
        lib = A.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source")
        scope = lib.join(A.queries_table(spark, d).select("query_id"), F.col("source") == F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))).select("query_id", "document_id")
    return R.hybrid_search(q, chunks, mode, scope=scope, postings=postings)


def cosines(weighted=False):
    """All cosines between queries and passages, and the share of each query's terms that a passage holds."""
    return POSTINGS + ",\n" + embedded("p", "select chunk_id as id, text from chunks", weighted) + ",\n" + embedded("q", "select query_id as id, query as text from queries_t", weighted) + """,
dots as (select q.id as query_id, p.id as chunk_id, sum(q.v * p.v) as dot from q_v q join p_v p using (place) group by 1, 2),
sims as materialized (select q.id as query_id, p.id as chunk_id, round(coalesce(dot, 0) / sqrt(q.nn * p.nn), 12) as similarity from q_n q cross join p_n p left join dots on dots.query_id = q.id and dots.chunk_id = p.id),
cover as (select query_id, chunk_id, count(distinct lexeme) / any_value(n_terms) as coverage from postings join terms using (lexeme) join (select query_id, count(*) as n_terms from terms group by 1) using (query_id) group by 1, 2),
scope as (select query_id, chunk_id from queries_t join documents on source = 'src' || (query_id % 20) join chunks on document_id = doc_id)"""


COSINES = cosines()


def search_sql(mode="hybrid", limit=20, scoped=False):
    """CTEs from the candidates of the legs to mode_pl, the places of a search."""
    inside = " semi join scope using (query_id, chunk_id)" if scoped else ""
    score = "(-keyword_rank)::double" if mode == "keyword" else "coalesce(similarity, 0)" + (" + 0.015 * coalesce(coverage, 0)" if mode == "hybrid" else "")
    legs = {"vector": "select query_id, chunk_id, null::bigint as keyword_rank from {m}_v", "keyword": "select query_id, chunk_id, rank as keyword_rank from {m}_k",
            "hybrid": "select query_id, chunk_id, {m}_k.rank as keyword_rank from {m}_v full join {m}_k using (query_id, chunk_id)"}[mode]
    less = "0" if scoped else f"case when total > {limit} then 0.006 * greatest(n - 2, 0) else 0 end"
    return (""",
{m}_v as (select * from (select query_id, chunk_id, row_number() over (partition by query_id order by similarity desc, chunk_id) as rank from sims{inside}) where rank <= 60),
{m}_k as (select * from (select query_id, chunk_id, row_number() over (partition by query_id order by hits desc, chunk_id) as rank from kn{inside}) where rank <= 60),
{m}_u as (""" + legs + """),
{m}_s as (select u.query_id, u.chunk_id, c.document_id, c.ordinal::int as ordinal, {score} as score from {m}_u u join chunks c using (chunk_id) left join sims using (query_id, chunk_id) left join cover using (query_id, chunk_id)),
{m}_g as (select query_id, document_id, list(ordinal order by score desc, chunk_id) as os from {m}_s group by 1, 2),
{m}_kp as (select query_id, document_id, unnest(list_reduce(list_transform(os, lambda o: [o]), lambda acc, x: case when len(list_filter(acc, lambda k: abs(k - x[1]) <= 1)) > 0 then acc else list_concat(acc, x) end)) as ordinal from {m}_g),
{m}_c as (select s.* from {m}_s s join {m}_kp using (query_id, document_id, ordinal)),
{m}_n as (select *, row_number() over (partition by query_id, document_id order by score desc, chunk_id) - 1 as n, count(*) over (partition by query_id) as total from {m}_c),
{m}_d as (select *, score - {less} as adjusted from {m}_n),
{m}_pl as (select * from (select *, row_number() over (partition by query_id order by adjusted desc, score desc, chunk_id)::int as place from {m}_d) where place <= {limit})""").format(m=mode, inside=inside, score=score, less=less, limit=limit)


@query("h6_hybrid_search", COSINES + search_sql() + " select query_id, chunk_id, round(score, 10) as score, place from hybrid_pl")
def _(spark, d):
    return search(spark, d).select("query_id", "chunk_id", F.round("score", 10).alias("score"), "place")


@query("h6_vector_search", COSINES + search_sql("vector") + " select query_id, chunk_id, round(score, 10) as score, place from vector_pl")
def _(spark, d):
    return search(spark, d, "vector").select("query_id", "chunk_id", F.round("score", 10).alias("score"), "place")


@query("h6_scoped_search", COSINES + search_sql(scoped=True) + " select query_id, chunk_id, document_id, round(score, 10) as score, place from hybrid_pl")
def _(spark, d):
    return search(spark, d, scoped=True).select("query_id", "chunk_id", "document_id", F.round("score", 10).alias("score"), "place")


@query("h6_keyword_search", POSTINGS + """, s as (select k.query_id, k.chunk_id, c.document_id, c.ordinal::int as ordinal, (-k.rank)::double as score from ktop k join chunks c using (chunk_id)),
go as (select query_id, document_id, list(ordinal order by score desc, chunk_id) as os from s group by 1, 2),
kp as (select query_id, document_id, unnest(list_reduce(list_transform(os, lambda o: [o]), lambda acc, x: case when len(list_filter(acc, lambda k: abs(k - x[1]) <= 1)) > 0 then acc else list_concat(acc, x) end)) as ordinal from go),
c as (select s.* from s join kp using (query_id, document_id, ordinal))""" + DIVERSE + " select query_id, chunk_id, place from pl")
def _(spark, d):
    return search(spark, d, "keyword").select("query_id", "chunk_id", "place")


@query("h7_hit_facets", POSTINGS + ", f as (select query_id, document_id, count(*) as hits from ktop join chunks using (chunk_id) group by 1, 2) select *, count(*) over (partition by query_id) as documents from f")
def _(spark, d):
    chunks, postings, _, terms = keyword_parts(spark, d)
    return R.hit_facets(K.keyword_topk(terms, postings).join(chunks.select("chunk_id", "document_id"), "chunk_id"))


@query("k1_page_accuracy", A.with_(A.CHUNKS, A.PAGES).rstrip() + f""", pn as (select document_id, page, {NORM.format('text')} as n from pages_t), cn as (select *, {NORM.format('text')} as nt from chunks),
w as (select chunk_id, page_start, page_end, nt, page, n from cn join pn using (document_id) where page between page_start - 1 and page_end + 1),
e as (select *, sum(length(n) + 1) over (partition by chunk_id order by page) as stop from w), t as (select chunk_id, page_start, page_end, nt, instr(' ' || string_agg(n, ' ' order by page) || ' ', ' ' || nt || ' ') as pos from w group by 1, 2, 3, 4),
o as (select t.*, (select min(page) from e where e.chunk_id = t.chunk_id and stop >= pos) as p1, (select min(page) from e where e.chunk_id = t.chunk_id and stop >= pos + length(nt) - 1) as p2 from t)
select chunk_id, case when nt = '' then 'empty' when pos = 0 then 'missing' when p1 <> page_start then 'starts elsewhere' when p2 <> page_end then 'ends elsewhere' else 'ok' end as reason from o""")
def _(spark, d):
    return E.page_accuracy(A.chunks(spark, d), A.pages(spark, d))


def cases(spark, d):
    """Each benchmark text is asked for; a passage that holds its longest line answers."""
    longest = F.array_max(F.transform(F.split("text", "\n"), lambda l, i: F.struct(F.length(l).alias("n"), (-i).alias("i"), l.alias("line"))))["line"]
    q = A.table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.array(longest).alias("needles"))
    return q.withColumn("book", F.lit(None).cast("long"))


EVAL = POSTINGS + f""", ln as (select item_id::bigint as query_id, i, string_split(text, chr(10))[i] as line from benchmark, unnest(range(1, len(string_split(text, chr(10))) + 1)) as r(i)),
nd as (select query_id, {NORM.format("arg_max(line, length(line) * 100000 - i)")} as needle from ln group by 1),
g as (select k.query_id, min(k.rank) as place from ktop k join chunks c using (chunk_id) join nd on nd.query_id = k.query_id where k.rank <= 10 and contains({NORM.format('c.text')}, needle) group by 1),
rk as (select query_id, place from nd left join g using (query_id))"""


#: The queries outside the first five.
MISSES = "coalesce(string_agg(query_id::varchar, ',' order by query_id) filter (place is null or place > 5), '') as misses"


@query("k2_retrieval_eval", EVAL + " select 'keyword' as variant, count(*) as cases, count_if(place = 1)::bigint as hit1, count_if(place <= 5)::bigint as hit5, round(avg(coalesce(1 / place, 0)), 6) as mrr, " + MISSES + " from rk")
def _(spark, d):
    chunks, postings, _, terms = keyword_parts(spark, d)
    hits = K.keyword_topk(terms, postings).withColumn("place", F.col("rank")).withColumn("variant", F.lit("keyword")).join(chunks.select("chunk_id", "document_id"), "chunk_id")
    return E.retrieval_eval(E.answer_ranks(hits, chunks, cases(spark, d))).withColumn("mrr", F.round("mrr", 6))


def variants_sql(weighted=False):
    return cosines(weighted) + "".join(search_sql(m, 10) for m in ("vector", "keyword", "hybrid")) + f""",
ln as (select item_id::bigint as query_id, i, string_split(text, chr(10))[i] as line from benchmark, unnest(range(1, len(string_split(text, chr(10))) + 1)) as r(i)),
nd as (select query_id, {NORM.format("arg_max(line, length(line) * 100000 - i)")} as needle from ln group by 1),
found as (select 'vector' as variant, query_id, chunk_id, place from vector_pl union all select 'keyword', query_id, chunk_id, place from keyword_pl union all select 'hybrid', query_id, chunk_id, place from hybrid_pl),
g as (select variant, query_id, min(place) as place from found join chunks c using (chunk_id) join nd using (query_id) where contains({NORM.format('c.text')}, needle) group by 1, 2),
rk as (select v.variant, query_id, place from (select distinct variant from found) v cross join nd left join g using (variant, query_id))
"""


RANKED = " select variant, count(*) as cases, count_if(place = 1)::bigint as hit1, count_if(place <= 5)::bigint as hit5, round(avg(coalesce(1 / place, 0)), 6) as mrr from rk group by 1"


def variant_ranks(spark, d, embedder=None):
    """The same cases under all three modes of the search, whose candidates are found once."""
    path = scratch_path(spark)
    V.embed_passages(A.chunks(spark, d).select("chunk_id", "document_id", "ordinal", "text"), embedder).write.parquet(f"{path}/chunks")
    chunks, postings = spark.read.parquet(f"{path}/chunks"), stored_postings(spark, d)
    q = V.embed_queries(A.queries_table(spark, d), embedder, prefix="")
    hits = written(R.search_modes(q, chunks, limit=10, postings=postings).select("variant", "query_id", "chunk_id", "document_id", "place"))
    return E.answer_ranks(hits, chunks, cases(spark, d))


def fitted(spark, d):
    """The embedder whose weights are fitted on all passages."""
    return V.weighted_embedder(V.fit_frequencies(A.chunks(spark, d), f"{scratch_path(spark)}/frequencies"))


@query("k2_retrieval_variants", variants_sql() + RANKED.replace(" from rk", f", {MISSES} from rk"))
def _(spark, d):
    return E.retrieval_eval(variant_ranks(spark, d)).withColumn("mrr", F.round("mrr", 6))


@query("k2_fitted_variants", variants_sql(True) + RANKED)
def _(spark, d):
    return E.retrieval_eval(variant_ranks(spark, d, fitted(spark, d))).drop("misses").withColumn("mrr", F.round("mrr", 6))


@query("k2_misses", variants_sql() + " select variant, query_id, place from rk where place is null or place > 5")
def _(spark, d):
    return E.retrieval_misses(variant_ranks(spark, d))


@query("e1_fit_frequencies", A.with_(A.CHUNKS, embedded("p", "select chunk_id as id, text from chunks", True)) + "select pl as place, df from fw union all select -1, n from fn")
def _(spark, d):
    return V.fit_frequencies(A.chunks(spark, d), f"{scratch_path(spark)}/frequencies")


@query("e1_fitted_embedder", A.with_(A.CHUNKS, embedded("p", "select chunk_id as id, text from chunks", True)) + "select id as chunk_id, place::int as place, round(v, 5) as value from p_v where v <> 0")
def _(spark, d):
    return components(V.embed_passages(A.chunks(spark, d).select("chunk_id", "text"), fitted(spark, d)), "chunk_id", "embedding")


@query("g3_updated_index", f"select count(*) as n, true as enough from (select q.vec_id, row_number() over (partition by q.vec_id order by {COS} desc, c.vec_id) as rank from embeddings q cross join embeddings c where q.vec_id % 50 = 0 and q.vec_id % 3 <> 1 and c.vec_id % 3 <> 1) where rank <= 10")
def _(spark, d):
    """An index without every third vector, to which a third is added while another third goes: exact neighbours there are, and whether nine tenths are found."""
    v, path = vectors(spark, d), f"{scratch_path(spark)}/graphs"
    V.graph_index(v.where("chunk_id % 3 <> 2"), path)
    index = V.update_index(path, v.where("chunk_id % 3 = 2"), v.where("chunk_id % 3 = 1").select("chunk_id"))
    q, left = vector_queries(spark, d).where("query_id % 3 <> 1"), v.where("chunk_id % 3 <> 1")
    r = V.recall(V.knn_ann(q, index, 10), V.knn_exact(q, left, 10))
    return r.select("n", (F.col("found") >= 0.9 * F.col("n")).alias("enough"))


@query("h6_index_search", COSINES + search_sql() + " select count(*) as n, true as enough from hybrid_pl")
def _(spark, d):
    """The hybrid search through the graph index, of narrow vectors: how many hits the exact one has, and whether nine tenths of them are found."""
    path, narrow = scratch_path(spark), V.hashing_embedder(64)
    V.embed_passages(A.chunks(spark, d).select("chunk_id", "document_id", "ordinal", "text"), narrow).write.parquet(f"{path}/chunks")
    chunks, postings = spark.read.parquet(f"{path}/chunks"), stored_postings(spark, d)
    q = V.embed_queries(A.queries_table(spark, d), narrow, prefix="")
    graphs = V.graph_index(chunks, f"{path}/graphs")
    words, *rest = R.keyword_leg(R.requests(q), chunks, postings=postings)
    leg = written(words), *rest
    found = R.hybrid_search(q, chunks, index=graphs, leg=leg)
    r = V.recall(found, R.hybrid_search(q, chunks, leg=leg))
    return r.select("n", (F.col("found") >= 0.9 * F.col("n")).alias("enough"))


@query("k3_boost_sweep", HITS + """, b as (select unnest([0.0, 0.015, 0.06])::double as boost), sw as (select h.*, b.boost, similarity + boost * coverage as score from h cross join b),
g as (select boost, query_id, document_id, list(ordinal order by score desc, chunk_id) as os from sw group by 1, 2, 3),
kp as (select boost, query_id, document_id, unnest(list_reduce(list_transform(os, lambda o: [o]), lambda acc, x: case when len(list_filter(acc, lambda k: abs(k - x[1]) <= 1)) > 0 then acc else list_concat(acc, x) end)) as ordinal from g),
c as (select sw.* from sw join kp using (boost, query_id, document_id, ordinal)), n as (select *, row_number() over (partition by boost, query_id, document_id order by score desc, chunk_id) - 1 as n, count(*) over (partition by boost, query_id) as total from c),
dv as (select *, score - case when total > 10 then 0.006 * greatest(n - 2, 0) else 0 end as adjusted from n)
select case boost when 0 then 'boost 0' when 0.06 then 'boost 0.06' else 'boost 0.015' end as variant, query_id, chunk_id, place from (select *, row_number() over (partition by boost, query_id order by adjusted desc, score desc, chunk_id)::int as place from dv) where place <= 10""")
def _(spark, d):
    return E.boost_sweep(candidates(spark, d), [0.0, 0.015, 0.06]).select("variant", "query_id", "chunk_id", "place")
