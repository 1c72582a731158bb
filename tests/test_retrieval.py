import numpy as np
from pyspark.sql import functions as F

from lectern.functions.stemming import stem
from lectern.operators import keyword as K
from lectern.operators import rank as R
from lectern.operators import vector as V


def test_query_analysis(spark):
    q = spark.createDataFrame([(1, "What do these books say about suffering?"), (2, 'where is "the good life" found'), (3, "what do these books say")], "query_id long, query string")
    got = {r.query_id: (r.text, r.mode) for r in K.keyword_queries(q).collect()}
    assert got == {1: ("suffering", "or"), 2: ('where is "the good life" found', "web"), 3: (None, None)}


def chunks(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, text string")


def test_document_frequency_cap(spark):
    c = chunks(spark, ["rare common"] * 25 + ["common"])
    terms = spark.createDataFrame([(1, "rare"), (1, "common"), (1, "absent")], "query_id long, lexeme string")
    kept = K.informative_terms(terms, K.build_postings(c), c.agg(F.count("*").alias("n"))).collect()
    assert [(r.lexeme, r.df) for r in kept] == [("rare", 25)]


def test_phrases(spark):
    c = chunks(spark, ["the good life is near", "life good", "good life, bad dog", "bad cat"])
    q = spark.createDataFrame([(1, '"good life"', "web"), (2, '"good life" -dog', "web"), (3, '"good life" dog or cat', "web")], "query_id long, text string, mode string")
    got = {(r.query_id, r.chunk_id) for r in K.phrase_topk(q, K.build_postings(c)).collect()}
    assert got == {(1, 0), (1, 2), (2, 0), (3, 2), (3, 3)}


def test_collapse_and_diversify(spark):
    rows = [(1, o, 1, o, s) for o, s in ((5, 0.9), (6, 0.8), (7, 0.7))]
    h = spark.createDataFrame(rows, "query_id long, chunk_id long, document_id long, ordinal int, score double")
    assert {r.ordinal for r in R.collapse_adjacent(h).collect()} == {5, 7}
    many = spark.createDataFrame([(1, i, 1, i * 3, 1.0 - i / 100) for i in range(5)], h.schema)
    less = {r.chunk_id: round(r.score - r.adjusted, 6) for r in R.diversify(many, 4).collect()}
    assert less == {0: 0, 1: 0, 2: 0, 3: 0.006, 4: 0.012}
    assert all(r.score == r.adjusted for r in R.diversify(many, 5).collect())


def test_exact_search_is_brute_force_and_ann_is_measured(spark, tmp_path):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(300, 64)).astype("float32")
    x[150:] = x[:150] + 0.1 * x[150:]
    c = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "chunk_id long, document_id long, embedding array<float>")
    q = c.where("chunk_id < 10").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec"))
    u = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
    got = V.knn_exact(q, c, 5)
    for r in got.collect():
        assert np.argsort(-(u @ u[r.query_id]), kind="stable")[r["rank"] - 1] == r.chunk_id
    r = V.recall(V.knn_ann(q, V.graph_index(c, str(tmp_path / 'graphs')), 2), V.knn_exact(q, c, 2)).first()
    assert r.found / r.n >= 0.9
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()


def test_equal_vectors_rank_by_id(spark):
    import numpy as np

    v = np.random.default_rng(3).normal(size=(3, 256)).astype("float32").tolist()
    c = spark.createDataFrame([(i, 0, v[i % 2]) for i in range(400)], "chunk_id long, document_id long, embedding array<float>")
    q = spark.createDataFrame([(1, v[0]), (2, v[2])], "query_id long, qvec array<float>")
    got = [(r.query_id, r["rank"], r.chunk_id) for r in V.knn_exact(q, c, 50).orderBy("query_id", "rank").collect()]
    sims = [float(np.dot(v[2], x) / np.linalg.norm(x)) for x in v[:2]]
    near = 0 if sims[0] > sims[1] else 1
    assert got == [(1, n + 1, 2 * n) for n in range(50)] + [(2, n + 1, 2 * n + near) for n in range(50)]
    scope = q.select("query_id", F.lit(0).cast("long").alias("document_id"))
    assert [(r.query_id, r["rank"], r.chunk_id) for r in V.knn_exact(q, c, 50, scope).orderBy("query_id", "rank").collect()] == got


def test_embedder_places_words_by_their_hash():
    import hashlib

    h = int(hashlib.md5(b"calm").hexdigest()[:8], 16)
    one, two, none = V.hashing_embedder(256)(["Calm", "calm  CALM", " "])
    assert one == two and one[h % 256] == (1 if h >> 31 else -1) and sum(map(abs, one)) == 1 and not any(none)


def test_hybrid_search_modes(spark):
    c = chunks(spark, ["stoic calm and reason", "stoic anger", "a garden of herbs", "reason alone"]).withColumns({"document_id": F.col("chunk_id") % 2, "ordinal": (F.col("chunk_id") * 5).cast("int")})
    c = V.embed_passages(c)
    q = V.embed_queries(spark.createDataFrame([(1, "stoic reason"), (2, " ")], "query_id long, query string"), prefix="")
    for mode in ("hybrid", "vector", "keyword"):
        hits = R.hybrid_search(q, c, mode, limit=2).collect()
        assert {h.query_id for h in hits} == {1} and min(hits, key=lambda h: h.place).chunk_id == 0, mode
    scope = spark.createDataFrame([(1, 1)], "query_id long, document_id long")
    assert {h.document_id for h in R.hybrid_search(q, c, scope=scope).collect()} == {1}


def test_scoped_phrases_beyond_the_global_cut(spark):
    """More matches outside the scope than there are candidates, all before the one inside."""
    c = chunks(spark, ["good life good life"] * 70 + ["a good life", "bad cat"]).withColumns({"document_id": (F.col("chunk_id") >= 70).cast("long"), "ordinal": (F.col("chunk_id") * 5).cast("int")})
    q = V.embed_queries(spark.createDataFrame([(1, '"good life"')], "query_id long, query string"), prefix="")
    scope = spark.createDataFrame([(1, 1)], "query_id long, document_id long")
    hits = R.hybrid_search(q, V.embed_passages(c), "keyword", scope=scope).collect()
    assert [(h.chunk_id, h.keyword_rank) for h in hits] == [(70, 1)]


def test_ann_recall_on_the_given_table(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    c = e.select(F.col("vec_id").alias("chunk_id"), F.lit(0).alias("document_id"), "embedding")
    q = c.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec"))
    r = V.recall(V.knn_ann(q, V.graph_index(c, str(tmp_path / 'graphs')), 10), V.knn_exact(q, c, 10)).first()
    assert r.n == 10 * q.count() and r.found / r.n >= 0.9, r


def test_vectors_without_a_direction_are_near_nothing(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 0, [0.0, 0.0]), (1, 0, [1.0, 0.0]), (2, 0, [0.6, 0.8]), (3, 0, None), (4, 0, [nan, 1.0]), (5, 0, [inf, 1.0]), (6, 0, []), (7, 0, [1e-30, 0.0]), (8, 0, [1.0, 0.0, 0.0])]
    c = spark.createDataFrame(rows, "chunk_id long, document_id long, embedding array<float>")
    q = c.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec"))
    want = {1: [1, 7, 2], 2: [2, 1, 7], 7: [1, 7, 2], 8: [8]}
    scope = q.select("query_id", F.lit(0).cast("long").alias("document_id"))
    for found in (V.knn_exact(q, c, 5), V.knn_ann(q, V.graph_index(c, str(tmp_path / "graphs")), 5)):
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == want
    assert {r.query_id for r in V.knn_exact(q.where("query_id <> 8"), c.where("chunk_id <> 8"), 5, scope).collect()} == {1, 2, 7}
    assert c.select(V.cosine(F.col("embedding"), F.col("embedding")).alias("s")).where("chunk_id = 0").first().s is None


def test_hybrid_search_survives_blank_passages_and_unknown_words(spark):
    c = chunks(spark, ["stoic calm and reason", "", "a garden of herbs"]).withColumns({"document_id": F.col("chunk_id"), "ordinal": F.lit(0)})
    q = V.embed_queries(spark.createDataFrame([(1, "stoic"), (2, "unheard words"), (3, "...")], "query_id long, query string"), prefix="")
    q = q.withColumn("qvec", F.when(F.col("query_id") == 3, F.transform("qvec", lambda x: x * 0)).otherwise(F.col("qvec")))
    for mode in ("hybrid", "vector", "keyword"):
        hits = R.hybrid_search(q, V.embed_passages(c), mode).collect()
        assert min((h for h in hits if h.query_id == 1), key=lambda h: h.place).chunk_id == 0
        assert not [h for h in hits if h.query_id == 3 or h.chunk_id == 1], mode


def test_batches():
    bounds = list(V.batches_of(["x" * n for n in range(1, 301)]))
    assert bounds[0][0] == 0 and bounds[-1][1] == 300 and all(b - a <= 128 for a, b in bounds) and all(x[1] == y[0] for x, y in zip(bounds, bounds[1:]))


def test_stems():
    for word, want in {"caresses": "caress", "ponies": "poni", "hopping": "hop", "relational": "relat", "happy": "happi", "generalization": "gener", "adjustment": "adjust", "sky": "sky", "feed": "feed", "agreed": "agre"}.items():
        assert stem(word) == want


def test_misses_are_told(spark):
    from lectern.operators import evaluate as E

    ranks = spark.createDataFrame([("a", 1, 1), ("a", 10, None), ("a", 9, 6), ("a", 3, 5), ("b", 1, 2)], "variant string, query_id long, place int")
    assert {r.variant: (r.cases, r.hit1, r.hit5, r.misses) for r in E.retrieval_eval(ranks).collect()} == {"a": (4, 1, 2, "9,10"), "b": (1, 0, 1, "")}


def test_scoped_search_by_sets_of_queries(spark, monkeypatch):
    """Scopes that share sets of queries, overlap, or name unknown documents: in place as by pairs, and without a row a pair."""
    rng = np.random.default_rng(5)
    c = spark.createDataFrame([(i, i % 9, [float(x) for x in rng.normal(size=8)]) for i in range(900)], "chunk_id long, document_id long, embedding array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(12)], "query_id long, qvec array<double>")
    scope = spark.createDataFrame([(i, j) for i in range(12) for j in range(12) if (i + j) % 3 == 0 or i == 5], "query_id long, document_id long")
    found = {}
    for most in (V.QUERY_NUMBERS, 0):
        monkeypatch.setattr(V, "QUERY_NUMBERS", most)
        df = V.knn_exact(q, c, 7, scope)
        found[most] = sorted((r.query_id, r.rank, r.chunk_id, round(r.similarity, 9)) for r in df.collect())
        assert ("MapInArrow" in df._jdf.queryExecution().executedPlan().toString()) == (most > 0)
    assert len(found[0]) == 84 and len(set(map(str, found.values()))) == 1


def test_modes_share_candidates(spark):
    words = "red fox runs past many trees and sees a river under old stone walls".split()
    c = V.embed_passages(spark.createDataFrame([(i, i // 4, i % 4, " ".join(words[(i * j) % 13] for j in range(1, 7))) for i in range(60)], "chunk_id long, document_id long, ordinal int, text string"))
    q = V.embed_queries(spark.createDataFrame([(1, "red fox river"), (2, "stone walls"), (3, "unheard"), (4, " ")], "query_id long, query string"), prefix="")
    columns = ["query_id", "chunk_id", "document_id", "place", "score"]
    got = R.search_modes(q, c, limit=10).select("variant", *columns).collect()
    for mode in ("vector", "keyword", "hybrid"):
        want = sorted(tuple(r) for r in R.hybrid_search(q, c, mode, limit=10).select(*columns).collect())
        assert want and sorted(tuple(r)[1:] for r in got if r.variant == mode) == want, mode


def test_index_search_meets_the_postings_once(spark, monkeypatch):
    """The search through the index and the exact one have one keyword leg; edges chosen in single precision find what they should."""
    from lectern.operators import rank
    from lectern.plans import q_retrieval

    calls, plain = [], rank.keyword.matches_of
    monkeypatch.setattr(rank.keyword, "matches_of", lambda *a: calls.append(1) or plain(*a))
    got = q_retrieval.Q["h6_index_search"](spark, "/root/testdata/sf0.001").collect()
    assert [r.enough for r in got] == [True] and got[0].n > 100 and calls == [1]


def test_modes_search_by_whole_queries(spark):
    """The word that finds stands beyond the thousandth character."""
    c = V.embed_passages(spark.createDataFrame([(i, i, 0, t) for i, t in enumerate(["amber moss", "quiet harbour", "slow comet"])], "chunk_id long, document_id long, ordinal int, text string"))
    q = V.embed_queries(spark.createDataFrame([(1, "unheard " * 130 + "harbour")], "query_id long, query string"), prefix="")
    hits = R.search_modes(q, c, limit=10).where("keyword_rank is not null").select("variant", "chunk_id").collect()
    assert {tuple(h) for h in hits} == {("vector", 1), ("keyword", 1), ("hybrid", 1)}


def test_second_leg_reads_each_vector_once(spark, monkeypatch):
    """Not a row for each pair of a query and a passage of its label."""
    from lectern.plans import q_retrieval

    seen, plain = [], K.top_k
    monkeypatch.setattr(q_retrieval.K, "top_k", lambda rows, k, *order: seen.append(rows.count()) or plain(rows, k, *order))
    d = "/root/testdata/sf0.01"
    q_retrieval.second_leg(spark, d)
    assert seen == [q_retrieval.vectors(spark, d).count()]


def test_places_of_a_frequent_word_are_not_written_where_its_alternative_is_not(spark, monkeypatch):
    """300 passages hold the frequent word, two the rare one, and one of these the negated one: what is written is about the query, not about the 300."""
    rows = [(i, "common " * 5 + ("rare " if i < 2 else "") + ("unwanted" if i == 1 else "")) for i in range(300)]
    postings = K.build_postings(spark.createDataFrame(rows, "chunk_id long, text string"))
    sizes = []

    def written(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    plain = K.written
    monkeypatch.setattr(K, "written", written)
    kw = K.keyword_queries(spark.createDataFrame([(1, '"common common" rare -unwanted')], "query_id long, query string"))
    assert [(r.chunk_id, r.covers) for r in K.cover_topk(kw, postings).collect()] == [(0, 1)]
    assert max(sizes) <= 10


def test_pairs_of_queries_and_passages_are_not_written(spark, monkeypatch):
    """Ten queries of 40 words, each in ten of 400 passages: 4,000 pairs, of which the candidates alone are kept; matches stand for postings."""
    texts = [(i, 1, i, f"word{i % 40} filler") for i in range(400)]
    passages = V.embed_passages(spark.createDataFrame(texts, "chunk_id long, document_id long, ordinal long, text string"))
    queries = V.embed_queries(spark.createDataFrame([(q, " ".join(f"word{w}" for w in range(40))) for q in range(10)], "query_id long, query string"), prefix="")
    sizes = []

    def written(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    plain = R.written
    monkeypatch.setattr(R, "written", written)
    got = R.hybrid_candidates(queries, passages, "keyword").collect()
    assert len(got) == 600 and {r.coverage for r in got} == {1 / 40} and max(sizes) <= 800
    terms, postings = K.query_terms(K.keyword_queries(queries), "simple"), K.build_postings(passages)
    matches = K.matches_of(terms, postings)
    n = passages.agg(F.count("*").alias("n"))
    assert sorted(map(tuple, K.informative_terms(terms, matches, n).collect())) == sorted(map(tuple, K.informative_terms(terms, postings, n).collect()))
    assert sorted(map(tuple, K.keyword_topk(terms, matches).collect())) == sorted(map(tuple, K.keyword_topk(terms, postings).collect()))


def test_cosines_of_groups_are_those_of_single_pairs(spark, monkeypatch):
    """Blocks of two queries and parts of three passages, with vectors that are null, zero, of another width, not finite, or out of range."""
    monkeypatch.setattr(V, "PAIR_BLOCK", 2)
    monkeypatch.setattr(V, "PAIR_PART", 3)
    odd = [None, [0.0, 0.0], [1.0], [float("nan"), 1.0], [1e200, 1.0], [None, 1.0]]
    rows = [(i, i % 2, [float(i % 5 + 1), float(i % 3)]) for i in range(20)] + [(20 + i, i % 2, v) for i, v in enumerate(odd)]
    v = spark.createDataFrame(rows, "chunk_id long, label long, embedding array<double>")
    q = v.where("chunk_id % 2 = 0 or chunk_id % 5 = 1").select(F.col("chunk_id").alias("query_id"), "label", F.col("embedding").alias("qvec"))
    want = q.join(v, "label").select("query_id", "chunk_id", V.cosine(F.col("qvec"), F.col("embedding")).alias("similarity"))
    told = lambda rows: sorted((r.query_id, r.chunk_id, str(None if r.similarity is None else round(r.similarity, 12))) for r in rows.collect())
    assert told(V.cosines(q, v, "label")) == told(want)


def test_page_texts_are_put_together_once_for_all_passages_of_a_page(spark):
    from lectern.operators import evaluate as E

    c = spark.createDataFrame([(i, 1, 1, 1, f"line {i}") for i in range(20)] + [(20, 1, 1, 1, "nowhere"), (21, 1, 2, 2, "line 3")], "chunk_id long, document_id long, page_start int, page_end int, text string")
    p = spark.createDataFrame([(1, 1, "\n".join(f"line {i}" for i in range(20))), (1, 2, "end")], "document_id long, page int, text string")
    checks = E.page_accuracy(c, p)
    assert {r.chunk_id: r.reason for r in checks.collect()} == {i: "ok" for i in range(20)} | {20: "missing", 21: "starts elsewhere"}
    gathered = [x for x in checks._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [" in x]
    assert gathered and not any("chunk_id" in x for x in gathered)
