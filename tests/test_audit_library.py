from pyspark.sql import functions as F

from lectern.operators import audit as J
from lectern.operators import context as C
from lectern.operators import library as L


def test_quotes_and_citations(spark):
    p = spark.createDataFrame([(1, "P1", "We live by a philoso-\nphy of calm reason and quiet work."), (1, "P2", "The mind is a garden; what we sow there grows, for good or ill, in time.")], "thread_id long, passage_id string, text string")
    a = spark.createDataFrame([(7, 1, 'He says "a philosophy of calm reason" and “the mind is a garden ... grows, for good or ill” but never "an invented sentence of mine" [P1][P7].')], "answer_id long, thread_id long, text string")
    got = [(r.verified, r.found_in) for r in J.check_quotes(a, p).orderBy("pos").collect()]
    assert got == [(True, "P1"), (True, "P2"), (False, "")]
    assert {(r.passage_id, r.known) for r in J.check_citations(a, p).collect()} == {("P1", True), ("P7", False)}
    s = J.audit_summary(a, p).first()
    assert (s.cited, s.unknown, s.verified, s.quotes, s.consulted, s.uncited, s.mentions) == (1, 1, 2, 3, 2, 1, 0)


def test_segments(spark):
    a = spark.createDataFrame([(1, "Plain <synthesis>one</synthesis> <outside>two</outside>"), (2, "Text <synth"), (3, "A <synthesis>partial")], "answer_id long, text string")
    got = {(r.answer_id, r.pos): (r.kind, r.body.strip()) for r in J.segment_answer(a).collect()}
    assert got == {(1, 0): ("text", "Plain"), (1, 1): ("synthesis", "one"), (1, 2): ("outside", "two"), (2, 0): ("text", "Text"), (3, 0): ("text", "A"), (3, 1): ("synthesis", "partial")}


def test_places_on_a_page(spark):
    spans = ["An opening sentence stands here first.", "The soul becomes dyed with the col-", "our of its thoughts, as wool", "is dyed by the dyer at his work.", "Another matter begins in this line", "and it ends with the page below."]
    s = spark.createDataFrame([(1, i, t) for i, t in enumerate(spans)], "page_key long, idx long, text string")
    t = spark.createDataFrame([(1, 1, "The soul becomes dyed with the colour of its thoughts, as wool is dyed by the dyer at his work."),
                               (2, 1, "words that stood on the page before this one and so are missing here. The soul becomes dyed with the colour of its thoughts, as wool is dyed by the dyer at his work. Another matter begins in this line"),
                               (3, 1, "Nothing of this is anywhere on the page at all, not one bit.")], "target_id long, page_key long, text string")
    got = {}
    for r in J.locate_passage(s, t).collect():
        got.setdefault(r.target_id, set()).add(r.idx)
    assert got[1] == {1, 2, 3} and {1, 4} <= got[2] and 0 not in got[2] and 3 not in got


def documents(spark, tmp_path):
    """Four documents whose lines fill more than one page each."""
    rows = [(i, "\n".join(f"line {k} of book {i} tells{' again and' * 40} of thing {k}x{i}" for k in range(40))) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text)::bigint as n_chars")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_answers_without_a_closed_tag_are_audited(spark, tmp_path):
    from lectern.plans import q_context as Q

    a = Q.answers(spark, documents(spark, tmp_path))
    assert {r.answer_id for r in a.where("text is not null").collect()} == {0, 1, 2, 3}
    kinds = {}
    for r in J.segment_answer(a).orderBy("pos").collect():
        kinds.setdefault(r.answer_id, []).append(r.kind)
    assert kinds == {0: ["text", "synthesis", "outside"], 1: ["text", "synthesis"], 2: ["text", "synthesis", "outside"], 3: ["text", "synthesis"]}
    p = spark.createDataFrame([(i, "P1", f"line 0 of book {i} tells") for i in range(4)], "thread_id long, passage_id string, text string")
    got = {r.answer_id: (r.cited, r.unknown, r.verified, r.quotes) for r in J.audit_summary(a, p).collect()}
    assert got == {0: (1, 4, 1, 3), 1: (1, 3, 1, 3), 2: (1, 3, 1, 3), 3: (1, 4, 1, 3)}


def test_passages_are_located_on_every_page(spark, tmp_path):
    from lectern.plans import adapters as A
    from lectern.plans import q_context as Q

    d = documents(spark, tmp_path)
    lines = {(r.document_id * 1_000_000_000 + r.seq): (r.document_id, r.page, r.seq) for r in A.paragraphs(spark, d).collect()}
    assert max(page for _, page, _ in lines.values()) > 1
    got = {}
    for r in Q.Q["j9_locate_passage"](spark, d).collect():
        got.setdefault(r.target_id, set()).add(r.idx)
    last = {}
    for doc, page, seq in lines.values():
        last[doc, page] = max(seq, last.get((doc, page), 0))
    assert got == {t: {seq, min(seq + 1, last[doc, page])} for t, (doc, page, seq) in lines.items()}


def test_jobs(spark):
    rows = [(1, "running", 16, 2), (2, "running", 16, 3), (3, "running", 3, 0), (4, "pending", 0, 0)]
    j = spark.createDataFrame(rows, "job_id long, status string, age int, attempts int").withColumns({"started_at": F.expr("timestamp '2024-01-01 12:00:00' - make_interval(0,0,0,0,0,age,0)"), "error": F.lit(None).cast("string"), "created_at": F.lit(0)})
    got = {r.job_id: (r.claimable, r.recovered_status) for r in L.classify_jobs(j, F.expr("timestamp '2024-01-01 12:00:00'")).collect()}
    assert got == {1: (True, "pending"), 2: (False, "failed"), 3: (False, "pending"), 4: (True, "pending")}
    assert [r.job_id for r in L.claim_oldest(j, F.expr("timestamp '2024-01-01 12:00:00'")).collect()] == [1, 4]


def test_turns(spark):
    e = [(1, 0, "search", None, "q1"), (1, 1, "text", "note", None), (1, 2, "turn", None, None), (1, 3, "search", None, "q2"), (1, 4, "text", "An", None), (1, 5, "text", "swer", None), (1, 6, "done", None, None), (2, 0, "text", "cut", None)]
    df = spark.createDataFrame([r + (None,) for r in e], "turn_id long, seq long, type string, text string, query string, error string")
    a, b = L.fold_turns(df).orderBy("turn_id").collect()
    assert (a.searches, a.notes, a.answer, a.error, a.trail) == (2, "note", "Answer", None, "search:q1|search:q2")
    assert b.error == "ended unexpectedly"


def test_registry_ids_are_unique_and_stable(spark):
    rows = [(1, 0, "a", "P3"), (1, 1, "b", "P3"), (1, 2, "c", None), (1, 3, "a", None), (2, 0, "x", None)]
    df = spark.createDataFrame(rows, "thread_id long, seq long, source_key string, forced_id string")
    got = {(r.thread_id, r.source_key): r.passage_id for r in C.register_passages(df).collect()}
    assert got == {(1, "a"): "P3", (1, "b"): "P4", (1, "c"): "P5", (2, "x"): "P1"}


def test_numbering_over_ranges(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 37) % 1000)
    got = C.numbered(df, F.col("k")).select("k", "n").collect()
    assert all(r.n == r.k + 1 for r in got)


def test_numbering_of_wide_rows(spark):
    """Ranges of wide rows and of their keys alone are joined by adaptive execution into different ones."""
    small = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        wide = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.md5((F.col("id") * 100 + i).cast("string"))), "")
        df = spark.range(4000).select("id", ((F.col("id") * 7919) % 4000).alias("k"), wide.alias("text"))
        got = C.numbered(df, F.col("k")).where(F.length("text") > 0).select("k", "n").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.n, r.k) for r in got) == [(i + 1, i) for i in range(4000)]


def test_replacing_twice_changes_nothing(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, v string")
    n = spark.createDataFrame([(2, "c"), (3, "d")], "document_id long, v string")
    once = L.replace_documents(t, n)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, L.replace_documents(once, n).collect())) == [(1, "a"), (2, "c"), (3, "d")]
