"""What changes over time: tables in buckets, ingest, streams with state, an index kept up to date; and quotations, covers, sentences, requests."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import audit, context, graph_index, joins, keyword, library, quotes, vector
from lectern.sources import buckets, files
from lectern.streaming import jobs, stateful


#: Where event time begins here: a watermark begins at 0, and what is not after it is late.
T0 = 10_000


# --- tables in buckets ---


def rows_of(spark, path, schema):
    return sorted(map(tuple, buckets.read_buckets(spark, path, schema).collect()))


def test_replacing_on_disk(spark, tmp_path, monkeypatch):
    path, schema = f"{tmp_path}/t", "document_id long, part int, v string"
    start = spark.createDataFrame([(i, p, "old") for i in range(40) for p in range(3)], schema)
    buckets.replace_in_buckets(start, path, buckets=8)
    before = buckets.committed(spark, path)[1]
    new = spark.createDataFrame([(5, 0, "new"), (5, 1, "new"), (100, 0, "new")], schema)
    gone = spark.createDataFrame([(7,)], "document_id long")
    touched = {r[0] for r in spark.createDataFrame([(5,), (100,), (7,)], "document_id long").select(buckets.bucket_of("document_id", 8)).collect()}

    # the driver is lost between two buckets: their files are there, the commit is not
    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(buckets, "commit", lost)
        with pytest.raises(RuntimeError):
            buckets.replace_in_buckets(new, path, buckets=8, gone=gone)
    assert rows_of(spark, path, start.schema) == sorted(map(tuple, start.collect()))
    want = sorted([(i, p, "old") for i in range(40) for p in range(3) if i not in (5, 7)] + [(5, 0, "new"), (5, 1, "new"), (100, 0, "new")])
    for _ in range(2):
        assert set(buckets.replace_in_buckets(new, path, buckets=8, gone=gone)) == touched
        assert rows_of(spark, path, start.schema) == want
    after = buckets.committed(spark, path)[1]
    assert {b for b in before if after.get(b) != before[b]} <= touched and len(touched) < len(before)
    # all of it may go
    buckets.replace_in_buckets(start.limit(0), path, buckets=8, gone=spark.createDataFrame([(i,) for i in range(200)], "document_id long"))
    assert rows_of(spark, path, start.schema) == []


# --- ingest ---


def deliver(spark, path, n, rows):
    df = spark.createDataFrame(rows, "document_id long, title string, sha256 string").coalesce(1)
    df.write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema("document_id long, title string, sha256 string").parquet(f"{path}/in")
    jobs.stream_ingest(stream, f"{path}/out", f"{path}/check", buckets=4).awaitTermination()
    return {(r.document_id, r.title, r.sha256) for r in jobs.latest_documents(spark.read.parquet(f"{path}/out/rows")).collect()}


def test_a_document_that_becomes_a_duplicate_goes(spark, tmp_path):
    assert deliver(spark, tmp_path, 0, [(3, "three", "X"), (5, "old", "Y"), (6, "copy", "Y")]) == {(3, "three", "X"), (5, "old", "Y")}
    assert deliver(spark, tmp_path, 1, [(5, "new", "X")]) == {(3, "three", "X")}
    # the content that it gave up is free, its own id too
    assert deliver(spark, tmp_path, 2, [(8, "eight", "Y"), (5, "again", "Z")]) == {(3, "three", "X"), (8, "eight", "Y"), (5, "again", "Z")}
    assert deliver(spark, tmp_path, 3, [(8, "eight", "Y"), (3, "three", "W"), (9, "nine", "X")]) == {(3, "three", "W"), (8, "eight", "Y"), (5, "again", "Z"), (9, "nine", "X")}


def test_ingest_from_files(spark, tmp_path):
    def take(n, rows):
        for name, body in rows.items():
            at = tmp_path / "inbox" / str(n) / name
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(body)
        name = F.xxhash64(F.element_at(F.split("path", "/"), -1))
        jobs.ingest_files(spark, f"{tmp_path}/inbox", f"{tmp_path}/out", f"{tmp_path}/check", name).awaitTermination()
        got = jobs.latest_documents(spark.read.parquet(f"{tmp_path}/out/rows"))
        return sorted((r.path.rsplit("/", 2)[1], r.path.rsplit("/", 1)[1]) for r in got.collect())

    assert take(0, {"a.pdf": b"%PDF-1 a", "b.pdf": b"%PDF-1 b", "c.pdf": b"no pdf"}) == [("0", "a.pdf"), ("0", "b.pdf")]
    # again, changed, a copy under another name, and one that is right now
    assert take(1, {"a.pdf": b"%PDF-1 a", "b.pdf": b"%PDF-2 b", "d.pdf": b"%PDF-1 a", "c.pdf": b"%PDF-1 c"}) == [("1", "a.pdf"), ("1", "b.pdf"), ("1", "c.pdf")]
    rejects = spark.read.parquet(f"{tmp_path}/out/rejects").collect()
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in rejects] == [("c.pdf", "wrong magic bytes")]


def test_small_files_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    """A scan that has a partition for each file is no batch with a task and a written file for each."""
    monkeypatch.setattr(jobs, "LOOKUPS", 1)
    monkeypatch.setattr(jobs, "PARTITIONS_READ", 5, raising=False)
    (tmp_path / "inbox").mkdir()
    for i in range(40):
        (tmp_path / "inbox" / f"{i}.txt").write_text(f"no pdf {i}")
    lookups, size = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(lookups)
    spark.conf.set(size, "4m")
    try:
        jobs.ingest_files(spark, f"{tmp_path}/inbox", f"{tmp_path}/out", f"{tmp_path}/check", F.xxhash64("path")).awaitTermination()
    finally:
        spark.conf.unset(size)
        spark.conf.set(lookups, before)
    assert spark.read.parquet(f"{tmp_path}/out/rejects").distinct().count() == 40
    assert len(list(tmp_path.glob("out/rejects/batch=0/part-*"))) <= 8


def test_files_lie_in_few_folders_and_a_batch_is_met_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FOLDER_FILES", 3)
    rows = spark.createDataFrame([(f"id={i}.txt", f"{'%PDF-' if i % 2 else ''}é{i}\n".encode()) for i in range(10)], "name string, body binary").coalesce(1)
    assert files.write_files(rows, f"{tmp_path}/inbox") == 10
    made = sorted(tmp_path.glob("inbox/*/*"), key=lambda f: int(f.stem[3:]))
    assert [f.read_bytes() for f in made] == [f"{'%PDF-' if i % 2 else ''}é{i}\n".encode() for i in range(10)]
    assert sorted(len(list(d.glob("*"))) for d in tmp_path.glob("inbox/*")) == [1, 3, 3, 3]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def digest(v):
        seen.add(1)
        return v

    rows.select("name").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("name string").parquet(f"{tmp_path}/in").select(F.substring("name", 4, 1).cast("long").alias("document_id"), digest("name").alias("sha256"))
    jobs.stream_ingest(stream, f"{tmp_path}/out", f"{tmp_path}/check", lambda b: b.where("sha256 < 'id=5'"), rejects=lambda b: b.where("sha256 >= 'id=5'")).awaitTermination()
    assert seen.value == 10
    assert spark.read.parquet(f"{tmp_path}/out/rows").count() == spark.read.parquet(f"{tmp_path}/out/rejects").count() == 5


def run(stream, path, schema):
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{path}/out")


def test_first_documents_and_horizons(spark, tmp_path):
    schema = "document_id long, sha256 string, ts timestamp"
    got, near = [], []
    for n, rows in enumerate([[(2, "a", 0), (1, "a", 5), (3, "b", 0)], [(0, "a", 3000), (9, "c", 7200)], [(8, "z", 100000)], [(4, "b", 200000), (2, "a", 200000), (5, "c", 200000), (6, "c", 200001)]]):
        df = spark.createDataFrame(rows, "document_id long, sha256 string, s long").select("document_id", "sha256", F.timestamp_seconds(F.col("s") + T0).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        got = run(jobs.first_documents(stream), f"{tmp_path}/all", "sha256 string, document_id long").collect()
        near = run(jobs.stream_dedupe(stream, horizon="1 hour"), f"{tmp_path}/near", schema).collect()
    assert {(r.sha256, r.document_id) for r in got} == {("a", 1), ("b", 3), ("c", 9), ("z", 8)} and len(got) == 4
    # a content is forgotten an hour behind the newest row, and met anew later
    assert sorted(r.sha256 for r in near) == ["a", "a", "b", "b", "c", "c", "z"]


def test_state_on_disk(spark, tmp_path):
    saved = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled")}
    try:
        jobs.remember_on_disk(spark)
        for n, rows in enumerate([[(1, "a"), (2, "b")], [(3, "a"), (4, "c")]]):
            spark.createDataFrame(rows, "document_id long, sha256 string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            got = run(jobs.first_documents(spark.readStream.schema("document_id long, sha256 string").parquet(f"{tmp_path}/in")), tmp_path, "sha256 string, document_id long").collect()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert sorted((r.sha256, r.document_id) for r in got) == [("a", 1), ("b", 2), ("c", 4)]


# --- streams with timers ---

LIFE = "document_id long, ts timestamp, seq long, status string, stage string, progress double, detail string"


def test_stalled_once_and_again(spark, tmp_path):
    """Batch by batch: a silence is told once, a later one again; other documents' events move the time."""
    def life(rows):
        return spark.createDataFrame(rows, "document_id long, s double, seq long, status string, detail string").select("document_id", F.timestamp_micros(((F.col("s") + T0) * 1_000_000).cast("long")).alias("ts"), "seq", "status", F.lit("x").alias("stage"), F.lit(1.5).alias("progress"), "detail")

    batches = [[(1, 0.0, 0, "queued", "why"), (2, 1.0, 0, "processing", None), (3, 2.0, 0, "queued", None), (3, 3.0, 1, "ready", None)], [(2, 40.0, 1, "processing", None)], [(4, 46.0, 0, "ready", None)], [(4, 86.0, 1, "ready", None), (1, 60.0, 1, "processing", None)], [(4, 300.0, 2, "ready", None)]]
    told = []
    for rows in batches:
        life(rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = run(stateful.stalled_stream(spark.readStream.schema(LIFE).parquet(f"{tmp_path}/in")), tmp_path, stateful.STALLED).collect()
        told.append(sorted((r.document_id, r.updated_at.replace(tzinfo=datetime.UTC).timestamp() - T0) for r in out))
    assert told == [[], [], [(1, 0.0)], [(1, 0.0), (2, 40.0)], [(1, 0.0), (1, 60.0), (2, 40.0)]]
    assert {r.detail for r in out if r.document_id == 1} == {"why"} and {r.progress for r in out} == {1.0}
    state = library.document_status(spark.read.schema(LIFE).parquet(f"{tmp_path}/in"))
    now = F.timestamp_seconds(F.lit(300 + T0))
    assert {r.document_id for r in library.stalled(state, now).collect()} == {1, 2}


def test_states_settle(spark):
    rows = [(1, 0, "processing", "embed", 0.4, "half"), (1, 1, "failed", "embed", 0.5, "Processing failed: x"), (2, 0, "ready", "done", 0.9, None), (3, 0, "processing", "embed", -1.0, None), (4, 0, "needs_ocr", "x", None, "no text")]
    df = spark.createDataFrame(rows, "document_id long, seq long, status string, stage string, progress double, detail string").withColumn("ts", F.timestamp_seconds("seq"))
    got = {r.document_id: (r.status, r.stage, r.progress, r.detail) for r in library.document_status(df).collect()}
    assert got == {1: ("failed", None, 0.5, "Processing failed: x"), 2: ("ready", None, 1.0, None), 3: ("processing", "embed", 0.0, None), 4: ("needs_ocr", None, 1.0, "no text")}


def test_turns_end_by_event_or_by_timer(spark, tmp_path):
    def event(turn, seq, kind, s, text=None, query=None, **more):
        return {"turn_id": turn, "seq": seq, "type": kind, "text": text, "query": query, "round": None, "cited": None, "unknown": None, "verified": None, "input_tokens": None, "output_tokens": None, "error": None, **more, "s": s}

    schema = files.EVENTS.replace("at timestamp", "s long")
    done = {"cited": ["P1"], "unknown": [], "verified": [True, False], "input_tokens": 70, "output_tokens": 5}
    batches = [[event(1, 0, "search", 0, query="q"), event(1, 1, "text", 1, "note"), event(1, 2, "turn", 2), event(2, 0, "text", 3, "cut"), event(3, 1, "done", 4, **done)],
               [event(1, 3, "text", 10, "An"), event(1, 4, "text", 10, "swer"), event(1, 4, "text", 10, "swer"), event(1, 5, "done", 11, **done), event(3, 0, "text", 12, "late")],
               [event(1, 5, "done", 11, **done), event(4, 0, "error", 700, error="boom")], [event(5, 0, "search", 2000, query="x")]]
    ends = []
    for rows in batches:
        df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema).withColumn("at", F.timestamp_seconds(F.col("s") + T0)).drop("s")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = run(stateful.fold_turns_stream(spark.readStream.schema(files.EVENTS).parquet(f"{tmp_path}/in")), tmp_path, stateful.TURN).collect()
        ends.append(sorted(r.turn_id for r in out))
    assert ends == [[], [1, 3], [1, 2, 3, 4], [1, 2, 3, 4]]
    batch = library.fold_turns(spark.read.schema(files.EVENTS).parquet(f"{tmp_path}/in").dropDuplicates(["turn_id", "seq"])).where("turn_id < 5")
    columns = [c.split()[0] for c in stateful.TURN.split(", ")]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in out))) == sorted(map(str, (tuple(r[c] for c in columns) for r in batch.collect())))
    one = next(r for r in out if r.turn_id == 1)
    assert (one.answer, one.notes, one.trail, one.cited, one.verified, one.input_tokens, one.error) == ("Answer", "note", "search:q", ["P1"], [True, False], 70, None)
    assert {r.turn_id: r.error for r in out if r.error} == {2: "ended unexpectedly", 4: "boom"}


def test_cascade(spark):
    t = {"documents": [(1,), (2,)], "chunks": [(10, 1), (11, 1), (20, 2), (30, None)], "postings": [(10, "a"), (20, "b"), (20, "c")], "jobs": [(7, 1), (8, 2)], "attempts": [(7, 1), (7, 2), (8, 1)], "notes": [(7, "x")]}
    kinds = {"documents": "document_id long", "chunks": "chunk_id long, document_id long", "postings": "chunk_id long, lexeme string", "jobs": "job_id long, document_id long", "attempts": "job_id long, n int", "notes": "job_id long, v string"}
    tables = {k: spark.createDataFrame(v, kinds[k]) for k, v in t.items()}
    left = library.delete_documents(tables, spark.createDataFrame([(1,), (None,)], "document_id long"), {"postings": ("chunks", "chunk_id"), "attempts": ("jobs", "job_id"), "notes": ("attempts", "job_id")})
    got = {k: sorted(tuple(r[c.split()[0]] for c in kinds[k].split(", ")) for r in v.collect()) for k, v in left.items()}
    assert got == {"documents": [(2,)], "chunks": [(20, 2), (30, None)], "postings": [(20, "b"), (20, "c")], "jobs": [(8, 2)], "attempts": [(8, 1)], "notes": []}


def test_many_keys_that_go_are_hashed_and_rows_are_not_sorted(spark):
    n = joins.MAX_BROADCAST_ROWS + 1
    tables = {"chunks": spark.range(n + 3).select((F.col("id") * 10).alias("chunk_id"), F.col("id").alias("document_id")), "postings": spark.range(2 * n + 6).select((F.floor(F.col("id") / 2) * 10).alias("chunk_id"))}
    left = library.delete_documents(tables, spark.range(n).withColumnRenamed("id", "document_id"), {"postings": ("chunks", "chunk_id")})
    for name, rows in (("chunks", 3), ("postings", 6)):
        plan = left[name]._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        assert left[name].count() == rows and left[name].where(F.col("chunk_id") < 10 * n).count() == 0


# --- an index that changes ---


def test_graphs_are_built_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def built(shard):
        seen.add(1)
        return shard

    rows = [(s, 2, [2 * s, 2 * s + 1], [1.0, 0.0, 0.0, 1.0], [1, -1, 0, -1], 2) for s in range(3)]
    index = graph_index.store_graphs(spark.createDataFrame(rows, graph_index.GRAPH).withColumn("shard", built("shard")), f"{tmp_path}/index")
    assert seen.value == 3 and sorted(k for r in index.collect() for k in r["keys"]) == list(range(6))


def test_clearing_a_shard_holds_candidates_only():
    import tracemalloc

    from lectern.functions import graph

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32))
    adj, dead = graph.build(x), rng.random(1500) < 0.3
    tracemalloc.start()
    after = graph.without(x, adj.copy(), dead)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # 256 points with 64 x 65 places for candidates of 32 numbers are 273 MB
    assert len(after) == (~dead).sum() and after.max() < len(after) and ((after >= 0).sum(axis=1) > 0).all()


def test_index_after_a_third_is_replaced(spark, tmp_path):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1800, 24)).round(4)
    rows = lambda ids, shift=0: spark.createDataFrame([(int(i), x[(i + shift) % 1800].tolist()) for i in ids], "chunk_id long, embedding array<double>")
    path = f"{tmp_path}/index"
    vector.graph_index(rows(range(1200)), path)
    index = vector.update_index(path, rows(range(1200, 1600)), spark.createDataFrame([(i,) for i in range(400)], "chunk_id long"))
    # some are replaced by other vectors, one comes back, one has no direction any more
    index = vector.update_index(path, rows(range(1000, 1100), 800).unionByName(rows([0])).unionByName(spark.createDataFrame([(500, [0.0] * 24)], "chunk_id long, embedding array<double>")))
    now = {i: x[i] for i in [0, *range(400, 1600)] if i != 500} | {i: x[(i + 800) % 1800] for i in range(1000, 1100)}
    table = spark.createDataFrame([(i, v.tolist()) for i, v in now.items()], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(int(i), x[i].tolist()) for i in range(0, 1800, 9)], "query_id long, qvec array<double>")
    found, exact = vector.knn_ann(q, index, 10), vector.knn_exact(q, table.withColumn("document_id", F.lit(1)), 10)
    r = vector.recall(found, exact).first()
    ids = {i.chunk_id for i in found.select("chunk_id").distinct().collect()}
    assert r.found >= 0.9 * r.n and ids <= set(now) and found.count() == 2000


def test_exact_search_in_place_and_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(3000, 6)), 1)
    rows = [(i, 1, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, 1, x[7].tolist()) for i in range(90)] + [(9000, 1, None), (9001, 1, [0.0] * 6), (9002, 1, [1.0])]
    c = spark.createDataFrame(rows, "chunk_id long, document_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(40)] + [(99, [2.0])], "query_id long, qvec array<double>")
    near = sorted(map(tuple, vector.knn_exact(q, c, 60).select("query_id", "rank", "chunk_id", F.round("similarity", 9)).collect()))
    monkeypatch.setattr(vector, "QUERY_NUMBERS", 0)
    assert near == sorted(map(tuple, vector.knn_exact(q, c, 60).select("query_id", "rank", "chunk_id", F.round("similarity", 9)).collect()))
    assert len(near) == 40 * 60 + 1


def test_fitted_embedder(spark, tmp_path):
    texts = [(i, f"the common words and rare{i}" + (" often" if i % 2 else "")) for i in range(64)]
    df = spark.createDataFrame(texts, "chunk_id long, text string")
    fitted = vector.fit_frequencies(df, f"{tmp_path}/f")
    assert fitted.where("place = -1").first().df == 64
    one = vector.weighted_embedder(fitted)
    again = vector.weighted_embedder(spark.read.parquet(f"{tmp_path}/f"))
    both = [m([t for _, t in texts]) for m in (one, again)]
    assert both[0] == both[1] == [list(map(float, v)) for v in both[0]]
    q = vector.embed_queries(spark.createDataFrame([(1, texts[9][1])], "query_id long, query string"), one, prefix="").first().qvec
    p = [r.embedding for r in vector.embed_passages(df.where("chunk_id = 9"), again).collect()]
    assert list(p[0]) == list(q)
    plain = vector.hashing_embedder()([texts[3][1], texts[5][1]])
    # passages that share only what all share are less alike once words are weighed
    assert np.dot(*one([texts[3][1], texts[5][1]])) < np.dot(*plain) - 0.2


def test_vectors_are_audited(spark):
    rows = [([1.0, 0.0],), ([float("inf"), 0.0],), ([float("nan"), 0.0],), (None,), ([1.0],), ([1.0, None],), ([3.0, 4.0],)]
    df = spark.createDataFrame(rows, "embedding array<double>")
    assert {r.kind: r.n for r in vector.validate_vectors(df, 2, asked=9).collect()} == {"ok": 1, "not finite": 3, "null": 1, "width": 1, "norm": 1, "missing": 2}
    assert {r.kind: r.n for r in vector.validate_vectors(df, 2, asked=7).collect()} == {"ok": 1, "not finite": 3, "null": 1, "width": 1, "norm": 1}


# --- quotations, covers, sentences, requests, order ---


def test_quotes_in_the_library(spark):
    """Against plain containment: parts of words at both ends, short fragments, ellipses, edits, and a sentence that every third passage has."""
    boiler = "all of this was said before and will be said again"
    texts = {i: f"passage {i} begins the tale of number {i}; " + (boiler if i % 3 == 0 else f"nothing more is told of {i % 7} wolves") for i in range(120)} | {500: "hyphen-\nated words are rejoined here", 501: "The cat sat; catalogues of the day", 502: "", 503: None}
    passages = spark.createDataFrame(list(texts.items()), "passage_id long, text string")
    asked = ["passage 7 begins the tale of number 7", "begins the tale of number 11", boiler, "his was said before and will b", "the tale ... was said before", "tale of number 5 [edit] of 5 wolves", "at sat ... he day", "hyphenated words are rejoined", "e cat ... ogues of", "never was written anywhere here", "he tale ... f numb", "told of ... nothing more is", "[only edits] ... [and dots here]"]
    answers = spark.createDataFrame([(i, f'It says "{q}" there.') for i, q in enumerate(asked)] + [(77, f'Both "{boiler}" and “{asked[0]}”.'), (78, None)], "answer_id long, text string")
    norm = {r.i: r.n for r in passages.select(F.col("passage_id").alias("i"), T.normalize_for_match(F.col("text")).alias("n")).collect()}
    quoted = answers.select("answer_id", F.posexplode(T.extract_quotes(F.col("text"))).alias("pos", "quote")).select("*", T.quote_fragments(F.col("quote")).alias("fs")).collect()
    want = {}
    for r in quoted:
        hits = [i for i, n in norm.items() if n is not None and r.fs and all(f in n for f in r.fs)]
        want[r.answer_id, r.pos] = (bool(hits), len(hits), min(hits, default=None))
    got = {(r.answer_id, r.pos): (r.verified, r.passages, r.first_passage) for r in quotes.check_library_quotes(answers, passages).collect()}
    assert got == want and sum(v[0] for v in want.values()) >= 10 and got[2, 0][1] == 40
    assert quotes.check_library_quotes(answers.limit(0), passages).collect() == [] and not any(r.verified for r in quotes.check_library_quotes(answers, passages.limit(0)).collect())
    plan = quotes.check_library_quotes(answers, passages)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_quotes_of_three_words_are_sought_by_all_of_them(spark, monkeypatch):
    """A fragment's frequent inner word alone leads to no passage, and of the other keys nearly none are shuffled."""
    passages = spark.range(300).select(F.col("id").alias("passage_id"), F.format_string("w%d the x%d and more the words", "id", "id").alias("text"))
    answers = spark.range(300).select(F.col("id").alias("answer_id"), F.format_string('"w%d the x%d ... and more the words"', "id", "id").alias("text"))
    most, plain = [], quotes.written
    monkeypatch.setattr(quotes, "written", lambda df: most.append((df.columns, (w := plain(df)).count())) or w)
    got = quotes.check_library_quotes(answers, passages).collect()
    assert {(r.answer_id, r.passages, r.first_passage) for r in got} == {(i, 1, i) for i in range(300)}
    assert max(n for columns, n in most if "of" in columns) <= 3000 < 300 * 300


def test_quotes_are_candidates_where_all_their_keys_are(spark, monkeypatch):
    """Passages that have one key of a quotation each are no candidates; a passage longer than an Arrow batch is one passage."""
    monkeypatch.setattr(quotes, "MAX_BROADCAST_ROWS", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    rows = spark.range(200).select(F.col("id").alias("passage_id"), F.concat(F.repeat(F.lit("filler of the page "), 30), F.when(F.col("id") % 2 == 0, "the green door stood").otherwise("the small key turned"), F.format_string(" in w%d x%d y%d", "id", "id", "id")).alias("text"))
    passages = rows.unionByName(spark.createDataFrame([(900, "so the green door stood open and the small key turned"), (None, "the green door stood where the small key turned")], "passage_id long, text string"))
    answers = spark.createDataFrame([(1, '"the green door stood ... the small key turned"')], "answer_id long, text string")
    most, plain = [], quotes.written
    monkeypatch.setattr(quotes, "written", lambda df: most.append((df.columns, (w := plain(df)).count())) or w)
    try:
        got = quotes.check_library_quotes(answers, passages).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.verified, r.passages, r.first_passage) for r in got] == [(True, 1, 900)]
    assert [n for columns, n in most if "of" in columns] == [1, 1] and ["passage_id", "keys"] in [columns for columns, _ in most]


def plain_covers(places):
    """(begin, end) by trying: the shortest stretch of places from each start that holds all parts, if none of the stretches inside it does."""
    parts, out = {p for _, p, _ in places}, []
    whole = lambda x: {p for _, p, _ in x} == parts
    for i in range(len(places)):
        j = next((j for j in range(i + 1, len(places) + 1) if whole(places[i:j])), None)
        # of places at one point any may begin a cover, so it must not shrink by points
        if j and not whole([p for p in places[i:j] if p[0] > places[i][0]]):
            span = (places[i][0], max(s + z for s, _, z in places[i:j]))
            out += [span] if not out or span[0] > out[-1][0] else []
    return [x for x in out if not any(y != x and x[0] <= y[0] and y[1] <= x[1] and y[0] > x[0] for y in out)]


def test_covers():
    rng = np.random.default_rng(2)
    assert keyword.covers([(0, 1, 2), (3, 2, 1), (9, 1, 2)]) == [(0, 4, 1), (3, 11, 5)] and keyword.covers([(4, 1, 3), (9, 1, 3)]) == [(4, 7, 0), (9, 12, 0)]
    for _ in range(200):
        places = sorted({(int(s), int(p), 1) for s, p in zip(rng.integers(0, 40, 14), rng.integers(0, 3, 14))})
        got = keyword.covers(places)
        assert [(b, e) for b, e, _ in got] == plain_covers(places), places


def test_cover_density_ranks_tight_passages_first(spark):
    c = spark.createDataFrame([(1, "red fox runs past many trees and sees a river"), (2, "red fox river"), (3, "fox red river"), (4, "river red fox and again red fox by the river"), (5, "a red fox river but owl"), (6, "river only")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, '"red fox" river -owl'), (2, '"red fox" or river'), (3, '"red fox" unheard')], "query_id long, query string")
    got = {}
    for r in keyword.cover_topk(keyword.keyword_queries(q), keyword.build_postings(c)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.covers, round(r.score, 6)))
    # 4: river red fox, and red fox by the river (what lies between holds the second); 2: one cover without noise; 1: seven words between
    assert got[1] == [(4, 2, round((1 + 1 / 3) / (1 + 1 + 1 / 3), 6)), (2, 1, 0.5), (1, 1, round((1 / 8) / (9 / 8), 6))]
    assert [x[0] for x in got[2]] == [4, 1, 2, 3, 5, 6] and 3 not in got, got


def test_sentences(spark):
    cases = {
        "Dr. Smith met Mr. J. Jones at 5 p.m. in St. Paul. He left.": ["Dr. Smith met Mr. J. Jones at 5 p.m. in St. Paul.", "He left."],
        "It cost 3.50. She paid! Why?": ["It cost 3.50.", "She paid!", "Why?"],
        "“Stop!” He ran. “No.” (He fell.) Then...": ["“Stop!”", "He ran.", "“No.”", "(He fell.)", "Then..."],
        "They waited... and waited... Then left.": ["They waited... and waited...", "Then left."],
        "これは文です。次の文！最後": ["これは文です。", "次の文！", "最後"],
        "The U.S.A. is large, e.g. in Texas; cf. Fig. 3. Next.": ["The U.S.A. is large, e.g. in Texas; cf. Fig. 3.", "Next."],
        "Yes! — she said. a small letter. Über uns.": ["Yes! — she said. a small letter.", "Über uns."],
        "One line.\nTwo lines.\n": ["One line.", "Two lines."], "": [], "no end": ["no end"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.s for r in df.select("t", T.sentences(F.col("t")).alias("s")).collect()} == cases


def test_requests_are_refused_not_cut(spark):
    many = [f"B{i}" for i in range(1, 52)]
    rows = [(1, 1, "search", "q", ["b1", "B9"], 12, None, None), (2, 1, "search", "q", many, None, None, None), (3, 1, "search", "q", many[:50], None, None, None), (4, 1, "search", "q", None, 13, None, None), (5, 1, "search", " ", None, None, None, None),
            (6, 1, "read", None, ["B1"], None, 0, 2), (7, 1, "read", None, ["B1"], None, 1, 2), (8, 1, "search", "q", ["B77"], 0, None, None), (9, 1, "search", "q", ["B77"], 1, None, None), (10, 1, "search", "x" * 501, None, None, None, None)]
    r = spark.createDataFrame(rows, "request_id long, thread_id long, kind string, query string, refs array<string>, limit int, start_page int, end_page int")
    catalog = spark.createDataFrame([("B1", 100), ("B50", 150)], "ref string, document_id long")
    scope = spark.createDataFrame([(1, "7,8")], "thread_id long, documents string")
    got = {x.request_id: (x.documents, x.error) for x in context.resolve_requests(r, catalog, scope).collect()}
    words = "query must have 1 to 500 characters"
    assert got == {1: ("100", None), 2: ("", "at most 50 books"), 3: ("100,150", None), 4: ("", "limit must be 1 to 12"), 5: ("", words), 6: ("", "pages begin at 1"), 7: ("100", None), 8: ("", "limit must be 1 to 12"), 9: ("", "no such books"), 10: ("", words)}
    unknown = {x.request_id: x.unknown for x in context.resolve_requests(r, catalog, scope).collect()}
    assert unknown[1] == "B9" and len(unknown[3].split(",")) == 48 and audit


def test_orders_of_the_library(spark):
    rows = [(1, "Éclair", "Zoë Adams", 5, 10), (2, "echo", "adams, Bob", None, 30), (3, "Zebra", None, 7, 20), (4, "apple", "Émile Adam", 7, 20), (5, "Echo", "  ", 1, None)]
    df = spark.createDataFrame(rows, "document_id long, title string, author string, page_count int, s long").withColumn("created_at", F.timestamp_seconds("s"))
    got = {key: [r.document_id for r in library.sort_library(df, key).collect()] for key in ("recent", "title", "author", "length")}
    assert got == {"recent": [2, 3, 4, 1, 5], "title": [4, 2, 5, 1, 3], "author": [4, 1, 2, 5, 3], "length": [3, 4, 1, 5, 2]}
    for key in got:
        assert [r.document_id for r in context.numbered(df, *library.library_order(key)).orderBy("n").collect()] == got[key]


def test_contents_of_scoped_books(spark):
    book = "array<struct<title: string, page: int, level: int>>"
    rows = [(i, f"t{i}", None, 9, 3, [(f"c{n}", n, n % 5) for n in range(100 if i == 1 else 2)] if i < 3 else None) for i in range(6)]
    df = spark.createDataFrame(rows, f"document_id long, title string, author string, page_count int, chunk_count int, outline {book}")
    few = {r.document_id: r.listing for r in context.build_catalog(df, df.where("document_id in (0, 1, 4)"), "outline").collect()}
    assert few[0] == "[B1] t0 (9 pages)\n  c0 (p. 0)\n    c1 (p. 1)" and few[1].count("\n") == 80 and "\n      c3" in few[1] and few[4] == "[B3] t4 (9 pages)"
    assert not any("\n" in r.listing for r in context.build_catalog(df, df.where("document_id < 4"), "outline").collect())
