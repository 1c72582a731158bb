"""Every operator on rows that are odd in some way, and on none."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import embedding_dedup, minhash, mixing, packing, pii, suffixes, tokens, toxicity, warc
from lectern.llm.ann import nearest

LONG = " ".join(f"w{i}" for i in range(40_000))
TEXT = "the quiet river runs under the old stone bridge and on to the sea where ships wait for the tide to turn again today"
DOCS = [(1, TEXT, "en", "a", 5), (1, TEXT, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \t\n ", "en", None, 4), (None, TEXT, "en", "a", 5), (5, TEXT + " once more", "en", "b", 9),
        (6, LONG, "xx", "b", len(LONG)), (7, "İé😀 mail me.now@x-y.org or +1 (555) 010-9999", "tr", "c", 40), (8, TEXT, "en", "a", 5)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = ("id", "a", "b", "key", "d", "n", "n_tokens", "component_id", "kept", "score", "rank", "toxic", "shard", "row_key", "spans", "z", "hits", "copy_no", "mix_key", "bin_id", "rate", "x", "features", "digest", "u", "weight")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


def test_minhash(docs, none):
    got = by_id(minhash.near_duplicates(docs, size=2))
    assert len(got[1]) == 2 and all(r.component_id == 1 and r.kept for r in got[1])
    assert (got[8][0].component_id, got[8][0].kept, got[5][0].component_id) == (1, False, 1)
    assert all(got[i][0].n_shingles == 0 and got[i][0].kept and got[i][0].component_id == i for i in (2, 3, 4))
    assert got[None][0].kept and got[None][0].component_id is None and got[6][0].n_shingles == 39_999
    assert minhash.near_duplicates(none).collect() == []
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(docs).where("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 7]


def test_suffixes(docs, none):
    got = by_id(suffixes.repeated_spans(docs))
    assert all(r.n_removed == 0 and r.n_bytes == len(TEXT) for r in got[1] + got[None])
    assert (got[8][0].n_removed, got[8][0].kept_sha256) == (len(TEXT), hashlib.sha256(b"").hexdigest())
    assert (got[5][0].n_removed, got[5][0].kept_sha256) == (len(TEXT), hashlib.sha256(b" once more").hexdigest())
    assert got[2][0].n_bytes == got[3][0].n_bytes == 0 and got[6][0].n_removed == 0
    assert suffixes.repeated_spans(none).collect() == []


def test_pii(docs, none):
    got = by_id(pii.find_pii(docs))
    assert [(s.kind, s.start, s.end) for s in got[7][0].spans] == [("email", 9, 23), ("phone", 27, 44)]
    assert len(got) == 9 and all(not r.spans for i in (1, 2, 3, 4, None) for r in got[i])
    clean = by_id(pii.redact(docs))
    assert clean[7][0].text == "İé😀 mail <EMAIL> or <PHONE>" and clean[7][0].n_chars == len(clean[7][0].text)
    assert clean[2][0].text is None and clean[1][0].text == TEXT and set(clean[1][0].asDict()) == {*SCHEMA.replace(",", "").split()[::2], *CLASH}
    assert pii.redact(none).collect() == []


def test_tokens_and_packing(docs, none):
    got = by_id(tokens.token_counts(docs))
    assert (got[2][0].n_tokens, got[3][0].n_tokens, got[4][0].n_tokens) == (0, 0, 0) and got[1][0] == got[1][1]
    assert tokens.token_counts(none).collect() == []
    packed = packing.pack_documents(docs, 100).collect()
    assert sum(r.n_words for r in packed if r.doc_id == 6) == 40_000
    assert all((r.bin_id is None) == (r.n_words == 0) for r in packed) and {r.doc_id for r in packed if r.bin_id is None} == {2, 3, 4}
    assert packing.pack_documents(none).collect() == []


def test_mixing(docs, none):
    got = mixing.mix(docs, {"a": 1.0, "c": 1.0}, total=40.0).collect()
    assert {r.source for r in got} == {"a", "c"} and set(got[0].asDict()) == {*SCHEMA.replace(",", "").split()[::2], *CLASH}
    assert mixing.mix(none).collect() == [] and mixing.mix(docs, {"a": 1.0, None: 1.0}).where("source = 'b'").count() == 0
    again = mixing.mix(docs.repartition(5), {"a": 1.0, "c": 1.0}, total=40.0)
    assert sorted((r.mix_key, r.copy_no) for r in got) == sorted((r.mix_key, r.copy_no) for r in again.collect())


def test_toxicity_without_labels(docs, none, spark):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs.withColumn("text", F.when(F.col("doc_id") == 5, "you idiot").otherwise(F.col("text"))), labels).collect()
    assert len(got) == len(DOCS) and {r.doc_id for r in got if r.predicted} == {5}
    assert toxicity.toxicity(none, labels).collect() == []


VECTORS = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [2.0, 0.1]), (8, [0.0, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (1, [1.0, 0.0]), (10, [])]


def test_vectors(spark):
    v = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "u", "cell", "query_id", "score", "weight")})
    got = by_id(embedding_dedup.near_duplicate_vectors(v), "vec_id")
    assert [(got[i][0].n_links, got[i][0].component_id, got[i][0].kept) for i in (1, 2, 7, 8)] == [(2, 1, True), (2, 1, False), (2, 1, False), (0, 8, True)]
    assert all(got[i][0].n_links == 0 and got[i][0].kept for i in (3, 4, 5, 6, 9, 10, None)) and len(got[1]) == 2
    near = by_id(nearest(v, v, k=2), "query_id")
    assert [(r.vec_id, round(r.score, 6)) for r in sorted(near[1], key=lambda r: r["rank"])] == [(2, 0.0), (7, 1.004988)]
    assert set(near) == {1, 2, 7, 8}
    assert embedding_dedup.near_duplicate_vectors(v.limit(0)).collect() == [] and nearest(v.limit(0), v).collect() == []


def test_warc(spark):
    big = "x" * 200
    rows = [(1, "http://a b", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "é" * 30), (6, "u", "é" * 30), (None, "u", big), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" + big)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "first": F.lit(1)})
    got = by_id(warc.archive(p), "page_id")
    assert (got[1][0].record_type, got[2][0].record_type, got[2][0].refers_to, got[None][0].refers_to) == ("response", "revisit", 1, 1)
    assert got[3][0].payload_bytes == 0 and got[5][0].record_type == got[6][0].record_type == "response" and got[6][0].payload_bytes == 60
    assert got[7][0].payload_digest == hashlib.sha256(rows[7][2].encode()).hexdigest()
    assert warc.archive(p.limit(0)).collect() == []


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_rows(spark, docs, tmp_path, empty):
    import corpus_pipeline as cp

    rude = spark.createDataFrame([(11, "you idiot", "en", "a", 9)], SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})
    table = docs.union(rude)
    (table.limit(0) if empty else table).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(1, 0, "clash"), (None, 1, "clash"), (2, None, "clash")], "doc_id long, toxic int, text string")
    (labels.limit(0) if empty else labels).write.parquet(f"{tmp_path}/labels.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    if empty:
        assert got == []
        return
    step, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == cp.DOCUMENT_COLUMNS
        step.write.parquet(f"{tmp_path}/{name}.parquet")
        step = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        seen[name] = [r.doc_id for r in step.collect()]
    key = lambda i: (i is None, i or 0)
    assert sorted(seen["toxicity"], key=key) == sorted((r[0] for r in DOCS), key=key)
    assert sorted(seen["near_duplicates"], key=key) == [1, 2, 3, 4, 6, 7, None] and sorted(seen["pii"], key=key) == [1, 2, 3, 4, 6, 7, None]
    words = {r.doc_id: len((r.text or "").split()) for r in spark.read.parquet(f"{tmp_path}/pii.parquet").collect()}
    for i in words:
        assert sum(r.n_words for r in got if r.doc_id == i) == words[i] * seen["mixing"].count(i)
    bins = {}
    for r in got:
        assert (r.bin_id is None) == (r.n_words == 0)
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for pieces in bins.values():
        named = [r.source for r in pieces if r.source is not None]
        assert sum(r.n_words for r in pieces) <= packing.CAPACITY and len(named) == len(set(named))
