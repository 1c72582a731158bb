"""Vectors: similarity, exact and approximate nearest neighbours, embedding, audit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.graph_index import build_graphs, search_graphs, store_graphs, update_graphs, usable
from lectern.operators.joins import few, written
from lectern.operators.keyword import CANDIDATES, top_k

#: Queries and passages (a few hundred bytes each) that a task of the exact search holds at once.
QUERY_BLOCK, PART_ROWS = 2_000, 16_384
#: Numbers in queries' vectors (of 8 bytes) up to which all queries are sent to all tasks.
QUERY_NUMBERS = 1_000_000
BATCH_TEXTS, BATCH_TOKENS, CHARS_PER_TOKEN = 128, 60_000, 4
DECIMALS = 12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a vector is zero, or null."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


#: Queries and passages of a group of ``cosines``, whose pairs (of 24 bytes) a task holds at once.
PAIR_BLOCK, PAIR_PART = 500, 4_096


def cosines(queries: DataFrame, passages: DataFrame, by: str) -> DataFrame:
    """(query_id, chunk_id, similarity): all pairs of queries (query_id, qvec) and passages (chunk_id, embedding) of one ``by``, with what ``cosine`` gives.

    The rows are as many as the pairs, by nature. A ``by`` of any size is dealt in groups of a block of queries and a part of its passages, both of bounded size, whose
    cosines are a product of matrices. Vectors of another width than most, and those that are null, zero, not finite or out of range, meet the others one by one.
    """
    width = passages.where(usable(F.col("embedding"))).groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    plain = lambda v: usable(v) & (F.size(v) == (width.w if width else 0)) & dot(v, v).between(1e-140, 1e140)
    q = queries.select(by, "query_id", F.col("qvec").cast("array<double>").alias("qvec")).withColumn("_plain", plain(F.col("qvec")))
    c = passages.select(by, "chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("_plain", plain(F.col("embedding")))
    good_q, good_c = q.where("_plain").drop("_plain"), c.where("_plain").drop("_plain")
    most = lambda rows: rows.groupBy(by).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    blocks, parts = max(1, -(-most(good_q) // PAIR_BLOCK)), max(1, -(-most(good_c) // PAIR_PART))
    deal = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = good_q.withColumn("_block", deal("query_id", blocks)).withColumn("_part", each(parts))
    sought = good_c.withColumn("_part", deal("chunk_id", parts)).withColumn("_block", each(blocks))

    def score(left, right):
        import numpy as np
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "chunk_id": np.empty(0, np.int64), "similarity": np.empty(0)})
        a, b = np.stack(left["qvec"].to_numpy()), np.stack(right["embedding"].to_numpy())
        sims = (a @ b.T) / np.sqrt(np.einsum("ij,ij->i", a, a)[:, None] * np.einsum("ij,ij->i", b, b)[None, :])
        return pd.DataFrame({"query_id": np.repeat(left["query_id"].to_numpy(np.int64), len(b)), "chunk_id": np.tile(right["chunk_id"].to_numpy(np.int64), len(a)), "similarity": sims.ravel()})

    group = [by, "_block", "_part"]
    n = max(blocks * parts, queries.sparkSession.sparkContext.defaultParallelism)
    pairs = asked.groupBy(*group).cogroup(sought.repartition(n, *group).groupBy(*group)).applyInPandas(score, "query_id long, chunk_id long, similarity double")
    odd = q.where("not _plain").drop("_plain").join(c.drop("_plain"), by).unionByName(good_q.join(c.where("not _plain").drop("_plain"), by))
    return pairs.unionByName(odd.select(F.col("query_id").cast("long").alias("query_id"), F.col("chunk_id").cast("long").alias("chunk_id"), cosine(F.col("qvec"), F.col("embedding")).alias("similarity")))


def knn_exact(queries: DataFrame, chunks: DataFrame, k: int = CANDIDATES, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): all passages (of the scoped documents) by cosine, the first k.

    queries (query_id, qvec), chunks (chunk_id, document_id, embedding), scope (query_id, document_id). Up to QUERY_NUMBERS
    numbers of queries go to where the passages lie, and a task hands on the best k of each query among its passages. More queries
    are compared with all passages by groups of one block of queries and one part of the passages, both of bounded size, as products of matrices. Scoped searches join on the document first and
    score only what is in scope; where documents share few sets of queries, each set goes to where its documents' passages lie. Vectors that are null, empty, zero or hold null or non-finite components are
    near nothing: such queries have no hits, such passages are none. Widths don't mix. Cosines are rounded to 12 decimals
    (their noise depends on a row's place in a block), so that equal vectors rank by id.
    """
    q = queries.where(usable(F.col("qvec"))).select("query_id", "qvec")
    c = chunks.where(usable(F.col("embedding")))
    best = (F.desc("similarity"), F.asc("chunk_id"))
    if scope is not None:
        owned = written(scope.select("query_id", "document_id").join(q.select("query_id"), "query_id").groupBy("document_id").agg(F.array_sort(F.collect_set("query_id")).alias("queries")).withColumn("set", F.xxhash64("queries")))
        sets = owned.groupBy("set").agg(F.first("queries").alias("queries"))
        one, most = q.agg(F.coalesce(F.max(F.size("qvec")), F.lit(0))).first()[0], sets.agg(F.coalesce(F.sum(F.size("queries")), F.lit(0))).first()[0]
        if one * most <= QUERY_NUMBERS:
            asked = sets.select("set", F.explode("queries").alias("query_id")).join(q, "query_id")
            return top_k(best_in_place(asked, c.join(few(owned.select("document_id", "set")), "document_id"), k), k, *best)
        pairs = c.select("chunk_id", "document_id", "embedding").join(scope.select("query_id", "document_id").join(q, "query_id"), "document_id")
        return top_k(pairs.select("query_id", "chunk_id", F.round(cosine(F.col("qvec"), F.col("embedding")), DECIMALS).alias("similarity")).where("similarity is not null"), k, *best)
    numbers = q.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("qvec")), F.lit(0)).alias("numbers")).first()
    if numbers.numbers <= QUERY_NUMBERS:
        return top_k(best_in_place(q, c, k), k, *best)
    blocks, parts = max(1, -(-numbers.n // QUERY_BLOCK)), max(1, -(-c.count() // PART_ROWS))
    deal = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    by = ["block", "part", "width"]
    q = q.select("query_id", F.col("qvec").cast("array<double>").alias("qvec"), F.size("qvec").alias("width"), deal("query_id", blocks).alias("block"), each(parts).alias("part"))
    c = c.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("width"), deal("chunk_id", parts).alias("part"), each(blocks).alias("block"))

    def score(asked, passages):
        import numpy as np
        import pandas as pd

        if not len(asked) or not len(passages):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "chunk_id": np.empty(0, np.int64), "similarity": np.empty(0)})
        unit = lambda rows: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))((lambda x: x / np.abs(x).max(axis=1, keepdims=True))(np.stack(rows.to_numpy())))
        ids, own = asked["query_id"].to_numpy(np.int64), passages["chunk_id"].to_numpy(np.int64)
        order = np.argsort(own, kind="stable")
        own, x = own[order], unit(passages["embedding"])[order]
        out = []
        qs = unit(asked["qvec"])
        for at in range(0, len(ids), 256):
            sims = np.round(qs[at:at + 256] @ x.T, DECIMALS)
            first = np.argsort(-sims, axis=1, kind="stable")[:, :k]  # rows are by id, so ties go to the smaller
            out.append(pd.DataFrame({"query_id": np.repeat(ids[at:at + 256], first.shape[1]), "chunk_id": own[first].ravel(), "similarity": np.take_along_axis(sims, first, 1).ravel()}))
        return pd.concat(out, ignore_index=True)

    pairs = q.groupBy(*by).cogroup(c.repartition(blocks * parts, *by).groupBy(*by))
    return top_k(pairs.applyInPandas(score, "query_id long, chunk_id long, similarity double"), k, *best)


def best_in_place(q: DataFrame, c: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, similarity): of each task's passages the best k of each of the few queries; ties to the smaller id.

    A task keeps k hits a query; of each batch of passages only those are sorted that reach the k-th. With a column ``set`` on both sides
    a query meets the passages of its set only.
    """
    from collections import defaultdict

    scoped = "set" in q.columns
    groups = defaultdict(list)
    for r in q.collect():  # bounded by QUERY_NUMBERS
        groups[r.set if scoped else 0, len(r.qvec)].append((r.query_id, r.qvec))

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        unit = lambda x: (lambda y: y / np.linalg.norm(y, axis=1, keepdims=True))(x / np.abs(x).max(axis=1, keepdims=True))
        asked = {g: unit(np.array([v for _, v in rows], np.float64)) for g, rows in groups.items()}
        hits = {g: [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)] for g in asked}  # query, similarity, passage
        least = {g: np.full(len(x), -np.inf) for g, x in asked.items()}
        for batch in batches:
            lists, ids = batch.column("embedding"), batch.column("chunk_id").to_numpy()
            sizes, sets = lists.value_lengths().to_numpy(), batch.column("set").to_numpy()
            for g in asked:
                rows = np.flatnonzero((sets == g[0]) & (sizes == g[1]))
                if not len(rows):
                    continue
                x = unit(lists.take(pa.array(rows)).flatten().to_numpy().astype(np.float64).reshape(len(rows), g[1]))
                for at in range(0, len(rows), 1024):
                    sims = np.round(asked[g] @ x[at:at + 1024].T, DECIMALS)
                    if sims.shape[1] > k:
                        least[g] = np.maximum(least[g], -np.partition(-sims, k - 1, axis=1)[:, k - 1])
                    i, j = np.nonzero(sims >= least[g][:, None])
                    found = [np.concatenate(x) for x in zip(hits[g], (i, sims[i, j], ids[rows[at:at + 1024]][j]))]
                    order = np.lexsort((found[2], -found[1], found[0]))
                    found = [f[order] for f in found]
                    begin = np.searchsorted(found[0], np.arange(len(asked[g])))
                    place = np.arange(len(order)) - begin[found[0]]
                    hits[g] = [f[place < k] for f in found]
                    full = found[0][place == k - 1]
                    least[g][full] = np.maximum(least[g][full], found[1][place == k - 1])
        for g, (i, sims, ids) in hits.items():
            names = np.array([n for n, _ in groups[g]], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(ids, pa.int64()), pa.array(sims)], names=["query_id", "chunk_id", "similarity"])

    of = F.col("set") if scoped else F.lit(0).cast("long")
    return c.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"), of.alias("set")).mapInArrow(scan, "query_id long, chunk_id long, similarity double")


def graph_index(chunks: DataFrame, path: str) -> DataFrame:
    """The passages' vectors (chunk_id, embedding) as pruned graphs, written to ``path`` once, searched any number of times by ``knn_ann`` and kept up to date by ``update_index``.

    Vectors are of unit length in it; those that are null, empty, zero or not finite are left out.
    """
    good = indexed(chunks).where("v is not null")
    return store_graphs(build_graphs(good, good.count(), single=True), path)


def indexed(chunks: DataFrame) -> DataFrame:
    """(key, v): passages as an index has them; v is null for vectors that are near nothing."""
    return chunks.select(F.col("chunk_id").alias("key"), F.when(usable(F.col("embedding")), unit_vector(F.col("embedding"))).alias("v"))


def update_index(path: str, chunks: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The index at ``path`` with the vectors of new and changed passages, and without those of ``gone(chunk_id)``."""
    changes = indexed(chunks)
    if gone is not None:
        changes = changes.unionByName(gone.select(F.col("chunk_id").alias("key"), F.lit(None).cast("array<double>").alias("v")).join(changes.select("key"), "key", "left_anti"))
    return update_graphs(path, changes)


def unit_vector(v: Column) -> Column:
    d = v.cast("array<double>")
    # the length is computed once for all components
    return F.get(F.transform(F.array(F.sqrt(dot(d, d))), lambda n: F.transform(d, lambda x: x / n)), F.lit(0))


def knn_ann(queries: DataFrame, index: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """As knn_exact, over what beam search finds in a ``graph_index``; ``recall`` measures it against knn_exact.

    On unit vectors the nearest are those of the largest cosine, which is 1 - distance^2 / 2. Any width will do.
    """
    asked = queries.where(usable(F.col("qvec"))).select("query_id", unit_vector(F.col("qvec")).alias("v"))
    found = search_graphs(index, asked, k).select("query_id", F.col("key").alias("chunk_id"), (1 - F.col("distance") * F.col("distance") / 2).alias("similarity"))
    return top_k(found, k, F.desc("similarity"), F.asc("chunk_id"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many of the exact neighbours were found."""
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id").withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    return hit.agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"))


Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(width: int = 256, weights=None) -> Embedder:
    """Deterministic vectors of unit length from hashed words; a word's first four bytes of MD5 give its place (mod width) and its sign (top bit).

    ``weights`` (a numpy array): what a word counts, by the same four bytes modulo its length; else 1.
    """

    def embed(texts: list[str]) -> list[list[float]]:
        import hashlib

        import numpy as np

        out, seen = np.zeros((len(texts), width)), {}  # the words of one batch
        for i, t in enumerate(texts):
            for w in t.lower().split():
                if w not in seen:
                    h = int.from_bytes(hashlib.md5(w.encode("utf-8", "surrogatepass")).digest()[:4], "big")
                    seen[w] = h % width, (1 if h >> 31 else -1) * (1 if weights is None else int(weights[h % len(weights)]))
                place, sign = seen[w]
                out[i, place] += sign
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()

    return embed


#: Places of hashed words that document frequencies are kept for (8 bytes each), whatever the vocabulary.
FREQUENCY_PLACES = 1 << 18


def word_place(word: Column, places: int = FREQUENCY_PLACES) -> Column:
    """A word's place by the first four bytes of its MD5, as the hashing embedder takes it."""
    return F.pmod(F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(places))


def fit_frequencies(passages: DataFrame, path: str, places: int = FREQUENCY_PLACES) -> DataFrame:
    """(place, df): in how many passages (text) each place of the hashed vocabulary occurs, and under place -1 how many passages there are.

    Fitted on all passages once, written to ``path``, and read again for every embedding of passages and of queries.
    """
    words = F.array_distinct(F.transform(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != ""), lambda w: word_place(w, places)))
    counts = passages.select(F.explode(F.array_append(words, F.lit(-1).cast("long"))).alias("place")).groupBy("place").agg(F.count("*").alias("df"))
    counts.write.mode("overwrite").parquet(path)
    return passages.sparkSession.read.schema("place long, df long").parquet(path)


def weighted_embedder(frequencies: DataFrame, width: int = 256, places: int = FREQUENCY_PLACES) -> Embedder:
    """The hashing embedder with each word weighed by its rarity among the fitted passages: whole eighths of a bit of log2((passages + 1) / (df + 1)).

    Weights are whole numbers, so sums are exact in every order. The frequencies are ``places`` numbers at most, and go to every task.
    """
    import numpy as np

    known = {r.place: r.df for r in frequencies.collect()}  # at most ``places`` numbers
    n = known.pop(-1, 0)
    df = np.zeros(places, np.int64)
    df[list(known)] = list(known.values())
    weights = np.round(8 * np.log2((n + 1) / (df + 1))).astype(np.int32)
    return hashing_embedder(width, weights)


def batches_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of batches: at most 128 texts and an estimated 60,000 tokens each (a longer text is alone)."""
    start = tokens = 0
    for i, t in enumerate(texts):
        n = -(-len(t) // CHARS_PER_TOKEN)
        if i > start and (i - start >= BATCH_TEXTS or tokens + n > BATCH_TOKENS):
            yield start, i
            start, tokens = i, 0
        tokens += n
    if start < len(texts):
        yield start, len(texts)


def embed_passages(df: DataFrame, embedder: Embedder | None = None, text: str = "text", out: str = "embedding") -> DataFrame:
    """df plus ``out`` array<float>: vectors by a pluggable embedder, in bounded batches; a worker loads the model once."""
    model = embedder or hashing_embedder()
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(frames):
        for pdf in frames:
            texts = pdf[text].fillna("").tolist()
            vectors: list = []
            for a, b in batches_of(texts):
                vectors += model(texts[a:b])
            pdf[out] = vectors
            yield pdf

    return df.mapInPandas(run, schema)


def embed_queries(df: DataFrame, embedder: Embedder | None = None, prefix: str = "query: ", text: str = "query") -> DataFrame:
    """Queries in the passages' space, with an instruction in front of each."""
    asked = df.withColumn("_text", F.concat(F.lit(prefix), F.col(text)))
    return embed_passages(asked, embedder, "_text", "qvec").drop("_text")


def validate_vectors(df: DataFrame, width: int, column: str = "embedding", asked: int | None = None) -> DataFrame:
    """One row per kind of vector: ok, null, wrong width, not finite (null, NaN or infinite components), not of unit length; with the count of each.

    ``asked`` is the number of texts that were to be embedded: a difference to the rows is a kind of its own, missing or surplus.
    """
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kind = F.when(v.isNull(), "null").when(F.size(v) != width, "width").when(bad, "not finite").when(F.abs(F.sqrt(dot(v, v)) - 1) > 1e-3, "norm").otherwise("ok")
    kinds = df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    if asked is None:
        return kinds
    rows = df.agg((F.count("*") - F.lit(asked)).alias("d")).where("d <> 0")
    return kinds.unionByName(rows.select(F.when(F.col("d") < 0, "missing").otherwise("surplus").alias("kind"), F.abs("d").alias("n")))
