"""MinHash near-duplicates: one-permutation hashing, optimal densification, bands, star edges (operator 4)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm.common import by_ids, mix64, one_per_id, read_table, words_of, written
from lectern.llm.components import connected_components
from lectern.operators.joins import among, key_bits

BANDS, ROWS = 40, 6  # two sets at similarity 0.8 share no band with probability (1 - 0.8^6)^40 = 5e-6
MAX_KEPT = 300_000
SALTS, MAX_BROADCAST_KEYS = 16, 50_000
#: Ids up to which they are broadcast (some 80 bytes each in the driver), and bits that go to tasks in place of more ids (8 MB, whatever their number).
MAX_IDS, WANTED_BITS = 65_536, 1 << 26
CLASSES_MET = 2_048  # classes in a block of those that a shingle brings together


class _Hashes(dict):
    """64-bit hashes of words, kept by a worker for the words it has met."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MAX_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingle_set(text: str | None, size: int):
    """Sorted distinct 64-bit hashes of a text's word shingles (numpy uint64); see ``words_of`` for words.

    A text with fewer words than ``size`` has one shingle, its whole sequence; a text without words none.
    """
    import numpy as np

    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    width = min(size, len(h))
    acc = np.full(n, np.uint64(width), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
    return np.unique(acc)


@functools.lru_cache(4)
def donors(bins: int, attempts: int = 64):
    """Which bin an empty bin asks at each attempt: an independent hash of (bin, attempt) for every pair."""
    import numpy as np

    with np.errstate(over="ignore"):
        k = np.arange(attempts * bins, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(bins)
        return (mix64(k) % np.uint64(bins)).astype(np.int64).reshape(attempts, bins)


def one_permutation(shingles, bins: int):
    """One minimum per bin from a single hash per shingle; empty bins borrow by optimal densification.

    ``shingles`` is sorted, so a bin's first shingle is its least. An empty bin takes the value of the first
    full bin among its own sequence of donors; should 64 donors all be empty, that of the next full bin.
    """
    import numpy as np

    with np.errstate(over="ignore"):
        spread = mix64(shingles + np.uint64(0x632BE59BD9B4E019))
    where, first = np.unique((spread >> np.uint64(17)) % np.uint64(bins), return_index=True)
    where = where.astype(np.int64)
    value = np.zeros(bins, np.uint64)
    full = np.zeros(bins, bool)
    value[where], full[where] = shingles[first], True
    if len(where) < bins:
        empty = np.flatnonzero(~full)
        asked = donors(bins)[:, empty]
        ok = full[asked]
        turn = ok.argmax(axis=0)
        source = np.where(ok.any(axis=0), asked[turn, np.arange(len(empty))], where[np.searchsorted(where, empty) % len(where)])
        value[empty] = value[source]
    return value


def band_keys(signature, bands: int, rows: int):
    """One 64-bit key per band; bands of equal content but different place have different keys."""
    import numpy as np

    s = signature.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + s[:, i])
    return key


def signatures(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands): set_key is 128 bits that only equal shingle sets share."""

    def sign(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            n, keys, out = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, size)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out.append(band_keys(one_permutation(s, bands * rows), bands, rows).view(np.int64) if len(s) else np.empty(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists],
                                             names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def shingle_table(docs: DataFrame, size: int, bits=None) -> DataFrame:
    """(doc_id, shingles array<long>), in full; with broadcast ``bits`` (of ``key_bits``) only of documents whose ids, not null, have theirs."""

    def sets(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if bits is not None:
                batch = batch.filter(pa.array(among(bits.value, batch.column(0).to_numpy())))
            out = [shingle_set(t, size).view(np.int64) for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sets, "doc_id long, shingles array<long>")


def unsent(rows: DataFrame) -> DataFrame:
    """``rows`` for a join that doesn't send them through the driver if they are more than MAX_IDS; the size of a file, by which Spark decides, tells little of the rows made of it."""
    return rows.hint("merge") if rows.limit(MAX_IDS + 1).count() > MAX_IDS else rows


def wanted_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles) of the written, distinct ids ``wanted(id)``, one row each.

    Few ids are broadcast. Of more, tasks have WANTED_BITS: other documents are passed over where they lie, and those of an id with another one's bit go in the join, which moves no texts.
    """
    if wanted.limit(MAX_IDS + 1).count() <= MAX_IDS:
        return shingle_table(by_ids(docs, wanted, "doc_id", keep=True), size).dropDuplicates(["doc_id"])
    bits = docs.sparkSession.sparkContext.broadcast(key_bits(wanted.select(F.col("id").alias("key")), WANTED_BITS))
    return by_ids(shingle_table(docs, size, bits), wanted, "doc_id", keep=True, most=0).dropDuplicates(["doc_id"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    few = ids.limit(MAX_IDS + 1).count() <= MAX_IDS
    # the joins with pairs leave other sets out, too
    mine = by_ids(sets, ids, "doc_id", keep=True) if few else sets.hint("merge")
    both = (pairs.join(mine.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
            .join(mine.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - F.col("common")
    return both.withColumn("common", common).where(100 * F.col("common") >= percent * union).select("a", "b")


def by_key(rows: DataFrame, keys: DataFrame, column: str = "key", spread: str = "d", how: str = "inner") -> DataFrame:
    """``rows`` with what the written ``keys`` (a few dozen bytes each) tell of their key.

    Few keys are broadcast. More are joined in as many parts as there are SALTS: a key of a third of all documents is spread over tasks.
    """
    if keys.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS:
        return rows.join(F.broadcast(keys), column, how)
    # by the size of their file, SALTS times as many rows would be taken for few
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [column, "salt"], how).drop("salt")


def links(sig: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed edges (a, b) that join whatever is similar, between documents of different shingle sets.

    A bucket's documents are compared with one of them, its hub, and not with each other: edges are a
    star. A document that its hub does not confirm may still be like another one: the documents of buckets whose hub
    did not confirm all others are then compared across components by exact prefix filtering, so no link is lost to
    the stars: first with one document for each early shingle, and then, across the components that this leaves, with all.
    """
    least = sig.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("id"))
    unique = sig.join(least.select("id"), sig["doc_id"] == F.col("id"), "left_semi")
    rows = unique.select(F.explode("bands").alias("key"), F.col("doc_id").alias("d"), F.col("n_shingles").alias("n"))
    fits = (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    pair = (F.least("d", "hub").alias("a"), F.greatest("d", "hub").alias("b"))

    hubs = rows.groupBy("key").agg(F.min(F.struct("d", "n")).alias("h"), F.count("*").alias("c")).where("c > 1")
    hubs = written(hubs.select("key", F.col("h.d").alias("hub"), F.col("h.n").alias("hub_n"), "c"))
    met = written(by_key(rows, hubs).where("d <> hub"))
    pairs = written(met.where(fits).select(*pair).distinct())
    # texts are read again only for documents that share a bucket with one of their size
    rest = met.where("c > 2")
    wanted = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(rest.select("d")).distinct())
    sets = written(wanted_sets(docs, wanted, size))
    found = written(confirm(pairs, sets, percent))
    ok = unsent(found.select("a", "b", F.lit(True).alias("ok")))
    rest = rest.select("key", "d", "n", *pair).join(ok, ["a", "b"], "left")
    rest = written(rest.select("key", "d", "ok"))
    open_ = written(rest.where("ok is null").select("key").distinct())
    left = written(by_key(rest, open_).select("d").distinct())
    if left.limit(1).count() == 0:
        return found
    early = written(early_shingles(left, sets, connected_components(found), percent))
    stars = written(hubs_met(early, percent).join(pairs, ["a", "b"], "left_anti"))
    near = written(confirm(stars, sets, percent))
    more = across(merged(early, near), percent).join(pairs.union(stars), ["a", "b"], "left_anti")
    return written(found.union(near).union(confirm(written(more), sets, percent)))


def early_shingles(ids: DataFrame, sets: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """(d, n, s, room, c): the shingles s that come early enough in the documents ``ids(d)``, of size n and class c, to be the first that two similar ones share.

    Exact prefix filtering: with shingles in order of rarity among these documents, two sets of the wanted similarity
    share a shingle so early in both that the rest can still make up the overlap needed. Variants of one text,
    each with changes of its own, begin with shingles that no other has, and meet nobody. What is left of d from s on,
    at most shared in full, is enough for a document of size m only if ``room`` >= percent * m.
    """
    mine = by_ids(sets, ids.select(F.col("d").alias("id")), "doc_id", keep=True, most=MAX_IDS).select(F.col("doc_id").alias("d"), F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    counts = mine.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    shared = mine.join(counts, "s")
    w = W.partitionBy("d").orderBy("df", "s")
    place = F.row_number().over(w) + F.col("n") - F.count("*").over(W.partitionBy("d"))  # shingles of its own come first
    early = shared.withColumn("p", place).where(100 * (F.col("p") - 1) <= (100 - percent) * F.col("n"))
    room = (100 + percent) * (1 + F.col("n") - F.col("p")) - percent * F.col("n")
    return early.withColumn("room", room).join(unsent(component.withColumnRenamed("id", "d")), "d", "left").select("d", "n", "s", "room", F.coalesce("component", "d").alias("c"))


def similar_by(n: str, room: str, n2: str, room2: str, percent: int) -> Column:
    """Whether two documents can be similar by their sizes and by the rooms that a shingle leaves them."""
    sizes = 100 * F.least(n, n2) >= percent * F.greatest(n, n2)
    return sizes & (F.col(room) >= percent * F.col(n2)) & (F.col(room2) >= percent * F.col(n))


def hubs_met(early: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a document of ``early`` and the one with most room at a shingle of both, if their classes differ: at most one for each row."""
    hubs = early.groupBy("s").agg(F.max_by(F.struct("d", "n", "room", "c"), F.struct("room", -F.col("d"))).alias("h"), F.count("*").alias("k")).where("k > 1")
    hubs = written(hubs.select("s", *[F.col(f"h.{k}").alias(f"{k}2") for k in ("d", "n", "room", "c")]))
    met = by_key(early, hubs, "s").where((F.col("c") != F.col("c2")) & similar_by("n", "room", "n2", "room2", percent))
    return met.select(F.least("d", "d2").alias("a"), F.greatest("d", "d2").alias("b")).distinct()


def merged(early: DataFrame, links: DataFrame) -> DataFrame:
    """``early`` with the classes that the ``links`` (a, b) between its documents make of its classes."""
    of = early.select("d", "c").distinct()
    edges = links.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    component = connected_components(edges).withColumnRenamed("id", "c")
    return written(early.join(component, "c", "left").select("d", "n", "s", "room", F.coalesce("component", "c").alias("c")))


def overlapping(ids: DataFrame, sets: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the documents ``ids(d)`` that lie in different components and can be similar enough."""
    return across(written(early_shingles(ids, sets, component, percent)), percent)


def across(early: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the documents of ``early`` that lie in different classes and can be similar by a shingle.

    Documents of the class with fewer of them go to a class in which one may have room for them, and meet the documents there that do.
    """
    early = unsent(early)
    x, y = early, early.select("s", *[F.col(k).alias(f"{k}2") for k in ("c", "d", "n", "room")])
    fits = (100 * F.col("n") >= percent * F.col("lo2")) & (percent * F.col("n") <= 100 * F.col("hi2")) & (F.col("room") >= percent * F.col("lo2")) & (F.col("most2") >= percent * F.col("n"))
    met = classes_met(early, percent).join(x, ["s", "c"]).where(fits).select("s", "c2", "d", "n", "room")
    return met.join(y, ["s", "c2"]).where(similar_by("n", "room", "n2", "room2", percent)).select(F.least("d", "d2").alias("a"), F.greatest("d", "d2").alias("b")).distinct()


def classes_met(early: DataFrame, percent: int) -> DataFrame:
    """(s, c, c2, lo2, hi2, most2): pairs of classes that can hold similar documents by the shingle s of ``early``, with the sizes and the most room in c2.

    Documents of one class never meet; c has no more documents with s than c2. Of two similar ones the smaller has room for its own size (``fit``),
    so a shingle that nobody has as early pairs nobody. A shingle of many classes is dealt by pairs of blocks of CLASSES_MET of them.
    """
    fit = F.col("room") >= percent * F.col("n")
    own = early.groupBy("s", "c").agg(F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("room").alias("most"), F.max(fit).alias("fit"))
    own = written(own)
    busy = own.groupBy("s").agg(F.count("*").alias("m"), F.max("fit").alias("some")).where("m > 1 and some")
    own = own.join(busy.select("s", F.ceil(F.col("m") / CLASSES_MET).cast("int").alias("parts")), "s")
    block, others = F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    mine = own.select("s", "c", "k", "lo", "hi", "most", "fit", block.alias("i"), others.alias("j"))
    theirs = own.select("s", *[F.col(k).alias(f"{k}2") for k in ("c", "k", "lo", "hi", "most", "fit")], block.alias("j"), others.alias("i"))
    first = (F.col("k") < F.col("k2")) | ((F.col("k") == F.col("k2")) & (F.col("c") < F.col("c2")))
    sizes = (100 * F.col("hi") >= percent * F.col("lo2")) & (100 * F.col("hi2") >= percent * F.col("lo"))
    rooms = (F.col("most") >= percent * F.col("lo2")) & (F.col("most2") >= percent * F.col("lo"))
    return mine.join(unsent(theirs), ["s", "i", "j"]).where(first & (F.col("fit") | F.col("fit2")) & sizes & rooms).select("s", "c", "c2", "lo2", "hi2", "most2")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document with its class of near-duplicates.

    Documents whose sets of ``size``-word shingles have 100 * intersection >= percent * union are linked;
    component_id is the smallest doc_id reachable. Candidates come from bands of one-permutation MinHash
    signatures, links from the full sets. Documents of equal sets are one document until the end.
    Null, empty and blank texts have no shingles and stand alone; a null doc_id stands alone, with a null
    component, and is kept. Rows that repeat a doc_id with the same text give repeated results. Other columns are ignored.
    """
    sig = written(signatures(docs, size))
    named = sig.where("doc_id is not null")
    edges = links(named, docs.where("doc_id is not null"), size, percent)
    component = connected_components(edges)
    least = named.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    classes = written(least.join(unsent(component.withColumnRenamed("id", "rep")), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id")))
    out = by_key(sig.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")), classes, "set_key", "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that ``near_duplicates`` doesn't keep, and one row of each repeated doc_id."""
    found = near_duplicates(docs, size, percent)
    gone = written(found.where("not kept").select(F.col("doc_id").alias("id")).distinct())
    return one_per_id(by_ids(docs, gone, "doc_id", keep=False))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=2)


#: The same in DuckDB's SQL, by exact prefix filtering of distinct sets.
MINHASH_SQL = r"""with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (select doc_id, case when len(w) < 2 then w else list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) end as s from words),
classes as (select s, len(s) as n, min(doc_id) as rep from sets where len(s) > 0 group by s),
shingles as (select rep, n, t, row_number() over (partition by rep order by df, t) as place from (select rep, n, t, count(*) over (partition by t) as df from (select rep, n, unnest(s) as t from classes))),
-- sets at 0.8 share a shingle among each one's rarest fifth
early as (select rep, n, t from shingles where place <= n - (4 * n + 4) // 5 + 1),
pairs as (select distinct a.rep as a, b.rep as b from early a join early b on a.t = b.t and a.rep < b.rep and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
met as (select a, b, x.n + y.n as total, len(list_intersect(x.s, y.s)) as shared from pairs join classes x on x.rep = a join classes y on y.rep = b),
links as (select a, b from met where 100 * shared >= 80 * (total - shared) union all select b, a from met where 100 * shared >= 80 * (total - shared)),
reached(rep, other) as (select rep, rep from classes union select rep, b from reached join links on a = other),
component as (select rep, min(other) as least from reached group by rep)
select doc_id, len(sets.s)::bigint as n_shingles, coalesce(least, doc_id) as component_id, coalesce(least, doc_id) = doc_id as kept
from sets left join classes on classes.s = sets.s left join component using (rep)"""
