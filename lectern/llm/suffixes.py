"""Removal of repeated byte strings by a distributed, sparse suffix sort (operator 9)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import by_ids, mix64, one_per_id, read_table, shuffle_partitions, written

LENGTH = 100  # bytes of a string that counts as repeated
GRAM = 50  # bytes of a gram; each LENGTH-byte string is filed under its gram of least hash
_BASE = 0x9E3779B97F4A7C15
_SECOND = 0xC2B2AE3D27D4EB4F
_tables: dict[int, tuple] = {}


def _powers(n: int, base: int = _BASE):
    """base^0 .. base^(n-1) and the inverses, modulo 2^64 (kept and extended by a worker)."""
    import numpy as np

    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            with np.errstate(over="ignore"):
                tables.append(np.multiply.accumulate(t))
        have = _tables[base] = tuple(tables)
    return have


class Hashes:
    """Fingerprints of any substrings of one text, from prefix sums."""

    def __init__(self, data: bytes, base: int = _BASE):
        import numpy as np

        b = np.frombuffer(data, np.uint8)
        power, self.inverse = _powers(len(b) + 1, base)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=self.sums[1:])

    def of(self, start, end):
        import numpy as np

        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def sliding_argmin(values, width: int):
    """Index of the first minimum of every ``width`` neighbours, by doubling."""
    import numpy as np

    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        span += step
    return at


def runs_of(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """(start, n, token 1, token 2) of the runs that a text's ``length``-byte strings fall into.

    A string is filed under the gram of least fingerprint in it (the first of several), which depends on its bytes
    alone; that fingerprint is its first token. Neighbouring strings filed under the same gram at the same place form
    a run: ``n`` strings from ``start``, at most length - gram + 1, all different. The second token fingerprints the
    bytes that they cover. None for texts that are too short.
    """
    import numpy as np

    if len(data) < length:
        return None
    h = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = h.of(at, at + gram)
    least = sliding_argmin(grams, length - gram + 1)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    n = np.diff(np.concatenate([start, [len(least)]]))
    return start, n, grams[least[start]], h.of(start, start + n + length - 1)


def multikey_order(columns):
    """Order of rows by several tokens: quicksort by the first, then only tied rows by the next, and so on."""
    import numpy as np

    order = np.argsort(columns[0], kind="quicksort")
    group = np.cumsum(np.concatenate([[False], np.diff(columns[0][order].astype(np.uint64)) != 0])) if len(order) else np.empty(0, np.int64)
    for col in columns[1:]:
        edge = np.concatenate([[True], group[1:] != group[:-1], [True]]) if len(group) else np.ones(1, bool)
        tied = np.flatnonzero(~(edge[:-1] & edge[1:]))
        if not len(tied):
            break
        part = order[tied]
        finer = np.lexsort((col[part], group[tied]))
        part = part[finer]
        order[tied] = part
        new = np.zeros(len(order), np.int64)
        new[tied[1:]] = (col[part][1:] != col[part][:-1]) & (np.diff(tied) == 1)
        new[1:] |= edge[1:-1].astype(np.int64)
        group = np.cumsum(new)
    return order


#: Suffixes that a task sorts: about 36 bytes each, and as many again while they are put in order.
BUCKET_ROWS = 4_000_000
ROW = "t1 long, t2 long, doc long, pos long, n int"
#: same_* compare with the neighbour in the global order: t1 alone, or both tokens.
SORTED = "doc long, pos long, n int, same_before boolean, t1_before boolean, t1_after boolean"


def suffix_sort(rows: DataFrame, expected: int = 0) -> DataFrame:
    """ROW -> SORTED: what each suffix shares with its neighbours in the order (t1, t2, doc, pos).

    ``expected`` tells about how many suffixes there are; there are as many buckets as it takes to keep one at about BUCKET_ROWS.
    Sampled splitters range-partition the suffixes by their leading tokens and, where tokens tie, by place: a
    string that a third of all documents share spans as many buckets as its suffixes fill, and none is
    larger than another. Buckets sort locally; a bucket's outermost suffixes are compared across its
    boundaries, from two short rows per bucket. Each suffix that equals the one before it also
    starts earlier, in a smaller document or place.
    """
    spark = rows.sparkSession
    n = max(shuffle_partitions(spark), -(-expected // BUCKET_ROWS))
    keys = ("t1", "t2", "doc", "pos")

    def bucket(batches):
        import numpy as np
        import pyarrow as pa

        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t1, t2, doc, pos, count = (np.concatenate([np.asarray(b.column(i)) for b in parts]) for i in range(5))
        del parts
        order = multikey_order([t1, t2, doc, pos])
        t1, t2, doc, pos, count = (x[order] for x in (t1, t2, doc, pos, count))
        eq1 = np.concatenate([[False], t1[1:] == t1[:-1]])
        eq2 = eq1 & np.concatenate([[False], t2[1:] == t2[:-1]])
        after = np.concatenate([eq1[1:], [False]])
        edge = np.zeros(len(t1), bool)
        edge[[0, -1]] = True
        keep = edge | eq1 | after
        m = edge[keep]
        cols = [pa.array(x[keep]) for x in (doc, pos, count.astype(np.int32), eq2, eq1, after)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(np.where(m, t1[keep], 0), mask=~m), pa.array(np.where(m, t2[keep], 0), mask=~m), pa.array(np.full(m.size, len(t1)))],
                                         names=["doc", "pos", "n", "same_before", "t1_before", "t1_after", "t1", "t2", "bucket_rows"])

    out = written(rows.select("t1", "t2", "doc", "pos", "n").repartitionByRange(n, *keys).mapInArrow(bucket, SORTED + ", t1 long, t2 long, bucket_rows long"))
    ends = sorted(out.where("t1 is not null").select("t1", "t2", "doc", "pos", "n", "same_before", "t1_before", "t1_after").collect(), key=tuple)  # two a bucket
    fixed = []
    for i, e in enumerate(ends):
        e1 = bool(i) and e.t1 == ends[i - 1].t1
        a1 = i + 1 < len(ends) and e.t1 == ends[i + 1].t1
        # neighbours among the ends are neighbours of the order, or ends of one bucket whose inner neighbours were compared there
        fixed.append((e.doc, e.pos, e.n, e.same_before or e1 and e.t2 == ends[i - 1].t2, e.t1_before or e1, e.t1_after or a1))
    return out.where("t1 is null").select("doc", "pos", "n", "same_before", "t1_before", "t1_after").unionByName(
        spark.createDataFrame(fixed, SORTED))


def strings_table(docs: DataFrame) -> DataFrame:
    """The runs of every document, as ROW."""

    def emit(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for i, text in zip(ids, batch.column(1).to_pylist()):
                r = runs_of(text.encode("utf-8", "surrogatepass")) if text else None
                if r:
                    out.append((r[2].view(np.int64), r[3].view(np.int64), np.full(len(r[0]), i), r[0], r[1].astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["t1", "t2", "doc", "pos", "n"])

    return docs.select("doc_id", "text").mapInArrow(emit, ROW)


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, z): texts of over LENGTH bytes, compressed, so that later shuffles of texts stay small."""

    def squeeze(batches):
        import pyarrow as pa
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([z.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "z"])

    return docs.where(F.octet_length("text") >= LENGTH).select("doc_id", "text").mapInArrow(squeeze, "doc_id long, z binary")


def _unpack(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z)


def open_strings(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """ROW of each single string of the given runs (doc, pos, n): fingerprints of its bytes by two bases."""
    lists = runs.groupBy("doc").agg(F.collect_list(F.struct("pos", "n")).alias("runs"))

    def emit(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for i, z, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = _unpack(z)
                at = np.concatenate([np.arange(r["pos"], r["pos"] + r["n"]) for r in runs])
                one = Hashes(data).of(at, at + LENGTH)
                two = Hashes(data, _SECOND).of(at, at + LENGTH) >> np.uint64(40)
                out.append((one.view(np.int64), two.view(np.int64), np.full(len(at), i), at, np.ones(len(at), np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["t1", "t2", "doc", "pos", "n"])

    return texts.join(lists, texts["doc_id"] == lists["doc"]).select("doc_id", "z", "runs").mapInArrow(emit, ROW)


def covered(starts, n, length: int):
    """Maximal byte ranges (start, end) that strings from ``starts`` (each ``n`` strings on) cover."""
    import numpy as np

    order = np.argsort(starts, kind="stable")
    s, e = starts[order], (starts + n + length - 1)[order]
    reach = np.maximum.accumulate(e)
    new = np.concatenate([[True], s[1:] > reach[:-1]])
    return s[new], np.concatenate([reach[:-1][new[1:]], reach[-1:]])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def repeated_spans(docs: DataFrame) -> DataFrame:
    """RESULT, one row per document: what is removed as a copy of bytes that start earlier.

    Texts are UTF-8 bytes; null and empty ones have none. A byte goes when some 100-byte string that covers
    it also starts earlier: in a document with a smaller id, or earlier in the same one. All strings
    are judged on the input. Whole copies of a text need no sorting: all but the first have every byte
    covered. Strings of the others are filed in runs under the least gram fingerprint
    (about one run per 26 bytes), and the runs' suffixes are sorted: a run equal to an earlier one is
    removed whole; a run that shares only its first token is opened, and its single strings are sorted likewise.
    Ids must be present and unique: a row with a null id is compared with nothing and keeps all bytes, and of rows
    that share an id each must hold the same text. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(F.encode(text, "UTF-8"), 256).alias("sha")))
    first = base.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    base = base.join(first.select("doc_id", F.lit(True).alias("is_first")).distinct(), "doc_id", "left")
    copies = written(base.where((F.col("n_bytes") >= LENGTH) & F.col("doc_id").isNotNull() & F.col("is_first").isNull()).select("doc_id"))
    originals = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    originals = by_ids(one_per_id(originals), copies.select(F.col("doc_id").alias("id")), "doc_id", keep=False)

    # a run begins at every (LENGTH - GRAM + 2) / 2 bytes on average; the strings to be opened are counted
    n_bytes = base.where("is_first is not null").agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    runs = suffix_sort(strings_table(originals), 2 * n_bytes // (LENGTH - GRAM + 2))
    whole = runs.where("same_before").select("doc", "pos", "n")
    # the first of equal runs is opened where other runs share its first token
    ambiguous = runs.where(~F.col("same_before") & (F.col("t1_before") | F.col("t1_after"))).select("doc", "pos", "n")
    texts = packed_texts(originals)
    n_strings = ambiguous.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    strings = suffix_sort(open_strings(texts, ambiguous), n_strings).where("same_before").select("doc", "pos", "n")
    hits = whole.unionByName(strings).groupBy("doc").agg(F.collect_list(F.struct("pos", "n")).alias("hits"))

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for i, z, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = _unpack(z)
                s, e = covered(np.array([h["pos"] for h in hits]), np.array([h["n"] for h in hits]), LENGTH)
                kept, at = hashlib.sha256(), 0
                for a, b in zip(s.tolist(), e.tolist()):
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                rows.append((i, int((e - s).sum()), len(s), kept.hexdigest(), [{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist())]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))],
                                                 names=["cut_id", "n_removed", "n_spans", "cut_sha", "spans"])

    done = texts.join(hits, texts["doc_id"] == hits["doc"]).select("doc_id", "z", "hits").mapInArrow(cut, "cut_id long, n_removed long, n_spans long, cut_sha string, spans array<struct<start: long, end: long>>").dropDuplicates(["cut_id"])
    gone = F.col("is_copy")
    out = base.join(copies.select("doc_id", F.lit(True).alias("is_copy")).distinct(), "doc_id", "left").join(done, F.col("doc_id") == F.col("cut_id"), "left")
    return out.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(gone, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"))).alias("spans"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read_table(spark, sf_dir, "documents")).drop("spans")


#: The same in DuckDB's SQL: every 100-byte string is a row.
STRINGS_SQL = """with bytes as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
strings as (select doc_id, p, b[p:p + 99] as string from (select doc_id, unnest(range(1, n - 98)) as p, b from bytes where n >= 100)),
again as (select doc_id, p from (select doc_id, p, row_number() over (partition by string order by doc_id, p) as k from strings) where k > 1),
-- strings that touch or overlap are one run
marked as (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 100 then 0 else 1 end as fresh from again),
runs as (select doc_id, min(p) as first, max(p) + 99 as last from (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as run from marked) group by doc_id, run),
kept as (select doc_id, first, last, coalesce(lag(last) over (partition by doc_id order by first), 0) + 1 as since from runs),
cut as (select doc_id, sum(last - first + 1)::bigint as n_removed, count(*) as n_spans, max(last) as last, list({'since': since, 'upto': first - 1} order by first) as pieces from kept group by doc_id)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(case when n_removed is null then b else unhex(array_to_string(list_transform(list_append(pieces, {'since': last + 1, 'upto': n}), lambda x: case when x.upto >= x.since then hex(b[x.since:x.upto]) else '' end), '')) end) as kept_sha256
from bytes left join cut using (doc_id)"""
