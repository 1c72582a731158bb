"""Conflict-constrained best-fit packing of documents into fixed-length bins (operator 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import read_table

CAPACITY = 2048  # words of a bin
SHARD_ROWS = 4096  # mean pieces that one task packs together
HOT = 24  # pieces of a shard from which a duplicate cluster gets an index row of its own


class Bins:
    """The open bins of one shard, ordered by residual, with what each may not take again.

    A bin's bitmaps say which sources and which duplicate clusters it holds. ``lacking[a, r]`` counts bins
    of residual ``r`` without attribute ``a`` (a source, or a cluster with many pieces here), so the
    successor search goes straight to residuals where a compatible bin can be.
    """

    def __init__(self, capacity: int, n_attributes: int):
        import numpy as np

        self.np, self.capacity = np, capacity
        self.at: list[dict[int, None]] = [{} for _ in range(capacity + 1)]  # bin numbers in order of arrival
        self.lacking = np.zeros((n_attributes, capacity + 1), np.int32)
        self.open = np.zeros(capacity + 1, np.int32)
        self.lacks: list = []  # per bin: boolean per attribute
        self.bits: list[int] = []  # per bin: cluster bitmap
        self.residual: list[int] = []

    def place(self, size: int, attributes: tuple[int, ...], cluster: int) -> int:
        """The tightest compatible bin's number, or a new bin's."""
        np, bit = self.np, (1 << cluster if cluster >= 0 else 0)
        able = self.open[size:] > 0
        for a in attributes:
            able = able & (self.lacking[a, size:] > 0)
        found = -1
        for r in np.flatnonzero(able):
            for b in self.at[size + int(r)]:
                if not self.bits[b] & bit and all(self.lacks[b][a] for a in attributes):
                    found = b
                    break
            if found >= 0:
                break
        if found < 0:
            found, r = len(self.bits), self.capacity
            self.bits.append(0)
            self.residual.append(r)
            self.lacks.append(np.ones(len(self.lacking), bool))
        else:
            r = self.residual[found]
            del self.at[r][found]
            self.open[r] -= 1
            self.lacking[self.lacks[found], r] -= 1
        left = r - size
        self.bits[found] |= bit
        self.lacks[found][list(attributes)] = False
        self.residual[found] = left
        if left:
            self.at[left][found] = None
            self.open[left] += 1
            self.lacking[self.lacks[found], left] += 1
        return found


def pack_shard(sizes, sources, clusters, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) of each piece, for pieces in the order given (largest first for best-fit decreasing).

    Sources and clusters are any hashable values; None conflicts with nothing.
    """
    from collections import Counter

    names = {s: i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    many = Counter(c for c in clusters if c is not None)
    hot = {c: len(names) + i for i, c in enumerate(c for c, n in many.items() if n >= HOT)}
    bits = {c: i for i, c in enumerate(c for c, n in many.items() if 1 < n < HOT)}
    bins, out = Bins(capacity, len(names) + len(hot)), []
    for size, s, c in zip(sizes, sources, clusters):
        a = tuple(x for x in (names.get(s), hot.get(c)) if x is not None)
        b = bins.place(size, a, bits.get(c, -1))
        out.append((b, capacity - bins.residual[b] - size))
    return out


def pack(items: DataFrame, id_col: str, size_col: str, source_col: str, cluster_col: str, capacity: int = CAPACITY,
         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, piece, bin_id string, bin_offset, n_words, source, piece_start) for every piece of every item.

    An item longer than the capacity is cut: full pieces fill bins of their own, the rest competes like
    any other item. No bin holds two pieces of one source or of one duplicate cluster. Items are dealt to
    shards by a hash of the id, which spreads every source and cluster evenly; shards are of bounded
    size and carry lengths and keys, never texts. Equal lengths are taken in order of id and piece. Items
    with null or no length have no words and take no bin (bin_id null). A null source or cluster conflicts with nothing;
    repeated rows are separate items. No items, no rows.
    """
    base = items.select(F.col(id_col).cast("long").alias("id"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)).cast("long"), F.lit(0)).alias("size"),
                        F.col(source_col).cast("string").alias("source"), F.col(cluster_col).cast("string").alias("cluster"))
    full = F.floor(F.col("size") / capacity).cast("int")
    rest = F.col("size") - full * capacity
    pieces = F.concat(
        F.transform(F.sequence(F.lit(1), F.greatest(full, F.lit(1))), lambda i: F.struct((i - 1).alias("piece"), F.lit(capacity).cast("long").alias("n"))),
        F.array(F.struct(full.alias("piece"), rest.alias("n"))))
    # without full pieces the first entry, and without a rest the last, is not wanted
    pieces = F.filter(pieces, lambda p: ((p["n"] == capacity) & (p["piece"] < full)) | ((p["n"] < capacity) & ((rest > 0) | (full == 0))))
    rows = base.withColumn("p", F.explode(pieces)).select("id", "source", "cluster", F.col("p.piece").alias("piece"), F.col("p.n").alias("n"))
    n_shards = max(1, -(-base.count() // shard_rows))
    waiting = rows.where(F.col("n") > 0).withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(n_shards)))

    def shard(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["n", "id", "piece"], ascending=[False, True, True], na_position="first", kind="stable").reset_index(drop=True)
        nones = lambda s: [None if pd.isna(x) else x for x in s]
        got = pack_shard(pdf["n"].tolist(), nones(pdf["source"]), nones(pdf["cluster"]), capacity)
        pdf["bin_id"] = [f"{k}-{b}" for k, (b, _) in zip(pdf["shard"], got)]
        pdf["bin_offset"] = [o for _, o in got]
        return pdf[["id", "source", "piece", "n", "bin_id", "bin_offset"]]

    packed = waiting.groupBy("shard").applyInPandas(shard, "id long, source string, piece int, n long, bin_id string, bin_offset long")
    none = rows.where("n = 0").select("id", "source", "piece", "n", F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("bin_offset"))
    return packed.unionByName(none).select(
        F.col("id").alias(id_col), "piece", "bin_id", "bin_offset", F.col("n").alias("n_words"), "source", (F.col("piece") * F.lit(capacity)).cast("long").alias("piece_start"))


def with_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, cluster): length in words, and a key that only texts equal but for letter case and space at the ends share."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", F.size(F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")).alias("n_words"),
                       F.when(F.trim(text) != "", F.md5(F.lower(F.trim(text)))).alias("cluster"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(with_lengths(docs), "doc_id", "n_words", "source", "cluster", capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
