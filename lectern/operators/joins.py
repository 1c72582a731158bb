"""Joins with small tables: what is broadcast is counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.scratch import scratch_path

#: Rows (of a few dozen to a few hundred bytes) up to which a table is broadcast.
MAX_BROADCAST_ROWS = 100_000
#: Bits of a piece of ``key_bits``: as many as Spark's bitmaps have.
PIECE_BITS = 32_768


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes the rows to the shared scratch folder and reads them again."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(rows: DataFrame, most: int = MAX_BROADCAST_ROWS, many: str | None = None) -> DataFrame:
    """Written ``rows``, to be broadcast if they are few; else adaptive execution deals with the join, skewed keys included, by the strategy ``many`` if there is one."""
    if rows.limit(most + 1).count() <= most:
        return F.broadcast(rows)
    return rows.hint(many) if many else rows


def key_bits(keys: DataFrame, bits: int):
    """``bits`` bits (a multiple of PIECE_BITS) as a numpy array of bytes, of which each ``keys(key long)`` sets the one of its remainder: their size is that of the array, whatever the number of keys."""
    import numpy as np

    at = F.pmod(F.col("key"), F.lit(bits))
    pieces = keys.groupBy(F.floor(at / PIECE_BITS).alias("piece")).agg(F.bitmap_construct_agg((at % PIECE_BITS).cast("long")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pieces.toLocalIterator():  # bits / PIECE_BITS pieces at most
        out[r.piece * PIECE_BITS // 8:(r.piece + 1) * PIECE_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def among(bits, keys):
    """Which of the ``keys`` (numpy int64) have their bit in an array of ``key_bits``."""
    import numpy as np

    x = keys % (len(bits) * 8)
    return (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1
