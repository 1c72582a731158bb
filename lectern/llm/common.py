"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.scratch import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes the rows to the shared scratch folder and reads them again."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: str | None) -> list[bytes]:
    """The contract's words: runs of anything but space and 0x09-0x0D, with A-Z lower-cased.

    ``bytes.split`` and ``bytes.lower`` know exactly these ASCII characters.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(x):
    """A finaliser that spreads 64-bit integers (numpy uint64 array in and out)."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Ids up to which a list of them (8 bytes each) is broadcast to filter rows; beyond, rows are joined.
MAX_BROADCAST_IDS = 500_000


def by_ids(rows: DataFrame, ids: DataFrame, column: str, keep: bool, most: int = MAX_BROADCAST_IDS) -> DataFrame:
    """Rows whose ``column`` is (keep) or is not (not keep) among ``ids(id)``, which are distinct and written, and broadcast if they are ``most`` at most.

    A null is never among them.
    """
    few = ids.limit(most + 1).count() <= most
    return rows.join(F.broadcast(ids) if few else ids.hint("merge"), rows[column] == ids["id"], "left_semi" if keep else "left_anti")


def one_per_id(docs: DataFrame, column: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each id that several rows have; rows are moved only if there are such ids. Null ids stay."""
    again = written(docs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).count().where("count > 1").select("id"))
    if again.limit(1).count() == 0:
        return docs
    return by_ids(docs, again, column, keep=False).unionByName(by_ids(docs, again, column, keep=True).dropDuplicates([column]))
