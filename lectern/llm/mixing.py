"""Mixing sources to target weights by Poisson replication (operator 10), with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import read_table, shuffle_partitions

#: Sources up to which the table of rates (one short row each) is broadcast; beyond, a salted join is used.
MAX_BROADCAST_SOURCES = 10_000
SALTS = 64
HEX = 13  # hexadecimal digits of a uniform number: 52 bits, exact in a double


def uniform(seed: int, *columns: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the columns' values alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns]))
    return (F.conv(F.substring(digest, 1, HEX), 16, 10).cast("double") + 0.5) / float(16**HEX)


def poisson_cdf(rate: Column) -> Column:
    """Array of P(X <= k), k = 0, 1, ... up to rate + 12 sqrt(rate) + 30, past which a 52-bit number never falls.

    Terms are taken through logarithms: ``exp(-rate)`` alone would be 0 for rates over 745.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.lit(0.0).alias("log_k"), F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log_k = acc["log_k"] + F.when(k > 0, F.log(k.cast("double"))).otherwise(0.0)
        total = acc["total"] + F.exp(k * F.log(rate) - rate - log_k)
        return F.struct(log_k.alias("log_k"), total.alias("total"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), last), start, step, lambda acc: acc["cdf"])).otherwise(
        F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5,
                 total: float = 1.0, source: str = "source") -> DataFrame:
    """(source, rate): the mean number of times that a row of each source is to appear.

    Target shares are ``weights`` (sources not named get none), or, without weights, the observed shares
    to the power ``temperature`` (1 keeps the observed mixture, 0 makes all sources equal). The target
    has ``total`` times as many rows as the input. A null source is a source of its own.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        wanted = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        pairs = [F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()]
        wanted = counts.withColumn("w", F.coalesce(*pairs, F.lit(0.0)))
    sums = wanted.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    rate = F.when(F.col("all_w") > 0, F.lit(float(total)) * F.col("all_n") * F.col("w") / F.col("all_w") / F.col("n"))
    return wanted.join(F.broadcast(sums)).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: float = 1.0,
        seed: int = 10, id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """All columns of ``docs`` plus ``copy_no`` (from 0) and ``mix_key`` (hex; the global order), globally shuffled.

    A row appears ``k`` times, ``k`` the inverse of its source's Poisson distribution at a number seeded by
    its id, so results don't depend on partitions and repeat after a lost executor. Rows that share an id
    are replicated alike. Null ids share one number; empty input gives no rows; a source with weight 0
    vanishes. Rates are one short row per source, broadcast only up to ``MAX_BROADCAST_SOURCES`` sources;
    beyond, docs are joined on (source, salt), so that a source with a third of the rows meets 64 tasks.
    Input columns named ``copy_no``, ``mix_key`` or ``_mix_*`` are replaced.
    """
    docs = docs.drop("copy_no", "mix_key")
    rates = source_rates(docs, weights, temperature, total, source)
    cdf = rates.select(F.col("source").alias("_mix_source"), poisson_cdf(F.col("rate")).alias("_mix_cdf"))
    few = docs.select(source).distinct().limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    same = F.col(source).eqNullSafe(F.col("_mix_source"))
    if few:
        joined = docs.join(F.broadcast(cdf), same)
    else:
        salted = cdf.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mine = docs.withColumn("_mix_own", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
        joined = mine.join(salted, same & (F.col("_mix_own") == F.col("_mix_salt"))).drop("_mix_salt", "_mix_own")
    u = uniform(seed, F.col(id_col))
    n = F.size(F.filter(F.col("_mix_cdf"), lambda c: c < F.col("_mix_u")))
    rows = (joined.withColumn("_mix_u", u).withColumn("_mix_n", n).where("_mix_n > 0")
            .withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("_mix_n") - 1)))
            .withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.col("copy_no").cast("string"))))
            .drop("_mix_source", "_mix_cdf", "_mix_u", "_mix_n"))
    # keys are uniform hashes, so equal ranges of their leading bits hold equally many rows whatever the sources, and need no sample
    n = shuffle_partitions(docs.sparkSession)
    leading = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long")
    placed = rows.withColumn("_mix_part", F.floor(leading * F.lit(n) / F.lit(float(1 << 32))).cast("int"))
    return placed.repartitionById(n, "_mix_part").drop("_mix_part").sortWithinPartitions("mix_key")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


#: The same in DuckDB: counts of each source, its tempered rate, the Poisson CDF, and the hash-seeded inversion.
MIX_SQL = """
with recursive c as (select source, count(*) n from documents group by source),
r as (select source, (select sum(n) from c) * pow(n, 0.5) / (select sum(pow(n, 0.5)) from c) / n as rate from c),
p(source, rate, k, log_k, total) as (
  select source, rate, 0, 0.0::double, exp(-rate) from r
  union all
  select source, rate, k + 1, log_k + ln((k + 1)::double), total + exp((k + 1) * ln(rate) - rate - (log_k + ln((k + 1)::double)))
  from p where k + 1 <= ceil(rate + 12 * sqrt(rate) + 30)),
cdf as (select source, list(total order by k) as cdf from p group by source),
u as (select d.*, (('0x' || substr(md5('10:' || coalesce(doc_id::varchar, '~')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u from documents d),
n as (select u.*, len(list_filter(cdf.cdf, lambda x: x < u.u)) as reps from u join cdf on u.source is not distinct from cdf.source),
e as (select n.* exclude (u, reps), unnest(range(reps))::int as copy_no from n)
select *, md5('10/order:' || coalesce(doc_id::varchar, '~') || ':' || copy_no) as mix_key from e
"""
