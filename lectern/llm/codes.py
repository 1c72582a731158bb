"""Vector code compression: product codes in whole numbers, entries found by equal-average search (operator 12)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm.common import read_table, written
from lectern.llm.minhash import by_key

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
FAR = (1 << 63) - 1


def nearest_entries(parts, book):
    """(index, squared distance) of each part's nearest codebook entry (parts n x d, book k x d, int64), ties to the lower index.

    Equal-average search: entries lie in order of their component sums. By Cauchy and Schwarz a squared distance is at least the squared gap
    between two sums over the dimension, so a part looks at entries outwards from its own sum, nearer sum first, and
    stops when that bound strictly exceeds its best distance: no entry beyond can be nearer, or as near under a lower index.
    All parts walk in lockstep; those that have stopped leave.
    """
    import numpy as np

    (n, d), k = parts.shape, len(book)
    best, index = np.full(n, FAR), np.zeros(n, np.int64)
    if d == 0:
        return index, np.zeros(n, np.int64)
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    at = np.concatenate([[0], sums[order], [0]])  # the i-th of the order at i, from 1
    own = parts.sum(axis=1)
    high = np.searchsorted(sums[order], own) + 1
    low = high - 1
    rows = np.arange(n)
    while len(rows):
        down = np.where(low[rows] > 0, own[rows] - at[low[rows]], FAR)
        up = np.where(high[rows] <= k, at[high[rows]] - own[rows], FAR)
        # floats with some slack: a part may look at an entry too many, never at one too few
        near = np.minimum(down, up).astype(np.float64) ** 2 <= best[rows].astype(np.float64) * d * (1 + 1e-9)
        rows, below = rows[near], (down <= up)[near]
        entry = order[np.where(below, low[rows], high[rows]) - 1]
        dist = ((parts[rows] - book[entry]) ** 2).sum(axis=1)
        better = (dist < best[rows]) | (dist == best[rows]) & (entry < index[rows])
        best[rows[better]], index[rows[better]] = dist[better], entry[better]
        low[rows[below]] -= 1
        high[rows[~below]] += 1
        rows = rows[(low[rows] > 0) | (high[rows] <= k)]
    return index, best


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, width, x array<int>): the vectors that take part, as floor(4096 * component).

    Zeros fill a vector up to 8 equal parts. Components are held within a bound (2^27 for a width of 64, so 32,768 before
    scaling) from which the squared distance of two vectors would not fit in a long.
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.where(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))
    most = F.pow(F.lit(2.0), F.least(F.lit(30), F.floor((60 - F.length(F.bin(F.size("v")))) / 2)))
    x = F.transform("v", lambda c: F.greatest(F.least(F.floor(c * SCALE).cast("double"), most), -most).cast("int"))
    gap = F.pmod(-F.size("v"), F.lit(PARTS))
    return kept.select("vec_id", "label", (F.size("v") + gap).alias("width"), F.concat(x, F.array_repeat(F.lit(0), gap)).alias("x"))


def first_books(whole: DataFrame) -> dict:
    """Codebooks (8 x entries x part, int64) by width: the parts of the vectors of the 16 smallest ids (of an id's several vectors the least)."""
    import numpy as np

    ids = whole.select("width", "vec_id").distinct().withColumn("n", F.row_number().over(W.partitionBy("width").orderBy(F.asc_nulls_last("vec_id")))).where(F.col("n") <= ENTRIES)
    ids = ids.select(F.col("width").alias("w"), F.col("vec_id").alias("id"))
    same = (F.col("width") == F.col("w")) & F.col("vec_id").eqNullSafe(F.col("id"))
    found: dict = {}
    for r in whole.join(F.broadcast(written(ids)), same).groupBy("width", "vec_id").agg(F.min("x").alias("x")).orderBy("width", F.asc_nulls_last("vec_id")).collect():
        found.setdefault(r.width, []).append(r.x)
    return {w: np.asarray(v, np.int64).reshape(len(v), PARTS, w // PARTS).swapaxes(0, 1) for w, v in found.items()}


def by_width(batch):
    """(width, row numbers, n x 8 x part int64) for the widths of a batch of (width, x)."""
    import numpy as np
    import pyarrow as pa

    widths = batch.column("width").to_numpy()
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        x = batch.column("x").take(pa.array(rows)).flatten().to_numpy().astype(np.int64)
        yield int(w), rows, x.reshape(len(rows), PARTS, w // PARTS)


def next_books(whole: DataFrame, books: dict) -> dict:
    """The codebooks after a round: each entry the componentwise floor of its parts' mean; an entry without parts stays.

    A task hands on one row of sums for each entry and component that it met.
    """
    def add(batches):
        import numpy as np
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            for w, _, x in by_width(batch):
                for p in range(PARTS):
                    index, _ = nearest_entries(x[:, p], books[w][p])
                    count, sums = total.setdefault((w, p), (np.zeros(len(books[w][p]), np.int64), np.zeros_like(books[w][p])))
                    count += np.bincount(index, minlength=len(count))
                    np.add.at(sums, index, x[:, p])
        rows = [(w, p, e, int(count[e]), sums[e].tolist()) for (w, p), (count, sums) in total.items() for e in np.flatnonzero(count)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["width", "part", "entry", "n", "sums"])

    partial = whole.select("width", "x").mapInArrow(add, "width int, part int, entry int, n long, sums array<long>")
    met = partial.select("width", "part", "entry", "n", F.posexplode("sums").alias("place", "sum")).groupBy("width", "part", "entry", "place")
    new = {w: b.copy() for w, b in books.items()}
    for r in met.agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect():  # as many numbers as the codebooks hold
        new[r.width][r.part, r.entry, r.place] = int(r["sum"]) // r.n
    return new


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, dict]:
    """(vec_id, label, width, code string, error long), one row per vector that takes part, and the codebooks by width (8 x entries x part).

    ``vectors`` is (vec_id, embedding, label); other columns are ignored. Vectors that are null or hold null or non-finite
    components are left out; zero and empty ones take part. Widths don't mix: each has its own codebooks, from the 16
    smallest ids of its vectors (fewer if there are fewer; null ids count once, after all others). Rows that repeat count
    as often as they are there. Codebooks (16 x width numbers) go through the driver, vectors never do: a round is one pass over them and sums
    per entry that are combined in each task. A round that changes nothing ends the rounds, as no later one would change anything.
    """
    import numpy as np

    whole = written(whole_vectors(vectors))
    books = first_books(whole)
    for _ in range(rounds if books else 0):
        books, before = next_books(whole, books), books
        if all(np.array_equal(books[w], before[w]) for w in books):
            break

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            codes, errors = np.empty((len(batch), PARTS), np.uint8), np.zeros(len(batch), np.int64)
            for w, rows, x in by_width(batch):
                for p in range(PARTS):
                    codes[rows, p], dist = nearest_entries(x[:, p], books[w][p])
                    errors[rows] += dist
            text = codes.tobytes().hex()
            code = pa.array([text[i:i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("vec_id", "label", "width")], code, pa.array(errors)], names=["vec_id", "label", "width", "code", "error"])

    kind = whole.schema["label"].dataType.simpleString()
    return whole.mapInArrow(encode, f"vec_id long, label {kind}, width int, code string, error long"), books


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(read_table(spark, sf_dir, "embeddings"))
    coded = written(coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    labels = written(coded.groupBy("key").agg(F.sum("error").alias("label_error")))
    sha = {w: hashlib.sha256(",".join(map(str, b.ravel().tolist())).encode()).hexdigest() for w, b in books.items()}
    name = F.create_map(*[F.lit(x) for item in (sha or {0: ""}).items() for x in item])
    return by_key(coded, labels, spread="vec_id").select("vec_id", "code", "error", "label_error", name[F.col("width")].alias("codebooks_sha256"))


def codes_sql() -> str:
    """op12_codes in DuckDB's SQL, for vectors of one width that divides by 8: the rounds one after another."""
    dist = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def assigned(book):
        return f"select vec_id, label, x.p, x.v, min(struct_pack(d := {dist}, e := b.e)) as m from parts x join {book} b on x.p = b.p group by all"

    out = ["""kept as (select vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::double)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
parts as materialized (select vec_id, label, p, x[p * len(x) // 8 + 1:(p + 1) * len(x) // 8] as v from kept, unnest(range(8)) as r(p)),
b0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, v from parts qualify e < 16)"""]
    for i in range(ROUNDS):
        out.append(f"""a{i} as materialized ({assigned(f"b{i}")}),
s{i} as (select p, m.e as e, i, sum(v[i])::bigint as s, count(*) as c from a{i}, unnest(range(1, len(v) + 1)) as r(i) group by all),
b{i + 1} as materialized (select b.p, b.e, coalesce(n.v, b.v) as v from b{i} b left join (select p, e, list((s - (s % c + c) % c) // c order by i) as v from s{i} group by all) n using (p, e))""")
    out.append(f"last as materialized ({assigned(f'b{ROUNDS}')})")
    out.append("coded as (select vec_id, label, string_agg(printf('%02x', m.e), '' order by p) as code, sum(m.d)::bigint as error from last group by all)")
    return "with " + ",\n".join(out) + f"""
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) from b{ROUNDS}) as codebooks_sha256 from coded"""


CODES_SQL = codes_sql()
