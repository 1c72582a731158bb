"""An index of vectors as pruned graphs over shards, and the search of many queries in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lectern.operators.joins import written
from lectern.sources.buckets import read_buckets, replace_in_buckets

SHARD_ROWS, BEAM, MAX_BUCKETS = 4096, 256, 1024
GRAPH = "shard int, width int, keys array<long>, vectors array<double>, neighbours array<int>, degree int"


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda c: c != 0), F.lit(False))


def build_graphs(vectors: DataFrame, n: int, shard_rows: int = SHARD_ROWS, passes: int = 1, single: bool = False) -> DataFrame:
    """GRAPH, one row per shard (a few megabytes), of ``n`` rows (key long, v array<double>) with distinct keys.

    A hash of the key deals the vectors to shards of bounded size, so that a cluster of any size is spread evenly. Shards hold
    one width. A vector is scaled by its shard's largest component, so that squares neither overflow nor vanish. With ``single`` the edges are chosen in single
    precision, which takes two thirds of the time and does for vectors of unit length; the vectors stay as they are.
    """
    shards = max(1, -(-n // shard_rows))

    def make(pdf):
        import numpy as np
        import pandas as pd

        from lectern.functions.graph import build

        pdf = pdf.sort_values("key")  # the same graph however rows arrive
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        adj = build((x / np.abs(x).max()).astype(np.float32 if single else np.float64), passes=passes)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "width": [x.shape[1]], "keys": [pdf["key"].to_numpy(np.int64)], "vectors": [x.ravel()], "neighbours": [adj.ravel().astype(np.int32)], "degree": [adj.shape[1]]})

    dealt = vectors.select("key", "v", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("width"))
    # shards are small in bytes and long in work: a partition each
    return dealt.repartition(max(shards, 1), "shard", "width").groupBy("shard", "width").applyInPandas(make, GRAPH)


def search_graphs(graphs: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """(query_id, key, distance): for each query (query_id, v array<double>) the k nearest found, by Euclidean distance in double precision.

    Every query is sought in every shard of its width by beam search. Graphs and queries are sorted together, a shard's graph in front of the queries: a task
    holds one graph and takes the queries past it in batches, so a graph moves once, however many queries there are. Distances are
    of the vectors as they are; ties go to the smaller key. Vectors that an update marked as dead lead the way but are not found.
    """
    by = ["shard", "width"]
    ways = graphs.select(*by)
    asked = queries.select("query_id", F.col("v").alias("q"), F.size("v").alias("width")).join(F.broadcast(ways), "width")
    if "dead" not in graphs.columns:
        graphs = graphs.withColumn("dead", F.lit(None).cast("array<int>"))
    parts = ("keys", "vectors", "neighbours", "degree", "dead")
    types = {f.name: f.dataType.simpleString() for f in graphs.schema.fields}
    tape = graphs.select(*by, F.lit(0).alias("turn"), *parts, F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("q")).unionByName(
        asked.select(*by, F.lit(1).alias("turn"), *[F.lit(None).cast(types[c]).alias(c) for c in parts], F.col("query_id").cast("long").alias("query_id"), "q"))
    tape = tape.repartition(max(1, ways.count()), *by).sortWithinPartitions(*by, "turn")

    def search(frames):
        import numpy as np
        import pandas as pd

        from lectern.functions.graph import beam_search, medoid

        for frame in frames:
            out = []
            for (shard, width, turn), pdf in frame.groupby(by + ["turn"], sort=True):
                if turn == 0:
                    g = pdf.iloc[0]
                    keys = np.asarray(g["keys"], np.int64)
                    own = np.asarray(g["vectors"], np.float64).reshape(len(keys), -1)
                    adj = np.asarray(g["neighbours"]).astype(np.int64).reshape(len(keys), -1)
                    dead = np.zeros(len(keys), bool)
                    dead[np.asarray(g["dead"] if g["dead"] is not None else [], np.int64)] = True
                    most, at_hand = np.abs(own).max(initial=0.0), (shard, width)
                    continue
                if at_hand != (shard, width) or not len(keys):
                    continue
                ids, asked_v = pdf["query_id"].to_numpy(np.int64), np.stack(pdf["q"].to_numpy())
                for at in range(0, len(ids), 256):
                    q = asked_v[at:at + 256]
                    scale = max(most, np.abs(q).max())
                    x = own / scale
                    norms = np.einsum("ij,ij->i", x, x)
                    near, _ = beam_search(x, norms, adj, q / scale, np.full((len(q), 1), medoid(x)), min(beam, len(x)), step=8)
                    safe, rows = np.maximum(near, 0), np.arange(len(q))[:, None]
                    none = (near < 0) | dead[safe]
                    d = np.where(none, np.inf, scale * np.sqrt(((x[safe] - q[:, None, :] / scale) ** 2).sum(axis=2)))
                    exact = np.where(none, np.inf, np.sqrt(((own[safe] - q[:, None, :]) ** 2).sum(axis=2)))
                    d = np.where(np.isfinite(exact) & (exact > 0) | none, exact, d)
                    first = np.lexsort((keys[safe], d), axis=1)[:, :k]
                    d, i = d[rows, first], keys[safe[rows, first]]
                    good = np.isfinite(d)
                    out.append(pd.DataFrame({"query_id": np.repeat(ids[at:at + 256], first.shape[1])[good.ravel()], "key": i[good], "distance": d[good]}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": np.empty(0, np.int64), "key": np.empty(0, np.int64), "distance": np.empty(0)})

    found = tape.mapInPandas(search, "query_id long, key long, distance double")
    best = W.partitionBy("query_id").orderBy("distance", "key")
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


#: The share of dead vectors from which a shard is cleared of them.
MOST_DEAD = 0.2
STORED = GRAPH + ", dead array<int>, shards int"


def store_graphs(graphs: DataFrame, path: str) -> DataFrame:
    """Writes graphs as an index that ``update_graphs`` can change, in buckets of shards; the index.

    Graphs are met several times on the way, so they are written first and built once.
    """
    graphs = written(graphs)
    spark, shards = graphs.sparkSession, max(1, graphs.select("shard").distinct().count())
    rows = graphs.withColumns({"dead": F.array().cast("array<int>"), "shards": F.lit(shards)})
    replace_in_buckets(rows, path, "shard", min(MAX_BUCKETS, shards))
    return stored_graphs(spark, path)


def stored_graphs(spark: SparkSession, path: str) -> DataFrame:
    return read_buckets(spark, path, T._parse_datatype_string(STORED))


def update_graphs(path: str, changes: DataFrame) -> DataFrame:
    """The index after changes (key long, v array<double>; null deletes, a known key is replaced), without building it anew.

    Each change goes to the shard that its key falls in; of the shards only those are read and written. A new vector is inserted as in
    building: it seeks itself, prunes what it meets to its neighbours and gets edges back. A vector that goes is marked as dead and still leads the
    way; from MOST_DEAD on, a shard drops them and joins their neighbours. Of several changes of a key in one table the result is that of any one.
    Shards grow with the table: build the index anew when it has doubled.
    """
    spark = changes.sparkSession
    index = stored_graphs(spark, path)
    shards = index.select("shards").first()[0]
    dealt = changes.select("key", "v", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")).dropDuplicates(["key"])
    touched = index.join(F.broadcast(dealt.select("shard").distinct()), "shard", "left_semi")

    def change(graph, pdf):
        import numpy as np
        import pandas as pd

        from lectern.functions.graph import DEGREE, extend, without

        gone = set(pdf["key"])
        new: dict = {}
        for key, v in sorted(zip(pdf["key"], pdf["v"]), key=lambda x: x[0]):
            if v is not None and len(v):
                new.setdefault(len(v), []).append((key, v))
        by_width = {int(g["width"]): g for _, g in graph.iterrows()}
        rows = []
        for width in sorted({*new, *by_width}):
            if width in by_width:
                g = by_width[width]
                keys, adj = np.asarray(g["keys"], np.int64), np.asarray(g["neighbours"]).astype(np.int64).reshape(len(g["keys"]), -1)
                x = np.asarray(g["vectors"], np.float64).reshape(len(keys), -1)
                dead = np.isin(keys, list(gone))
                dead[np.asarray(g["dead"], np.int64)] = True
            else:
                keys, adj, x, dead = np.empty(0, np.int64), np.empty((0, 2 * DEGREE), np.int64), np.empty((0, width)), np.zeros(0, bool)
            if width in new:
                x = np.concatenate([x, np.array([v for _, v in new[width]], np.float64)])
                keys = np.concatenate([keys, np.array([k for k, _ in new[width]], np.int64)])
                adj = extend(x / np.abs(x).max(), adj)
                dead = np.concatenate([dead, np.zeros(len(keys) - len(dead), bool)])
            if dead.sum() > MOST_DEAD * len(dead):
                adj = without(x / np.abs(x).max(), adj, dead)
                keys, x, dead = keys[~dead], x[~dead], np.zeros(int((~dead).sum()), bool)
            if len(keys):
                shard = int(pdf["shard"].iloc[0]) if len(pdf) else int(graph["shard"].iloc[0])
                rows.append((shard, width, keys, x.ravel(), adj.ravel().astype(np.int32), adj.shape[1], np.flatnonzero(dead).astype(np.int32), shards))
        return pd.DataFrame(rows, columns=["shard", "width", "keys", "vectors", "neighbours", "degree", "dead", "shards"])

    after = touched.repartition(max(1, shards), "shard").groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(change, STORED)
    replace_in_buckets(written(after), path, "shard", min(MAX_BUCKETS, shards), dealt.select("shard").distinct())
    return stored_graphs(spark, path)
