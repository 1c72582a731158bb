"""Near-duplicate vectors by a robust-pruned flat graph on overlapping cluster shards (operator 7)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import read_table, shuffle_partitions, written
from lectern.llm.components import connected_components
from lectern.operators.graph_index import usable

LEAST = 0.9
#: Vectors per centroid on average, the most centroids of one split, its sample per centroid, and the most vectors of a cell that is not split further.
CELL_ROWS, FAN, SAMPLE, MAX_ROWS, LEVELS = 2048, 1024, 20, 12_288, 4
OVERLAP = 3  # nearest centroids whose cells a vector belongs to
BLOCK_ROWS = 4096  # vectors of a group that looks for balls; half of what a task holds of a cell that can't be split
DEGREE, BUILD_BEAM = 16, 48
AUDIT_QUERIES, LEAST_RECALL = 256, 0.99
SLACK = 1e-6  # radians, above what rounding does to an angle


def split(rows: DataFrame, overlap: int) -> tuple[DataFrame, int]:
    """(vec_id, u, ..., cell): each vector in the cells of its nearest centroids; and the most centroids of a split.

    All vectors of a width begin as one cell. A cell that is too large is split around centroids (spherical k-means on a
    hash-chosen sample of its vectors, so many per centroid), again and again while cells are too large; the vectors of one are dealt
    to tasks in parts of bounded size, each with the cell's centroids. Nothing is collected.
    """
    names = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cell long"

    def fit(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("vec_id")
        x, k = np.stack(pdf["u"].to_numpy()), int(pdf["k"].iloc[0])
        c = x[np.unique(np.linspace(0, len(x) - 1, min(k, len(x))).astype(int))]
        for _ in range(4):
            near, sums = (x @ c.T).argmax(axis=1), np.zeros_like(c)
            np.add.at(sums, near, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(size > 0, sums / np.maximum(size, 1e-30), c)
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "c": [c.ravel()]})

    def deal(pdf, centroids):
        import numpy as np
        import pandas as pd

        if not len(pdf) or not len(centroids):
            return pd.DataFrame(columns=[*names, "cell"])
        x = np.stack(pdf["u"].to_numpy())
        c = np.asarray(centroids["c"].iloc[0]).reshape(-1, x.shape[1])
        near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :overlap]
        out = pdf[names].loc[pdf.index.repeat(near.shape[1])].copy()
        # a cell's name is spread over 64 bits, so that names of different splits don't meet
        old = np.repeat(pdf["cell"].to_numpy(np.int64), near.shape[1]).view(np.uint64)
        with np.errstate(over="ignore"):
            out["cell"] = ((old * np.uint64(0x9E3779B97F4A7C15) + near.ravel().astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
        return out

    cells, most = rows.withColumn("cell", F.size("u").cast("long")), 1
    for _ in range(LEVELS):
        sizes = written(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > MAX_ROWS).withColumn("k", F.least(F.ceil(F.col("n") / CELL_ROWS), F.lit(FAN)).cast("int")))
        top = sizes.agg(F.max("k").alias("k")).first().k
        if top is None:
            break
        most = max(most, top)
        mine = cells.join(sizes, "cell")
        spread = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30))
        fitted = mine.where(spread <= (SAMPLE * F.col("k") / F.col("n") * (1 << 30))).select("vec_id", "u", "cell", "k").groupBy("cell").applyInPandas(fit, "cell long, c array<double>")
        parts = F.ceil(F.col("n") / BLOCK_ROWS / 4).cast("int")
        mine = mine.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(5)), parts).cast("int")).select(*names, "cell", "part")
        fitted = written(fitted).join(sizes, "cell").select(F.col("cell").alias("of_cell"), "c", F.explode(F.sequence(F.lit(0), parts - 1)).alias("of_part"))
        dealt = mine.groupBy("cell", "part").cogroup(fitted.groupBy("of_cell", "of_part")).applyInPandas(deal, schema)
        cells = written(cells.join(sizes.select("cell"), "cell", "left_anti").select(*names, "cell").unionByName(dealt))
    return cells, most


def unite(parent, a, b):
    """``parent`` (each place's smallest place known to be joined with it) after joining the places a with b (numpy)."""
    import numpy as np

    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def leaders(rows: DataFrame, radius: float) -> DataFrame:
    """(vec_id, lead): each of the rows (vec_id, u, cell) with a vector of its cell at most ``radius`` away that leads it.

    A cell of any size is dealt to groups of BLOCK_ROWS by a hash; in a group, the vector that reaches most others
    (of equal ones that of the smallest id) leads all within reach that no other leads yet.
    """
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    dealt = rows.join(sizes, "cell").select("vec_id", "u", "cell", F.pmod(F.xxhash64("vec_id", F.lit(17)), F.col("parts")).cast("int").alias("part"))
    close = math.cos(radius)

    def lead(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("vec_id")
        ids, x = pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["u"].to_numpy())
        by = np.full(len(ids), -1)
        near = np.concatenate([x[k:k + 512] @ x.T >= close for k in range(0, len(x), 512)])
        reached = near.sum(axis=1)
        order = np.argsort(-reached, kind="stable")
        for i in order[: np.count_nonzero(reached > 1)]:
            if by[i] < 0:
                by[near[i] & (by < 0)] = i
        return pd.DataFrame({"vec_id": ids, "lead": ids[np.where(by < 0, np.arange(len(ids)), by)]})

    return dealt.groupBy("cell", "part").applyInPandas(lead, "vec_id long, lead long")


def balls_of(one: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Members (ball, vec_id, u, weight) and balls (vec_id, u, weight, members, rho) of distinct vectors (vec_id, u, weight).

    A ball's vectors lie within half the linking angle of its centre, so they are all linked with each other, and a dense
    cluster of any size is a few balls. Twice a vector is led by one within a quarter of the angle: in groups dealt by
    hash, then the leaders among each other. A ball goes by its smallest id; u is its centre, rho its true radius.
    """
    reach = math.acos(least) / 4 - SLACK
    cells = split(one.select("vec_id", "u"), 1)[0]
    first = written(leaders(cells, reach))
    again = written(leaders(cells.join(first.where("vec_id = lead").select("vec_id"), "vec_id", "left_semi"), reach))
    led = first.join(again.select(F.col("vec_id").alias("lead"), F.col("lead").alias("centre")), "lead").select("vec_id", "centre")
    centre = one.select(F.col("vec_id").alias("centre"), F.col("u").alias("centre_u"))
    others = led.where("vec_id <> centre").join(one, "vec_id").join(centre, "centre")
    angle = F.acos(F.least(F.lit(1.0), F.aggregate(F.zip_with("u", "centre_u", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))
    others = others.select("vec_id", "centre", "u", "weight", angle.alias("angle"))
    members = written(others.unionByName(led.where("vec_id = centre").join(one, "vec_id").select("vec_id", "centre", "u", "weight", F.lit(0.0).alias("angle"))))
    sums = members.groupBy("centre").agg(F.min("vec_id").alias("ball"), F.sum("weight").alias("weight"), F.count("*").alias("members"), F.max("angle").alias("rho"))
    sums = written(sums)
    balls = written(sums.join(centre, "centre").select(F.col("ball").alias("vec_id"), F.col("centre_u").alias("u"), "weight", "members", "rho"))
    return members.join(sums.select("centre", "ball"), "centre").select("ball", "vec_id", "u", "weight"), balls


def shards_of(cells: DataFrame) -> DataFrame:
    """One row per ball and shard: (vec_id, u, weight, members, rho, cells, cell, b, i, j, blocks).

    A cell is one shard. One that could not be split below twice BLOCK_ROWS is dealt into blocks by a hash of the id, and each
    pair of blocks (i < j) is a shard, so that every two of the cell meet in one of bounded size.
    """
    lists = cells.groupBy("vec_id").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("rows"))
    blocks = F.when(F.col("rows") <= MAX_ROWS, 1).otherwise(F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int")
    each = cells.join(lists, "vec_id").join(sizes.select("cell", blocks.alias("blocks")), "cell")
    each = each.withColumn("b", F.pmod(F.xxhash64("vec_id", F.lit(11)), F.col("blocks")).cast("int"))
    other = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("b"))
    each = each.withColumn("o", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(other)))
    return each.select("vec_id", "u", "weight", "members", "rho", "cells", "cell", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "blocks")


def one_task_each(rows: DataFrame, n_shards: int) -> DataFrame:
    """Shards dealt to tasks of their own: they are small in bytes but long in work, so partitions must not be merged by size."""
    return rows.repartition(max(shuffle_partitions(rows.sparkSession), 2 * n_shards), "cell", "i", "j").groupBy("cell", "i", "j")


def adjacency(shards: DataFrame, n_shards: int) -> DataFrame:
    """(vec_id, neighbours): each shard's graph, its vectors' lists united over all shards."""

    def make(pdf):
        import numpy as np
        import pandas as pd

        from lectern.functions.graph import build

        pdf = pdf.sort_values("vec_id")
        ids = pdf["vec_id"].to_numpy(np.int64)
        adj = build(np.stack(pdf["u"].to_numpy()).astype(np.float32), DEGREE, BUILD_BEAM)
        return pd.DataFrame({"vec_id": ids, "neighbours": [ids[a[a >= 0]] for a in adj]})

    lists = one_task_each(shards.select("cell", "i", "j", "vec_id", "u"), n_shards).applyInPandas(make, "vec_id long, neighbours array<long>")
    return lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))


def linked(shards: DataFrame, flat: DataFrame, least: float, n_shards: int) -> DataFrame:
    """Rows (vec_id, n, root, other). Per ball and shard: n vectors that all of its own are linked with, and the smallest id it is joined to; or
    a pair of balls (vec_id, other) of which some vectors may be linked.

    Batches of balls search their shard's part of the flat graph, from the shard's medoids and their own neighbours. Centres closer than
    the linking angle less both radii link all of both balls, those farther than the angle and both radii none. A pair that shares
    several shards counts in the first alone, so counts add up and no linked pair is written anywhere.
    """
    theta = math.acos(least)

    def search(pdf):
        import numpy as np
        import pandas as pd

        from lectern.functions.graph import medoid
        from lectern.llm.range_graph import both_ways, range_search

        pdf = pdf.sort_values("vec_id").reset_index(drop=True)
        ids = pdf["vec_id"].to_numpy(np.int64)
        u = np.stack(pdf["u"].to_numpy())
        x = u.astype(np.float32)
        cell, i, j, blocks = (int(pdf[c].iloc[0]) for c in ("cell", "i", "j", "blocks"))
        lists = pdf["neighbours"].to_numpy()
        sizes = np.array([0 if a is None else len(a) for a in lists])
        to = np.concatenate([np.asarray(a, np.int64) for a in lists if a is not None and len(a)] or [np.empty(0, np.int64)])
        of = np.repeat(np.arange(len(ids)), sizes)
        place = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
        here = ids[place] == to
        of, place = of[here], place[here]
        begin, ends = both_ways(len(ids), of, place)
        cells = np.full((len(ids), max(map(len, pdf["cells"]))), 0, np.int64)
        for r, own in enumerate(pdf["cells"]):
            cells[r] = own[-1]
            cells[r, : len(own)] = own
        b, weight, rho, single = pdf["b"].to_numpy(), pdf["weight"].to_numpy(np.int64), pdf["rho"].to_numpy(), pdf["members"].to_numpy() == 1
        parent, count = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        # medoids of as many stretches of the vectors, along a first direction, as there are batches
        order = np.argsort(x @ x[medoid(x)], kind="stable")
        starts = np.array([part[medoid(x[part])] for part in np.array_split(order, max(1, len(ids) // 1024))])
        open_ = []
        for at in range(0, len(ids), 256):
            me = order[at:at + 256]
            entries = np.concatenate([starts, me])  # what a ball itself is in range of, its neighbours are met from
            far = np.minimum(theta + rho[me].max() + rho + 1e-3, math.pi)
            q, c = range_search(x, begin, ends, x[me], entries, np.cos(far))
            q = me[q]
            dots = np.concatenate([np.einsum("pd,pd->p", u[q[k:k + 65536]], u[c[k:k + 65536]]) for k in range(0, max(1, len(q)), 65536)])
            psi = np.arccos(np.clip(dots, -1, 1))
            two = single[q] & single[c]
            all_ = np.where(two, dots >= least, psi + rho[q] + rho[c] <= theta - SLACK) & (q != c)
            some = ~two & ~all_ & (psi <= theta + rho[q] + rho[c] + SLACK) & (q != c)
            # the first cell that both have; within a cell of several blocks, the pair of their blocks
            rows = np.flatnonzero(all_ | some)
            q, c, all_ = q[rows], c[rows], all_[rows]
            both = (cells[q][:, :, None] == cells[c][:, None, :]).any(axis=2)
            mine = cells[q, both.argmax(axis=1)] == cell
            if blocks > 1:
                lo, hi = np.minimum(b[q], b[c]), np.maximum(b[q], b[c])
                nxt = (lo + 1) % blocks
                mine &= np.where(lo == hi, (np.minimum(lo, nxt) == i) & (np.maximum(lo, nxt) == j), (lo == i) & (hi == j))
            np.add.at(count, q[mine & all_], weight[c[mine & all_]])
            parent = unite(parent, q[all_], c[all_])
            pair = mine & ~all_ & (q < c)
            open_.append(np.stack([ids[q[pair]], ids[c[pair]]], axis=1))
        pairs = np.concatenate(open_) if open_ else np.empty((0, 2), np.int64)
        done = pd.DataFrame({"vec_id": ids, "n": count, "root": ids[parent], "other": pd.array([None] * len(ids), "Int64")})
        return pd.concat([done, pd.DataFrame({"vec_id": pairs[:, 0], "n": 0, "root": pairs[:, 0], "other": pd.array(pairs[:, 1], "Int64")})], ignore_index=True)

    rows = shards.join(flat, "vec_id", "left")
    return one_task_each(rows, n_shards).applyInPandas(search, "vec_id long, n long, root long, other long")


def between(pairs: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """(vec_id, n, a, b): the vectors of pairs of balls (a, b), each with the number of vectors of the other ball linked with it.

    A task compares one block of a ball with one of the other.
    """
    dealt = members.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(19)), F.lit(1 << 20)))
    sizes = members.groupBy("ball").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    wanted = pairs.join(sizes.select(F.col("ball").alias("a"), F.col("blocks").alias("na")), "a").join(sizes.select(F.col("ball").alias("b"), F.col("blocks").alias("nb")), "b")

    def side(one: str, other: str) -> DataFrame:
        rows = wanted.join(dealt, F.col(one) == F.col("ball")).withColumn("mine", F.pmod("block", F.col(f"n{one}")).cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)))
        first, second = ("mine", "theirs") if one == "a" else ("theirs", "mine")
        return rows.select(F.col("a").alias(f"a_{one}"), F.col("b").alias(f"b_{one}"), F.col(first).alias(f"i_{one}"), F.col(second).alias(f"j_{one}"), "vec_id", "u", "weight")

    def compare(left, right):
        import numpy as np
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({c: np.empty(0, np.int64) for c in ("vec_id", "n", "a", "b")})
        near = np.stack(left["u"].to_numpy()) @ np.stack(right["u"].to_numpy()).T >= least
        n = np.concatenate([near @ right["weight"].to_numpy(np.int64), near.T @ left["weight"].to_numpy(np.int64)])
        ids = np.concatenate([left["vec_id"].to_numpy(np.int64), right["vec_id"].to_numpy(np.int64)])
        return pd.DataFrame({"vec_id": ids[n > 0], "n": n[n > 0], "a": int(left["a_a"].iloc[0]), "b": int(left["b_a"].iloc[0])})

    keys = lambda s: [f"{k}_{s}" for k in ("a", "b", "i", "j")]
    return side("a", "b").groupBy(*keys("a")).cogroup(side("b", "a").groupBy(*keys("b"))).applyInPandas(compare, "vec_id long, n long, a long, b long")


def audit(one: DataFrame, links: DataFrame, least: float) -> float:
    """The mean share of its true links that the search has found, over two bounded, hash-chosen samples of distinct vectors: of all, and of
    those with links (vec_id, n_links) found. Each vector counts once, however many copies it has; 1 if none has links.
    """
    import numpy as np

    spread = F.xxhash64("vec_id", F.lit(13))
    pick = lambda rows: rows.orderBy(spread).limit(AUDIT_QUERIES).select("vec_id", "u").collect()
    chosen = {r.vec_id: r.u for r in pick(one) + pick(one.join(links.where("n_links > 0").select("vec_id"), "vec_id", "left_semi"))}
    by_width: dict[int, list[int]] = {}
    for i in sorted(chosen):
        by_width.setdefault(len(chosen[i]), []).append(i)
    asked = {w: (np.array(ids), np.array([chosen[i] for i in ids])) for w, ids in by_width.items()}

    def scan(batches):
        import pyarrow as pa

        true = {w: np.zeros(len(ids), np.int64) for w, (ids, _) in asked.items()}
        for batch in batches:
            me, weight, vectors = np.asarray(batch.column(0)), np.asarray(batch.column(2)), batch.column(1).to_pylist()
            width = np.array([len(v) for v in vectors])
            for w, (ids, q) in asked.items():
                at = np.flatnonzero(width == w)
                if len(at):
                    close = (np.array([vectors[k] for k in at]) @ q.T >= least) & (me[at][:, None] != ids)
                    true[w] += (close * weight[at][:, None]).sum(axis=0)
        for w, (ids, _) in asked.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(true[w])], names=["vec_id", "really"])

    true = one.select("vec_id", "u", "weight").mapInArrow(scan, "vec_id long, really long").groupBy("vec_id").agg(F.sum("really").alias("really")).where("really > 0")
    share = F.least(F.lit(1.0), F.coalesce("n_links", F.lit(0)) / F.col("really"))
    got = true.join(links, "vec_id", "left").agg(F.avg(share).alias("mean")).first().mean
    return 1.0 if got is None else got


def near_duplicate_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row of (vec_id, embedding).

    Vectors of cosine >= ``least`` (of the components in double precision) are linked. Equal vectors are one until the
    end, and so are those of a ball that is known to be linked throughout. Balls lie in shards around the nearest centroids of their centres; per-shard
    graphs are united to one flat graph, each ball searches it, and what it finds is confirmed: by the angle where that decides for all of two
    balls, else vector by vector. An audit against all rows measures recall on bounded samples; below
    ``LEAST_RECALL`` the overlap is doubled and the search repeated, at last over all cells of a split. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing, nor do rows with a null id; widths, of which there may be any number, don't mix. Rows that
    repeat an id must hold the same vector, and are one vector.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda c: c + F.lit(0.0)).alias("v"))
    # scaled by the largest component first, so that no square overflows or vanishes; each divisor is computed once for a vector
    over = lambda v, by: F.get(F.transform(F.array(by(v)), lambda n: F.transform(v, lambda c: c / n)), F.lit(0))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, c: a + c * c))
    scaled = F.transform(F.array(over(F.col("v"), lambda v: F.array_max(F.transform(v, F.abs)))), lambda v: over(v, length))
    unit = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull()).select("vec_id", F.get(scaled, F.lit(0)).alias("u"))
    unit = written(unit.withColumn("key", F.struct(F.xxhash64(F.lit(1), "u").alias("h1"), F.xxhash64(F.lit(2), "u").alias("h2"), F.size("u").alias("width"))))
    classes = written(unit.groupBy("key").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies")))
    one = written(unit.join(classes.select(F.col("rep").alias("vec_id"), F.col("copies").alias("weight")), "vec_id").dropDuplicates(["vec_id"]).select("vec_id", "u", "weight"))
    found = links_of(one, least)
    # the search has counted a linked vector's copies; a vector's own copies are linked with it too
    weights = classes.select(F.col("rep").alias("vec_id"), "key", "copies")
    per_class = weights.join(found, "vec_id").select("key", (F.col("n_links") + F.col("copies") - 1).alias("n_links"), "component_id")
    mine = unit.select("vec_id", "key").distinct().join(per_class, "key").select(F.col("vec_id").alias("known_id"), "n_links", "component_id")
    out = rows.select("vec_id").join(mine, F.col("vec_id") == F.col("known_id"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))


def links_of(one: DataFrame, least: float) -> DataFrame:
    """(vec_id, n_links, component_id) of distinct vectors (vec_id, u, weight): links to others, with their copies."""
    members, balls = balls_of(one, least)
    members = written(members)
    overlap = OVERLAP
    while True:
        cells, most = split(balls, overlap)
        shards = written(shards_of(cells))
        n_shards = shards.select("cell", "i", "j").distinct().count()
        rows = written(linked(shards, adjacency(shards, n_shards), least, n_shards))
        pairs = rows.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")).distinct()
        partly = written(between(pairs, members, least))
        own = rows.where("other is null").groupBy(F.col("vec_id").alias("ball")).agg(F.sum("n").alias("n")).join(balls.select(F.col("vec_id").alias("ball"), F.col("weight").alias("all")), "ball")
        single = partly.groupBy("vec_id").agg(F.sum("n").alias("more"))
        links = members.join(own, "ball").join(single, "vec_id", "left").select("vec_id", "ball", (F.col("n") + F.col("all") - F.col("weight") + F.coalesce("more", F.lit(0))).alias("n_links"))
        links = written(links)
        if audit(one, links, least) >= LEAST_RECALL or overlap >= most:
            break
        overlap *= 2
    edges = rows.where("other is null").select(F.col("vec_id").alias("a"), F.col("root").alias("b")).unionByName(partly.select("a", "b"))
    component = connected_components(edges.where("a <> b").distinct()).select(F.col("id").alias("ball"), "component")
    return links.join(component, "ball", "left").select("vec_id", "n_links", F.coalesce("component", "ball").alias("component_id"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


#: The same in DuckDB's SQL, by all pairs.
VECTORS_SQL = """with recursive vectors as (
  select vec_id, embedding::double[] as v from embeddings where len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding) and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from vectors a join vectors b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.9),
reached(vec_id, other) as (select vec_id, vec_id from vectors union select vec_id, b from reached join links on a = other),
component as (select vec_id, min(other) as least from reached group by vec_id),
counts as (select a as vec_id, count(distinct b) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(least, vec_id) as component_id, coalesce(least, vec_id) = vec_id as kept
from embeddings left join component using (vec_id) left join counts using (vec_id)"""
