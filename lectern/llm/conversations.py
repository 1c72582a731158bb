"""Conversation structure repair: cheapest edits by block tables of cost-vector transitions (operator 11)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import by_ids, read_table, shuffle_partitions, written
from lectern.llm.minhash import by_key

#: Costs of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows that one lookup takes, and rows of a conversation that are walked together.
BLOCK, PIECE_ROWS = 4, 16_384
#: States of the role initials written so far, (s?(ua)+)?: nothing, s, an open u, a closed pair. ROLE: the initial that may be
#: made or inserted next; NEXT: the state after it.
STATES, ROLE, NEXT, LAST = 4, "uuau", (2, 2, 3, 2), (0, 10, 5, 0)
NAMES = {"u": "user", "a": "assistant"}
FAR = 1 << 20
#: Symbols of rows: an initial (s, u, a, another) times whole or truncated; one that must go; and no row, which fills up blocks.
GONE, NONE, SYMBOLS = 8, 9, 10


def step(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) of what may be done with a row; without inserting."""
    if symbol == NONE:
        return [("", 0, state)]
    out = [("D", DELETE, state)]
    if symbol != GONE:
        initial, extra = "sua?"[symbol // 2], TRUNCATED * (symbol % 2)
        if initial == "s" and state == 0:
            out.append(("K", extra, 1))
        if initial == ROLE[state]:
            out.append(("K", extra, NEXT[state]))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


def costs_before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The least costs to the end from each state before a row (insertions first), from those after it."""
    own = [min(cost + after[to] for _, cost, to in step(symbol, q)) for q in range(STATES)]
    if symbol == NONE:
        return tuple(own)
    once = [min(own[q], INSERT + own[NEXT[q]]) for q in range(STATES)]
    return tuple(min(FAR, own[q], INSERT + once[NEXT[q]]) for q in range(STATES))


def normal(costs) -> tuple[tuple[int, ...], int]:
    """The costs less their least, and that; what cannot be reached stays FAR."""
    least = min(costs)
    return tuple(c - least if c < FAR // 2 else FAR for c in costs), least


@functools.lru_cache(1)
def tables():
    """(vectors, numbers by vector, to, add): the closure of normalised cost vectors, and for each of them and each block of BLOCK symbols
    the vector before the block and the cost that normalising took off. A block's code has its first symbol in the highest place."""
    import numpy as np

    vectors, numbers = [], {}

    def number(v):
        if v not in numbers:
            numbers[v] = len(vectors)
            vectors.append(v)
        return numbers[v]

    for q in range(STATES):
        number(tuple(0 if s == q else FAR for s in range(STATES)))
    number(LAST)
    to, add = [], []
    while len(to) < len(vectors):
        found = [normal(costs_before(symbol, vectors[len(to)])) for symbol in range(SYMBOLS)]
        to.append([number(v) for v, _ in found])
        add.append([least for _, least in found])
    one_to, one_add = np.array(to), np.array(add)
    to, add = one_to, one_add
    for _ in range(BLOCK - 1):  # one symbol more in front
        add = (one_add[to] + add[:, :, None]).transpose(0, 2, 1).reshape(len(vectors), -1)
        to = one_to[to].transpose(0, 2, 1).reshape(len(vectors), -1)
    return vectors, numbers, to, add


def blocks_of(symbols):
    """Codes of a piece's blocks; the last is filled up with NONE."""
    import numpy as np

    n = -(-len(symbols) // BLOCK)
    full = np.full(n * BLOCK, NONE, np.int64)
    full[:len(symbols)] = symbols
    return full.reshape(n, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))


def costs_by_block(pieces: list, last: list[int]):
    """For pieces of block codes, and the number of the vector after each: the number before each block and after the last (flat), where pieces begin, and the costs taken off.

    Pieces walk from their ends in lockstep, a lookup a block.
    """
    import numpy as np

    _, _, to, add = tables()
    sizes = np.array([len(p) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    codes = np.zeros(begin[-1], np.int64)
    for p, b in zip(pieces, begin):
        codes[b:b + len(p)] = p
    out, cost = np.zeros(begin[-1], np.int64), np.zeros(len(pieces), np.int64)
    out[begin[1:] - 1] = last
    order = np.argsort(-sizes, kind="stable")
    for back in range(1, int(sizes.max(initial=0)) + 1):
        live = order[:np.searchsorted(-sizes[order], -back, side="right")]
        at = begin[live + 1] - 1 - back
        cost[live] += add[out[at + 1], codes[at]]
        out[at] = to[out[at + 1], codes[at]]
    return out, begin, cost


@functools.lru_cache(200_000)
def traced(after: int, code: int, state: int) -> tuple[tuple[str, ...], int]:
    """Each row's edits (insertions in front of its own) of the ASCII-least cheapest way through a block, and the state after it.

    The block is expanded backward from the vector after it; then, as a state knows its only role, each edit leads to one state,
    and the least letter that keeps the cost least is the least string.
    """
    vectors = tables()[0]
    symbols = [code // SYMBOLS ** i % SYMBOLS for i in range(BLOCK - 1, -1, -1)]
    costs = [vectors[after]]
    for symbol in reversed(symbols):
        costs.append(costs_before(symbol, costs[-1]))
    costs.reverse()
    out = []
    for i, symbol in enumerate(symbols):
        edits = ""
        while True:
            ways = [(edit, to) for edit, cost, to in step(symbol, state) if cost + costs[i + 1][to] == costs[i][state]]
            if symbol != NONE and INSERT + costs[i][NEXT[state]] == costs[i][state]:
                ways.append(("I", NEXT[state]))
            edit, state = min(ways)
            edits += edit
            if edit != "I":
                break
        out.append(edits)
    return tuple(out), state


def rest(state: int) -> str:
    """Insertions after the last row."""
    return "I" * (LAST[state] // INSERT)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): the contract's damage by crc32 of ``conv_id:turn``; nulls of the row are one space, but the two ids stay null."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("times"))


KEY = ["conv_id", "turn", "tie_role", "tie_text"]


def in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times, tie_role, tie_text): equal rows of a turn as one, with their number.

    Order is by KEY, nulls first: a turn's rows by role and text, which are named only where there are several, so that texts needn't be sorted.
    """
    keyed = rows.withColumn("turn_key", F.xxhash64("conv_id", "turn"))
    several = written(keyed.groupBy(F.col("turn_key").alias("id")).count().where("count > 1").select("id"))
    none = F.lit(None).cast("string")
    alone = by_ids(keyed, several, "turn_key", keep=False).select("conv_id", "turn", "role", "text", "times", none.alias("tie_role"), none.alias("tie_text"))
    crowd = by_ids(keyed, several, "turn_key", keep=True).groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    return alone.unionByName(crowd.select("conv_id", "turn", "role", "text", "times", F.col("role").alias("tie_role"), F.col("text").alias("tie_text")))


def judged(rows: DataFrame) -> DataFrame:
    """``in_order`` rows plus initial, blank, duplicate, truncated (numbers of rows) and symbol."""
    ends = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.withColumns({"is_blank": ends == "", "said": F.concat(F.xxhash64("conv_id", "role", "text").cast("string"), F.lit(" "), F.xxhash64("text", F.lit(11), "role", "conv_id").cast("string"))})
    stamp = F.struct(F.col("turn").isNotNull().alias("late"), F.col("turn").alias("turn"))
    again = rows.where(~F.col("is_blank")).groupBy("said").agg(F.min(stamp).alias("first"), F.count("*").alias("n")).where("n > 1").select("said", "first")
    rows = by_key(rows.withColumn("stamp", stamp), written(again), "said", "turn", "left")
    seen = ~F.col("is_blank") & F.coalesce(F.col("first") < F.col("stamp"), F.lit(False))
    cut = ~F.col("is_blank") & ~seen & ~F.substring(ends, -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 2).when(initial == "a", 4).otherwise(6)
    return rows.select(*KEY, "role", "text", "times", initial.alias("initial"), F.when(F.col("is_blank"), F.col("times")).otherwise(0).alias("blank"), F.when(~F.col("is_blank"), F.col("times") - (~seen).cast("long")).otherwise(0).alias("duplicate"),
                       cut.cast("long").alias("truncated"), F.when(F.col("is_blank") | seen, GONE).otherwise(kind + cut.cast("int")).cast("int").alias("symbol"))


def pieces_of(rows: DataFrame) -> DataFrame:
    """(conv_id, piece, first: place and KEY of its first row, steps: (at, symbol, initial, times) in order, blank, duplicate, truncated): each conversation's rows in runs of at most PIECE_ROWS.

    Rows are sorted by ranges, so that a conversation of any size is dealt to many tasks; of texts only those of crowded turns move.
    """
    key = [F.asc_nulls_first(c) for c in KEY]
    counts = ["blank", "duplicate", "truncated"]
    placed = rows.select(*KEY, "symbol", "initial", "times", *counts).repartitionByRange(shuffle_partitions(rows.sparkSession), *key).sortWithinPartitions(*key)
    placed = placed.withColumn("at", F.monotonically_increasing_id()).withColumn("piece", F.floor(F.col("at") / PIECE_ROWS))
    return placed.groupBy("conv_id", "piece").agg(F.min(F.struct("at", *KEY[1:])).alias("first"), F.array_sort(F.collect_list(F.struct("at", "symbol", "initial", "times"))).alias("steps"), *[F.sum(c).alias(c) for c in counts])


def costs_of_pieces(pieces: DataFrame) -> DataFrame:
    """(conv_id, piece, costs: 4 x 4 by state after and state before the piece), of the table's ``steps``, by lookups."""
    def walk(batches):
        import pyarrow as pa

        vectors = tables()[0]
        for batch in batches:
            codes = [blocks_of([s["symbol"] for s in piece]) for piece in batch.column("steps").to_pylist()]
            ways = [costs_by_block(codes, [q] * len(codes)) for q in range(STATES)]
            costs = [[int(min(FAR, vectors[number[begin[i]]][q] + took[i])) for number, begin, took in ways for q in range(STATES)] for i in range(len(codes))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), pa.array(costs, pa.list_(pa.int64()))], names=["conv_id", "piece", "costs"])

    kind = pieces.schema["conv_id"].dataType.simpleString()
    return pieces.select("conv_id", "piece", "steps").mapInArrow(walk, f"conv_id {kind}, piece long, costs array<long>")


def trace(pieces: DataFrame, entries: list[int]) -> DataFrame:
    """``pieces`` with ``after``, the normalised cost vector behind each: in place of both, edits (a string per row) and out (state after), an array of each by state of ``entries`` before the piece."""
    kept = [c for c in pieces.columns if c != "after"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in kept)

    def walk(batches):
        import pyarrow as pa

        numbers = tables()[1]
        for batch in batches:
            symbols = [[s["symbol"] for s in piece] for piece in batch.column("steps").to_pylist()]
            codes = [blocks_of(x) for x in symbols]
            number, begin, _ = costs_by_block(codes, [numbers[tuple(a)] for a in batch.column("after").to_pylist()])
            edits, out = [], []
            for x, piece, b in zip(symbols, codes, begin):
                ways = []
                for q in entries:
                    own: list[str] = []
                    for j, code in enumerate(piece.tolist()):
                        way, q = traced(int(number[b + j + 1]), code, q)
                        own += way
                    ways.append((own[:len(x)], q))
                edits.append([w for w, _ in ways])
                out.append([q for _, q in ways])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(edits, pa.list_(pa.list_(pa.string()))), pa.array(out, pa.list_(pa.int32()))], names=[*kept, "edits", "out"])

    return pieces.mapInArrow(walk, f"{fields}, edits array<array<string>>, out array<int>")


def edited(pieces: DataFrame) -> DataFrame:
    """Written ``pieces`` plus edits array<string> (a string per row) and out (state after the piece).

    Most conversations are one piece, which is traced from its end. The pieces of a long one are first summed up as 4 x 4 costs;
    a fold over these few numbers gives the vector behind each piece, each is traced from all four states, and a second fold picks.
    """
    key = F.xxhash64("conv_id")
    many = written(pieces.groupBy(key.alias("id")).count().where("count > 1").select("id"))
    keyed = pieces.withColumn("conv_key", key)
    end = F.array(*map(F.lit, LAST))
    done = trace(by_ids(keyed, many, "conv_key", keep=False).drop("conv_key").withColumn("after", end), [0])
    one = done.withColumns({"edits": F.get("edits", F.lit(0)), "out": F.get("out", F.lit(0))})
    if many.limit(1).count() == 0:
        return one
    long = by_ids(keyed, many, "conv_key", keep=True).drop("conv_key")
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def behind(pdf):
        import pandas as pd

        pdf, after, out = pdf.sort_values("piece"), LAST, []
        for costs in reversed(pdf["costs"].tolist()):
            out.append(list(map(int, after)))
            after, _ = normal(tuple(min(FAR, *(int(costs[to * STATES + q]) + after[to] for to in range(STATES))) for q in range(STATES)))
        return pd.DataFrame({"conv": pdf["conv_id"], "number": pdf["piece"], "after": out[::-1]})

    def entered(pdf):
        import pandas as pd

        pdf, state, out = pdf.sort_values("piece"), 0, []
        for ends in pdf["out"]:
            out.append(state)
            state = int(ends[state])
        return pd.DataFrame({"conv": pdf["conv_id"], "number": pdf["piece"], "entry": out})

    same = F.col("conv").eqNullSafe(F.col("conv_id")) & (F.col("number") == F.col("piece"))
    after = written(costs_of_pieces(long).groupBy("conv_id").applyInPandas(behind, f"conv {kind}, number long, after array<int>"))
    ways = written(trace(long.join(after, same).drop("conv", "number"), list(range(STATES))))
    entry = written(ways.select("conv_id", "piece", "out").groupBy("conv_id").applyInPandas(entered, f"conv {kind}, number long, entry int"))
    picked = ways.join(entry, same).withColumns({"edits": F.get("edits", F.col("entry")), "out": F.get("out", F.col("entry"))})
    return one.unionByName(picked.select(one.columns))


def played(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """(conv_id, place long, role, text, edit): the repaired rows, each conversation's in order, within one partition.

    Rows and pieces are sorted together, a piece's edits in front of its first row, and played as they come:
    a task holds one piece's edits, however long a conversation is.
    """
    none = F.lit(None)
    tape = rows.select(*KEY, F.lit(1).alias("kind"), "role", "text", none.cast("array<string>").alias("edits"), none.cast("int").alias("out"))
    tape = tape.unionByName(pieces.select("conv_id", *[F.col("first")[c].alias(c) for c in KEY[1:]], F.lit(0).alias("kind"), none.cast("string").alias("role"), none.cast("string").alias("text"), "edits", "out"))
    tape = tape.repartition("conv_id").sortWithinPartitions("conv_id", *[F.asc_nulls_first(c) for c in KEY[1:]], "kind")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def play(batches):
        import pyarrow as pa

        conv, edits, state, out, place = None, None, 0, 0, 0

        def written_rows(letters, role, text):
            nonlocal state
            for letter in letters:
                if letter == "D":
                    continue
                name = NAMES[ROLE[state]] if letter != "K" else role
                state = 1 if letter == "K" and role[0] == "s" else NEXT[state]
                yield name, text if letter != "I" else "", letter

        for batch in batches:
            ids, names, texts, marks, places = [], [], [], [], []

            def put(letters, role="", text=""):
                nonlocal place
                for name, said, letter in written_rows(letters, role, text):
                    ids.append(conv)
                    names.append(name)
                    texts.append(said)
                    marks.append(letter)
                    places.append(place)
                    place += 1

            for r in batch.select(["conv_id", "kind", "role", "text", "edits", "out"]).to_pylist():
                if edits is None or r["conv_id"] != conv:
                    put(rest(out))
                    conv, state, out, place = r["conv_id"], 0, 0, 0
                if r["kind"] == 0:
                    edits, out = iter(r["edits"]), r["out"]
                else:
                    put(next(edits), r["role"], r["text"])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("conv_id").type), pa.array(places, pa.int64()), pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(marks, pa.string())],
                                             names=["conv_id", "place", "role", "text", "edit"])
            of = batch.schema.field("conv_id").type
        left = [(conv, place + i, NAMES[ROLE[q]], "", "I") for i, q in enumerate([state, NEXT[state]][:len(rest(out))])] if edits is not None else []
        if left:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in left], k) for i, k in enumerate((of, pa.int64(), pa.string(), pa.string(), pa.string()))], names=["conv_id", "place", "role", "text", "edit"])

    return tape.mapInArrow(play, f"conv_id {kind}, place long, role string, text string, edit string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports and repaired rows of (conv_id, turn, role, text, times), where ``times`` is how often a row stands there.

    Report: (conv_id, blank, duplicate, truncated, illegal, cost, audit), one row per conversation. Repaired: (conv_id, place, role, text, edit).
    A conversation's rows are in the order of their turns, nulls first; several of a turn by role, then text, equal ones together. A null
    conv_id is one more conversation. Costs, faults and ties are the contract's; an empty role, and one of another initial, is never kept.
    Other columns are ignored; text and role are not null.
    """
    rows = judged(in_order(turns))
    pieces = written(edited(written(pieces_of(rows))))
    kept = F.aggregate(F.zip_with("edits", "steps", lambda e, s: F.when((s["symbol"] < GONE) & (s["symbol"] % 2 == 1) & ~e.contains("D"), TRUNCATED).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    audit = F.array_join(F.zip_with("edits", "steps", lambda e, s: F.concat(e, F.repeat(F.lit("D"), (s["times"] - 1).cast("int")))), "")
    bad = lambda x, y: (~F.concat(x, y).isin("su", "ua", "au")).cast("long")
    steps = F.col("steps")
    inside = F.aggregate(F.zip_with(steps, F.slice(steps, F.lit(2), F.size(steps)), lambda x, y: x["times"] - 1 + F.when(y.isNull(), 0).otherwise(bad(x["initial"], y["initial"]))), F.lit(0).cast("long"), lambda a, x: a + x)
    one = pieces.select("conv_id", "blank", "duplicate", "truncated", inside.alias("illegal"), kept.alias("kept"),
                        F.struct("piece", audit.alias("audit"), "out", F.get(steps, F.lit(0))["initial"].alias("head"), F.element_at(steps, -1)["initial"].alias("tail")).alias("p"))
    sums = one.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "kept")], F.array_sort(F.collect_list("p")).alias("p"))
    between = F.aggregate(F.zip_with("p", F.slice("p", F.lit(2), F.size("p")), lambda x, y: F.when(y.isNull(), 0).otherwise(bad(x["tail"], y["head"]))), F.lit(0).cast("long"), lambda a, x: a + x)
    end = F.element_at("p", -1)["out"]
    sums = sums.withColumns({"illegal": F.col("illegal") + between, "audit": F.concat(F.array_join(F.transform("p", lambda x: x["audit"]), ""), F.when(end == 1, rest(1)).when(end == 2, rest(2)).otherwise(""))})
    number = lambda letter: F.length("audit") - F.length(F.replace("audit", F.lit(letter), F.lit("")))
    cost = F.col("kept") + DELETE * number("D") + INSERT * number("I") + REROLE * number("R")
    return sums.select("conv_id", "blank", "duplicate", "truncated", "illegal", cost.cast("long").alias("cost"), "audit"), played(rows, pieces)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``played`` rows as they come, each conversation's in order in one partition: a digest is fed row by row."""
    def feed(batches):
        import hashlib

        import pyarrow as pa

        conv, sha, out = None, None, []
        for batch in batches:
            for i, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if sha is None or i != conv:
                    if sha is not None:
                        out.append((conv, sha.hexdigest()))
                    conv, sha = i, hashlib.sha256(line)
                else:
                    sha.update(b"\n" + line)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], batch.schema.field("conv_id").type), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
            out, kind = [], batch.schema.field("conv_id").type
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return repaired.mapInArrow(feed, f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    report, repaired = repair(rows)
    turns = rows.where("turn is not null").select("conv_id", "turn").distinct().groupBy("conv_id")
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = turns.agg((wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("*")).cast("long").alias("gaps"))
    out = conversations.select("conv_id").distinct()
    for part in (report, gaps, digests(repaired)):
        part = part.withColumnRenamed("conv_id", "of")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


#: The same in DuckDB's SQL: a recursion from each conversation's last row to its first.
CONVERSATIONS_SQL = """with recursive said as (
  select conv_id, turn, coalesce(role::varchar, ' ') as role, coalesce(text::varchar, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
-- crc32, bit by bit
faults as (select * exclude (key), xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda ch: ascii(ch)::bigint)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295::bigint) % 20 as fault from said),
after_damage as (select conv_id, turn, case when fault = 4 then 'user' else role end as role, case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when fault = 3 then 2 else 1 end)) as copy from faults where fault <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, left(role, 1) as initial from after_damage),
judged as (select *, case when bare = '' then 'blank' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as kind,
    lag(initial) over (partition by conv_id order by n) as before from placed),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count_if(kind = 'blank')::bigint as blank, count_if(kind = 'duplicate')::bigint as duplicate,
    count_if(kind = 'truncated')::bigint as truncated, count_if(before || initial not in ('su', 'ua', 'au'))::bigint as illegal, max(n) as last from judged group by conv_id),
-- the cheapest way (cost, edits, lines) from each row to the end, by what has been written: nothing, s, an open u, a closed pair
ways(conv_id, n, v) as (
  select conv_id, last + 1, [{'c': 0::bigint, 'a': '', 'l': []::varchar[]}, {'c': 10::bigint, 'a': 'II', 'l': ['user:', 'assistant:']}, {'c': 5::bigint, 'a': 'I', 'l': ['assistant:']}, {'c': 0::bigint, 'a': '', 'l': []::varchar[]}] from counts
  union all
  select conv_id, n, list_transform(range(4), lambda q: list_min([own[q + 1],
      {'c': 5 + own[[3, 3, 4, 3][q + 1]].c, 'a': 'I' || own[[3, 3, 4, 3][q + 1]].a, 'l': list_prepend(name[q + 1] || ':', own[[3, 3, 4, 3][q + 1]].l)},
      {'c': 10 + own[[4, 4, 3, 4][q + 1]].c, 'a': 'II' || own[[4, 4, 3, 4][q + 1]].a, 'l': list_prepend(name[q + 1] || ':', list_prepend(name[[3, 3, 4, 3][q + 1]] || ':', own[[4, 4, 3, 4][q + 1]].l))}]))
  from (select j.conv_id, j.n, ['user', 'user', 'assistant', 'user'] as name, list_transform(range(4), lambda q: list_min([{'c': 2 + v[q + 1].c, 'a': 'D' || v[q + 1].a, 'l': v[q + 1].l},
        case when kind not in ('blank', 'duplicate') and initial = 's' and q = 0 then {'c': cut + v[2].c, 'a': 'K' || v[2].a, 'l': list_prepend(role || ':' || text, v[2].l)}
             when kind not in ('blank', 'duplicate') and initial = ['u', 'u', 'a', 'u'][q + 1] then {'c': cut + v[[3, 3, 4, 3][q + 1]].c, 'a': 'K' || v[[3, 3, 4, 3][q + 1]].a, 'l': list_prepend(role || ':' || text, v[[3, 3, 4, 3][q + 1]].l)} end,
        case when kind not in ('blank', 'duplicate') then {'c': 1 + cut + v[[3, 3, 4, 3][q + 1]].c, 'a': 'R' || v[[3, 3, 4, 3][q + 1]].a, 'l': list_prepend(['user', 'user', 'assistant', 'user'][q + 1] || ':' || text, v[[3, 3, 4, 3][q + 1]].l)} end])) as own
      from ways join (select *, case when kind = 'truncated' then 5 else 0 end as cut from judged) j on j.conv_id is not distinct from ways.conv_id and j.n = ways.n - 1)),
best as (select conv_id, v[1] as w from ways where n = 1)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(w.c, 0) as cost,
  coalesce(w.a, '') as audit, sha256(coalesce(array_to_string(w.l, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts on counts.conv_id is not distinct from o.conv_id left join best on best.conv_id is not distinct from o.conv_id"""
