"""Personal data: fixed patterns, and contextual patterns bootstrapped from their finds (operator 3).

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm.common import MAX_BROADCAST_IDS, read_table, written

KINDS = ("email", "ip", "card", "phone")

#: The contract's patterns for Java's matcher. A match can only begin at the left end of its run of characters
#: (or, for email, where the last match ended), so a look-behind skips the other places, and possessive
#: repeats, which never have to be given back here, take time in proportion to the text and no stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",  # shorter runs of digits are no cards
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can match at all.
MAYBE = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
}

#: Bootstrapping: rounds of scoring, the distinct known instances that a pattern needs, the confidence from which it is
#: trusted, the weight against a pattern of an unknown instance that has a form of the pattern's kind (others, and bare numbers, count fully), and
#: the digits (or, with an at sign or a bracket, characters) that an instance found needs.
ROUNDS, SUPPORT, TRUST, UNKNOWN, DIGITS = 3, 5, 0.8, 0.2, 6
#: Dates and numbers with separated thousands, which are no phones.
ORDINARY = r"^(?:(?:19|20)[0-9]{2}([./-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\2(?:19|20)?[0-9]{2}|[0-9]{1,3}(?:[.\x20][0-9]{3})+)$"
#: What of a pattern stands before this is its words.
CLASS = "\u0001"
#: An instance: groups of digits joined by single signs or spaces, or a run without white space; it holds a digit, an at sign or a bracket between letters.
INSTANCE = (r"(?<!\S)(?:[+(]*+[0-9][0-9().+/-]*+(?:\x20\(?[0-9][0-9().+/-]*+)*+(?=[\s,;:!?\"'\u201d\u2019\u00bb\]]|$)"
            r"|(?=[^\s0-9@(\[{]*+(?:[0-9@]|(?<=\p{L})[(\[{]\p{L}))\S++)")
HOLDS = r"[0-9@]|\p{L}[(\[{]\p{L}"
#: What is no part of an instance or a context word at its ends (a colon or an equals sign after a word belongs to it).
AROUND = ".,;!?\"'`[]{}<>|/\\*&%~^_\u2013\u2014\u2026\u201c\u201d\u201e\u2018\u2019\u00ab\u00bb\u00bf\u00a1"
#: Context words are the last and first words of so many characters beside an instance, on its line.
REACH = 64
#: Function words, which are no context by themselves.
FUNCTION_WORDS = (
    "a an and are as at be but by for from has he her his in is it its not of on or our she so that the their they this to was we were will with you your "
    "aber als am an auf aus bei das dass dem den der des die ein eine einem einen einer er es f\u00fcr ich im in ist mit nach nicht oder sie sind so und von war wie wir zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas pour que qui sa se ses son sont sur un une vous "
    "al como con de del el ella en es esta este la las lo los m\u00e1s mi no o para pero por que se si sin sobre son su sus un una y").split()

SPAN = "array<struct<kind: string, start: bigint, end: bigint>>"
NO_SPANS = f"cast(array() as {SPAN})"
#: Elements of an array that are taken together, so that work stays in proportion to its length.
BLOCK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks_of(values: Column) -> Column:
    """An array's elements in arrays of BLOCK (one empty array for none)."""
    last = F.greatest(F.ceil(F.size(values) / BLOCK).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """An array<bigint>'s running results of an operation that may be grouped at will and for which 0 changes nothing."""
    zero = F.lit(0).cast("long")

    def starts(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, op))
        return F.aggregate(totals, F.array(zero), lambda acc, t: F.concat(acc, F.array(op(F.element_at(acc, -1), t))))

    def within(block: Column, first: Column) -> Column:
        none = F.struct(first.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], x))).alias("out"))
        return F.aggregate(block, none, step, lambda acc: acc["out"])

    return let(blocks_of(values), lambda b: let(starts(b), lambda s: F.flatten(F.zip_with(b, F.slice(s, F.lit(1), F.size(b)), within))))


def located(text: Column, pattern: str, beside: Callable[[Column, Column], Column] | None = None) -> Column:
    """Array of (m, start, end) of a pattern's leftmost non-overlapping matches, in code points, in time linear in them.

    The text's parts between the matches, together with the matches, give the places. ``beside`` adds what it makes
    of the parts before and after a match.
    """
    length = lambda x: F.coalesce(F.length(x), F.lit(0)).cast("long")

    def places(p: Column) -> Column:
        ends = running(F.zip_with(p["gaps"], p["found"], lambda g, m: length(g) + length(m)), lambda a, x: a + x)
        at = F.zip_with(p["found"], F.slice(ends, F.lit(1), F.size(p["found"])), lambda m, e: F.struct(m.alias("m"), (e - F.length(m)).alias("start"), e.alias("end")))
        if beside is None:
            return at
        n = F.size(p["found"])
        sides = F.zip_with(F.slice(p["gaps"], F.lit(1), n), F.slice(p["gaps"], F.lit(2), n), beside)
        return F.zip_with(at, sides, lambda a, s: F.struct(a["m"].alias("m"), a["start"].alias("start"), a["end"].alias("end"), s.alias("beside")))

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), places)


def luhn(digits: Column) -> Column:
    """Whether the digits' sum, every second from the right doubled (less 9 if over 9), divides by 10."""
    back = F.split(F.reverse(digits), "")
    doubled = F.transform(F.filter(back, lambda d: d != ""), lambda d, i: F.when(
        i % 2 == 1, (2 * d.cast("int")) - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, m: Column) -> Column:
    """Whether a match of the kind's pattern is one of the kind."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def spans_of(kind: str, text: Column) -> Column:
    """SPAN of one kind, by start."""
    valid = F.filter(located(text, PATTERNS[kind]), lambda x: holds(kind, x["m"]))
    spans = F.transform(valid, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return F.when(MAYBE[kind](text), spans).otherwise(F.expr(NO_SPANS))


def base_spans(text: Column) -> Column:
    """SPAN of all kinds, by kind and start."""
    return F.concat(*[spans_of(kind, text) for kind in KINDS])


def in_order(spans: Column) -> Column:
    """Spans by start, then by kind as listed."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def merged(spans: Column) -> Column:
    """Spans in order with those that overlap as one, under the first's kind."""

    def groups(z: Column) -> Column:
        heads = F.filter(z, lambda s, i: F.coalesce(F.get(z, i - 1)["reach"] <= s["start"], F.lit(True)))
        tails = F.filter(z, lambda s, i: F.coalesce(F.get(z, i + 1)["start"] >= s["reach"], F.lit(True)))
        return F.zip_with(heads, tails, lambda h, t: F.struct(h["kind"].alias("kind"), h["start"].alias("start"), t["reach"].alias("end")))

    def reached(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
        return F.zip_with(s, reach, lambda x, r: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), r.alias("reach")))

    return let(spans, lambda s: let(reached(s), groups))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each of its (merged) spans as its kind in angle brackets; a block's spans are cut from the block's part of the text."""

    def pieces(blocks: Column) -> Column:
        def of(block: Column, b: Column) -> Column:
            first = F.coalesce(F.element_at(F.get(blocks, b - 1), -1)["end"], F.lit(0).cast("long"))
            part = F.substring(text, (first + 1).cast("int"), (F.element_at(block, -1)["end"] - first).cast("int"))
            cut = lambda p: F.transform(block, lambda s, i: F.concat(
                let(F.coalesce(F.get(block, i - 1)["end"], p["first"]), lambda before: F.substring(p["part"], (before - p["first"] + 1).cast("int"), (s["start"] - before).cast("int"))),
                F.lit("<"), F.upper(s["kind"]), F.lit(">")))
            return let(F.struct(first.alias("first"), part.alias("part")), cut)

        return F.flatten(F.transform(blocks, of))

    tail = lambda s: F.substring(text, (F.element_at(s, -1)["end"] + 1).cast("int"), F.length(text))
    return let(spans, lambda s: F.concat(F.array_join(let(blocks_of(s), pieces), ""), tail(s)))


def context(before: Column, after: Column) -> Column:
    """(l2, l1, r1): the two words before and the word after an instance on its line, in lower case; empty where there is none."""
    def words(part: Column) -> Column:
        clean = F.transform(F.split(F.lower(part), r"\s+", -1), lambda w: F.btrim(w, F.lit(AROUND + "()")))
        return F.filter(clean, lambda w: w != "")

    word = lambda w, i: F.coalesce(F.get(w, F.size(w) + i if i < 0 else F.lit(i)), F.lit(""))
    left = F.substring(F.substring_index(before, "\n", -1), -REACH, REACH)
    right = F.substring(F.substring_index(after, "\n", 1), 1, REACH)
    return let(words(left), lambda l: F.struct(word(l, -2).alias("l2"), word(l, -1).alias("l1"), word(words(right), 0).alias("r1")))


def instances_in(text: Column) -> Column:
    """Array of (token, start, end, l2, l1, r1) of a text's instances, without the signs around them."""

    def bare(x: Column) -> Column:
        def trim(t: Column) -> Column:
            t = let(F.rtrim(F.ltrim(t, F.lit(AROUND + ":=#-)")), F.lit(AROUND + ":=#-+(")), lambda m: F.when(m.contains("(") & ~m.contains(")"), F.ltrim(m, F.lit("("))).when(m.contains(")") & ~m.contains("("), F.rtrim(m, F.lit(")"))).otherwise(m))
            return F.when(t.rlike(r"^\([^()]*\)$"), F.btrim(t, F.lit("()"))).otherwise(t)

        def place(t: Column) -> Column:
            # what is cut in front is found again by the token's first place in the match
            start = x["start"] + F.instr(x["m"], t).cast("long") - 1
            return F.struct(t.alias("token"), start.alias("start"), (start + F.length(t)).alias("end"), x["beside"]["l2"].alias("l2"), x["beside"]["l1"].alias("l1"), x["beside"]["r1"].alias("r1"))

        return let(trim(x["m"]), place)

    found = F.filter(F.transform(located(text, INSTANCE, context), bare), lambda x: x["token"] != "")
    none = F.expr("cast(array() as array<struct<token: string, start: bigint, end: bigint, l2: string, l1: string, r1: string>>)")
    return F.when(text.rlike(HOLDS), found).otherwise(none)


def known_instances(facts: DataFrame) -> DataFrame:
    """(doc_id, row_key, start, end, token long, kind, fits, bare, patterns): every instance of the texts, once.

    kind is that of a base span which overlaps it, else null; ``fits`` are the kinds as which context may find it,
    ``bare`` tells a plain run of digits.
    Spans and instances of a text are put in one order, in which windows carry the spans' ends forwards and starts backwards.
    """
    key = ["doc_id", "row_key"]
    spans = facts.select(*key, F.explode("base").alias("s")).select(*key, "s.start", "s.end", "s.kind", *[F.lit(None).cast("string").alias(c) for c in ("token", "l2", "l1", "r1")])
    found = facts.select(*key, F.explode("instances").alias("s")).select(*key, "s.start", "s.end", F.lit(None).cast("string").alias("kind"), "s.token", "s.l2", "s.l1", "s.r1")
    both = spans.unionByName(found).dropDuplicates([*key, "start", "end", "kind"])
    is_found = F.col("token").isNotNull()
    ahead = W.partitionBy(*key).orderBy("start", is_found.cast("int")).rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy(*key).orderBy(F.desc("start"), F.col("kind").isNull().cast("int")).rowsBetween(W.unboundedPreceding, 0)
    # a place and a kind in one number
    with_kind = lambda c: F.when(~is_found, F.col(c) * 8 + F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    both = both.withColumns({"left": F.max(with_kind("end")).over(ahead), "right": F.last(with_kind("start"), ignorenulls=True).over(back)}).where(is_found)
    touching = F.when(F.floor(F.col("left") / 8) > F.col("start"), F.col("left")).when(F.floor(F.col("right") / 8) < F.col("end"), F.col("right"))
    kind = F.get(F.array(*map(F.lit, KINDS)), (touching % 8 - 1).cast("int"))
    digits = F.length(F.regexp_replace("token", "[^0-9]", ""))
    return both.select(*key, "start", "end", F.xxhash64(F.lower("token")).alias("token"), kind.alias("kind"), fitting(F.col("token"), digits).alias("fits"), F.col("token").rlike("^[0-9]+$").alias("bare"), patterns_of(digits).alias("patterns"))


def fitting(token: Column, digits: Column) -> Column:
    """The kinds that an instance can be by its form: with letters around an at sign or a bracket an email, in four groups of digits (or groups
    of hexadecimal ones between colons) an ip, else by the number of its digits a card or a phone."""
    mail = token.rlike(r"@|[\p{L}0-9][(\[{]\p{L}") & (F.length(token) >= DIGITS)
    ip = token.rlike(r"^[0-9]{1,5}(?:[.:][0-9]{1,5}){3}$|^[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}$") & (digits >= DIGITS)
    card = token.rlike(r"^[0-9][0-9\x20.-]*$") & digits.between(12, 19)
    phone = token.rlike(r"^[+(0-9][0-9().+/\x20-]*$") & digits.between(7, 15) & ~ip & ~token.rlike(ORDINARY)
    return F.array_compact(F.array(*[F.when(ok, kind) for kind, ok in (("email", mail), ("ip", ip), ("card", card), ("phone", phone))]))


def patterns_of(digits: Column) -> Column:
    """An instance's lexical patterns: words around it, with its coarse class (signs, and few, some or many digits), its exact shape, or neither.

    The words are the one before, the two before, or those on both sides; function words are no context by themselves, nor is a word that follows.
    """
    l2, l1, r1, token = F.col("l2"), F.col("l1"), F.col("r1"), F.col("token")
    size = F.when(digits < DIGITS, "few").when(digits < 20, "some").otherwise("many")
    coarse = F.when(token.contains("@"), "@").when(token.rlike(r"\p{L}"), F.concat(F.lit("a "), size)).otherwise(size)
    shape = F.when(F.length(token) <= REACH, F.regexp_replace(F.regexp_replace(token, "[0-9]", "9"), r"\p{L}+", "a")).otherwise(coarse)
    plain = lambda w: (w != "") & ~w.isin(FUNCTION_WORDS)
    there = [(plain(l1), F.concat(l1, F.lit(" _"))), ((l2 != "") & (l1 != "") & (plain(l2) | plain(l1)), F.concat(l2, F.lit(" "), l1, F.lit(" _"))),
             ((l1 != "") & (r1 != "") & (plain(l1) | plain(r1)), F.concat(l1, F.lit(" _ "), r1))]
    return F.array_compact(F.array(*[F.when(ok, F.concat(words, F.lit(CLASS), what)) for ok, words in there for what in (coarse, F.concat(F.lit("="), shape), F.lit("*"))]))


def small(rows: DataFrame) -> DataFrame:
    """Written rows (a few dozen bytes each), broadcast while they are few."""
    most = MAX_BROADCAST_IDS // 10
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def some(rows: DataFrame) -> bool:
    return rows.limit(1).count() > 0


def bootstrap(found: DataFrame) -> DataFrame | None:
    """Trusted patterns (pattern, kind, score), from the graph of patterns and the instances they occur with; None if there are none.

    Seeds are instances that the fixed patterns know, at score 1. In each round a pattern's confidence in a kind is
    its instances' score for the kind over the number of all its instances (and 1 as a prior), so one that is not known speaks against it: fully,
    or as UNKNOWN if it has a form of the kind and is no bare number; a pattern of SUPPORT known instances and confidence TRUST is trusted. Instances of trusted patterns
    that fit the kind become known at the best confidence, and support further patterns in the next round, but never one of the same
    words: for that the best of other words counts, so no pattern confirms itself. Counts are of distinct
    instances: copies of a text add nothing. Sums are combined before their shuffles, so that a pattern which a third of all
    instances share costs a row a task.
    """
    edges = written(found.select("token", "fits", "bare", F.explode("patterns").alias("pattern")).distinct())
    soft = {kind: ~F.col("bare") & F.array_contains("fits", kind) for kind in KINDS}
    sizes = written(edges.groupBy("pattern").agg(F.count("*").alias("n"), *[F.count_if(soft[kind]).alias(f"soft_{kind}") for kind in KINDS]).where(F.col("n") >= SUPPORT))
    edges = written(edges.join(small(sizes.select("pattern")), "pattern", "left_semi").withColumn("words", F.substring_index("pattern", CLASS, 1)))
    seeds = written(found.where("kind is not null").groupBy("token").agg(F.min("kind").alias("kind")))
    known = seeds.select("token", F.struct("kind", F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("words")).alias("k1"), F.lit(None).cast("struct<kind: string, score: double, words: string>").alias("k2"))
    first, trusted = known, None
    for _ in range(ROUNDS):
        says = F.when(F.col("k1.words") == F.col("words"), F.col("k2")).otherwise(F.col("k1"))
        of = lambda kind: F.coalesce(F.sum(F.when(F.col("k.kind") == kind, F.col("k.score"))), F.lit(0.0))
        sums = edges.join(known, "token").withColumn("k", says).where("k is not null").groupBy("pattern").agg(F.count("*").alias("known"), *[of(kind).alias(kind) for kind in KINDS], *[F.count_if(soft[kind]).alias(f"known_{kind}") for kind in KINDS])
        sums = sums.where(F.col("known") >= SUPPORT).join(sizes, "pattern")
        against = lambda kind: F.col("n") + 1 - (1 - UNKNOWN) * (F.col(f"soft_{kind}") - F.col(f"known_{kind}"))
        best = F.greatest(*[F.struct(F.col(kind).alias("sum"), F.lit(kind).alias("kind"), (F.col(kind) / against(kind)).alias("score")) for kind in KINDS])
        trusted = written(sums.select("pattern", best.alias("b")).select("pattern", "b.kind", "b.score").where(F.col("score") >= TRUST))
        if not some(trusted):
            return None
        more = edges.join(small(trusted), "pattern").where(F.array_contains("fits", F.col("kind"))).groupBy("token", "words").agg(F.max(F.struct("score", "kind")).alias("best"))
        more = more.join(seeds.select("token"), "token", "left_anti")
        place = F.row_number().over(W.partitionBy("token").orderBy(F.desc("best.score"), F.desc("best.kind"), "words"))
        more = more.withColumn("place", place).where("place <= 2").withColumn("k", F.struct(F.col("best.kind").alias("kind"), F.col("best.score").alias("score"), "words"))
        more = written(more.groupBy("token").agg(*[F.max(F.when(F.col("place") == i, F.col("k"))).alias(f"k{i}") for i in (1, 2)]))
        if not some(more):
            break
        known = first.unionByName(more)
    return trusted


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, base, spans), one row per document, of its whole text.

    base: the fixed patterns' spans. spans: these, and whole instances that overlap none of them, stand in the context of a
    trusted pattern and fit its kind by their form (``fitting``), under this kind. An instance holds a digit, an at sign or a bracket between letters; words
    of letters alone fit no kind, and years, prices and numbers of fewer than six digits stay. Offsets are code points, ends exclusive; both lists are
    ordered by start, then kind. Null and empty texts have no spans. Null ids and repeated rows are fine: equal
    (id, text) rows get equal results. Of kinds that a pattern serves equally well the last in the alphabet is taken.
    Other columns are ignored. Time is linear in a text's length and matches.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), in_order(base_spans(text)).alias("base"), instances_in(text).alias("instances"))
    facts = written(facts)
    found = written(known_instances(facts))
    trusted = bootstrap(found)
    if trusted is None:
        return facts.select("doc_id", "row_key", "base", F.col("base").alias("spans"))
    # a text's instances stay together, so their rows are joined to the texts once, not each by itself
    at = found.where("kind is null and size(fits) > 0").select("doc_id", "row_key", "start", "end", "fits", F.explode("patterns").alias("pattern")).join(small(trusted), "pattern").where(F.array_contains("fits", F.col("kind")))
    at = at.groupBy("doc_id", "row_key", "start", "end").agg(F.max(F.struct("score", "kind")).alias("best"))
    extra = written(at.groupBy(F.col("doc_id").alias("x_id"), F.col("row_key").alias("x_key")).agg(F.collect_list(F.struct(F.col("best.kind").alias("kind"), "start", "end")).alias("extra")))
    same = F.col("doc_id").eqNullSafe(F.col("x_id")) & (F.col("row_key") == F.col("x_key"))
    out = facts.select("doc_id", "row_key", "base").join(few_spans(extra, "extra"), same, "left")
    return out.select("doc_id", "row_key", "base", F.when(F.col("extra").isNull(), F.col("base")).otherwise(in_order(F.concat("base", "extra"))).alias("spans"))


def few_spans(rows: DataFrame, column: str) -> DataFrame:
    """Written rows with an array of spans (about 40 bytes each), broadcast while rows and spans together are few."""
    most = MAX_BROADCAST_IDS // 5
    n = rows.agg(F.coalesce(F.sum(F.size(column) + 1), F.lit(0)).alias("n")).first().n
    return F.broadcast(rows) if n <= most else rows


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets, and n_chars set anew if there.

    Spans that overlap are one, under the first's kind. Texts without spans stay as they are, null included.
    """
    found = find_pii(docs)
    names = ("_pii_id", "_pii_key", "_pii_spans", "_pii_row")
    docs = docs.drop(*names)
    few_texts = written(found.where(F.size("spans") > 0).select(F.col("doc_id").alias("_pii_id"), F.col("row_key").alias("_pii_key"), merged(F.col("spans")).alias("_pii_spans")).dropDuplicates(["_pii_id", "_pii_key"]))
    keyed = docs.withColumn("_pii_row", F.xxhash64(F.col("doc_id"), F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("_pii_id")) & (F.col("_pii_row") == F.col("_pii_key"))
    whole = keyed.join(few_spans(few_texts, "_pii_spans"), same, "left")
    spans = F.col("_pii_spans")
    out = whole.withColumn("text", F.when(spans.isNull(), F.col("text")).otherwise(replaced(F.col("text"), spans)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(spans.isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(docs.columns)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
