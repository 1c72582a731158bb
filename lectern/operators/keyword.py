"""Keyword index and search: postings, query analysis, informative terms, ranked matches, phrases, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions.stemming import porter_stem
from lectern.functions.text import lead_excerpt
from lectern.operators.joins import few, written

CANDIDATES = 60
MAX_TERM_SHARE, LEAST_CAP = 0.04, 25

#: Words of a request rather than its subject, and common English function words.
REQUEST_WORDS = (
    "book books author authors say says said discuss discusses discussed discussion passage passages find show where what which how why when does do did text texts "
    "library mention mentions mentioned talk talks write writes wrote writing idea ideas concept concepts view views think thinks compare comparison describe describes "
    "these those about regarding explain explains meaning mean means quote quotes chapter chapters page pages please tell give list").split()
STOP_WORDS = (
    "a an and are as at be been but by for from had has have he her him his i if in into is it its me my no not of on or our she so than that the their them then there they "
    "this to was we were will with you your").split()


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def build_postings(chunks: DataFrame, analyzer: str = "simple", id_cols: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """(chunk_id, lexeme, pos) without stop words; positions count all tokens from 0.

    "english" stems each word of the distinct vocabulary once and joins the stems back.
    """
    rows = chunks.select(*id_cols, F.posexplode(tokens(F.col("text"))).alias("pos", "lexeme")).where(~F.col("lexeme").isin(STOP_WORDS))
    return rows.select(*id_cols, "lexeme", "pos") if analyzer == "simple" else stemmed(rows, id_cols)


def stemmed(rows: DataFrame, id_cols: tuple[str, ...]) -> DataFrame:
    stems = rows.select("lexeme").distinct().select("lexeme", porter_stem("lexeme").alias("stem"))
    return rows.join(stems, "lexeme").select(*id_cols, F.col("stem").alias("lexeme"), "pos")


def keyword_queries(queries: DataFrame) -> DataFrame:
    """(query_id, text, mode): phrase searches as they are ("web"), else the salient words ("or"); others null."""
    web = F.col("query").rlike('"[^"]+"')
    words = F.split(F.regexp_replace(F.lower("query"), r"[^\p{L}\p{N}'\s-]", " "), r"\s+")
    words = F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^['-]+|['-]+$", "")), lambda w: (F.length(w) > 1) & ~w.isin(REQUEST_WORDS))
    text = F.when(web, F.col("query")).when(F.size(words) > 0, F.array_join(words, " "))
    return queries.select("query_id", text.alias("text"), F.when(web, "web").when(F.size(words) > 0, "or").alias("mode"))


def query_terms(keywords: DataFrame, analyzer: str = "simple") -> DataFrame:
    """Distinct (query_id, lexeme) of the "or" queries, analysed like passages."""
    rows = build_postings(keywords.where("mode = 'or'"), analyzer, ("query_id",))
    return rows.select("query_id", "lexeme").distinct()


def matches_of(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(chunk_id, lexeme, n): how often each passage holds each of the terms' words, a passage's rows together. What follows may take it for postings, which are met once then."""
    cut = postings.join(few(written(terms.select("lexeme").distinct())), "lexeme", "left_semi")
    return cut.repartition("chunk_id").groupBy("chunk_id", "lexeme").agg(F.count("*").alias("n"))


def informative_terms(terms: DataFrame, postings: DataFrame, n_chunks: DataFrame) -> DataFrame:
    """Terms that some passages hold but not over max(25, 4 %) of all; frequencies are of the whole corpus.

    ``n_chunks`` is one row (n). Postings (or matches_of them) are cut to the queries' words before they are counted.
    """
    asked = terms.select("lexeme").distinct()
    held = postings.join(asked, "lexeme", "left_semi").select("chunk_id", "lexeme")
    df = (held if "n" in postings.columns else held.distinct()).groupBy("lexeme").agg(F.count("*").alias("df"))
    cap = n_chunks.select(F.greatest(F.lit(LEAST_CAP), F.ceil(F.col("n") * MAX_TERM_SHARE)).alias("cap"))
    return terms.join(df.join(F.broadcast(cap)).where("df <= cap").select("lexeme", "df"), "lexeme").select("query_id", "lexeme", "df")


def top_k(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def keyword_hits(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, chunk_id, hits): matching places. Postings (or matches_of them) are cut to the terms and gathered by passage before queries multiply them, so that pairs of query and passage stay where they are counted."""
    asked = written(terms.select("query_id", "lexeme"))
    cut = postings.join(few(written(asked.select("lexeme").distinct())), "lexeme", "left_semi").repartition("chunk_id")
    return cut.join(few(asked), "lexeme").groupBy("query_id", "chunk_id").agg((F.sum("n") if "n" in postings.columns else F.count("*")).alias("hits"))


def keyword_topk(terms: DataFrame, postings: DataFrame, k: int = CANDIDATES, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, hits, score, rank): passages with any of a query's terms, most matching places first.

    Each matching place is a cover of its own for a query of alternatives, so the score n / (n + 1) orders like cover density.
    """
    n = keyword_hits(terms, postings)
    if scope is not None:
        n = n.join(scope.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    return top_k(n, k, F.desc("hits"), F.asc("chunk_id")).withColumn("score", F.col("hits") / (F.col("hits") + 1))


def phrase_parts(queries: DataFrame) -> DataFrame:
    """(query_id, alt, part, negated, words): phrases and words of web-style queries; ``or`` begins an alternative."""
    quoted = F.transform(F.split("text", '"'), lambda s, i: F.when(i % 2 == 1, F.array(F.concat(F.lit('"'), s))).otherwise(F.filter(F.split(F.lower(F.trim(s)), r"\s+"), lambda w: w != "")))
    rows = queries.where("mode = 'web'").select("query_id", F.posexplode(F.flatten(quoted)).alias("i", "item"))
    rows = rows.withColumn("alt", F.sum(F.when(F.col("item") == "or", 1).otherwise(0)).over(W.partitionBy("query_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0))).where("item <> 'or' and item <> '-'")
    lead = F.lag("item").over(W.partitionBy("query_id").orderBy("i"))
    words = F.filter(tokens(F.col("item")), lambda w: ~w.isin(STOP_WORDS))
    return rows.select("query_id", "alt", F.col("i").alias("part"), (F.col("item").startswith("-") | F.coalesce(lead == "-", F.lit(False))).alias("negated"), words.alias("words")).where(F.size("words") > 0)


def matching_places(keywords: DataFrame, postings: DataFrame, scope: DataFrame | None, owners: DataFrame | None = None) -> DataFrame:
    """(query_id, alt, chunk_id, part, start, size): where each part's words stand in order and adjacent, in the passages that hold every part of an alternative and no negated one.

    Postings are cut to the words asked for and gathered by passage, once. An alternative is entered at the rarest word of all its parts, and places leave a passage only
    if it holds all words of these parts and no negated word; frequencies are those of the postings. ``scope`` is (query_id, chunk_id), or (query_id, document_id) with the ``owners`` (chunk_id, document_id).
    """
    by = ["query_id", "alt"]
    words = written(phrase_parts(keywords).select(*by, "part", "negated", F.size("words").alias("size"), F.posexplode("words").alias("off", "lexeme")))
    ids = few(written(words.select("lexeme").distinct().withColumn("w", F.monotonically_increasing_id())))
    asked = postings.join(ids, "lexeme").select("chunk_id", "w", "pos")
    counts = written(asked.groupBy("w").agg(F.count("*").alias("n")))
    words = written(words.join(ids, "lexeme").drop("lexeme"))
    ranked = words.join(few(counts), "w", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wanted, barred = ~F.col("negated"), F.col("negated") & (F.col("size") == 1)
    # an alternative with a word that is nowhere has no place; a negated word alone bars a passage
    wants = ranked.groupBy(*by).agg(F.sort_array(F.collect_set(F.when(wanted, F.struct("n", "w")))).alias("needs"), F.collect_set(F.when(barred, F.col("w"))).alias("bars"),
                                    F.collect_set("w").alias("all"), F.count_distinct(F.when(wanted, F.col("part"))).alias("need"))
    turn = lambda i: F.get("needs.w", F.least(F.lit(i), F.size("needs") - 1))
    wants = written(wants.where(F.get("needs.n", F.lit(0)) > 0).select(*by, turn(0).alias("entry"), turn(1).alias("second"), turn(2).alias("third"), F.col("needs.w").alias("needs"), "bars", "all", "need"))
    passages = asked.groupBy("chunk_id").agg(F.collect_list(F.struct("w", "pos")).alias("at")).select("chunk_id", F.col("at.w").alias("ws"), F.col("at.pos").alias("ps"), F.array_distinct("at.w").alias("held"))
    met = passages.select("*", F.explode("held").alias("entry")).join(few(wants), "entry")
    # the rarest words first, as they leave little
    met = met.where(F.array_contains("held", F.col("second")) & F.array_contains("held", F.col("third")) & (F.size(F.array_except("needs", "held")) == 0) & ~F.arrays_overlap("bars", "held"))
    met = met.select(*by, "need", "chunk_id", F.filter(F.arrays_zip(F.col("ws").alias("w"), F.col("ps").alias("pos")), lambda x: F.array_contains("all", x["w"])).alias("at"))
    if scope is not None:
        within = "chunk_id" if owners is None else "document_id"
        met = met if owners is None else met.join(owners.select("chunk_id", "document_id"), "chunk_id")
        met = met.join(scope.select("query_id", within), ["query_id", within], "left_semi")
    # none is empty; an outer one infers no filter that would go before the words'
    places = met.select(*by, "need", "chunk_id", F.inline_outer("at")).join(few(words), [*by, "w"])
    places = places.groupBy(*by, "need", "chunk_id", "part", "negated", "size", (F.col("pos") - F.col("off")).alias("start")).agg(F.count("*").alias("have")).where("have = size")
    # one row for each alternative and passage, as a passage is bounded
    found = places.groupBy(*by, "need", "chunk_id").agg(F.collect_list(F.struct("part", "negated", "start", "size")).alias("x"))
    good = found.where(~F.exists("x", lambda x: x["negated"]) & (F.size(F.array_distinct("x.part")) == F.col("need")))
    return good.select(*by, "chunk_id", F.inline("x")).select(*by, "chunk_id", "part", "start", "size")


def phrase_topk(keywords: DataFrame, postings: DataFrame, k: int = CANDIDATES, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, hits, rank): every phrase in order and adjacent, every word, none of the negated ones; alternatives by ``or``.

    Of the passages in scope (query_id, chunk_id), if there is one. Passages with most places of an alternative's parts come first.
    """
    n = matching_places(keywords, postings, scope).groupBy("query_id", "alt", "chunk_id").agg(F.count("*").alias("hits"))
    return top_k(n.groupBy("query_id", "chunk_id").agg(F.max("hits").alias("hits")), k, F.desc("hits"), F.asc("chunk_id"))


def covers(places: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(begin, end, noise) of the minimal covers of places (start, part, size), sorted: stretches that hold each part and no shorter one that does.

    One sweep over the points where places start: each may end a cover, which begins at the least of the parts' latest starts; of covers with one beginning the first
    counts. noise is the number of words in the cover that its own places don't take.
    """
    n = len({part for _, part, _ in places})
    latest: dict[int, tuple[int, int]] = {}
    out: list[tuple[int, int, int]] = []
    for i, (start, part, size) in enumerate(places):
        latest[part] = start, size
        if len(latest) == n and (i + 1 == len(places) or places[i + 1][0] > start):
            begin = min(latest.values())[0]
            if not out or begin > out[-1][0]:
                end = max(s + z for s, z in latest.values())
                out.append((begin, end, max(0, end - begin - sum(z for _, z in latest.values()))))
    return out


def cover_topk(keywords: DataFrame, postings: DataFrame, k: int = CANDIDATES, scope: DataFrame | None = None, owners: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, covers, score, rank): as phrase_topk, ranked by cover density.

    A minimal cover of an alternative's phrases and words counts 1 / (1 + its words that are no match), so tight ones count most; a passage's
    density is the sum over the covers of its best alternative, and score is density / (1 + density). For a query of one
    part each place is a cover of its own. Places of a passage are swept together: a passage is bounded, a query's passages are not.
    """
    by = ["query_id", "alt", "chunk_id"]
    rows = matching_places(keywords, postings, scope, owners).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("start", "part", "size"))).alias("places"))

    def sweep(batches):
        import pyarrow as pa

        for batch in batches:
            found = [covers([(p["start"], p["part"], p["size"]) for p in places]) for places in batch.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("chunk_id"), pa.array([len(x) for x in found], pa.int64()), pa.array([sum(1 / (1 + noise) for _, _, noise in x) for x in found], pa.float64())],
                                             names=["query_id", "chunk_id", "covers", "density"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    swept = rows.mapInArrow(sweep, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, covers long, density double")
    # sums of fractions come in the order of the places, so equal passages have equal densities; noise of the last digits must not rank
    best = swept.groupBy("query_id", "chunk_id").agg(F.max(F.struct(F.round("density", 9).alias("density"), "covers")).alias("b"))
    return top_k(best.select("query_id", "chunk_id", "b.covers", (F.col("b.density") / (1 + F.col("b.density"))).alias("score")), k, F.desc("score"), F.asc("chunk_id"))


def term_coverage(candidates: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, chunk_id, coverage): the share of a query's informative terms that each candidate holds."""
    total = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    wanted = candidates.select("query_id", "chunk_id").join(terms.select("query_id", "lexeme"), "query_id")
    have = wanted.join(postings.select("chunk_id", "lexeme").distinct(), ["chunk_id", "lexeme"]).groupBy("query_id", "chunk_id").agg(F.count("*").alias("have"))
    out = candidates.select("query_id", "chunk_id").join(total, "query_id", "left").join(have, ["query_id", "chunk_id"], "left")
    return out.select("query_id", "chunk_id", F.coalesce(F.col("have") / F.col("n_terms"), F.lit(0.0)).alias("coverage"))


def highlight(hits: DataFrame, terms: DataFrame, fragments: int = 2, words: int = 38) -> DataFrame:
    """hits (query_id, chunk_id, text) plus headline: fragments around matches, marked \\u0001 and \\u0002; else the lead."""
    per_query = terms.groupBy("query_id").agg(F.collect_set("lexeme").alias("_terms"))
    h = hits.join(per_query, "query_id", "left").withColumn("_w", F.split("text", r"\s+"))
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    hit = lambda w: F.array_contains(F.coalesce("_terms", F.array().cast("array<string>")), bare(w))
    h = h.withColumn("_at", F.filter(F.transform("_w", lambda w, i: F.when(hit(w), i).otherwise(-1)), lambda i: i >= 0))
    h = h.withColumn("_w", F.transform("_w", lambda w: F.when(hit(w), F.concat(F.lit("\u0001"), w, F.lit("\u0002"))).otherwise(w)))
    half = words // 2
    first = F.greatest(F.get("_at", F.lit(0)) - half, F.lit(0))
    h = h.withColumn("_a", first)
    after = F.filter("_at", lambda i: i >= F.col("_a") + words)
    h = h.withColumn("_b", F.when(F.size(after) > 0, F.greatest(F.get(after, F.lit(0)) - half, F.col("_a") + words)))
    piece = lambda start: F.array_join(F.slice("_w", start + 1, F.lit(words)), " ")
    parts = [piece(F.col("_a")), *[F.when(F.col("_b").isNotNull(), piece(F.col("_b"))) for _ in range(fragments - 1)]]
    line = F.when(F.size("_at") > 0, F.concat_ws(" … ", *parts)).otherwise(lead_excerpt(F.col("text")))
    return h.withColumn("headline", line).drop("_terms", "_w", "_at", "_a", "_b")
