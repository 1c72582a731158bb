"""Audit of answers: citations, quotations, segments, summaries, and places of passages on pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions.text import extract_citations, extract_quotes, fold_accents, normalize_for_match, page_mentions, quote_fragments


def check_citations(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(answer_id, passage_id, known): each distinct id that an answer (answer_id, thread_id, text) cites, in the order cited (pos)."""
    cited = answers.select("answer_id", "thread_id", F.posexplode(extract_citations(F.col("text"))).alias("pos", "passage_id"))
    cited = cited.groupBy("answer_id", "thread_id", "passage_id").agg(F.min("pos").alias("pos"))
    known = passages.select("thread_id", "passage_id", F.lit(True).alias("known")).distinct()
    return cited.join(known, ["thread_id", "passage_id"], "left").select("answer_id", "pos", "passage_id", F.coalesce("known", F.lit(False)).alias("known"))


def check_quotes(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(answer_id, pos, quote, verified, found_in): whether one passage of the thread holds all of a quotation's fragments.

    Ellipses and [edits] part a quotation; fragments of fewer than two words don't count; with none left it is not verified.
    """
    q = answers.select("answer_id", "thread_id", F.posexplode(extract_quotes(F.col("text"))).alias("pos", "quote"))
    q = q.withColumn("parts", quote_fragments(F.col("quote")))
    texts = passages.select("thread_id", "passage_id", normalize_for_match(F.col("text")).alias("norm"))
    hits = q.where(F.size("parts") > 0).join(texts, "thread_id").where(F.forall("parts", lambda f: F.col("norm").contains(f)))
    found = hits.groupBy("answer_id", "pos").agg(F.array_join(F.sort_array(F.collect_set("passage_id")), ",").alias("found_in"))
    out = q.select("answer_id", "pos", "quote").join(found, ["answer_id", "pos"], "left")
    return out.select("answer_id", "pos", "quote", F.col("found_in").isNotNull().alias("verified"), F.coalesce("found_in", F.lit("")).alias("found_in"))


def segment_answer(answers: DataFrame) -> DataFrame:
    """(answer_id, pos, kind, body): text, synthesis and outside segments; a tag cut off at the end is hidden, equal neighbours are one."""
    text = F.regexp_replace("text", r"(?i)</?[a-z]*$", "")
    marked = F.regexp_replace(text, r"<(/?)(synthesis|outside)>", "\u0001$1$2\u0002")
    # each part but the first begins with its tag, closed by \u0002
    rows = answers.select("answer_id", F.posexplode(F.split(marked, "\u0001")).alias("i", "part"))
    tag = F.when(F.col("part").contains("\u0002"), F.substring_index("part", "\u0002", 1))
    rows = rows.select("answer_id", "i", F.when(tag.isNull() | tag.startswith("/"), "text").otherwise(tag).alias("kind"), F.when(tag.isNull(), F.col("part")).otherwise(F.expr("substring(part, locate('\u0002', part) + 1)")).alias("body"))
    rows = rows.where(F.trim(F.regexp_replace("body", r"\s", "")) != "")
    w = W.partitionBy("answer_id").orderBy("i")
    rows = rows.withColumn("new", F.when(F.lag("kind").over(w).eqNullSafe(F.col("kind")), 0).otherwise(1)).withColumn("pos", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "body"))), lambda x: x["body"]), "")
    return rows.groupBy("answer_id", "pos", "kind").agg(body.alias("body"))


def audit_summary(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """Per answer: sources cited and consulted, consulted but not cited, unknown citations, quotes verified of all, page mentions."""
    c = check_citations(answers, passages).groupBy("answer_id").agg(F.count_if("known").alias("cited"), F.count_if(~F.col("known")).alias("unknown"))
    q = check_quotes(answers, passages).groupBy("answer_id").agg(F.count_if("verified").alias("verified"), F.count("*").alias("quotes"))
    n = passages.select("thread_id", "passage_id").distinct().groupBy("thread_id").agg(F.count("*").alias("consulted"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    a = answers.select("answer_id", "thread_id", F.size(page_mentions(F.col("text"))).alias("mentions")).join(c, "answer_id", "left").join(q, "answer_id", "left").join(n, "thread_id", "left")
    a = a.select("answer_id", zero("cited"), zero("unknown"), zero("verified"), zero("quotes"), zero("consulted"), F.col("mentions").cast("long").alias("mentions"))
    return a.withColumn("uncited", F.col("consulted") - F.col("cited"))


def letters_only(c):
    return F.regexp_replace(fold_accents(F.lower(c)), r"[^\p{L}\p{N}]+", "")


WINDOW, BRIDGE, LEAP, SHORTEST = 28, 80, 480, 8


def places(page: str, target: str) -> list[tuple[int, int]]:
    """Ranges of ``page`` that ``target`` covers: the whole of it, or the longest chain of its windows; ranges close together are one.

    Every place of every window is a point (place on the page, number of the window). A chain goes forward in both, with leaps of
    bounded length; of equally long ones the first on the page is taken.
    """
    if not page or len(target) < SHORTEST:
        return []
    if target in page:
        return [(page.index(target), page.index(target) + len(target))]
    windows = [target[s:s + WINDOW] for s in sorted({*range(0, len(target) - WINDOW + 1, WINDOW), max(0, len(target) - WINDOW)})]
    points = sorted((m.start(), k) for k, w in enumerate(windows) if len(w) == WINDOW for m in re.finditer(re.escape(w), page))
    if not points:
        return []
    length, before, low = [1] * len(points), [-1] * len(points), 0
    for i, (at, k) in enumerate(points):
        while points[low][0] < at - WINDOW - LEAP:
            low += 1
        for j in range(low, i):
            if points[j][0] < at and points[j][1] < k and length[j] >= length[i]:
                length[i], before[i] = length[j] + 1, j
    i, chain = length.index(max(length)), []
    while i >= 0:
        chain.append(points[i][0])
        i = before[i]
    chain.reverse()
    breaks = [0, *(n for n in range(1, len(chain)) if chain[n] - chain[n - 1] - WINDOW > BRIDGE), len(chain)]
    return [(chain[a], chain[b - 1] + WINDOW) for a, b in zip(breaks, breaks[1:])]


def locate_passage(spans: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, idx): which of its page's spans (page_key, idx, text) each target (target_id, page_key, text) covers.

    Only letters and digits count. A group is one target and one page.
    """
    s = spans.select("page_key", F.struct("idx", letters_only(F.col("text")).alias("t")).alias("s")).groupBy("page_key").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    both = targets.select("target_id", "page_key", letters_only(F.col("text")).alias("target")).join(s, "page_key")

    def find(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                ends, page = [], ""
                for x in r.spans:
                    page += x["t"]
                    ends.append((len(page) - len(x["t"]), len(page), x["idx"]))
                got = places(page, r.target)
                out += [(r.target_id, i) for a, b, i in ends if any(a < hi and lo < b for lo, hi in got)]
            yield pd.DataFrame(out, columns=["target_id", "idx"])

    return both.select("target_id", "target", "spans").mapInPandas(find, "target_id long, idx long")
