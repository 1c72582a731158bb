"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration (operator 6)."""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import by_ids, read_table, written

#: Labelled rows that the model is fitted on at most (a hash-chosen sample of them, where there are more).
MAX_LABELLED = 16_000
#: A term enters the lexicon if the lower bound (Z standard errors, Wilson) of its share of toxic documents is this high.
LEAST_SHARE, Z = 0.5, 3.0
#: Entries of the lexicon at most, the surest first; it is sent to every task.
MAX_LEXICON = 5_000
PREFIXES = (4, 5, 6)  # beginnings of words that count as terms too: inflections and compounds share them
MAX_KEPT = 300_000
NEAR = 5  # words between an insult and a second-person word that stand close

#: Common insults, and words for the person addressed, in the corpus's four languages.
SEEDS = frozenset("idiot stupid moron loser trash scum clown pathetic worthless disgusting dumb fool jerk filth vermin dummkopf idiotisch abschaum trottel "
                  "imbécile débile crétin ordure idiota estúpido imbécil basura".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre tú ti usted ustedes vosotros".split())
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})

FEATURES = ["n_words", "lexicon_hits", "lexicon_density", "seed_hits", "seed_density", "close_hits", "close_share", "second_person",
            "capitals", "capital_words", "punctuation", "exclamation", "obfuscated", "obfuscated_hits"]

_bare = re.compile(r"^[\W_]+|[\W_]+$")
_mixed = re.compile(r"[^\W\d_][\d@$!|*#%&.\-_]+[^\W\d_]")
_kept: dict[int, dict] = {}


def folded(word: str) -> tuple[str, bool]:
    """(lower-case core of a word with look-alike characters put back, whether that changed it)."""
    core = _bare.sub("", word.lower())
    if core.isalpha():
        return core, False
    if _mixed.search(core):
        return re.sub(r"[\W\d_]", "", core.translate(LOOKALIKES)), True
    return core, False


def terms_of(core: str) -> list[str]:
    """A word, and its beginnings marked as such."""
    return [core, *("^" + core[:n] for n in PREFIXES if len(core) >= n)]


#: Bits of a word's code.
HIT, SEED, YOU, CAPS, ODD = 1, 2, 4, 8, 16


class _Codes(dict):
    def __init__(self, lexicon: frozenset[str]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_KEPT:
            self.clear()
        core, odd = folded(word)
        code = 0
        if core:
            code = (HIT * any(t in self.lexicon for t in terms_of(core)) | SEED * (core in SEEDS) | YOU * (core in SECOND_PERSON)
                    | CAPS * (len(core) > 1 and word.isupper()) | ODD * odd)
        self[word] = code
        return code


def _byte_classes():
    import numpy as np

    punctuation, marks = np.zeros(256, bool), np.zeros(256, bool)
    punctuation[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
    marks[[ord("!"), ord("?")]] = True
    return punctuation, marks


def features_of(text: str | None, codes: _Codes, classes) -> list[float]:
    """FEATURES of one text, in order; all 0 for a null or empty one."""
    import numpy as np

    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    c = np.fromiter(map(codes.__getitem__, words), np.uint8, len(words))
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(b, minlength=256)
    n, chars = len(words), len(b)
    bad, you = np.flatnonzero(c & (HIT | SEED)), np.flatnonzero(c & YOU)
    close = 0
    if len(bad) and len(you):
        at = np.searchsorted(you, bad)
        gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - bad), np.abs(bad - you[np.maximum(at - 1, 0)]))
        close = int((gap <= NEAR).sum())
    hits, seeds, odd = int(((c & HIT) > 0).sum()), int(((c & SEED) > 0).sum()), (c & ODD) > 0
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    return [float(np.log1p(n)), float(np.log1p(hits)), hits / n, float(np.log1p(seeds)), seeds / n, float(np.log1p(close)), close / max(1, len(bad)), len(you) / n,
            int(counts[65:91].sum()) / letters, float(((c & CAPS) > 0).mean()), int(counts[classes[0]].sum()) / chars, int(counts[classes[1]].sum()) / chars,
            float(odd.mean()), float(np.log1p(int((odd & ((c & (HIT | SEED)) > 0)).sum())))]


def features(docs: DataFrame, lexicon: list[str]) -> DataFrame:
    """(doc_id, x array<double>): FEATURES of each whole text, in one pass."""
    fixed = frozenset(lexicon)

    def compute(batches):
        import pyarrow as pa

        codes, classes = _kept.get(hash(fixed)), _byte_classes()
        if codes is None:
            _kept.clear()
            codes = _kept[hash(fixed)] = _Codes(fixed)
        for batch in batches:
            x = [features_of(t, codes, classes) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(compute, "doc_id long, x array<double>")


def learn_lexicon(labelled: DataFrame) -> list[str]:
    """Terms that tell toxic documents from others, learned from (text, toxic) rows.

    Counts are of documents; a term is kept if even the lower bound of its share of toxic ones is high.
    """

    def terms(batches):
        import pyarrow as pa

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen: set[str] = set()
                for w in set((text or "").split()):
                    core = folded(w)[0]
                    if 2 < len(core) <= 24:
                        seen.update(terms_of(core))
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([toxic] * len(seen), pa.int64())], names=["term", "toxic"])

    counts = labelled.select("text", F.col("toxic").cast("long")).mapInArrow(terms, "term string, toxic long").groupBy("term").agg(
        F.count("*").cast("double").alias("n"), F.sum("toxic").cast("double").alias("k"))
    p = F.col("k") / F.col("n")
    z2 = F.lit(Z * Z)
    low = (p + z2 / (2 * F.col("n")) - Z * F.sqrt(p * (1 - p) / F.col("n") + z2 / (4 * F.col("n") * F.col("n")))) / (1 + z2 / F.col("n"))
    rows = counts.where("k >= 5").withColumn("low", low).where(F.col("low") >= LEAST_SHARE).orderBy(F.desc("low"), "term").limit(MAX_LEXICON).select("term").collect()
    return sorted(r.term for r in rows)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: 0 is held out, 4 calibrates, the others train."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document.

    Learns from labelled rows outside the held-out fold alone: a lexicon and the trees from folds 1-3, the
    calibration from fold 4; at most about ``max_labelled`` rows, chosen by a hash of the id. A score depends on
    the text alone. Rows of ``labels`` without id or label are ignored; of several labels of an id the largest
    counts. Without labels of both kinds in the training folds there is no model: the score is then 0.9 for texts with a
    seed insult, 0.1 for others. Null and empty texts are scored like any other (all features 0); null ids and
    repeated rows get their own results. Other columns are ignored.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic")).where(fold(F.col("doc_id")) > 0)
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    share = max_labelled / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    known = written(known)  # of about max_labelled rows at most
    texts = docs.join(F.broadcast(known), "doc_id")
    lexicon = learn_lexicon(texts.where(fold(F.col("doc_id")) < 4).select("text", "toxic"))
    x = written(features(docs, lexicon))
    row = x.join(F.broadcast(known), "doc_id").select(array_to_vector("x").alias("features"), F.col("toxic").cast("double").alias("label"), fold(F.col("doc_id")).alias("fold"))
    row = written(row.repartition(max(1, spark.sparkContext.defaultParallelism)))
    train, held = row.where("fold < 4"), row.where("fold = 4")
    kinds = {r.label for r in train.select("label").distinct().collect()}
    base = x.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "x")
    if len(kinds) < 2:
        out = base.withColumn("score", F.when(F.col("x")[FEATURES.index("seed_hits")] > 0, 0.9).otherwise(0.1))
    else:
        trees = GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.3, seed=6, featuresCol="features", labelCol="label").fit(train)
        raw = lambda df: trees.transform(df).withColumn("margin", vector_to_array("probability")[1])
        enough = {r.label for r in held.select("label").distinct().collect()} == {0.0, 1.0}
        line = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(raw(held if enough else train).select("margin", "label"))
        scored = raw(base.withColumn("features", array_to_vector("x"))).select("doc_id", "held_out", "margin")
        out = line.transform(scored)
    out = out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))
    return out.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted to be toxic; of rows that share an id all go if one does, a null id stays."""
    gone = toxicity(docs, labels).where("predicted = 1 and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    return by_ids(docs, written(gone), "doc_id", keep=False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
