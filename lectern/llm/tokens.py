"""Token counts under a unigram model by dynamic programming shared along a trie (operator 5)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import read_table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"  # the pieces' mark of a word's beginning
#: Distinct pre-tokens whose counts a Python worker keeps between batches; then it starts anew.
MAX_KEPT = 1_000_000


def piece_scores(model: str = MODEL) -> dict[str, float]:
    """Piece -> unigram log-probability (less a constant) of a public vocabulary file; byte, control and unknown pieces are left out.

    The file tells the rank at which a piece was merged (as minus the rank), not how often it occurs. Frequency falls about as
    one over rank, so a piece's log-probability is minus the rank's logarithm; ranks themselves, summed, would rather
    cut a common word in pieces of small rank than take it whole. Pieces without a rank (single characters) come last.
    """
    import math

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return {sp.id_to_piece(i): -math.log(2.0 - min(0.0, sp.get_score(i))) for i in range(sp.get_piece_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}


def terminal_counts(pretokens: Iterable[str], scores: dict[str, float], longest: int, unknown: float) -> Iterator[tuple[str, int]]:
    """(pre-token, number of tokens) for each of a set of distinct pre-tokens.

    Sorted pre-tokens are a trie in depth-first order. The path from the root to the present node is a
    stack of forward states (best score, fewest tokens at that score), so each trie node is computed once
    however many pre-tokens pass it; a pre-token's count is its terminal node's. A character that no
    piece begins or covers costs one token per UTF-8 byte at the score ``unknown`` each.
    """
    path, states = "", [(0.0, 0)]
    get = scores.get
    for word in sorted(pretokens):
        shared, most = 0, min(len(path), len(word))
        while shared < most and path[shared] == word[shared]:
            shared += 1
        del states[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            width = len(word[end - 1].encode("utf-8", "surrogatepass"))
            score, n = states[end - 1]
            best, fewest = score + width * unknown, n + width
            for start in range(max(0, end - longest), end):
                s = get(word[start:end])
                if s is not None:
                    score, n = states[start]
                    score += s
                    if score > best or score == best and n + 1 < fewest:
                        best, fewest = score, n + 1
            states.append((best, fewest))
        path = word
        yield word, states[-1][1]


_counts: dict[str, dict[str, int]] = {}  # of this Python worker, by model file
_models: dict[str, tuple[dict[str, float], int, float]] = {}


def _model(path: str) -> tuple[dict[str, float], int, float]:
    if path not in _models:
        scores = piece_scores(path)
        _models[path] = scores, max(map(len, scores)), min(scores.values()) - 10.0
    return _models[path]


def token_counts(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pretokens long, n_tokens long), one row per input row.

    Pre-tokens are the text's runs between white space, each with the word mark in front. Work is one pass
    without a shuffle: a task inserts the distinct pre-tokens of its batches in the trie, and a worker keeps
    terminal counts for later batches. Null and empty texts have 0 of both; the id may be null or repeated;
    other columns are ignored. Ties between segmentations go to the one with fewer tokens.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        import pyarrow as pa

        scores, longest, unknown = _model(model)
        known = _counts.setdefault(model, {})
        for batch in batches:
            words = [t.split() if t else [] for t in batch.column(1).to_pylist()]
            if len(known) > MAX_KEPT:
                known.clear()
            new = set().union(*words).difference(known)
            for word, n in terminal_counts((SPACE + w for w in new), scores, longest, unknown):
                known[word[1:]] = n
            at = known.__getitem__
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(at, w)) for w in words], pa.int64())],
                names=[id_col, "n_pretokens", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_pretokens long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
