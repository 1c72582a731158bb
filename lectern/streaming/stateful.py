"""Streams with a state of their own per key and timers in event time: stalled documents, and answers put together."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.library import UNEXPECTED

STALLED = "document_id long, status string, stage string, progress double, detail string, updated_at timestamp"
TURN = ("turn_id long, searches long, reads long, trail string, notes string, answer string, error string, "
        "cited array<string>, unknown array<string>, verified array<boolean>, input_tokens long, output_tokens long")
OPEN = ("queued", "processing")


def stalled_stream(events: DataFrame, after_seconds: int = 45, lateness: str = "0 seconds") -> DataFrame:
    """Documents that stay queued or processing while event time goes on for ``after_seconds`` without an event of theirs: each such silence once.

    events: (document_id, ts, seq, status, stage, progress, detail). A document's state is its latest event by (ts, seq) and the latest
    detail; a timer at ts + after_seconds is set anew by each later event, and fires when the watermark (the largest ts less ``lateness``) has passed it, so the
    answer is that of ``stalled`` at the watermark, in whole milliseconds. Events behind the watermark are late and dropped.
    Work for a batch is that of its documents and of the timers that fire, whatever came before.
    """
    def follow(key, frames: Iterator, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            at, seq, status, stage, progress, detail, _, _ = state.get
            state.remove()
            # the silence has been told; a later event begins anew, with the detail that was known
            state.update((at, seq, status, stage, progress, detail, at, True))
            yield pd.DataFrame({"document_id": [key[0]], "status": [status], "stage": [stage], "progress": [progress], "detail": [detail], "updated_at": [pd.Timestamp(at, unit="us")]})
            return
        at, seq, status, stage, progress, detail, detail_at, told = state.get if state.exists else (-(1 << 62), 0, None, None, None, None, -(1 << 62), False)
        for pdf in frames:
            for r in pdf.sort_values(["at", "seq"]).itertuples(index=False):
                if r.detail is not None and r.at >= detail_at:
                    detail, detail_at = r.detail, r.at
                if (r.at, r.seq) >= (at, seq):
                    at, seq, status, stage, progress, told = int(r.at), int(r.seq), r.status, r.stage, None if pd.isna(r.progress) else float(r.progress), False
        state.update((at, seq, status, stage, progress, detail, detail_at, told))
        if status in OPEN and not told:
            state.setTimeoutTimestamp(max(at // 1000 + after_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    kept = events.withWatermark("ts", lateness).select("document_id", "ts", F.unix_micros("ts").alias("at"), "seq", "status", "stage", "progress", "detail")
    state = "at long, seq long, status string, stage string, progress double, detail string, detail_at long, told boolean"
    out = kept.groupBy("document_id").applyInPandasWithState(follow, STALLED, state, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("progress", F.when(F.col("progress").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "progress"))))


def fold_events(turn_id: int, events: dict[str, dict]) -> dict:
    """One turn's events by seq -> its row, as ``fold_turns`` makes it."""
    rows = [events[k] for k in sorted(events, key=int)]
    rounds, number = [], 0
    for e in rows:
        number += e["type"] == "turn"
        rounds.append(number)
    text = [(n, e["text"] or "") for n, e in zip(rounds, rows) if e["type"] == "text"]
    errors = [e["error"] if e["error"] is not None else "error" for e in rows if e["type"] == "error"]
    done = [e for e in rows if e["type"] == "done"]
    last = done[-1] if done else {}
    answer = "".join(t for n, t in text if n == number)
    trail = "|".join(e["type"] if e["query"] is None else f"{e['type']}:{e['query']}" for e in rows if e["type"] in ("search", "read"))
    kinds = [e["type"] for e in rows]
    return {"turn_id": turn_id, "searches": kinds.count("search"), "reads": kinds.count("read"), "trail": trail, "notes": "".join(t for n, t in text if n < number),
            "answer": last["text"] if last.get("text") is not None else answer, "error": max(errors) if errors else None if done else UNEXPECTED,
            **{c: last.get(c) for c in ("cited", "unknown", "verified", "input_tokens", "output_tokens")}}


def fold_turns_stream(events: DataFrame, silence_seconds: int = 600, lateness: str = "0 seconds") -> DataFrame:
    """Answer events (those of ``EVENTS``, with their time ``at``) -> one row per turn, when it ends.

    A turn's events are numbered from 0. A turn ends with its done or error event once all before it are in, in whatever order and however often they
    come, or unexpectedly when event time has gone on for ``silence_seconds`` since its last event. Its state is its own events, so the cost of a batch is that of the
    turns that it touches; an ended turn leaves a mark, against repeated events, for another such time.
    """
    fields = ("type", "text", "query", "error", "cited", "unknown", "verified", "input_tokens", "output_tokens")
    plain = {"cited": list, "unknown": list, "verified": lambda v: [None if x is None else bool(x) for x in v], "input_tokens": int, "output_tokens": int}

    def fold(key, frames: Iterator, state: GroupState):
        import pandas as pd

        def value(row, c):
            v = getattr(row, c)
            # a frame has NaN for a missing number
            return None if v is None or isinstance(v, float) and v != v else plain.get(c, str)(v)

        silence = silence_seconds * 1000
        if state.hasTimedOut:
            ended, _, stored = state.get
            state.remove()
            if not ended:
                state.update((True, 0, "{}"))
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + silence)
                yield pd.DataFrame([fold_events(int(key[0]), json.loads(stored))])
            return
        ended, last, stored = state.get if state.exists else (False, 0, "{}")
        known = json.loads(stored)
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                last = max(last, int(r.at_ms))
                if not ended:
                    known.setdefault(str(int(r.seq)), {c: value(r, c) for c in fields})
        closing = [int(k) for k, e in known.items() if e["type"] in ("done", "error")]
        if not ended and closing and len([k for k in known if int(k) <= min(closing)]) == min(closing) + 1:
            yield pd.DataFrame([fold_events(int(key[0]), known)])
            ended, known = True, {}
        state.update((ended, last, json.dumps(known)))
        state.setTimeoutTimestamp(max(last + silence, state.getCurrentWatermarkMs() + 1))

    kept = events.withWatermark("at", lateness).select("turn_id", "at", F.unix_millis("at").alias("at_ms"), "seq", *fields)
    return kept.groupBy("turn_id").applyInPandasWithState(fold, TURN, "ended boolean, last long, events string", "append", GroupStateTimeout.EventTimeTimeout)
