"""The signals of turns as a stream: the same operators, with the state that crosses turns.

What a session must remember is small: the vector of the turn before, how many
alarms are pending, and the last topics.  It is kept per session by the state store
and given up after a time without turns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest import lexicon as L
from palimpsest.operators import memory as M
from palimpsest.operators import signals as S

OUTPUT = "session_id long, turn long, topic_shift boolean, top_k int, relevance_threshold double, caution string, is_sustained boolean"
STATE = "before array<double>, pending string, topics array<string>"
IDLE_MS = 6 * 3600 * 1000


def prepared(turns: DataFrame) -> DataFrame:
    """session_id, turn, embedding, norepinephrine, topic: what the fold needs, by built-in functions."""
    return S.with_topic(S.norepinephrine(turns)).select("session_id", "turn", F.col("embedding").cast("array<double>").alias("embedding"), "norepinephrine", "topic")


def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, expiring: bool = True) -> Iterator[pd.DataFrame]:
    """One micro-batch of a session: turns in order, each against what came before."""
    if state.hasTimedOut:
        state.remove()
        return
    before, pending, topics = state.get if state.exists else (None, None, [])
    topics = [None if t == "" else t for t in topics or []]
    rows = pd.concat(list(frames)).sort_values("turn")
    out = []
    for r in rows.itertuples():
        v = None if r.embedding is None else np.asarray(r.embedding, float)
        shift = False
        if v is not None and before is not None and len(v) == len(before):
            n = np.linalg.norm(v) * np.linalg.norm(before)
            shift = bool(round(float(v @ np.asarray(before)) / n, 6) < S.TOPIC_SHIFT) if n else True
        times = (pending is not None) + shift
        caution = L.CAUTIONS["topic_shift"] if shift else L.CAUTIONS.get(pending) if pending else None
        topics = [*topics, r.topic][-10:]
        last = topics[-S.TOPIC_TURNS :]
        common = set.intersection(*(set(t.split(" ")) for t in last)) if len(last) == S.TOPIC_TURNS and all(last) else set()
        out.append((key[0], int(r.turn), shift, min(M.WIDEST, M.TOP_K * 2**times), M.THRESHOLD * 0.5**times, caution, bool(common)))
        before = before if v is None else v.tolist()
        pending = r.norepinephrine
    state.update((before, pending, ["" if t is None else t for t in topics]))
    if expiring:
        state.setTimeoutDuration(IDLE_MS)
    yield pd.DataFrame(out, columns=["session_id", "turn", "topic_shift", "top_k", "relevance_threshold", "caution", "is_sustained"])


def watched(turns: DataFrame, expiring: bool = True) -> DataFrame:
    """The configuration of every turn of a stream of (session_id, turn, message, embedding).

    Sessions expire by processing time, which keeps a query running for ever; a run
    over what is available, that must end, keeps its sessions.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return fold(key, frames, state, expiring)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if expiring else GroupStateTimeout.NoTimeout
    return prepared(turns).groupBy("session_id").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)


def habits(turns: DataFrame) -> DataFrame:
    """pattern_key, observations, sessions of a stream, exactly: the sessions of a pattern are kept as a set in its state."""
    counts = S.patterns(turns).groupBy("pattern_key").agg(F.count("*").alias("observations"), F.collect_set("session_id").alias("_in"))
    return counts.select("pattern_key", "observations", F.size("_in").cast("long").alias("sessions"))


def counted_events(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Signals of an event stream by window, closed once events that late are past."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
