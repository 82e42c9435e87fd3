"""Keyed state on streams: open starts, activity sessions, rate limits by first event."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GRACE = "24 hours"


def lost_starts(starts: DataFrame, completions: DataFrame, delay: str = "1 hour", grace: str = GRACE) -> DataFrame:
    """Starts with no completion within ``grace``, released once the watermark says none can come.

    Both streams carry ``session_id`` and ``received_at``; starts ``seq``, completions ``started_seq``.
    """
    s = starts.withWatermark("received_at", delay).alias("s")
    c = completions.select(
        F.col("session_id").alias("c_session"), F.col("started_seq").alias("c_seq"), F.col("received_at").alias("c_at"),
    ).withWatermark("c_at", delay).alias("c")
    rule = F.expr(
        f"s.session_id = c_session AND s.seq = c_seq AND c_at >= s.received_at AND c_at <= s.received_at + interval {grace}")
    return s.join(c, rule, "leftOuter").where("c_session is null").select("s.*")


def activity_sessions(stream: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """Sessions of a key closed by ``gap`` of silence."""
    cells = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return cells.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_event_limit(stream: DataFrame, key: str, seconds: str, limit: int, window: float) -> DataFrame:
    """Rate limit whose window opens at a key's first event; adds ``allowed``.

    The state is two numbers per key. Rows must come in the order of time from one micro-batch to the next, as ``replayed`` gives
    them; a key's rows of one micro-batch are sorted in memory, so take as many slices as let the largest key of one fit
    a task. The loop runs once per window, not per row. ``stream`` holds the key (string), ``event_id`` and the time in seconds.
    """
    schema = f"{key} string, event_id bigint, at double, allowed boolean"

    def admit(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (-np.inf, 0)
        rows = pd.concat(list(batches)).sort_values([seconds, "event_id"])
        times = rows[seconds].to_numpy()
        allowed = np.zeros(len(times), bool)
        i = 0
        while i < len(times):
            if times[i] >= start + window:
                start, used = float(times[i]), 0
            end = i + max(1, int(np.searchsorted(times[i:], start + window)))
            let = min(limit - used, end - i)
            allowed[i : i + let] = True
            used, i = used + let, end
        state.update((float(start), int(used)))
        yield pd.DataFrame({key: k[0], "event_id": rows["event_id"], "at": times, "allowed": allowed})

    return stream.groupBy(key).applyInPandasWithState(
        admit, schema, "start double, used long", "append", GroupStateTimeout.NoTimeout)
