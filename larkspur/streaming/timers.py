"""Bursts of changes as one: quiet periods and least distances, as keyed state with timers.

Both take a stream of (path, at: timestamp).  ``clock="event"`` runs on ``at`` itself, behind a
watermark of ``late``: its timers fire as later rows arrive, so results depend on the data
alone.  ``clock="processing"`` runs on the wall clock, for live folders.  A path's state is three
numbers and goes when its timer fires.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BURST = "path string, first timestamp, last timestamp, n long"


def _timed(changes: DataFrame, clock: str, late: str) -> tuple[DataFrame, str]:
    rows = changes.select("path", F.col("at").cast("timestamp").alias("at"))
    if clock == "event":
        return rows.withWatermark("at", late), GroupStateTimeout.EventTimeTimeout
    if clock == "processing":
        return rows, GroupStateTimeout.ProcessingTimeTimeout
    raise ValueError(f"unknown clock {clock}")


def _micros(times: pd.Series) -> list[int]:
    return sorted(times.astype("datetime64[us]").astype("int64").tolist())


def _burst(path: str, first: int, last: int, n: int) -> pd.DataFrame:
    stamp = lambda t: pd.Timestamp(t, unit="us")
    return pd.DataFrame([(path, stamp(first), stamp(last), n)], columns=["path", "first", "last", "n"])


def settled(changes: DataFrame, quiet_seconds: float, clock: str = "processing", late: str = "0 seconds") -> DataFrame:
    """(path, first, last, n): one row for a burst of changes, once its path has been quiet."""
    timed, timeout = _timed(changes, clock, late)
    quiet = int(quiet_seconds * 1_000_000)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield _burst(key[0], *held)
            return
        first, last, n = state.get if state.exists else (None, None, 0)
        out = []
        for at in sorted(t for pdf in pdfs for t in _micros(pdf["at"])):
            if last is not None and clock == "event" and at - last > quiet:
                out.append(_burst(key[0], first, last, n))
                first, last, n = None, None, 0
            first, last, n = at if first is None else min(first, at), at if last is None else max(last, at), n + 1
        if clock == "processing":
            state.update((first, last, n))
            state.setTimeoutDuration(max(1, quiet // 1000))
        elif (due := (last + quiet) // 1000) <= state.getCurrentWatermarkMs():
            out.append(_burst(key[0], first, last, n))
            if state.exists:
                state.remove()
        else:
            state.update((first, last, n))
            state.setTimeoutTimestamp(due)
        yield from out

    return timed.groupBy("path").applyInPandasWithState(step, BURST, "first long, last long, n long", "append", timeout)


def fired(changes: DataFrame, least_seconds: float, clock: str = "event", late: str = "0 seconds") -> DataFrame:
    """(path, at): changes that come ``least_seconds`` or more after the last one let through."""
    timed, timeout = _timed(changes, clock, late)
    least = int(least_seconds * 1_000_000)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the next change is far enough away
            state.remove()
            return
        last, out = state.get[0] if state.exists else None, []
        for at in sorted(t for pdf in pdfs for t in _micros(pdf["at"])):
            if last is None or at - last >= least:
                last = at
                out.append((key[0], pd.Timestamp(at, unit="us")))
        state.update((last,))
        if clock == "processing":
            state.setTimeoutDuration(max(1, least // 1000))
        else:
            state.setTimeoutTimestamp(max((last + least) // 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["path", "at"])

    return timed.groupBy("path").applyInPandasWithState(step, "path string, at timestamp", "last long", "append", timeout)
