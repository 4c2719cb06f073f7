"""Near duplicates among captured chunks, decided from the recent vectors of a key.

The state of a key is the ids, sessions, times and unit vectors kept within ``keep_seconds``, so
a stream reads no store.  The key is a platform and session, of which there are many; with
``scope="platform"`` the nearest of all sessions of a platform decides, as in the batch
decisions, at one key for each platform.  Chunks are taken in order of time and id.  One that is
a near duplicate is not kept and is not compared with later ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed value: the likeness from which a chunk counts as sent again.
SKIP_THRESHOLD = 0.92
REASONS = ["embed_failed", "search_failed", "no_match", "different_session", "near_duplicate", "below_threshold"]
DECISION = "id long, platform string, session string, at timestamp, reason string, score double, matched long"
STATE = "ids array<bigint>, sessions array<string>, ats array<bigint>, vectors binary"


class Recent:
    """What a key remembers."""

    def __init__(self, size: int, held: tuple | None = None):
        self.size = size
        ids, sessions, ats, vectors = held or ([], [], [], b"")
        self.ids, self.sessions, self.ats = list(ids), list(sessions), list(ats)
        self.vectors = [*np.frombuffer(bytes(vectors), np.float64).reshape(-1, size)]

    def forget(self, before: int) -> None:
        keep = [i for i, t in enumerate(self.ats) if t >= before]
        if len(keep) < len(self.ats):
            self.ids, self.sessions, self.ats, self.vectors = ([x[i] for i in keep] for x in (self.ids, self.sessions, self.ats, self.vectors))

    def decide(self, row_id: int, session: str | None, at: int, vector, threshold: float) -> tuple[str, float, int | None]:
        if vector is None:
            return "embed_failed", 0.0, None
        x = np.asarray(vector, np.float64)
        if x.shape != (self.size,) or not np.isfinite(x).all():
            return "search_failed", 0.0, None
        norm = np.linalg.norm(x)
        x = x / norm if norm else x
        reason, score, matched = "no_match", 0.0, None
        if self.ids:
            scores = np.round(np.stack(self.vectors) @ x, 12)
            best = min(range(len(scores)), key=lambda i: (-scores[i], self.ids[i]))
            score = float(scores[best])
            if session is not None and self.sessions[best] is not None and self.sessions[best] != session:
                reason = "different_session"
            elif score >= threshold:
                return "near_duplicate", score, self.ids[best]
            else:
                reason = "below_threshold"
        self.ids.append(row_id)
        self.sessions.append(session)
        self.ats.append(at)
        self.vectors.append(x)
        return reason, score, matched

    def state(self) -> tuple:
        return self.ids, self.sessions, self.ats, b"".join(v.tobytes() for v in self.vectors)


def decisions(chunks: DataFrame, size: int, threshold: float = SKIP_THRESHOLD, keep_seconds: int = 7 * 86400, late: str = "1 minute", scope: str = "session", carry: tuple[str, ...] = ()) -> DataFrame:
    """``DECISION``, and the string columns named in ``carry``, for every row of the stream or table
    ``chunks`` (id, platform, session, at: timestamp, vector)."""
    keys = {"session": ["platform", "session"], "platform": ["platform"]}[scope]
    rows = chunks.select("id", "platform", "session", F.col("at").cast("timestamp").alias("at"), F.col("vector").cast("array<double>").alias("vector"), *carry)
    ddl = DECISION + "".join(f", {c} string" for c in carry)
    names = [x.split()[0] for x in ddl.split(", ")]

    def decided(pdf: pd.DataFrame, recent: Recent) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "id"])
        out = []
        for r, t in zip(pdf.itertuples(), pdf["at"].astype("datetime64[us]").astype("int64"), strict=True):
            recent.forget(t - keep_seconds * 1_000_000)
            out.append((r.id, r.platform, r.session, r.at, *recent.decide(r.id, r.session, t, r.vector, threshold), *(getattr(r, c) for c in carry)))
        made = pd.DataFrame(out, columns=names)
        return made.astype({"matched": "Int64"})

    if not rows.isStreaming:
        return rows.groupBy(*keys).applyInPandas(lambda pdf: decided(pdf, Recent(size)), ddl)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = Recent(size, state.get if state.exists else None)
        yield decided(pd.concat(list(pdfs)), recent)
        state.update(recent.state())
        due = max(recent.ats, default=0) // 1000 + keep_seconds * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    timed = rows.withWatermark("at", late)
    return timed.groupBy(*keys).applyInPandasWithState(step, ddl, STATE, "append", GroupStateTimeout.EventTimeTimeout)
