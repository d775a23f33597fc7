"""Jobs as keyed state: the newest view of each, transitions, throttled updates; batch and streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The states, and where each may go.
NEXT = {
    "inspecting": ("ready", "failed"), "ready": ("queued", "removed"), "queued": ("converting", "removed"), "converting": ("done", "failed"),
    "done": ("queued", "removed"), "failed": ("inspecting", "queued", "removed"), "removed": (),
}


def latest(updates: DataFrame, columns: list[str]) -> DataFrame:
    """updates(job_id, seq, ...) -> the row of each job's largest seq: late rows never win. Works on a stream in complete or update mode."""
    newest = F.max_by(F.struct("seq", *columns), "seq").alias("v")
    return updates.groupBy("job_id").agg(newest).select("job_id", "v.*")


def follow(updates: DataFrame, throttle_ms: int = 100) -> DataFrame:
    """A stream of updates(job_id, seq, state, ts) -> accepted updates, in order and throttled.

    A row is dropped if its seq is not above the job's newest, or if its state may not follow. A change of
    state is always passed on; within one state at most one update in throttle_ms of event time is.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, now, sent = state.get if state.exists else (-1, "", -(1 << 60))
        out = []
        for rows in batches:
            for r in rows.sort_values("seq").itertuples():
                if r.seq <= seq or now and r.state != now and r.state not in NEXT.get(now, ()):
                    continue
                at = int(r.ts.value // 1_000_000)
                if r.state != now or at - sent >= throttle_ms:
                    out.append((key[0], r.seq, r.state))
                    sent = at
                seq, now = r.seq, r.state
        state.update((seq, now, sent))
        yield pd.DataFrame(out, columns=["job_id", "seq", "state"])

    return updates.groupBy("job_id").applyInPandasWithState(step, "job_id long, seq long, state string", "seq long, state string, sent long", "append", GroupStateTimeout.NoTimeout)


def state_counts(views: DataFrame) -> DataFrame:
    """Jobs in each state."""
    return views.groupBy("state").agg(F.count("*").alias("n"))


def event_text(event: str, value: Column) -> Column:
    """A struct as one server-sent event: its name, its value as JSON, an empty line."""
    return F.concat(F.lit(f"event: {event}\ndata: "), F.to_json(value), F.lit("\n\n"))
