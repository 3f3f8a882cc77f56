"""Runs that overtake each other: only what the latest run of an owner gives counts.

Events: (owner, run_id, kind, at, payload); kind: "start" or "result"; a later run has a larger run_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_RESULT = "owner long, run_id long, at timestamp, payload string"


def latest_results(events: DataFrame) -> DataFrame:
    """(owner, run_id, at, payload): the result of each owner's latest run, where that run has one; the last one, if it has several. Folds on the map side."""
    result = F.when(F.col("kind") == "result", F.struct("at", "payload"))
    last = events.groupBy("owner").agg(F.max("run_id").alias("run_id"), F.max_by(F.struct(result.alias("r")), F.struct("run_id", result.isNotNull(), "at")).alias("x"))
    return last.filter("x.r IS NOT NULL").select("owner", "run_id", "x.r.at", "x.r.payload")


def current_results(stream: DataFrame, lateness: str = "10 minutes", patience_ms: int = 600_000) -> DataFrame:
    """(owner, run_id, at, payload) over a stream: results as they come in, without those of runs that a later one had overtaken by then.

    State is one number an owner, the latest run seen; it is dropped when an owner is silent for longer than patience_ms of event time.
    """

    def judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        latest = state.get[0] if state.exists else None
        rows = pd.concat(list(parts))
        rows = rows.assign(after=rows["kind"] == "result").sort_values(["at", "after", "run_id"], kind="stable")
        kept = []
        for row in rows.itertuples():
            latest = row.run_id if latest is None else max(latest, row.run_id)
            if row.kind == "result" and row.run_id == latest:
                kept.append((key[0], row.run_id, row.at, row.payload))
        state.update((int(latest),))
        state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs() + 1) + patience_ms)
        if kept:
            yield pd.DataFrame(kept, columns=["owner", "run_id", "at", "payload"])

    return stream.withWatermark("at", lateness).groupBy("owner").applyInPandasWithState(judge, _RESULT, "latest long", "append", GroupStateTimeout.EventTimeTimeout)
