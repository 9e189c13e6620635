"""The progress feed of jobs as a stream: only changed states are passed on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "id long, job_id string, status string, stage string, progress int, message string, created_at double"
_STATE = ["status", "stage", "progress", "message"]


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _changed(rows: Iterator[pd.DataFrame], last: tuple | None, newest: int) -> tuple[list[pd.DataFrame], tuple | None, int]:
    out = []
    for b in [pd.concat(list(rows))]:
        b = b[b["id"] > newest].drop_duplicates("id").sort_values("id")
        keep = []
        for r in b[_STATE].itertuples(index=False, name=None):
            now = tuple(None if pd.isna(x) else x for x in r)
            keep.append(now != last)
            last = now
        if len(b):
            newest = int(b["id"].iloc[-1])
        out.append(b[keep])
    return out, last, newest


def changed_states(events: DataFrame) -> DataFrame:
    """Events whose state differs from that of the event before them of their job, by id; duplicates and late ids count once
    or not at all.  State: the last event of each job, since a job that has ended may be resumed."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, stage, progress, message, newest = state.get if state.exists else (None, None, None, None, -1)
        last = (status, stage, progress, message) if state.exists else None
        out, last, newest = _changed(rows, last, newest)
        if last is not None:
            state.update((last[0], last[1], None if last[2] is None else int(last[2]), last[3], newest))
        yield from out

    return events.groupBy("job_id").applyInPandasWithState(step, EVENTS, "status string, stage string, progress int, message string, newest long", "append", GroupStateTimeout.NoTimeout)


def feed(events: DataFrame, checkpoint: str, sink_path: str):
    """Start the feed into a Parquet folder; everything available is processed, then it ends.  Exactly once by the checkpoint."""
    return changed_states(events).writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
