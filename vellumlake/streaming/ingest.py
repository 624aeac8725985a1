"""Snapshots that arrive as files, taken into an append-only table; what was taken before, or is older, changes nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellumlake.operators.library import KEY, latest


def _newest(columns: list[str], days: int | None):
    """Keeps a chapter's newest time and fingerprint; lets a snapshot through that is newer, one a batch."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, top = None, tuple(state.get) if state.exists else (-1 << 63, "")
        for df in batches:
            at = pd.to_datetime(df["updated_at"]).astype("datetime64[us]").astype("int64")
            for i, mine in enumerate(zip(at.tolist(), df["fingerprint"].tolist(), strict=True)):
                if mine > top:
                    best, top = df.iloc[i : i + 1], mine
        state.update(top)
        if days is not None:
            state.setTimeoutDuration(days * 86_400_000)
        if best is not None:
            yield best[columns]

    return run


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, once: bool = True, days: int | None = None) -> StreamingQuery:
    """Streams JSON snapshots (KEY, fingerprint, updated_at, …) from a folder into the table of Parquet files at target, which
    snapshots() reads. A chapter's newest snapshot so far is state, keyed by chapter; only a newer one, by updated_at, then
    fingerprint, is written, so what is written follows what is new in a batch, whatever the library's size, and repeated or late
    files change nothing. days: state of chapters that weren't seen for so long is given up (None: never); what comes again then
    is written again, and snapshots() sees to it. Rows without key, fingerprint or updated_at are left out. State is in the session's
    state store; RocksDB's holds more chapters than memory does."""
    rows = spark.readStream.schema(schema).json(source)
    whole = [*KEY, "fingerprint", "updated_at"]
    rows = rows.dropna(subset=whole)
    timeout = GroupStateTimeout.NoTimeout if days is None else GroupStateTimeout.ProcessingTimeTimeout
    new = rows.groupBy(*KEY).applyInPandasWithState(_newest(rows.columns, days), rows.schema, "at long, fingerprint string", "append", timeout)
    out = new.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()


def snapshots(spark: SparkSession, target: str) -> DataFrame:
    """The newest snapshot of each chapter."""
    return latest(spark.read.parquet(target), KEY, F.desc("updated_at"), F.desc("fingerprint"))
