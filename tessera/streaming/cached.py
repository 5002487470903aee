"""Answers kept for a time to live on a stream, with the answer in the state of its key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _fold(micros: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["at", "id"], kind="stable", ignore_index=True)
        started, kept = state.get if state.exists else (None, None)
        out = []
        for at, row_id, own in zip(rows["at"], rows["id"], rows["answer"], strict=True):
            if started is not None and started <= at < started + micros:
                out.append((row_id, started, kept, True))
            elif started is None or at >= started + micros:
                started, kept = int(at), own
                out.append((row_id, started, kept, False))
            else:
                out.append((row_id, int(at), own, False))  # from before what is kept now
        state.update((started, kept))
        over = (started + micros) // 1000 + 1
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "started", "answer", "hit"])

    return run


def answered(rows: DataFrame, key: Column, at: Column, row_id: str, answer: Column, seconds: int, late: str = "10 minutes") -> DataFrame:
    """id, started (TIMESTAMP), answer, hit for each row of a stream, as operators.lifetimes.answered has them for a table.

    The state of a key is the beginning of its present lifetime and the answer that it keeps; it goes when the watermark
    has passed its end. Rows of a micro-batch are taken in order of their time, then id; a row that comes after a later one
    of another lifetime is a miss with its own answer. Rows without a key, a time or an id are left out.
    """
    time = at.cast("timestamp")
    base = rows.select(key.cast("string").alias("key"), time.alias("time"), F.unix_micros(time).alias("at"), F.col(f"`{row_id}`").cast("long").alias("id"), answer.cast("string").alias("answer"))
    base = base.where("key is not null and at is not null and id is not null").withWatermark("time", late)
    found = base.groupBy("key").applyInPandasWithState(_fold(seconds * 1_000_000), "id long, started long, answer string, hit boolean", "started long, answer string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("started", F.timestamp_micros("started"))
