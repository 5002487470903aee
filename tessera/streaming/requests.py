"""Streams of requests: a limit a minute, answers remembered for a time, and ingest in chunks with running counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_minute(requests: DataFrame, most: int, late: str = "5 minutes", key: str = "user_id", time: str = "ts") -> DataFrame:
    """key, minute, n, refused of requests, a stream or a table: refused is how many of a minute are over the limit.

    A stream drops what comes later than `late` and emits a minute when it is over; its state is one row a key and
    open minute.
    """
    if requests.isStreaming:
        requests = requests.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    n = requests.groupBy(key, F.window(time, "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return n.select(key, F.col("w.start").alias("minute"), "n", F.greatest(F.col("n") - most, F.lit(0).cast("long")).alias("refused"))


def first_within(requests: DataFrame, keys: list[str], ttl: str = "30 days", time: str = "ts") -> DataFrame:
    """A stream with one row of each key within a time to live; the state of a key goes when its time is over."""
    return requests.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)


def chunked(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands each chunk of a stream to write(chunk, number), once each after a restart if write is idempotent."""
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
