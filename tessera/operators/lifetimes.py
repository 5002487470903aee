"""Answers kept for a time to live: each row of a key is answered by the row that began its present lifetime."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.written import cut


def _starts(micros: int):
    """Times (key, at) sorted by key, then time, to those that begin a lifetime: the first of a key, then each first one
    that is at least `micros` after the last beginning. Only a key and a time are held, however many rows a key has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, until = None, 0
        for batch in batches:
            keys = batch.column(0)
            at = batch.column(1).to_numpy(zero_copy_only=False)
            codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]]) if len(codes) else [0]
            kept: list[int] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = keys[int(a)].as_py()
                if key != own:
                    own, until = key, -(1 << 62)
                i = int(a) + int(np.searchsorted(at[a:b], until))
                while i < b:
                    kept.append(i)
                    until = int(at[i]) + micros
                    i += int(np.searchsorted(at[i:b], until))
            yield batch.take(pa.array(kept, pa.int64()))

    return run


def answered(rows: DataFrame, key: Column, at: Column, order: str, answer: Column, seconds: int, name: str = "cache") -> DataFrame:
    """rows with a struct column `name`: started (TIMESTAMP), answer and hit.

    Rows of a key come in order of their time, then of the column `order`. The first one is a miss: its own answer is kept
    for `seconds`, and rows before that is over are hits that get it; the next row begins anew. A hit doesn't lengthen
    the time. Rows without a key or a time are misses with their own answer and nothing is kept of them.

    Lifetimes form a chain, so a key's distinct times pass in order through one task that holds only the last beginning.
    Rows meet the beginning that covers them by key and stretch of time, so a key with a third of all rows isn't one
    task's there. Repeated rows and ties in time are hits of the first by `order`.
    """
    micros = seconds * 1_000_000
    base = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), key.alias("key"), F.unix_micros(at.cast("timestamp")).alias("at"), F.col(f"`{order}`").alias("order"), answer.alias("answer"))
    kept = base.where("key is not null and at is not null")
    times = kept.groupBy("key", "at").agg(F.min(F.struct("order", "answer")).alias("first"))
    times = cut(times, "key-times")
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = times.select("key", "at").schema
    starts = times.select("key", "at").repartition(tasks, "key").sortWithinPartitions("key", "at").mapInArrow(_starts(micros), schema)
    starts = starts.join(times, ["key", "at"]).select("key", F.col("at").alias("started"), F.col("first.order").alias("first_order"), F.col("first.answer").alias("kept"))
    # a lifetime lies in the stretch of its beginning and the next one
    stretch = lambda c: F.floor(F.col(c) / F.lit(micros)).cast("long")
    posted = starts.withColumn("stretch", F.explode(F.array(stretch("started"), stretch("started") + 1)))
    met = kept.withColumn("stretch", stretch("at")).join(posted, ["key", "stretch"]).where((F.col("started") <= F.col("at")) & (F.col("at") < F.col("started") + micros))
    miss = (F.col("at") == F.col("started")) & F.col("order").eqNullSafe(F.col("first_order"))
    found = met.select("row", F.struct(F.timestamp_micros("started").alias("started"), F.col("kept").alias("answer"), (~miss).alias("hit")).alias("cache"))
    alone = base.where("key is null or at is null").select("row", F.struct(F.timestamp_micros("at").alias("started"), "answer", F.lit(False).alias("hit")).alias("cache"))
    return found.unionByName(alone).select("row.*", F.col("cache").alias(name))
