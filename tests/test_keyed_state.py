"""Lifetimes of cached answers and snapshots kept by streams, against plain folds."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import lifetimes, upsert
from tessera.streaming import cached, snapshots

START = dt.datetime(2024, 1, 1)


def fold(rows, seconds):
    """(id, started, answer, hit) of rows (id, key, time, answer)."""
    now, out = {}, []
    for row_id, key, at, answer in sorted(rows, key=lambda r: (r[2] or START, r[0])):
        if key is None or at is None:
            out.append((row_id, at, answer, False))
            continue
        if key in now and at < now[key][0] + dt.timedelta(seconds=seconds):
            out.append((row_id, *now[key], True))
        else:
            now[key] = (at, answer)
            out.append((row_id, at, answer, False))
    return sorted(out, key=repr)


def requests(rng, n, keys=4):
    rows, at = [], START
    for k in range(n):
        at += dt.timedelta(seconds=rng.choice([0, 0, 1, 5, 30, 90]), microseconds=rng.choice([0, 1, 500_000]))
        rows.append((k, f"key{min(int(rng.paretovariate(0.6)), keys)}", at, f"answer {k}"))
    return rows


@pytest.mark.parametrize("seconds", [1, 60, 3600])
def test_table(spark, seconds):
    rows = requests(random.Random(seconds), 600) + [(9000, None, START, "x"), (9001, "key1", None, "y"), (9002, None, None, None)]
    df = spark.createDataFrame(rows, "id long, key string, at timestamp, answer string").withColumn("hit", F.lit(7)).repartition(5)
    out = lifetimes.answered(df, F.col("key"), F.col("at"), "id", F.col("answer"), seconds)
    assert out.columns == ["id", "key", "at", "answer", "hit", "cache"]
    got = sorted(((r["id"], r["cache"]["started"], r["cache"]["answer"], r["cache"]["hit"]) for r in out.collect()), key=repr)
    assert got == fold(rows, seconds)
    assert lifetimes.answered(df.limit(0), F.col("key"), F.col("at"), "id", F.col("answer"), seconds).count() == 0


def test_repeated_rows_and_a_hot_key(spark):
    """A third of all rows, and then some, in one key with many equal times."""
    rows = [(k, "hot", START + dt.timedelta(seconds=k // 400), f"a{k}") for k in range(8000)] + [(5, "hot", START, "a5")]
    df = spark.createDataFrame(rows, "id long, key string, at timestamp, answer string")
    out = lifetimes.answered(df, F.col("key"), F.col("at"), "id", F.col("answer"), 7)
    assert out.count() == 8001
    assert [r[0] for r in out.where("not cache.hit").select("id").orderBy("id").collect()] == [0, 2800, 5600]


def test_stream_by_replay(spark, tmp_path):
    rng = random.Random(9)
    rows = requests(rng, 300)
    schema = "id long, key string, at timestamp, answer string"
    closing = [(-1, "end", rows[-1][2] + dt.timedelta(days=3), "z"), (-2, "end", rows[-1][2] + dt.timedelta(days=6), "z")]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = cached.answered(source, F.col("key"), F.col("at"), "id", F.col("answer"), 60)
    for k, part in enumerate([rows[:100], rows[100:130], rows[130:], closing[:1], closing[1:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).where("id >= 0").select("id", "started", "answer", "hit").collect()), key=repr)
    assert got == fold(rows, 60)


def changes(rng, a, b):
    return [(rng.randrange(40), rng.choice(["x", "y", None]), f"v{k}", k) for k in range(a, b)]


def shown(df):
    return sorted((tuple(r) for r in df.select("id", "country", "value").collect()), key=repr)


def test_a_chunk_that_fails_half_way_counts_once(spark, tmp_path):
    rng = random.Random(2)
    kind = "id long, country string, value string, n long"
    parts = [changes(rng, 0, 60), changes(rng, 60, 90), changes(rng, 90, 200)]
    table = snapshots.Snapshots(spark, str(tmp_path / "table"), ["id", "country"], "n", parts=5)
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    assert table.table() is None and table.counters().count() == 0
    for k, part in enumerate(parts):
        spark.createDataFrame(part, kind).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 1:

            def broken(df, chunk):
                table.merge(df, chunk, before_commit=lambda: (_ for _ in ()).throw(RuntimeError("lost")))

            before = shown(table.table())
            query = source.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(broken).trigger(availableNow=True).start()
            with pytest.raises(Exception, match="lost"):
                query.awaitTermination(120)
            assert shown(table.table()) == before
        snapshots.keep_current(source, table, str(tmp_path / "c")).awaitTermination(120)
    every = spark.createDataFrame([c for p in parts for c in p], kind)
    whole = upsert.merged(spark.createDataFrame([], "id long, country string, value string"), every, ["id", "country"], "n")
    assert shown(table.table()) == shown(whole)
    last = table.counters().orderBy(F.desc("chunk")).first()
    assert (last["all_inserted"], last["all_updated"]) == (whole.count(), 200 - whole.count()) and last["chunk"] == 2
    table.merge(every, 1)  # handed out again
    assert shown(table.table()) == shown(whole)
    assert table.clean() > 0 and table.clean() == 0 and shown(table.table()) == shown(whole)


def test_an_empty_chunk(spark, tmp_path):
    table = snapshots.Snapshots(spark, str(tmp_path / "t"), ["id"], "n")
    kind = "id long, v string, n long"
    table.merge(spark.createDataFrame([], kind), 0)
    assert table.table().count() == 0
    table.merge(spark.createDataFrame([(None, "a", 1), (None, "b", 2)], kind), 1)
    assert [tuple(r) for r in table.table().collect()] == [(None, "b")]
