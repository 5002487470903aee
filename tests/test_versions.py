"""As-of joins and changing dictionaries against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import versions

START = dt.datetime(2024, 3, 1)


def times(rng, n):
    return [START + dt.timedelta(seconds=rng.randrange(-50, 4000), microseconds=rng.choice([0, 0, 1])) for _ in range(n)]


@pytest.mark.parametrize("stretch", [1, 60, 100_000])
def test_asof(spark, stretch):
    rng = random.Random(stretch)
    keys = ["a", "a", "a", "b", "c", None]
    v = [(rng.choice(keys), at, k, f"v{k}") for k, at in enumerate(times(rng, 60))] + [("b", None, 900, "x"), ("a", START, 901, "p"), ("a", START, 902, "q")]
    r = [(k, rng.choice(keys + ["d"]), at) for k, at in enumerate(times(rng, 400))] + [(1000, "a", None), (1001, "a", START), (1002, "a", v[0][1])]
    left = spark.createDataFrame(r, "n long, key string, at timestamp").repartition(5)
    right = spark.createDataFrame(v, "key string, at timestamp, id long, name string").repartition(3)
    got = {x["n"]: x["version"] and (x["version"]["at"], x["version"]["id"], x["version"]["name"]) for x in versions.asof(left, right, "key", "at", stretch=stretch).collect()}
    want = {}
    for n, key, at in r:
        fits = [(a, k, name) for own, a, k, name in v if own is not None and own == key and a is not None and at is not None and a <= at]
        want[n] = max(fits) if fits else None
    assert got == want and len(got) == len(r)
    assert versions.asof(left.limit(0), right, "key", "at").count() == 0
    assert versions.asof(left, right.limit(0), "key", "at").where("version is not null").count() == 0


def test_a_dictionary_that_changes(spark):
    day = lambda n: START + dt.timedelta(days=n)
    changes = [
        (1, day(0), "create", "IMAX", "IMAX"), (1, day(2), "approve", None, None), (1, day(5), "update", "IMAX", "IMAX 3D"), (1, day(6), "approve", None, None), (1, day(9), "delete", None, None),
        (2, day(1), "create", "Dolby ®", "Dolby"), (2, day(1), "approve", None, None), (2, day(3), "reject", None, None),
    ]
    table = spark.createDataFrame(changes, "id long, at timestamp, action string, keyword string, format string")
    asked = [(k, text, day(k)) for text in ("imax", " DOLBY") for k in range(11)] + [(50, None, day(4)), (51, " ", day(4)), (52, "other", day(4))]
    rows = spark.createDataFrame(asked, "n long, text string, at timestamp")
    got = {(r["text"], r["n"]): r["format"] for r in versions.detected_at(rows, table).collect()}
    want = {("imax", k): "IMAX" if 2 <= k < 5 else "IMAX 3D" if 6 <= k < 9 else None for k in range(11)} | {(" DOLBY", k): "Dolby" if 1 <= k < 3 else None for k in range(11)}
    assert got == want | {(None, 50): None, (" ", 51): None, ("other", 52): None}


def test_a_hot_key_is_spread(spark):
    rows = spark.range(20_000).select(F.col("id").alias("n"), F.lit("hot").alias("key"), F.timestamp_seconds(F.col("id") * 60).alias("at"))
    v = spark.range(0, 20_000, 500).select(F.lit("hot").alias("key"), F.timestamp_seconds(F.col("id") * 60).alias("at"), "id")
    out = versions.asof(rows, v, "key", "at")
    assert out.where("version.id <> n - n % 500").count() == 0 and out.count() == 20_000
