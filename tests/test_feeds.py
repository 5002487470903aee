"""Uploads, verdicts and streams on small cases with known answers."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieve, upsert, verdicts, web
from tessera.sources import files
from tessera.streaming import requests


def test_upload_checks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf Title ,SHOW_DATE,ticketing_url\r\n\"A \"\"b\"\", c\",2024-01-02,\r\nx\xff,,u\r\n")
    df = files.title_upload(files.read_csv(spark, str(tmp_path / "a.csv")))
    rows = df.orderBy("row_index").select(*[c.alias(n) for n, c in files.upload_fields(df).items()]).collect()
    assert [r["show_date"] for r in rows] == ["2024-01-02", ""] and rows[0]["movie_title"] == 'A "b", c' and rows[1]["movie_title"] == "x\ufffd"
    with pytest.raises(ValueError, match="country"):
        files.title_upload(files.read_csv(spark, str(tmp_path / "a.csv")), "international")
    with pytest.raises(ValueError, match="ticketing_url"):
        files.title_upload(files.read_csv(spark, str(tmp_path / "a.csv")).drop("ticketing_url"))
    with pytest.raises(ValueError, match="more than 1 rows"):
        files.title_upload(files.read_csv(spark, str(tmp_path / "a.csv")), most=1)


def test_upsert_takes_the_last_change_and_meets_null_keys(spark):
    table = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "id long, day string, v string")
    changes = spark.createDataFrame([(1, None, "c", 1), (1, None, None, 2), (3, None, "d", 3), (2, None, "e", 4)], "id long, day string, v string, n long")
    got = {(r["id"], r["day"]): (r["v"], r["action"]) for r in upsert.merged(table, changes, ["id", "day"], "n").collect()}
    assert got == {(1, None): (None, "updated"), (2, "x"): ("b", "kept"), (3, None): ("d", "inserted"), (2, None): ("e", "inserted")}


def test_verdicts(spark):
    results = spark.createDataFrame([(k, 7, "seven", 0.8, d) for k, d in enumerate(["REVIEW", "REVIEW", "REVIEW_NON_MOVIE", "AUTO_ACCEPT", "REVIEW", "REVIEW"])], "query_id long, movie_id long, title string, confidence double, decision string")
    told = spark.createDataFrame([(0, "CONFIRM", 7, None, 0.99), (1, "OVERRULE", 8, "eight", 0.91), (2, "CONFIRM", 7, None, 0.95), (3, "NO_DB_MATCH", None, "", 0.5), (4, "OVERRULE", 99, "x", 0.9)], "query_id long, verdict string, verdict_id long, verdict_title string, verdict_confidence double")
    films = spark.createDataFrame([(k, m) for k in range(6) for m in (7, 8)], "query_id long, movie_id long")
    got = [tuple(r) for r in verdicts.verified(results, told, films).orderBy("query_id").collect()]
    assert got == [
        (0, 7, "seven", 0.97, "AUTO_ACCEPT", "CONFIRM"), (1, 8, "eight", 0.91, "AUTO_ACCEPT", "OVERRULE"), (2, 7, "seven", 0.95, "REVIEW_NON_MOVIE", "CONFIRM"),
        (3, 0, "seven", 0.5, "AUTO_ACCEPT", "NO_DB_MATCH"), (4, 7, "seven", 0.8, "REVIEW", "discarded"), (5, 7, "seven", 0.8, "REVIEW", "none"),
    ]


def test_netloc_and_posters(spark):
    df = spark.createDataFrame([("https://WWW.viff.org/x", "a"), ("http://viff.org:80/", "NoImage"), (None, None), ("viff.org", " ")], "url string, cover string")
    got = web.routed(df).select("platform", web.poster_available(F.col("cover")).alias("p")).collect()
    assert sorted(map(tuple, got)) == [("GENERIC", False)] * 3 + [("VIFF", True)]


def test_streams_by_replay(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).orderBy("ts").limit(300)
    last = events.agg(F.max("ts")).first()[0]
    closing = spark.createDataFrame([(-1, -1, last + dt.timedelta(days=100))], events.schema)
    for k, part in enumerate([events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), closing]):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = requests.per_minute(source, 1, "30 days").writeStream.format("memory").queryName("minutes").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = sorted(map(tuple, requests.per_minute(events, 1).collect()))
    assert sorted(map(tuple, spark.table("minutes").where("user_id >= 0").collect())) == want
    query = requests.first_within(source, ["user_id"], "90 days").writeStream.format("memory").queryName("firsts").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("firsts").where("user_id >= 0").count() == events.select("user_id").distinct().count()
    sizes = []
    requests.chunked(source, lambda df, n: sizes.append((n, df.count())), str(tmp_path / "c3")).awaitTermination(120)
    assert sum(c for _, c in sizes) == 301 and len(sizes) == 3


def test_nearest_in_blocks_is_the_same(spark, sf_dir, monkeypatch):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    find = lambda: sorted((r["query_id"], r["id"], r["rank"]) for r in retrieve.nearest(q, v, 3).collect())
    whole = find()
    monkeypatch.setattr(retrieve, "NEAREST_BLOCK", 3)
    assert find() == whole and len(whole) == 3 * q.count()
