"""Batch jobs as aggregates over result rows, and the queues, pages and retries around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t


def differs(a: Column, b: Column) -> Column:
    """True where two labels differ by more than case and white space at their ends."""
    return F.lower(F.trim(F.coalesce(a, F.lit("")))) != F.lower(F.trim(F.coalesce(b, F.lit(""))))


def batch_counters(rows: DataFrame, default: str = "Standard") -> DataFrame:
    """total, matched, standard, no_match, anomalies of detected rows (screen_format, fired_ai, user_format)."""
    return rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("screen_format") != default).alias("matched"), F.count_if(F.col("screen_format") == default).alias("standard"),
        F.count_if("fired_ai").alias("no_match"), F.count_if(differs(F.col("user_format"), F.col("screen_format"))).alias("anomalies"),
    )


def anomalies(rows: DataFrame) -> DataFrame:
    return rows.where(differs(F.col("user_format"), F.col("screen_format")))


def top_unmatched(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k commonest strings without a match; of equally common ones the first met."""
    found = rows.where("fired_ai").groupBy(F.lower(F.trim("amenity")).alias("string")).agg(F.count("*").alias("n"), F.min("row_id").alias("_first"))
    return found.orderBy(F.desc("n"), "_first").limit(k).drop("_first")


def pending_keys(rows: DataFrame, prefix: str = "class:v1") -> DataFrame:
    """A row for each distinct key that needs a remote answer: n_rows, first_row."""
    key = t.cache_key(prefix, F.col("amenity"), F.coalesce("circuit", F.lit("")))
    return rows.where("fired_ai").groupBy(key.alias("key")).agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_row"))


def sampled_keys(keys: DataFrame, n: int = 50) -> DataFrame:
    """The n keys met first."""
    return keys.orderBy("first_row", "key").limit(n)


def prefetched(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """keys with the payload that cache (key, payload) has for them, if any."""
    return keys.join(cache, "key", "left").withColumn("cached", F.col("payload").isNotNull())


def review_items(rows: DataFrame) -> DataFrame:
    """A pending review item for each row without a match."""
    return rows.where("fired_ai").select("row_id", F.lit("ai_suggestion").alias("type"), F.lit("pending").alias("status"), F.col("amenity").alias("string"))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    window = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def offset_page(rows: DataFrame, order: list[str], page: int, size: int) -> tuple[DataFrame, int, int]:
    """A page from 1 on, the number of rows, and of pages, which is one at least."""
    total = rows.count()
    return rows.orderBy(*order).offset((page - 1) * size).limit(size), total, max(1, -(-total // size))


def keyset_page(rows: DataFrame, key: str, after: int | None, size: int = 100) -> DataFrame:
    """The next rows by key, each with the cursor that leads on from the last row of a full page (null on the last page)."""
    page = (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(size)
    whole = Window.partitionBy()
    cursor = F.when(F.count("*").over(whole) == size, F.translate(F.base64(F.max(key).over(whole).cast("string").cast("binary")), "+/", "-_"))
    return page.withColumn("cursor", cursor)


def job_state(attempts: DataFrame) -> DataFrame:
    """job_id, total, processed, matched, failed, progress, phase from an attempt log (job_id, row_id, attempt, status).

    A row's latest attempt counts, so a row that failed and was retried well is not failed.
    """
    now = attempts.groupBy("job_id", "row_id").agg(F.max_by("status", "attempt").alias("status"))
    out = now.groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") != "pending").alias("processed"), F.count_if(F.col("status") == "completed").alias("matched"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    phase = F.when(F.col("processed") < F.col("total"), "processing").when(F.col("failed") == 0, "completed").otherwise("completed_with_errors")
    return out.withColumns({"progress": t.progress(F.col("processed"), F.col("total")), "phase": phase})


def retry_queue(attempts: DataFrame, most: int = 3) -> DataFrame:
    """job_id, row_id, attempts, queued: rows whose latest attempt failed, queued if they have had fewer than `most`."""
    now = attempts.groupBy("job_id", "row_id").agg(F.max_by("status", "attempt").alias("status"), F.max("attempt").alias("attempts"))
    return now.where("status = 'failed'").select("job_id", "row_id", "attempts", (F.col("attempts") < most).alias("queued"))


def over_limit(jobs: DataFrame, keys: DataFrame, active: tuple[str, ...] = ("queued", "processing")) -> DataFrame:
    """key_id, in_flight, refused: keys (key_id, max_jobs) whose jobs (key_id, status) in flight reach their limit."""
    n = jobs.where(F.col("status").isin(*active)).groupBy("key_id").agg(F.count("*").alias("in_flight"))
    return keys.join(n, "key_id", "left").select("key_id", F.coalesce("in_flight", F.lit(0)).alias("in_flight"), (F.coalesce("in_flight", F.lit(0)) >= F.col("max_jobs")).alias("refused"))


def stale(jobs: DataFrame, now: Column, minutes: int = 30, active: tuple[str, ...] = ("queued", "processing")) -> DataFrame:
    """jobs with status failed where they have been in flight for too long."""
    late = F.col("status").isin(*active) & (F.col("created_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return jobs.withColumn("status", F.when(late, "failed").otherwise(F.col("status")))


def bulk_approve(asked: DataFrame, items: DataFrame) -> DataFrame:
    """id, outcome: approved, not_found or already_<status>, for asked (id) against items (id, status)."""
    found = asked.select("id").distinct().join(items.select("id", "status"), "id", "left")
    return found.select("id", F.when(F.col("status").isNull(), "not_found").when(F.col("status") == "pending", "approved").otherwise(F.concat(F.lit("already_"), "status")).alias("outcome"))


def audit_entries(before: DataFrame, after: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """entity_id, action, before_json, after_json for rows that differ between two states of a table with the same columns:
    in any of them, or, if a column `version` is named that each change raises, in that one. Each row of a key that stands
    in one state more than once is compared with each of the other."""
    state = lambda df, n: df.select(F.col(key).alias("entity_id"), F.to_json(F.struct(*df.columns)).alias(f"{n}_json"), *([F.col(version).alias(f"_{n}")] if version else []))
    b, a = ("_before", "_after") if version else ("before_json", "after_json")
    both = state(before, "before").join(state(after, "after"), "entity_id", "full")
    both = both.where(F.col("before_json").isNull() | F.col("after_json").isNull() | ~F.col(b).eqNullSafe(F.col(a)))
    return both.select("entity_id", F.when(F.col("before_json").isNull(), "create").when(F.col("after_json").isNull(), "delete").otherwise("update").alias("action"), "before_json", "after_json")


def patched(mappings: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """mappings with the fields that patches sets; a patched row is pending, its version one up, unless it sets status approved."""
    fields = [c for c in patches.columns if c != key]
    p = patches.withColumnsRenamed({c: f"_{c}" for c in fields}).withColumn("_hit", F.lit(True))
    out = mappings.join(p, key, "left")
    new = {c: F.coalesce(f"_{c}", c) for c in fields if c != "status"}
    wanted = F.col("_status") if "status" in fields else F.lit(None)
    new["status"] = F.when(F.col("_hit"), F.when(wanted == "approved", "approved").otherwise("pending")).otherwise(F.col("status"))
    new["version"] = F.col("version") + F.coalesce("_hit", F.lit(False)).cast("int")
    return out.withColumns(new).select(*mappings.columns)


def row_errors(rows: DataFrame, market: str) -> DataFrame:
    """row_uuid, field, message for each failed check of submitted rows (row_uuid, movie_title, show_date, ticketing_url, country)."""
    checks = {
        "row_uuid": F.col("row_uuid").rlike("^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"),
        "show_date": F.try_to_date("show_date", "yyyy-M-d").isNotNull(),
        "ticketing_url": F.col("ticketing_url").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+"),
        "country": F.lit(market != "international") | (F.coalesce(F.trim("country"), F.lit("")) != ""),
    }
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(k).alias("field"), F.lit("invalid").alias("message"))) for k, ok in checks.items()]
    often = rows.groupBy("row_uuid").agg(F.count("*").alias("_n")).where("_n > 1")
    repeated = F.when(F.col("_n").isNotNull(), F.struct(F.lit("row_uuid").alias("field"), F.lit("repeated").alias("message")))
    return rows.join(often, "row_uuid", "left").withColumn("e", F.explode(F.array_compact(F.array(*failed, repeated)))).select("row_uuid", "e.field", "e.message")


def owned(asked: DataFrame, rows: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """asked (keys, owner) with found: whether rows have such a row of that owner. One of another owner is as unknown as none,
    so nothing is told of it. Asked twice, a row is answered once."""
    own = rows.select(*keys, owner).distinct().withColumn("found", F.lit(True))
    return asked.select(*keys, owner).distinct().join(own, [*keys, owner], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def with_cover(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """results (movie_id) with cover: that of the film in catalog (id, cover), blank without a film or a cover; of several
    rows of a film the least cover."""
    covers = catalog.where("cover is not null").groupBy(F.col("id").alias("_id")).agg(F.min("cover").alias("_cover"))
    return results.join(covers, F.col("movie_id") == F.col("_id"), "left").withColumn("cover", F.coalesce("_cover", F.lit(""))).drop("_id", "_cover")


def downloads(jobs: DataFrame, now: Column, kept: str) -> DataFrame:
    """jobs (finished TIMESTAMP) with download: not_ready until they are finished, then ok for the interval `kept`, then gone."""
    over = now > F.col("finished") + F.expr(f"INTERVAL {kept}")
    return jobs.withColumn("download", F.when(F.col("finished").isNull(), "not_ready").when(over, "gone").otherwise("ok"))
