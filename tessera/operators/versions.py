"""Rows under the version of a table that was valid at their time: an as-of join, and dictionaries that change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t

#: Seconds of a stretch of time; a key's rows of one stretch are looked up together.
STRETCH = 24 * 3600


def asof(rows: DataFrame, versions: DataFrame, key: str, at: str, name: str = "version", stretch: int = STRETCH) -> DataFrame:
    """rows (key, at, ...) with a struct column `name`: the row of versions (key, at, ...) of the same key with the greatest
    time that isn't after theirs, null where there is none.

    Of versions of equal key and time, the greatest row of their other columns counts. Rows or versions without a key or
    a time meet nothing. A key's time is cut into stretches: the version in force at the beginning of each stretch that
    has rows is found first, from versions and stretches alone, and then each stretch is a group of its own. So a key with
    a third of all rows is spread over its stretches, and no range of versions meets a range of rows.
    """
    micros = stretch * 1_000_000
    part = lambda c: F.floor(c / F.lit(micros)).cast("long")
    others = [c for c in versions.columns if c not in (key, at)]
    body = F.struct(F.col(f"`{at}`"), *[F.col(f"`{c}`") for c in others])
    v = versions.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{at}`").isNotNull())
    v = v.groupBy(F.col(f"`{key}`").alias("_k"), F.unix_micros(F.col(f"`{at}`").cast("timestamp")).alias("_t")).agg(F.max(body).alias("_v"))
    r = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.col(f"`{key}`").alias("_k"), F.unix_micros(F.col(f"`{at}`").cast("timestamp")).alias("_t"))
    r = r.withColumn("_s", part(F.col("_t")))
    asked = r.where("_k is not null and _t is not null").select("_k", "_s").distinct()
    # versions before a stretch: one row a stretch and key among the versions of the key
    line = v.select("_k", "_t", "_v", F.lit(None).cast("long").alias("_s")).unionByName(asked.select("_k", (F.col("_s") * micros).alias("_t"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v"), "_s"))
    # at the very beginning of a stretch its own versions come within it
    past = Window.partitionBy("_k").orderBy("_t", F.col("_s").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    carried = line.withColumn("_v", F.when(F.col("_s").isNotNull(), F.last("_v", ignorenulls=True).over(past))).where("_s is not null").select("_k", "_s", (F.col("_s") * micros - 1).alias("_t"), "_v")
    posted = v.withColumn("_s", part(F.col("_t"))).join(asked, ["_k", "_s"], "left_semi").select("_k", "_s", "_t", "_v").unionByName(carried)
    both = r.select("_row", "_k", "_s", "_t", F.lit(None).cast(v.schema["_v"].dataType).alias("_v")).unionByName(posted.select(F.lit(None).cast(r.schema["_row"].dataType).alias("_row"), "_k", "_s", "_t", "_v"))
    # a version counts for rows of its own time
    order = Window.partitionBy("_k", "_s").orderBy("_t", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_v", F.last("_v", ignorenulls=True).over(order)).where("_row is not null")
    return met.select("_row.*", F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), F.col("_v")).alias(name))


def history(changes: DataFrame) -> DataFrame:
    """key, at, id, keyword, format, live of a dictionary's changes (id, at, action, keyword, format): what each change made
    of the entries of its normal form.

    Actions are those of the mapping service: create and update leave an entry pending, approve makes it live, reject and
    delete end it. approve, reject and delete need no keyword: that of the entry's last create or update holds.
    """
    order = Window.partitionBy("id").orderBy("at", F.expr("array_position(array('create', 'update', 'approve', 'reject', 'delete'), action)")).rowsBetween(Window.unboundedPreceding, 0)
    rows = changes.withColumn("keyword", F.last("keyword", ignorenulls=True).over(order)).withColumn("format", F.last("format", ignorenulls=True).over(order))
    return rows.select(t.light(F.col("keyword")).alias("key"), "at", "id", "keyword", "format", (F.col("action") == "approve").alias("live")).where("key is not null")


def detected_at(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """rows (text, at, ...) with format: that of the dictionary entry of their normal form as it was at their time.

    A form's last change decides: it gives a format if the change made its entry live, null otherwise. A null or blank text
    has none.
    """
    asked = rows.withColumn("_key", F.nullif(t.light(F.col("text")), F.lit("")))
    found = asof(asked, history(changes).withColumnRenamed("key", "_key"), "_key", "at", "_version")
    return found.withColumn("format", F.when(F.col("_version.live"), F.col("_version.format"))).drop("_key", "_version")
