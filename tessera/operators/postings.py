"""Row lists of keys in pieces of bounded size, and answers fanned out by piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Row ids of a piece, at most.
PIECE = 1000


def posted(rows: DataFrame, key: Column, row_id: Column, size: int = PIECE) -> DataFrame:
    """key, bucket, piece, rows ARRAY of the row ids of each key, in pieces of `size` at most, each id once.

    The rows of a key are dealt over buckets by a hash, as many as leave about half of `size` to each, so that a key that
    half of all rows have is many groups of like size; a bucket that got more is cut into pieces. A null key is a key.
    """
    base = rows.select(key.alias("key"), row_id.alias("row_id")).distinct()
    counts = base.groupBy("key").agg(F.count("*").alias("n"))
    dealt = base.join(counts.withColumnRenamed("key", "_k"), F.col("key").eqNullSafe(F.col("_k")))
    bucket = F.when(F.col("n") <= size, 0).otherwise(F.pmod(F.xxhash64("row_id", F.lit(21)), F.ceil(F.col("n") * 2 / size)))
    lists = dealt.select("key", bucket.cast("long").alias("bucket"), "row_id").groupBy("key", "bucket").agg(F.sort_array(F.collect_list("row_id")).alias("all"))
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / size).cast("int")), lambda k: F.struct(k.alias("piece"), F.slice("all", k * size + 1, F.lit(size)).alias("rows")))
    return lists.select("key", "bucket", F.explode(cuts).alias("p")).select("key", "bucket", "p.piece", "p.rows")


def answered(pieces: DataFrame, answers: DataFrame) -> DataFrame:
    """row_id and the columns of answers (key, ...; one row a key) for each row of the pieces; null where a key has none.

    An answer meets pieces, not rows: a key with a million rows is looked up a thousand times or so.
    """
    kept = [c for c in answers.columns if c != "key"]
    met = pieces.join(answers.withColumnRenamed("key", "_k"), F.col("key").eqNullSafe(F.col("_k")), "left")
    return met.select("key", F.explode("rows").alias("row_id"), *kept)
