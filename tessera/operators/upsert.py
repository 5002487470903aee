"""Upserts as full outer joins of a table and its changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All rows of table after changes, with an action (inserted, updated or kept) and n_changes, the changes of its keys,
    of which the last by order counts.

    Keys meet null-safe. Changes have the columns of table and order. The last change of a key is found by a partial
    aggregate, so any number of changes may share one.
    """
    values = [c for c in table.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_new"), F.count("*").alias("_n"))
    own = table.select(*(F.col(c).alias(f"_{c}") for c in keys), F.struct(*values).alias("_old"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys))
    both = last.join(own, same, "full")
    isold, isnew = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    action = F.when(isold & isnew, "updated").when(isnew, "inserted").otherwise("kept")
    return both.select(*(F.when(isnew, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in keys), *(F.when(isnew, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in values), action.alias("action"), F.coalesce(F.col("_n"), F.lit(0)).alias("n_changes"))


def counts(after: DataFrame, raw: DataFrame, skipped: Column, undefined: Column | None = None) -> DataFrame:
    """inserted, updated, skipped and skipped_undefined of an upsert: each change counts, as if they came one by one."""
    number = {"inserted": F.col("action") == "inserted", "updated": F.col("action") == "updated"}
    again = F.when(number["updated"], F.col("n_changes")).when(number["inserted"], F.col("n_changes") - 1).otherwise(0)
    none = F.lit(False) if undefined is None else F.coalesce(undefined, F.lit(False))
    zero = F.lit(0).cast("long")
    done = after.select(number["inserted"].cast("long").alias("inserted"), again.cast("long").alias("updated"), zero.alias("skipped"), zero.alias("skipped_undefined"))
    left = raw.select(zero.alias("inserted"), zero.alias("updated"), (~none & skipped).cast("long").alias("skipped"), none.cast("long").alias("skipped_undefined"))
    return done.unionByName(left).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("inserted", "updated", "skipped", "skipped_undefined")))


def not_indexed(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """The rows whose key the index has not."""
    return rows.join(index.select(key), key, "left_anti")
