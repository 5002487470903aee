"""Bounded samples of labelled rows, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One part in so many of a sample is drawn of each label value at least.
RARE = 10


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def share_below(key: Column, share: float) -> Column:
    """True for about that share of all keys, the same ones in every run."""
    return F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int, label: str = "quality", learn: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> list:
    """About `most` rows (text, label), one a doc_id, and about most / RARE at least of each label value that has so many.

    label 1 wins where an id has several labels, the text of the least hash where it has several texts. Values come by
    their share, but for rare ones. Only ids of the sample are broadcast, to the tasks that scan docs. learn: a condition
    on labels' doc_id. A ValueError says that a value which documents have was not drawn.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = (known if learn is None else known.where(learn)).groupBy("doc_id").agg(F.max(label).alias("label")).join(texts.select("doc_id"), "doc_id", "left_semi")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    drawn = F.lit(False)
    for value, n in counts.items():
        drawn |= (F.col("label") == value) & share_below(F.col("doc_id"), min(1.0, max(most / sum(counts.values()), most / RARE / n)))
    some = known.where(drawn).limit(2 * most)
    rows = texts.join(F.broadcast(some), "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    found = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label")).select("text", "label").collect()
    if missing := set(counts) - {r["label"] for r in found}:
        raise ValueError(f"no document of label {sorted(missing)} was drawn")
    return found
