"""Mixing sources to target weights by Efraimidis-Spirakis keys, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import cut

#: Words of the texts that go to one bucket of sampling keys, about.
BUCKET_WORDS = 2_000_000


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def unit_draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1), the same for the same id, text and seed in every run."""
    joined = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return (F.conv(F.substring(F.md5(joined), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """sizes (source, source_size) with a target for each: share times all sizes, split by weight.

    Sources in code point order, null last, take the weights in turn. A target stops at epochs times its source's size
    and what it can't take goes to the others by weight, until none is above. The end of that process is one level L:
    each target is least(weight * L, cap). With sources sorted by cap / weight, L is the first at which the next source
    is not full, so running sums over the table of sources give it at once; for the sources after it the same sums only fall.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % n + 1)
    base = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(epochs))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    open_at = base.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything))
    # no such source: every one is full
    return open_at.select("source", "source_size", F.least(F.coalesce(F.col("weight") * F.col("level"), F.col("cap")), F.col("cap")).alias("target"))


def _keyed(docs: DataFrame, quality: Column | None, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """_row (all columns of docs), _id, _source, _size and _key of each row; no column of docs can clash with these."""
    columns = [F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.col(source).alias("_source"), F.col(text).alias("_text")]
    out = docs.select(*columns, *([quality.alias("_good")] if quality is not None else [])).withColumn("_size", word_count(F.col("_text")))
    good = F.col("_good") if quality is not None else F.greatest(F.lit(0.05), 1 - F.col("_size") / (F.length("_text") + 1))
    key = -F.log(unit_draw(F.col("_id"), F.col("_text"), seed)) / F.coalesce(good, F.lit(0.05))
    return out.select("_row", "_id", "_source", "_size", key.alias("_key"))


def _bucket() -> Column:
    # the share of exponential draws below a key, at a rate of 0.8: any increasing function would do
    return F.floor((1 - F.exp(F.col("_key") * F.lit(-0.8))) * F.col("buckets"))


def _plan(drawn: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """A row per source: s, source_size, target, whole (complete epochs), buckets, edge and last, the last document taken
    once more, if any, by (_key, _id, _size) in bucket edge; most of the tied rows that are like last are taken, few of them.

    Equal rows are counted before they are sorted, so any number of them is one row of the window."""
    sizes = targets(drawn.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sizes = sizes.withColumnRenamed("source", "s").withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sizes = cut(sizes.withColumn("buckets", F.ceil(F.col("source_size") / BUCKET_WORDS).cast("long")), "sources")
    placed = drawn.join(sizes, F.col("_source").eqNullSafe(F.col("s"))).where("rest > 0").withColumn("bucket", _bucket())
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("s", "bucket").agg(F.sum("_size").alias("words"), F.first("rest").alias("rest"))
    totals = totals.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    # the bucket in which the rest ends: earlier buckets are taken whole, later ones are not touched
    edge = totals.where("before <= rest and before + words >= rest").groupBy("s").agg(F.min_by(F.struct("bucket", "before"), "bucket").alias("e"))
    edge = cut(edge.select(F.col("s").alias("t"), F.col("e.bucket").alias("edge"), F.col("e.before").alias("before")), "edges")
    inside = placed.join(edge, F.col("s").eqNullSafe(F.col("t")) & (F.col("bucket") == F.col("edge")))
    groups = inside.groupBy("t", "bucket", "rest", "before", "_key", "_id", "_size").agg(F.count("*").alias("tied"))
    earlier = Window.partitionBy("t", "bucket").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("start", F.col("before") + F.coalesce(F.sum(F.col("_size") * F.col("tied")).over(earlier), F.lit(0)))

    def fits(n: Column) -> Column:  # the middle of the n-th of a group's rows is not beyond the rest
        return F.col("start") + (n - 1) * F.col("_size") + F.col("_size") / 2 <= F.col("rest")

    about = F.when(F.col("_size") > 0, F.floor((F.col("rest") - F.col("start")) / F.col("_size") + 0.5)).otherwise(F.col("tied"))
    some = F.when(fits(about + 1), about + 1).when(fits(about), about).otherwise(about - 1)  # whatever the division rounds to
    groups = groups.withColumn("few", F.least(some, F.col("tied")).cast("long")).where(F.col("few") > 0)
    last = groups.groupBy("t").agg(F.max(F.struct("_key", "_id", "_size", "tied", "few")).alias("l"))
    last = last.select(F.col("t").alias("t2"), F.struct("l._key", "l._id", "l._size").alias("last"), "l.tied", "l.few")
    plan = sizes.join(edge, F.col("s").eqNullSafe(F.col("t")), "left").join(last, F.col("s").eqNullSafe(F.col("t2")), "left")
    return cut(plan.select("s", "source_size", "target", "whole", "buckets", "edge", "last", "tied", "few"), "plan")


def _picks(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """keyed with the columns of plan and picks, the times a document is taken."""
    placed = keyed.join(plan, F.col("_source").eqNullSafe(F.col("s"))).withColumn("bucket", _bucket())
    own = F.struct("_key", "_id", "_size")
    before = F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)) | F.coalesce((F.col("bucket") == F.col("edge")) & (own < F.col("last")), F.lit(False))
    level = F.coalesce((F.col("bucket") == F.col("edge")) & (own == F.col("last")), F.lit(False))
    picked = placed.withColumn("picks", F.col("whole") + (before | level).cast("long"))
    if plan.where("few < tied").isEmpty():
        return picked
    # equal rows of which some are taken: a written table numbers them, running sums over its parts deal out the places
    parted = F.coalesce(level & (F.col("few") < F.col("tied")), F.lit(False))
    ties = cut(placed.where(parted).withColumn("n", F.monotonically_increasing_id()), "ties").withColumn("part", F.shiftright("n", 33))
    upto = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ties.groupBy("s", "part").agg(F.count("*").alias("c")).withColumn("skip", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    parts = parts.select(F.col("s").alias("t"), F.col("part").alias("p"), "skip")
    place = F.col("skip") + F.row_number().over(Window.partitionBy("s", "part").orderBy("n"))
    dealt = ties.join(parts, F.col("s").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p"))).withColumn("picks", F.col("whole") + (place <= F.col("few")).cast("long"))
    return picked.where(~parted).unionByName(dealt.select(*picked.columns))


def mixed(docs: DataFrame, quality: Column | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 20, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and picks, the times it is taken.

    A source's target pays for as many complete epochs as fit; the rest goes to documents by the smallest keys
    -ln(u) / quality, an exponential draw whose rate is the document's quality (Efraimidis and Spirakis, 2006), up to
    the document whose end is nearest to the rest. quality: a positive column; by default the share of a text's
    characters that are in words. Keys fall into buckets of much the same number of words; running sums over buckets
    find the one in which a source's rest ends, and only that bucket is sorted, so a source of any size spreads over
    all tasks. Null texts have size 0; a null source is one source. Equal rows draw equal keys; where the rest ends among
    them, as many of them are taken as fit. Texts of any length are counted whole. Further columns of docs, whatever
    their names, take no part. An empty table gives an empty one.
    """
    keyed = _keyed(docs, quality, doc_id, text, source, seed)
    drawn = cut(keyed.select("_id", "_source", "_size", "_key"), "keys")
    out = _picks(drawn, _plan(drawn, weights, share, epochs))
    return out.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("picks")).alias("taken"), "picks")


def mix(docs: DataFrame, quality: Column | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 20, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """The mix itself: each row of docs as often as `mixed` picks it, all columns unchanged, whatever their names."""
    keyed = _keyed(docs, quality, doc_id, text, source, seed)
    drawn = cut(keyed.select("_id", "_source", "_size", "_key"), "keys")
    out = _picks(keyed, _plan(drawn, weights, share, epochs)).where("picks > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("picks")))).select("_row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents
), k AS (
  SELECT doc_id, source, size,
    -ln((CAST(('0x' || substr(md5('20|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
      / coalesce(greatest(0.05::DOUBLE, 1.0::DOUBLE - size / (CAST(length(text) AS DOUBLE) + 1)), 0.05::DOUBLE) AS key
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ([3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY source_size * 2.0::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(coalesce(weight * max(CASE WHEN level <= cap / weight THEN level END) OVER (), cap), cap) AS target FROM f
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), p AS (
  SELECT k.doc_id, k.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN w ON k.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN rest > 0 AND start + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p
"""
