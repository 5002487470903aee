"""The best titles by weighted ratio, exactly, scoring only pairs whose upper bound can still enter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.fuzzy import wratio
from tessera.operators.written import cut

#: Letters fall into so many classes; equal letters are of one class, so shared classes bound shared letters, in any script.
CLASSES = 31
#: Titles beyond this length share blocks by powers of two, so there are some 4,000 blocks at most.
LONG = 128
#: Blocks, the most promising ones of a text, that give its first scores.
FIRST_BLOCKS = 3
_PROFILE = "letters array<int>, blanks int, words array<string>, n_words int, size int, set_size int"


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            words = text.split()
            letters = [0] * CLASSES
            for ch in "".join(words):
                letters[ord(ch) % CLASSES] += 1
            distinct = sorted(set(words))
            rows.append((letters, len(text) - sum(letters), distinct, len(words), len(text), len(" ".join(distinct))))
        found = pd.DataFrame(rows, columns=["letters", "blanks", "words", "n_words", "size", "set_size"], index=batch.index)
        yield pd.concat([batch, found], axis=1)


def profiled(texts: DataFrame) -> DataFrame:
    """texts (text, ...) with what bounds need: letters by class, blanks, words, and lengths whole and as a set of words."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInPandas(_profiles, f"{schema}, {_PROFILE}")


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b).cast("double")


def common_letters(q: str, t: str) -> Column:
    """Letters that the profiles in columns q and t can have in common, by their classes; to be a column of its own."""
    return F.aggregate(F.zip_with(F.col(f"{q}.letters"), F.col(f"{t}.letters"), lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)


def bound(q: str, t: str, letters: Column, shared: Column | None = None) -> Column:
    """An upper bound on the weighted ratio of the profiles in columns q and t. t may bound a block from above: then it has
    the most letters of each class, blanks and words, the least set_size, and one size.

    No ratio has more letters in common than the classes allow (letters: common_letters). shared: the length of the words
    in common, joined by blanks, or 0; without it no word is in common.
    """

    def of(letters: Column) -> Column:
        a, b = (lambda n: F.col(f"{q}.{n}")), (lambda n: F.col(f"{t}.{n}"))
        plain = letters + F.least(a("blanks"), b("blanks"))
        words = letters + F.greatest(F.lit(0), F.least(a("n_words"), b("n_words")) - 1)
        whole = lambda c, x, y: F.least(F.lit(100.0), F.try_divide(F.lit(200.0) * c, x + y))
        part = lambda c, n: F.least(F.lit(100.0), F.try_divide(F.lit(200.0) * c, n + c))
        small, large = F.least(a("size"), b("size")), F.greatest(a("size"), b("size"))
        by_set = whole(words, a("set_size"), b("set_size"))
        by_part = part(words, F.least(a("set_size"), b("set_size")))
        if shared is not None:
            some = shared > 0
            by_set = F.when(some, F.greatest(by_set, F.try_divide(F.lit(200.0) * shared, shared + F.least(a("set_size"), b("set_size"))))).otherwise(by_set)
            by_part = F.when(some, F.lit(100.0)).otherwise(by_part)
        weight = F.when(large <= 8 * small, 0.9).otherwise(0.6)
        longer = F.greatest(weight * part(plain, small), 0.95 * weight * by_part)
        even = F.greatest(whole(plain, a("size"), b("size")), F.when(large < 1.5 * small, 0.95 * by_set).otherwise(longer))
        return F.when(small > 0, F.coalesce(even, F.lit(100.0))).otherwise(0.0) + 1e-6  # rounding

    # the letters are a variable of their own, so they are counted once and the generated code stays small
    return F.get(F.transform(F.array(letters), of), F.lit(0))


def _pack(df: DataFrame, name: str, *kept: str) -> DataFrame:
    return df.select(*kept, F.struct("letters", "blanks", "words", "n_words", "size", "set_size").alias(name))


def _block(df: DataFrame) -> Column:
    """The block of a title: its length, and the counts of three common letters up to two."""
    length = F.when(F.col("size") <= LONG, F.col("size")).otherwise(LONG + F.floor(F.log2(F.col("size").cast("double"))).cast("int"))
    return F.struct(length.alias("l"), *[F.least(F.col("letters")[ord(ch) % CLASSES], F.lit(2)).alias(ch) for ch in "eao"])


def _joined_length(words: Column) -> Column:
    return F.length(F.array_join(words, " "))


def _dealt(pairs: DataFrame) -> DataFrame:
    """pairs (text, title) dealt over tasks, to be scored: few bytes of pairs are much work."""
    spark = pairs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return pairs.repartition(tasks, "text", "title")


def scored_pairs(queries: DataFrame, titles: DataFrame, most: int) -> DataFrame:
    """text, title, score: at least all pairs of distinct queries (text) and distinct titles (title, n: rows that it stands
    for) that are among the `most` best rows of a text, or tie with them.

    Titles lie in blocks, of which there are a bounded number; a block's letters bound those of its titles. The best
    blocks of a text and the titles that share its words, as far as their bounds promise most, are scored first, which
    gives the score that the last of `most` rows has at least. Then only blocks, and within them only titles, whose bound
    reaches it are scored, and so are titles that share a word and reach it by that.
    """
    q = cut(_pack(profiled(queries.select("text").distinct()), "q", "text"), "fuzzy-texts")
    t = profiled(titles.select(F.col("title").alias("text"), "n"))
    t = t.withColumn("block", _block(t))
    t = cut(_pack(t, "t", F.col("text").alias("title"), "n", "block"), "fuzzy-titles")
    sizes = {n: F.min(f"t.{n}") for n in ("set_size",)} | {n: F.max(f"t.{n}") for n in ("blanks", "n_words")}
    top = F.array(*[F.max(F.col("t.letters")[k]) for k in range(CLASSES)])
    grouped = t.groupBy("block").agg(top.alias("letters"), *[c.alias(n) for n, c in sizes.items()], F.min("t.size").alias("low"), F.max("t.size").alias("high"), F.sum("n").alias("rows"))
    # titles of one length have one size; beyond LONG a block gets both of its ends, each a bound of its own
    ends = F.explode(F.array_distinct(F.array("low", "high"))).alias("size")
    blocks = grouped.select("block", "rows", "letters", "blanks", "n_words", ends, "set_size", "low", "high")
    blocks = _pack(blocks.withColumn("words", F.array().cast("array<string>")), "t", "block", "rows", "low", "high")
    # between the two ends any scale is possible, and the least size bounds each part
    reach = F.when(F.col("low") == F.col("high"), bound("q", "t", F.col("common"))).otherwise(100.0)
    met = q.crossJoin(F.broadcast(blocks)).withColumn("common", common_letters("q", "t")).select("text", "block", reach.alias("reach")).groupBy("text", "block").agg(F.max("reach").alias("reach"))
    met = cut(met, "fuzzy-reach")

    posts = t.select("title", "n", "t", F.explode("t.words").alias("word"))
    sharing = q.select("text", "q", F.explode("q.words").alias("word")).join(posts, "word").groupBy("text", "title").agg(F.first("q").alias("q"), F.first("t").alias("t"), F.first("n").alias("n"))
    both = F.array_intersect("q.words", "t.words")
    sharing = sharing.withColumns({"common": common_letters("q", "t"), "shared": _joined_length(both)})
    sharing = sharing.select("text", "title", "n", bound("q", "t", F.col("common"), F.col("shared")).alias("reach"))
    sharing = cut(sharing, "fuzzy-sharing")

    first = Window.partitionBy("text").orderBy(F.desc("reach"), "block")
    seeds = met.withColumn("k", F.row_number().over(first)).where(F.col("k") <= FIRST_BLOCKS).select("text", "block")
    seeds = seeds.join(q, "text").join(t, "block").withColumn("common", common_letters("q", "t")).select("text", "title", "n", bound("q", "t", F.col("common")).alias("reach"))
    seeds = sharing.unionByName(seeds).dropDuplicates(["text", "title"])
    seeds = seeds.withColumn("k", F.row_number().over(Window.partitionBy("text").orderBy(F.desc("reach"), "title"))).where(F.col("k") <= 2 * most)
    seeds = cut(_dealt(seeds).select("text", "title", "n", wratio("text", "title").alias("score")), "fuzzy-seeds")
    filled = F.sum("n").over(Window.partitionBy("text").orderBy(F.desc("score"), "title").rowsBetween(Window.unboundedPreceding, 0))
    least = seeds.withColumn("filled", filled).where(F.col("filled") >= most).groupBy("text").agg(F.max("score").alias("least"))
    least = cut(q.join(least, "text", "left").select("text", "q", F.coalesce("least", F.lit(0.0)).alias("least")), "fuzzy-least")

    near = met.join(least, "text").where(F.col("reach") >= F.col("least")).join(t, "block")
    near = near.withColumn("common", common_letters("q", "t")).where(bound("q", "t", F.col("common")) >= F.col("least")).select("text", "title")
    near = near.unionByName(sharing.join(least.select("text", "least"), "text").where(F.col("reach") >= F.col("least")).select("text", "title"))
    # pairs meet where they are scored, and those of the seeds have their score
    pairs = _dealt(near.withColumn("score", F.lit(None).cast("double")).unionByName(seeds.select("text", "title", "score")))
    pairs = pairs.groupBy("text", "title").agg(F.max("score").alias("score"))
    return pairs.withColumn("score", F.coalesce("score", wratio(F.when(F.col("score").isNull(), F.col("text")), F.col("title"))))


def best(queries: DataFrame, catalog: DataFrame, most: int) -> DataFrame:
    """text, id, title, score: the `most` best rows of a catalog (id, title) for each distinct text of queries (text), by
    weighted ratio, of equal ones the least ids. Null texts and titles take no part; repeated rows of a catalog count."""
    rows = catalog.where("title is not null").select("id", "title")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("title").orderBy("id"))).where(F.col("_n") <= most).drop("_n")
    rows = cut(rows, "fuzzy-rows")
    pairs = scored_pairs(queries.where("text is not null"), rows.groupBy("title").agg(F.count("*").alias("n")), most)
    order = Window.partitionBy("text").orderBy(F.desc("score"), "id")
    return pairs.join(rows, "title").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("text", "id", "title", "score")
