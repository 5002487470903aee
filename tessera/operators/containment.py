"""Joins by containment: entries whose words a text has all of, or with whose letters it begins, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_words(texts: DataFrame, entries: DataFrame, order: Column) -> DataFrame:
    """key, best: for each of texts (key, words ARRAY) and each set of words that it has whole, the least `order` of the
    entries (words ARRAY, ...) with that set.

    An entry is posted under one of its words, the one that fewest sets have, so that a frequent word leads to entries only
    if they have no rarer one. Texts look up each of their words and the rest of a set is verified. Entries of one set
    are one posting; words are distinct within an array, and sets and texts without words never match.
    """
    sets = entries.where(F.size("words") > 0).groupBy(F.array_sort("words").alias("need")).agg(F.min(order).alias("best"))
    posts = sets.select("need", "best", F.explode("need").alias("word"))
    count = posts.groupBy("word").agg(F.count("*").alias("n"))
    rarest = posts.join(count, "word").groupBy("need").agg(F.min(F.struct("n", "word"))["word"].alias("word"), F.first("best").alias("best"))
    asked = texts.select("key", "words", F.explode("words").alias("word"))
    return asked.join(rarest, "word").where(F.size(F.array_except("need", "words")) == 0).select("key", "best")


def by_head(texts: DataFrame, entries: DataFrame, order: Column, least: int) -> DataFrame:
    """key, best: for each of texts (key, letters) and each beginning of it of at least `least` characters that entries
    (letters, ...) have as their letters, the least `order` of these.

    Texts look up their beginnings at the lengths that occur among entries, which are one short array for all.
    """
    heads = entries.where(F.length("letters") >= least).groupBy("letters").agg(F.min(order).alias("best"))
    lengths = heads.agg(F.collect_set(F.length("letters")).alias("at"))  # one row
    cut = F.transform(F.filter("at", lambda n: n <= F.length("letters")), lambda n: F.substr(F.col("letters"), F.lit(1), n))
    asked = texts.select("key", "letters").crossJoin(F.broadcast(lengths)).select("key", F.explode(cut).alias("letters"))
    return asked.join(heads, "letters").select("key", "best")
