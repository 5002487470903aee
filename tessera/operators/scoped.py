"""Retrieval within a country: queries with a country rank only its rows, so that no filter empties a list cut before it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import retrieve
from tessera.operators.written import cut


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def _scopes(df: DataFrame) -> DataFrame:
    """Rows of a catalog (country, ...) once under their country and once under none, as `scope`."""
    return df.withColumn("scope", F.explode(F.when(F.col("country").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array(F.col("country"), F.lit(None).cast("string")))))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def bm25(queries: DataFrame, catalog: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id, bm25, rank: the k best titles by BM25 for queries (query_id, q, country) among the rows (id, title,
    country) of the query's country, or all rows where it has none. Statistics are those of the whole catalog.

    Postings carry their country, so a query of a country meets only its postings of a word, and the k best are cut after.
    """
    docs = catalog.select("id", "country", _words(F.col("title")).alias("w")).withColumn("len", F.size("w"))
    stats = docs.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
    tf = docs.select("id", "country", "len", F.explode("w").alias("word")).groupBy("id", "country", "len", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    asked = queries.select("q", F.col("country").alias("wanted")).distinct().select("q", "wanted", F.explode(F.array_distinct(_words(F.col("q")))).alias("word")).join(df, "word")
    posts = _scopes(tf).withColumnRenamed("word", "posted")
    hits = asked.join(posts, (F.col("word") == F.col("posted")) & _same("wanted", "scope")).crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = hits.groupBy("q", "wanted", "id").agg(F.sum(part).alias("bm25"))
    order = Window.partitionBy("q", "wanted").orderBy(F.round("bm25", 6).desc(), "id")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("q", "_q")
    return queries.join(best, (F.col("q") == F.col("_q")) & _same("country", "wanted")).select("query_id", "id", "bm25", "rank")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, cosine, rank: the k nearest of vectors (id, v, country) in the country of each of queries (query_id, v,
    country), or of all where it has none, each but itself.

    Both go the way of retrieve.nearest, blocks of queries against parts of vectors, the first country by country.
    """
    q, rows = queries.where("v is not null"), vectors.where("v is not null")
    scoped = retrieve.nearest(q.where("country is not null"), rows, k, by="country")
    free = retrieve.nearest(q.where("country is null").select("query_id", "v"), rows.select("id", "v"), k)
    return scoped.unionByName(free)


def hybrid(queries: DataFrame, catalog: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """retrieve.hybrid of both, within the country of each query (query_id, q, v, country)."""
    fetched = k + 10
    return retrieve.hybrid(bm25(queries, catalog, fetched), nearest(queries, vectors, fetched), k)


def by_title(queries: DataFrame, catalog: DataFrame, k: int = 20) -> DataFrame:
    """query_id, id, rank, method: what an international catalog (id, title, master_title, country) has for each of queries
    (query_id, q, country): titles that contain q in its country ("title"); where there are none, rows whose master title
    does ("master"); where there are none either, the most similar titles ("trigram").

    Each way is asked for the queries that those before left without a row, and each ranks within the country. Queries
    without a country search all rows; rows without one are found by these only. Null and empty queries find nothing.
    """
    # a text and its country are one key: the searches take countries as separate catalogs under one roof
    asked = cut(queries.where("q is not null and q <> ''").select("query_id", "q", "country"), "scoped-queries")
    rows = _scopes(catalog.select("id", "title", "master_title", "country"))
    ways = []
    left = asked
    for method, column in (("title", "title"), ("master", "master_title"), ("trigram", "title")):
        own = rows.where(F.col(column).isNotNull()).select("id", F.col(column).alias("title"), "scope")
        find = _trigrams if method == "trigram" else _patterns
        hits = cut(find(left, own, k), f"{method}-hits")
        ways.append(hits.withColumn("method", F.lit(method)))
        left = left.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    return reduce(DataFrame.unionByName, ways)


def _patterns(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Titles that contain q, in the scope of its country, in the order of retrieve.by_pattern."""
    texts = queries.select(F.lower("q").alias("_q"), "country").distinct()
    found = retrieve.matching_titles(texts.select("_q").distinct(), rows.select("title"))
    hits = texts.join(found, "_q").join(rows.withColumn("_t", F.lower("title")), (F.col("_t") == F.col("t")) & _same("country", "scope"))
    order = Window.partitionBy("_q", "country").orderBy(F.col("t") != F.col("_q"), F.length("title"), "id")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("_q", F.col("country").alias("_c"), "id", "rank")
    return queries.withColumn("_own", F.lower("q")).join(best, (F.col("_own") == F.col("_q")) & _same("country", "_c")).select("query_id", "id", "rank")


def _trigrams(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The most similar titles in the scope of a query's country, in the order of retrieve.by_trigrams."""
    pairs = retrieve.similar_titles(queries.select("q").distinct(), rows.select("title").distinct(), 0.3)
    hits = queries.select("q", "country").distinct().join(pairs, "q").join(rows.withColumnRenamed("title", "_t"), (F.col("title") == F.col("_t")) & _same("country", "scope"))
    order = Window.partitionBy("q", "country").orderBy(F.desc("similarity"), "id")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("q").alias("_q"), F.col("country").alias("_c"), "id", "rank")
    return queries.join(best, (F.col("q") == F.col("_q")) & _same("country", "_c")).select("query_id", "id", "rank")
