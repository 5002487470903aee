"""Retrieval of catalog rows (id, title) for queries (query_id, q): by alias, pattern, trigrams, fuzzy ratio, BM25, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions.titles import conflicting_ordinal
from tessera.operators import fuzzy_search, vector_index
from tessera.operators.written import cut

# Titles too generic to be a fuzzy match, and catalog ids of known franchise installments.
JUNK = ("3", "4", "la", "prince", "phoenix", "the order", "night", "king", "nix")
INSTALLMENTS = (
    ("harry_potter", 1, 14039), ("harry_potter", 2, 14038), ("harry_potter", 3, 14061), ("harry_potter", 4, 14062), ("harry_potter", 5, 14063), ("harry_potter", 6, 14561), ("harry_potter", 7, 11626),
    ("harry_potter", 8, 13837), ("toy_story", 1, 13868), ("toy_story", 2, 14046), ("toy_story", 3, 10731), ("toy_story", 4, 105988),
)


def by_alias(queries: DataFrame, aliases: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, id, score 0.95 where the query is an alias (alias, id) of a catalog row; of equal aliases the last id wins."""
    keys = aliases.groupBy(F.lower("alias").alias("_a")).agg(F.max("id").alias("id"))
    found = queries.select("query_id", F.lower("q").alias("_a")).join(keys, "_a")
    return found.join(catalog.select("id"), "id", "left_semi").select("query_id", "id", F.lit(0.95).alias("score"), F.lit("alias").alias("source"))


def by_franchise(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, id, score 0.95 for queries (query_id, franchise_hint, ordinal) that name a known installment."""
    known = F.create_map(*[F.lit(x) for hint, n, i in INSTALLMENTS for x in (f"{hint} {n}", i)])
    found = queries.select("query_id", F.element_at(known, F.concat("franchise_hint", F.lit(" "), F.col("ordinal").cast("string"))).cast("long").alias("id"))
    found = found.where("id is not null").join(catalog.select("id"), "id", "left_semi")
    return found.select("query_id", "id", F.lit(0.95).alias("score"), F.lit("franchise_map").alias("source"))


#: Letters of the pieces by which patterns are looked up.
GRAM = 3


def _grams(c: Column) -> Column:
    return F.when(F.length(c) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(c) - (GRAM - 1)), lambda i: F.substr(c, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))


def by_pattern(queries: DataFrame, catalog: DataFrame, k: int = 20, empty: bool = False) -> DataFrame:
    """query_id, id, rank: the k best titles that contain the pattern q in any case: equal ones first, then the shortest.

    % stands for any letters and _ for one, as in ILIKE '%q%' without an escape sign. Titles are posted under their
    trigrams; a pattern is looked up by that trigram of its literal pieces that fewest titles have, and order and gaps are
    verified on what it finds. Only patterns without a piece of three letters are compared with each title. A pattern
    that is empty finds nothing, or every title if `empty` is set; null ones find nothing.
    """
    texts = queries.select(F.lower("q").alias("_q")).where("_q is not null" if empty else "_q <> ''").distinct()
    hits = matching_titles(texts, catalog.select("title"))
    hits = hits.join(catalog.select("id", "title", F.lower("title").alias("t")), "t")
    order = Window.partitionBy("_q").orderBy(F.col("t") != F.col("_q"), F.length("title"), "id")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return queries.withColumn("_q", F.lower("q")).join(best, "_q").select("query_id", "id", "rank")


def matching_titles(texts: DataFrame, titles: DataFrame) -> DataFrame:
    """_q, t: the lower-case titles (title) that contain each of the distinct lower-case patterns (_q)."""
    pieces = F.split("_q", "[%_]")
    texts = texts.withColumn("g", F.array_distinct(F.flatten(F.transform(pieces, _grams))))
    titles = titles.where("title is not null").select(F.lower("title").alias("t")).distinct()
    posts = titles.select("t", F.explode(F.array_distinct(_grams(F.col("t")))).alias("gram"))
    count = posts.groupBy("gram").agg(F.count("*").alias("n"))
    fits = F.like(F.col("t"), F.concat(F.lit("%"), "_q", F.lit("%")), F.lit("\u0001"))
    rarest = texts.select("_q", F.explode("g").alias("gram")).join(count, "gram", "left")
    rarest = rarest.groupBy("_q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    hits = rarest.join(posts, "gram").where(fits).select("_q", "t")
    short = texts.where("size(g) = 0").select("_q")
    if not short.isEmpty():
        hits = hits.unionByName(short.join(titles, fits).select("_q", "t"))
    return hits


def by_trigrams(queries: DataFrame, catalog: DataFrame, threshold: float = 0.3, k: int = 20) -> DataFrame:
    """query_id, id, similarity, rank: the k most similar titles at or above a threshold."""
    pairs = similar_titles(queries.select("q").distinct(), catalog.select("title").distinct(), threshold)
    hits = pairs.join(catalog.select("id", "title"), "title")
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "id")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return queries.join(best, "q").select("query_id", "id", "similarity", "rank")


def similar_titles(texts: DataFrame, titles: DataFrame, threshold: float) -> DataFrame:
    """q, title, similarity of the distinct texts (q) and distinct titles (title) that are at or above a threshold.

    Two sets whose overlap reaches the threshold share one of the rarest trigrams of each, so only a prefix of each set,
    rarest first, is joined; the similarity of the pairs so found is then exact. Distinct texts meet once. The sets are
    written, as each is used three times and its expression holds the letters of all scripts.
    """
    def prefixes(df: DataFrame, name: str) -> DataFrame:
        grams = df.select(name, F.explode("g").alias("gram")).join(freq, "gram").groupBy(name).agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("s"))
        size = F.size("s") - F.ceil(F.size("s") * F.lit(threshold)).cast("int") + 1
        return grams.select(name, F.explode(F.slice("s", F.lit(1), size)).alias("s")).select(name, "s.gram")

    texts = cut(texts.withColumn("g", sim.trigrams(F.col("q"))), "trigram-texts")
    titles = cut(titles.withColumn("g", sim.trigrams(F.col("title"))), "trigram-titles")
    freq = titles.select(F.explode("g").alias("gram")).unionByName(texts.select(F.explode("g").alias("gram"))).groupBy("gram").agg(F.count("*").alias("n"))
    pairs = prefixes(texts, "q").join(prefixes(titles, "title"), "gram").select("q", "title").distinct()
    pairs = pairs.join(texts.withColumnRenamed("g", "gq"), "q").join(titles.withColumnRenamed("g", "gt"), "title")
    return pairs.withColumn("similarity", sim.overlap(F.col("gq"), F.col("gt"))).where(F.col("similarity") >= threshold).select("q", "title", "similarity")


def cascade(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, id, rank, method: pattern hits, and trigram hits only for queries without one."""
    first = cut(by_pattern(queries, catalog), "pattern-hits")
    rest = queries.join(first, "query_id", "left_anti")
    return first.withColumn("method", F.lit("pattern")).unionByName(by_trigrams(rest, catalog).select("query_id", "id", "rank").withColumn("method", F.lit("trigram")))


def plausible(pairs: DataFrame) -> DataFrame:
    """pairs (q, title, score 0 to 100, ordinal) without junk titles, weak coverage below a score of 90, or other installments."""
    low = F.lower("title")
    ok = ~low.isin(*JUNK) & (F.length("title") > 3) & ((sim.coverage(F.col("q"), F.col("title")) >= 0.6) | (F.col("score") >= 90))
    return pairs.where(ok & ~(F.coalesce(F.col("ordinal") > 0, F.lit(False)) & F.coalesce(conflicting_ordinal(F.col("title"), F.col("ordinal")), F.lit(False))))


def by_fuzzy(queries: DataFrame, catalog: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, score, rank: the best plausible titles by weighted ratio, out of the k + 5 best; score is at most 0.5.

    Only pairs whose upper bound can reach the last of them are scored (see fuzzy_search.best).
    """
    near = fuzzy_search.best(queries.select(F.col("q").alias("text")), catalog, k + 5).withColumnRenamed("text", "q")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = plausible(queries.select("query_id", "q", "ordinal").join(near, "q"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "id", (F.col("score") / 100 * 0.5).alias("score"), "rank", F.lit("fuzzy").alias("source"))


def bm25(queries: DataFrame, catalog: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id, bm25, rank: the k best titles by BM25 over lower-case words."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    docs = catalog.select("id", words("title").alias("w")).withColumn("len", F.size("w"))
    stats = docs.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
    tf = docs.select("id", "len", F.explode("w").alias("word")).groupBy("id", "len", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    asked = queries.select("q").distinct().select("q", F.explode(F.array_distinct(words("q"))).alias("word"))
    hits = asked.join(df, "word").join(tf, "word").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = hits.groupBy("q", "id").agg(F.sum(part).alias("bm25"))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.round("bm25", 6).desc(), "id"))).where(F.col("rank") <= k)
    return queries.join(best, "q").select("query_id", "id", "bm25", "rank")


#: Query vectors and vectors that one task compares, about.
NEAREST_BLOCK, NEAREST_PART = 5000, 10_000


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, by: str | None = None) -> DataFrame:
    """query_id, id, cosine, rank: the k nearest of vectors (id, v) for queries (query_id, v), each but itself; with a column
    `by` of both only of those that have the same value in it, and none where it is null.

    Queries and vectors are dealt into blocks and parts by hash; each block meets each part in a task of its own, which
    compares every pair by a product of matrices and keeps the k best of each query. The job is the product of the two.
    """
    spark = queries.sparkSession
    key = F.col(by) if by else F.lit(0)
    q = queries.select("query_id", key.alias("_key"), F.col("v").cast("array<double>").alias("v"))
    rows = vectors.select("id", key.alias("_key"), F.col("v").cast("array<double>").alias("v"))
    if by:
        q, rows = q.where("_key is not null"), rows.where("_key is not null")
    if by:
        blocks = q.groupBy("_key").agg(F.ceil(F.count("*") / NEAREST_BLOCK).cast("int").alias("blocks"))
        parts = rows.groupBy("_key").agg(F.ceil(F.count("*") / NEAREST_PART).cast("int").alias("parts"))
        deal = cut(blocks.join(parts, "_key"), "nearest-deal")
        q, rows = q.join(deal, "_key"), rows.join(deal, "_key")
    else:  # two numbers
        sides = q.select(F.lit("q").alias("side")).unionByName(rows.select(F.lit("v").alias("side")))
        n = {r["side"]: r["n"] for r in sides.groupBy("side").agg(F.count("*").alias("n")).collect()}
        deal = {"blocks": F.lit(max(1, -(-n.get("q", 0) // NEAREST_BLOCK))), "parts": F.lit(max(1, -(-n.get("v", 0) // NEAREST_PART)))}
        q, rows = q.withColumns(deal), rows.withColumns(deal)
    block, part = (F.pmod(F.xxhash64(c, F.lit(5)), F.col(n)).cast("int") for c, n in (("query_id", "blocks"), ("id", "parts")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys, tasks = ["_key", "_part", "_block"], max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    q = q.select("_key", each("parts").alias("_part"), block.alias("_block"), "query_id", "v").repartition(tasks, *keys)
    rows = rows.select("_key", part.alias("_part"), each("blocks").alias("_block"), "id", "v").repartition(tasks, *keys)
    kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, cosine double"
    hits = q.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(vector_index.exact_best(k), kinds)
    order = Window.partitionBy("query_id").orderBy(F.round("cosine", 9).desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid(lexical: DataFrame, near: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, raw, score, rank from lexical (query_id, id, bm25) and near (query_id, id, cosine): the sum of BM25 and
    closeness, cut off at 1 and scaled to 0.6."""
    both = lexical.select("query_id", "id", "bm25").join(near.select("query_id", "id", "cosine"), ["query_id", "id"], "full")
    raw = F.coalesce("bm25", F.lit(0.0)) + F.when(F.col("cosine").isNotNull(), sim.closeness(F.col("cosine"))).otherwise(0.0)
    both = both.withColumn("raw", raw).withColumn("score", F.least("raw", F.lit(1.0)) * 0.6)
    order = Window.partitionBy("query_id").orderBy(F.round("raw", 9).desc(), "id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "raw", "score", "rank")


def generated(queries: DataFrame, catalog: DataFrame, aliases: DataFrame, near: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, score, source, gen: the first k candidates of each of queries (query_id, q, franchise_hint, ordinal), as
    alias, franchise, fuzzy and hybrid hits give them in that order; fuzzy and hybrid hits leave out ids that are there.

    near: query_id, id, cosine of the nearest catalog rows, twice k of each query, for the hybrid search with BM25.
    What each search finds is written: in one plan each stage that ends has all of them planned anew.
    """
    lexical = cut(bm25(queries, catalog, 2 * k), "bm25-hits")
    both = cut(hybrid(lexical, near, 2 * k).select("query_id", "id", "score", F.lit("hybrid").alias("source"), "rank", F.lit(3).alias("_o")), "hybrid-hits")
    fuzzy = cut(by_fuzzy(queries, catalog, k).select("query_id", "id", "score", "source", "rank", F.lit(2).alias("_o")), "fuzzy-hits")
    named = by_alias(queries, aliases, catalog).withColumn("_o", F.lit(0)).unionByName(by_franchise(queries, catalog).withColumn("_o", F.lit(1)))
    rows = named.withColumn("rank", F.lit(1)).unionByName(fuzzy).unionByName(both).repartition("query_id")  # a few rows of each query, for both windows
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("_o"))).where("_n = 1 or _o < 2")
    rows = rows.withColumn("gen", F.row_number().over(Window.partitionBy("query_id").orderBy("_o", "rank", "id")))
    return rows.where(F.col("gen") <= k).select("query_id", "id", "score", "source", "gen")
