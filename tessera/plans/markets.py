"""Queries on an international catalog, searched within the country of each query: name -> (callable, DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import scoped, verdicts
from tessera.plans import inputs
from tessera.plans.titles import _conflict_sql, _grams


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a row of a country or of none: its brand or its name is the local title, its name the master title."""
    k = F.col("p_partkey")
    nations = inputs.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = inputs.table(spark, sf_dir, "part").join(nations, (k % 25 == F.col("n_nationkey")) & (k % 11 != 0), "left")
    title = F.when(k % 3 == 0, F.concat_ws(" ", "p_brand", F.left("p_name", F.lit(3)))).otherwise(F.col("p_name"))
    return rows.select(k.alias("id"), title.alias("title"), F.col("p_name").alias("master_title"), F.col("n_name").alias("country"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each part, in every second row with a country."""
    k = F.col("p_partkey")
    nations = inputs.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = inputs.table(spark, sf_dir, "part").join(nations, (k % 24 == F.col("n_nationkey")) & (k % 2 == 0), "left")
    q = F.when(k % 5 == 0, F.concat(F.lit("the "), F.upper("p_name"))).when(k % 5 == 1, F.col("p_brand")).when(k % 15 == 2, F.lit("")).otherwise(F.col("p_name"))
    return rows.select(k.alias("query_id"), q.alias("q"), F.col("n_name").alias("country"))


_INTL = """intl AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' ' || left(p_name, 3) ELSE p_name END AS title, p_name AS master_title, n_name AS country FROM part LEFT JOIN nation ON p_partkey % 25 = n_nationkey AND p_partkey % 11 <> 0),
  asked AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 5 = 0 THEN 'the ' || upper(p_name) WHEN p_partkey % 5 = 1 THEN p_brand WHEN p_partkey % 15 = 2 THEN '' ELSE p_name END AS q, n_name AS country FROM part LEFT JOIN nation ON p_partkey % 24 = n_nationkey AND p_partkey % 2 = 0),
  texts AS (SELECT DISTINCT q, country FROM asked)"""


def country_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped.by_title(_queries(spark, sf_dir), _catalog(spark, sf_dir))


def _contained(name: str, title: str, rest: str) -> str:
    return f"""{name} AS (SELECT t.q, t.country, i.id, row_number() OVER (PARTITION BY t.q, t.country ORDER BY lower({title}) <> lower(t.q), length({title}), i.id) AS rank
  FROM {rest} t JOIN intl i ON contains(lower({title}), lower(t.q)) AND (t.country IS NULL OR t.country = i.country) WHERE t.q <> '' QUALIFY rank <= 20)"""


#: What texts (q, country) find in intl: found (q, country, id, rank, method).
_FOUND = f"""{_contained("a", "title", "texts")}, r1 AS (SELECT * FROM texts t WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.q = t.q AND a.country IS NOT DISTINCT FROM t.country)),
  {_contained("b", "master_title", "r1")}, r2 AS (SELECT * FROM r1 t WHERE q <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE b.q = t.q AND b.country IS NOT DISTINCT FROM t.country)),
  gq AS (SELECT *, {_grams("q")} AS g FROM r2), gt AS (SELECT DISTINCT title, {_grams("title")} AS h FROM intl),
  s AS (SELECT q, country, title, len(list_intersect(g, h))::DOUBLE / (len(g) + len(h) - len(list_intersect(g, h))) AS similarity FROM gq JOIN gt ON len(g) + len(h) > 0),
  c AS (SELECT s.q, s.country, i.id, row_number() OVER (PARTITION BY s.q, s.country ORDER BY similarity DESC, i.id) AS rank FROM s JOIN intl i ON i.title = s.title AND (s.country IS NULL OR s.country = i.country) WHERE similarity >= 0.3 QUALIFY rank <= 20),
  found AS (SELECT *, 'title' AS method FROM a UNION ALL SELECT *, 'master' FROM b UNION ALL SELECT *, 'trigram' FROM c)"""
_SEARCH = f"""WITH {_INTL}, {_FOUND} SELECT query_id, id, rank, method FROM asked JOIN found f ON asked.q = f.q AND asked.country IS NOT DISTINCT FROM f.country"""


def second_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """International results that name a film without an id, one for each part, looked up again in their country."""
    k = F.col("query_id")
    asked = _queries(spark, sf_dir).drop("q")
    names = inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), "p_name", "p_brand")
    rows = asked.join(names, "query_id").select(
        "query_id", F.when(k % 4 == 0, k).otherwise(0).alias("movie_id"), F.when(k % 9 == 0, "Unknown").otherwise(F.col("p_name")).alias("title"), (k % 100 / 100).alias("confidence"),
        F.when(k % 5 == 0, "AUTO_ACCEPT").when(k % 5 == 1, "REVIEW_NON_MOVIE").otherwise("REVIEW").alias("decision"), F.lit("none").alias("reasoning"), F.when(k % 6 == 1, 2).cast("int").alias("ordinal"), "country", F.lit(True).alias("international"), "p_name", "p_brand",
    )
    tries = F.array(F.struct(F.lit(1).alias("rank"), F.when(k % 7 == 0, F.concat("p_brand", F.lit(" (restored)"))).alias("title")), F.struct(F.lit(2).alias("rank"), F.when(k % 3 == 0, F.concat(F.lit("zzzz"), k)).otherwise(F.col("p_name")).alias("title")), F.struct(F.lit(3).alias("rank"), F.concat(F.lit("["), "p_type", F.lit("] "), F.upper("p_name")).alias("title")))
    types = inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), "p_type")
    attempts = rows.join(types, "query_id").select("query_id", F.explode(tries).alias("a")).select("query_id", "a.rank", "a.title")
    out = verdicts.searched_again(rows.drop("p_name", "p_brand"), attempts, _catalog(spark, sf_dir))
    return out.select("query_id", "movie_id", "title", "confidence", "decision", "looked_up")


_AGAIN = f"""WITH {_INTL.split("asked AS")[0]} rows AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 4 = 0 THEN p_partkey ELSE 0 END AS movie_id, CASE WHEN p_partkey % 9 = 0 THEN 'Unknown' ELSE p_name END AS title, p_partkey % 100 / 100.0::DOUBLE AS confidence,
  CASE p_partkey % 5 WHEN 0 THEN 'AUTO_ACCEPT' WHEN 1 THEN 'REVIEW_NON_MOVIE' ELSE 'REVIEW' END AS decision, CASE WHEN p_partkey % 6 = 1 THEN 2 END AS wanted, n_name AS country, p_name, p_brand FROM part LEFT JOIN nation ON p_partkey % 24 = n_nationkey AND p_partkey % 2 = 0),
  tries AS (SELECT query_id, country, wanted, unnest([{{'attempt': 1, 'q': CASE WHEN query_id % 7 = 0 THEN p_brand END}}, {{'attempt': 2, 'q': CASE WHEN query_id % 3 = 0 THEN 'zzzz' || query_id ELSE p_name END}}, {{'attempt': 3, 'q': upper(p_name)}}], recursive := true) FROM rows WHERE movie_id = 0 AND title <> 'Unknown'),
  texts AS (SELECT DISTINCT q, country FROM tries WHERE q IS NOT NULL), {_FOUND},
  hits AS (SELECT query_id, arg_min({{'id': i.id, 'title': i.title}}, {{'attempt': attempt, 'rank': rank}}) AS film FROM tries t JOIN found f ON t.q = f.q AND t.country IS NOT DISTINCT FROM f.country JOIN intl i ON i.id = f.id
    WHERE wanted IS NULL OR NOT coalesce({_conflict_sql("i.title", "wanted")}, false) GROUP BY query_id)
  SELECT r.query_id, coalesce(film.id, movie_id) AS movie_id, coalesce(film.title, r.title) AS title, CASE WHEN film IS NULL THEN confidence ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN film IS NOT NULL AND decision = 'REVIEW' THEN 'AUTO_ACCEPT' ELSE decision END AS decision, film IS NOT NULL AS looked_up
  FROM rows r LEFT JOIN hits h ON h.query_id = r.query_id"""


def country_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and vectors together, within the country of each query; the vector of a part and of its query is that of its number."""
    v = inputs.table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("v"))
    rows = _catalog(spark, sf_dir)
    vectors = rows.join(v, F.col("id") == F.col("vec_id")).select("id", "v", "country")
    asked = _queries(spark, sf_dir).join(v, F.col("query_id") == F.col("vec_id"), "left").select("query_id", "q", "v", "country")
    return scoped.hybrid(asked, rows, vectors).withColumns({"raw": F.round("raw", 6), "score": F.round("score", 6)})


_HYBRID = rf"""WITH {_INTL}, d AS (SELECT id, country, list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM intl), st AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d),
  tf AS (SELECT id, country, any_value(len) AS len, word, count(*) AS tf FROM (SELECT id, country, len(w) AS len, unnest(w) AS word FROM d) GROUP BY id, country, word), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
  aq AS (SELECT q, country, unnest(list_distinct(list_filter(regexp_split_to_array(lower(q), '[^a-z0-9]+'), lambda w: w <> ''))) AS word FROM texts),
  sc AS (SELECT q, aq.country, id, sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS bm25
    FROM aq JOIN df USING (word) JOIN tf ON tf.word = aq.word AND (aq.country IS NULL OR aq.country = tf.country), st GROUP BY q, aq.country, id),
  top AS (SELECT *, row_number() OVER (PARTITION BY q, country ORDER BY round(bm25, 6) DESC, id) AS n FROM sc QUALIFY n <= 20),
  lexical AS (SELECT query_id, id, bm25 FROM asked JOIN top ON asked.q = top.q AND asked.country IS NOT DISTINCT FROM top.country),
  near AS (SELECT query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS n
    FROM asked JOIN embeddings a ON a.vec_id = query_id JOIN intl i ON asked.country IS NULL OR asked.country = i.country JOIN embeddings b ON b.vec_id = i.id WHERE b.vec_id <> query_id QUALIFY n <= 20),
  h AS (SELECT coalesce(l.query_id, n.query_id) AS query_id, coalesce(l.id, n.id) AS id, coalesce(bm25, 0) + CASE WHEN cosine IS NULL THEN 0 ELSE 1 / (1 + acos(greatest(-1, least(1, cosine)))) END AS raw FROM lexical l FULL JOIN near n ON l.query_id = n.query_id AND l.id = n.id)
  SELECT query_id, id, round(raw, 6) AS raw, round(least(raw, 1.0) * 0.6, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, id) AS rank FROM h QUALIFY rank <= 10"""

QUERIES = {"second_search": (second_search, _AGAIN), "country_search": (country_search, _SEARCH), "country_hybrid": (country_hybrid, _HYBRID)}
