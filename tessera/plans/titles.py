"""Queries on titles, retrieval and decisions: name -> (callable, DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions import text as t
from tessera.functions import titles as ti
from tessera.functions.fuzzy import ratio, wratio
from tessera.functions.unicode_forms import repaired
from tessera.operators import decide, retrieve, vector_index
from tessera.operators.written import cut
from tessera.plans import inputs

# A small catalog of titles, release dates and parents.
CATALOG = (
    (14039, "Harry Potter and the Sorcerer's Stone", "2001-11-16", None), (14038, "Harry Potter and the Chamber of Secrets", "2002-11-15", 14039), (14061, "Harry Potter and the Prisoner of Azkaban", "2004-06-04", 14039),
    (13868, "Toy Story", "1995-11-22", None), (14046, "Toy Story 2", "1999-11-24", 13868), (10731, "Toy Story 3", "2010-06-18", 13868), (105988, "Toy Story 4", "2019-06-21", 13868), (1, "Moana", "2016-11-23", 1),
    (2, "Moana 2", "2024-11-27", 1), (3, "Moana Animated", "2016-11-23", 99), (4, "The Dark Knight", "2008-07-18", None), (5, "The Dark Knight Rises", "2012-07-20", 4), (6, "Batman Begins", "2005-06-15", None),
    (7, "The Lion King", "1994-06-24", None), (8, "The Avengers", "2012-05-04", None), (9, "Das Boot", "1981-09-17", None), (10, "Interstellar", "2014-11-07", None), (11, "The Godfather Part 2", "0000-00-00", None),
    (12, "Rocky IV", "1985-11-27", None), (13, "Jaws", "1975-06-20", None), (14, "Blade Runner 2049", "2017-10-06", None), (15, "Alien", "1979-05-25", None), (16, "Dune", "2021-10-22", None), (17, "Gladiator II", "2031-01-01", None),
    (18, "Avatar", "2009-12-18", None), (19, "Us", "2019-03-22", None), (20, "I, Robot", "bad date", None), (21, "La", "2020-01-01", None),
)
_ROWS = tuple(CATALOG)
CATALOG_SQL = inputs.values_sql("films", "film_id, title, release_date, parent_id", _ROWS) + """, catalog AS (
  SELECT film_id AS id, title, release_date, parent_id FROM films
  UNION ALL SELECT 200000 + min(p_partkey) AS id, p_name AS title, strftime(DATE '1995-01-01' + CAST(min(p_partkey) AS INTEGER), '%Y-%m-%d') AS release_date, NULL AS parent_id FROM part GROUP BY p_name
)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    films = inputs.values(spark, "film_id long, title string, release_date string, parent_id long", _ROWS).select(F.col("film_id").alias("id"), "title", "release_date", "parent_id")
    parts = inputs.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("k"))
    day = F.date_format(F.date_add(F.to_date(F.lit("1995-01-01")), F.col("k").cast("int")), "yyyy-MM-dd")
    return films.unionByName(parts.select((F.col("k") + 200000).alias("id"), "title", day.alias("release_date"), F.lit(None).cast("long").alias("parent_id")))


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.titled(spark, sf_dir).groupBy("raw").agg(F.min("query_id").alias("query_id"))  # each distinct title once
    return ti.with_normal_form(raw).select("query_id", "raw", "cleaned", "edition_markers", "country_code", "event_type", "franchise_hint", "ordinal")


def _re(p: str) -> str:
    return p.replace("'", "''")


def _normal_sql() -> str:
    x = "raw"
    for p in ti.PROMOTIONS:
        x = f"trim(regexp_replace({x}, '{_re(p)}', '', 'gi'))"
    y = "bare"
    for p in ti.FORMATS:
        y = f"trim(regexp_replace({y}, '{_re(p)}', ' ', 'gi'))"
    code = " ".join(rf"WHEN regexp_matches(name, '(?i)\b{w}\b') THEN '{c}'" for w, c in ti.COUNTRIES)
    cut = " ".join(rf"WHEN regexp_matches(name, '(?i)\b{w}\b') THEN trim(regexp_replace(name, '\b{w}\b', '', 'gi'))" for w, _ in ti.COUNTRIES)
    event = " ".join("WHEN " + " OR ".join(f"contains(lower(rest), '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in ti.EVENTS)
    hint = " ".join(f"WHEN regexp_matches(rest, '(?i){p}') THEN '{n}'" for p, n in ti.FRANCHISES)
    romans = "[" + ", ".join(f"'{r}'" for r in ti.ROMANS) + "]"
    number = r"regexp_extract(list_filter(regexp_extract_all(rest, '(?i)\b\d+\b(?:\s*(?:mm|min|fps))?'), lambda z: regexp_full_match(z, '\d+'))[1], '(\d+)', 1)"
    ordinals = [r"TRY_CAST(regexp_extract(rest, '(?i)part\s*(\d+)', 1) AS BIGINT)", r"TRY_CAST(regexp_extract(rest, '(\d+)/(\d+)', 1) AS BIGINT)", f"TRY_CAST({number} AS BIGINT)", rf"list_position({romans}, lower(regexp_extract(rest, '(?i)\b(I{{1,3}}|IV|VI{{0,3}}|IX|XI{{0,2}}|XIV|XV)\b', 1)))"]
    ordinal = ", ".join(f"CASE WHEN {o} BETWEEN 1 AND 20 THEN {o} END" for o in ordinals)
    marks = "[" + ", ".join(f"'{e}'" for e in ti.EDITIONS) + "]"
    return f"""{inputs.TITLED_SQL}, n0 AS (SELECT raw, min(query_id) AS query_id FROM titled GROUP BY raw), n1 AS (SELECT *, {x} AS bare FROM n0),
n2 AS (SELECT *, trim({y}, ' .,:-') AS name FROM n1), n3 AS (SELECT *, CASE {code} END AS country_code, CASE {cut} ELSE name END AS rest FROM n2),
normal AS (SELECT query_id, raw, trim(rest, ' .,:-') AS cleaned, list_filter({marks}, lambda k: contains(lower(bare), lower(k))) AS edition_markers, country_code,
  CASE {event} ELSE 'MOVIE' END AS event_type, CASE {hint} END AS franchise_hint, CAST(coalesce({ordinal}) AS INTEGER) AS ordinal FROM n3)"""


NORMAL_SQL = _normal_sql()


def _field(name: str):
    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _normal(spark, sf_dir).select("query_id", "raw", name)
        return found.withColumn(name, F.array_join(name, "|")) if name == "edition_markers" else found

    return one


def _field_sql(name: str) -> str:
    return f"WITH {NORMAL_SQL} SELECT query_id, raw, " + ("array_to_string(edition_markers, '|') AS edition_markers" if name == "edition_markers" else name) + " FROM normal"


_CONFLICT_ROMANS = "[" + ", ".join(f"'{r}'" for r in ti.ROMANS) + "]"


def _conflict_sql(title: str, wanted: str) -> str:
    found = rf"""list_filter(list_concat(list_transform(regexp_extract_all({title}, '\b(\d+)\b', 1), lambda z: TRY_CAST(z AS BIGINT)),
      list_transform(regexp_extract_all({title}, '(?i)\b(I{{1,3}}|IV|VI{{0,3}}|IX)\b', 1), lambda z: CAST(list_position({_CONFLICT_ROMANS}, lower(z)) AS BIGINT))), lambda z: z BETWEEN 1 AND 10)"""
    return f"(len({found}) > 0 AND NOT list_contains({found}, {wanted}))"


def ordinal_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(1, 6).select(F.col("id").alias("wanted"))
    rows = catalog(spark, sf_dir).select("id", "title").join(wanted, F.lit(True))
    return rows.select("id", "wanted", ti.conflicting_ordinal(F.col("title"), F.col("wanted")).alias("conflict"))


def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).select("id", "release_date", t.release_date(F.col("release_date")).cast("string").alias("parsed"))


_DATE = r"CASE WHEN substr({0}, 1, 4) NOT IN ('0000', '9999') AND regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') AND year(TRY_CAST({0} AS DATE)) < 2030 THEN TRY_CAST({0} AS DATE) END"


def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("id") % 2 == 0, "Canada")
    return catalog(spark, sf_dir).select("id", t.embed_text(F.col("title"), F.col("release_date"), F.lit(""), c).alias("embed_text"))


def title_lookup_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(spark, sf_dir).select("query_id", ti.without_brackets(F.col("raw")).alias("unbracketed"), ti.after_colon(F.col("raw")).alias("tail"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal forms, written: a join on one of them would else push its whole expression down through every step and
    repeat it, some 400 KB of plan for a franchise."""
    return cut(_normal(spark, sf_dir).withColumnRenamed("cleaned", "q"), "title-queries")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog, written: a search reads it several times, and each would be a pass over all parts."""
    return cut(catalog(spark, sf_dir), "title-catalog")


def alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalog(spark, sf_dir)
    return retrieve.by_alias(_queries(spark, sf_dir), _aliases(c), c)


def _aliases(c: DataFrame) -> DataFrame:
    """Each title, in capitals, names its row; in small letters it names its parent too, so some names have two rows."""
    return c.select(F.upper("title").alias("alias"), "id").unionByName(c.where("parent_id is not null").select(F.lower("title").alias("alias"), F.col("parent_id").alias("id")))


ALIAS_SQL = f"""WITH {NORMAL_SQL}, {CATALOG_SQL}, a AS (SELECT lower(title) AS a, id FROM catalog UNION ALL SELECT lower(title), parent_id FROM catalog WHERE parent_id IS NOT NULL), k AS (SELECT a, max(id) AS id FROM a GROUP BY a)
SELECT query_id, id, 0.95::DOUBLE AS score, 'alias' AS source FROM normal JOIN k ON lower(cleaned) = a WHERE id IN (SELECT id FROM catalog)"""


def franchise_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.by_franchise(_queries(spark, sf_dir), catalog(spark, sf_dir))


FRANCHISE_SQL = f"""WITH {NORMAL_SQL}, {CATALOG_SQL}, {inputs.values_sql("known", "hint, n, movie", retrieve.INSTALLMENTS)}
SELECT query_id, movie AS id, 0.95::DOUBLE AS score, 'franchise_map' AS source FROM normal JOIN known ON franchise_hint = hint AND ordinal = n WHERE movie IN (SELECT id FROM catalog)"""


def ilike_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.by_pattern(_queries(spark, sf_dir), _catalog(spark, sf_dir))


ILIKE_SQL = """pattern AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY lower(title) <> lower(cleaned), length(title), id) AS rank
  FROM normal JOIN catalog ON contains(lower(title), lower(cleaned)) WHERE cleaned <> '' QUALIFY rank <= 20)"""


def _grams(x: str) -> str:
    return rf"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(strip_accents({x})), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


TRIGRAM_SQL = f"""tq AS (SELECT query_id, {_grams('cleaned')} AS g FROM normal), tc AS (SELECT id, title, {_grams('title')} AS g FROM catalog),
trigram AS (SELECT query_id, id, len(list_intersect(tq.g, tc.g))::DOUBLE / (len(tq.g) + len(tc.g) - len(list_intersect(tq.g, tc.g))) AS similarity,
  row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(tq.g, tc.g))::DOUBLE / (len(tq.g) + len(tc.g) - len(list_intersect(tq.g, tc.g))) DESC, id) AS rank FROM tq JOIN tc ON len(tq.g) + len(tc.g) > 0
  AND len(list_intersect(tq.g, tc.g))::DOUBLE / (len(tq.g) + len(tc.g) - len(list_intersect(tq.g, tc.g))) >= 0.3 QUALIFY rank <= 20)"""


def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.by_trigrams(_queries(spark, sf_dir), _catalog(spark, sf_dir))


def db_search_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.cascade(_queries(spark, sf_dir), _catalog(spark, sf_dir))


def _lexical(spark: SparkSession, sf_dir: str, q: DataFrame | None = None, c: DataFrame | None = None) -> DataFrame:
    """Every query with the titles that BM25 finds for it in the whole catalog. q, c: the queries and the catalog, if they
    are there."""
    c, q = c or _catalog(spark, sf_dir), q or _queries(spark, sf_dir)
    return retrieve.bm25(q, c).join(c, "id").join(q, "query_id")


def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir).select("query_id", "id", F.round(sim.coverage(F.col("q"), F.col("title")), 6).alias("coverage"))


_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> ''))"


def plausible_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of the trigram search that pass the guards, scored by their similarity out of 100."""
    c, q = _catalog(spark, sf_dir), _queries(spark, sf_dir)
    pairs = retrieve.by_trigrams(q, c).join(c, "id").join(q, "query_id").withColumn("score", F.round(100 * F.col("similarity"), 4))
    return retrieve.plausible(pairs).select("query_id", "id", "score")


def _plausible_sql() -> str:
    guards = f"(len(w) = 0 OR len(list_intersect(w, c)) >= 0.6 * len(w) OR score >= 90) AND NOT (ordinal IS NOT NULL AND {_conflict_sql('title', 'CAST(ordinal AS BIGINT)')})"
    return f"""WITH {NORMAL_SQL}, {CATALOG_SQL}, {TRIGRAM_SQL}, y AS (SELECT query_id, id, title, ordinal, round(100 * similarity, 4) AS score, {_TOKENS.format("cleaned")} AS w, {_TOKENS.format("title")} AS c FROM trigram JOIN normal USING (query_id) JOIN catalog USING (id))
SELECT query_id, id, score FROM y WHERE lower(title) NOT IN ({", ".join("'" + j + "'" for j in retrieve.JUNK)}) AND length(title) > 3 AND {guards}"""


def fuzzy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.by_fuzzy(_queries(spark, sf_dir), catalog(spark, sf_dir))


def director_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = inputs.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return s.select("s_suppkey", ratio(F.lower("s_name"), F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string"))).alias("ratio"))


#: The longest common subsequence letter by letter: each row holds the best lengths for the prefixes of the name.
DIRECTOR_SQL = """WITH RECURSIVE p AS (SELECT s_suppkey, lower(s_name) AS a, 'supplier ' || s_suppkey AS b FROM supplier),
best AS (SELECT s_suppkey, 0 AS i, list_transform(range(length(a)), lambda z: 0::BIGINT) AS lengths FROM p UNION ALL
  SELECT s_suppkey, i + 1, list_transform(range(1, length(a) + 1), lambda z: list_max(step[1:z])) FROM (
    SELECT s_suppkey, i, a, list_transform(range(1, length(a) + 1), lambda z: greatest(lengths[z], coalesce(lengths[z - 1], 0) + CASE WHEN a[z] = b[i + 1] THEN 1 ELSE 0 END)) AS step FROM best JOIN p USING (s_suppkey) WHERE i < length(b)))
SELECT s_suppkey, 200.0::DOUBLE * lengths[length(a)] / (length(a) + length(b)) AS ratio FROM best JOIN p USING (s_suppkey) WHERE i = length(b)"""


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.bm25(_queries(spark, sf_dir), _catalog(spark, sf_dir)).withColumn("bm25", F.round("bm25", 6))


BM25_SQL = rf"""d AS (SELECT id, list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM catalog), st AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d),
tf AS (SELECT id, any_value(len) AS len, word, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS word FROM d) GROUP BY id, word), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
aq AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(cleaned), '[^a-z0-9]+'), lambda w: w <> ''))) AS word FROM normal),
sc AS (SELECT query_id, id, sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS bm25 FROM aq JOIN df USING (word) JOIN tf USING (word), st GROUP BY query_id, id),
lexical AS (SELECT query_id, id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, id) AS rank FROM sc QUALIFY rank <= 10)"""


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = inputs.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return retrieve.nearest(q, v).withColumn("cosine", F.round("cosine", 6))


NEAR_SQL = """near AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS cosine,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id QUALIFY rank <= 10)"""


def _shown(rows: DataFrame) -> DataFrame:
    """rows (query_id) with a show date: some days after the release of the part that the query is about, or of one film."""
    k = F.col("query_id")
    shift = F.element_at(F.array(*map(F.lit, (0, 3, 45, 400))), (k % 4 + 1).cast("int"))
    first = F.when(k % 8 < 4, F.to_date(F.lit("2016-11-23"))).otherwise(F.date_add(F.to_date(F.lit("1995-01-01")), k.cast("int")))
    return rows.withColumn("show_date", F.date_format(F.date_add(first, shift), "yyyy-MM-dd"))


def _candidates(spark: SparkSession, sf_dir: str, q: DataFrame | None = None, c: DataFrame | None = None) -> DataFrame:
    """What BM25 finds for every query in the whole catalog, a twentieth of it the score: the candidates that SQL can state."""
    rows = _shown(_lexical(spark, sf_dir, q, c))
    return rows.select("query_id", "id", "q", "title", "release_date", "show_date", "edition_markers", "event_type", F.round(F.least(F.lit(1.0), F.col("bm25") / 20), 4).alias("score"), F.col("rank").alias("gen"))


_SHOWN = "strftime(CASE WHEN query_id % 8 < 4 THEN DATE '2016-11-23' ELSE DATE '1995-01-01' + CAST(query_id AS INTEGER) END + ([0, 3, 45, 400])[query_id % 4 + 1], '%Y-%m-%d')"
CANDIDATES_SQL = f"""WITH {NORMAL_SQL}, {CATALOG_SQL}, {BM25_SQL}, cand AS (SELECT query_id, id, cleaned, title, release_date, {_SHOWN} AS show_date, edition_markers, event_type,
  round(least(1.0::DOUBLE, bm25 / 20), 4) AS score, rank AS gen FROM lexical JOIN normal USING (query_id) JOIN catalog USING (id)),
dw AS (SELECT *, {_DATE.format('release_date')} AS rd, abs(date_diff('day', {_DATE.format('show_date')}, {_DATE.format('release_date')})) AS days FROM cand),
comp AS (SELECT *, CASE WHEN days = 0 THEN 'EXACT' WHEN days <= 30 THEN 'NEAR' WHEN days <= 365 THEN 'YEAR' ELSE 'NONE' END AS date_window,
  greatest(0, least(1, score + CASE WHEN days = 0 THEN 0.30 WHEN days <= 30 THEN 0.15 WHEN days <= 365 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN list_contains(edition_markers, 'Live Action') AND (contains(lower(title), 'animated') OR contains(lower(title), 'animation') OR contains(lower(title), 'cartoon')) THEN -0.20 ELSE 0 END::DOUBLE))::DOUBLE AS composite FROM dw),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY composite DESC, gen) AS place, count(*) OVER (PARTITION BY query_id) AS n, max(rd) OVER (PARTITION BY query_id) AS newest FROM comp)"""


def composite_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.composite(_candidates(spark, sf_dir)).select("query_id", "id", "date_window", F.round("composite", 6).alias("composite"), "place")


def decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = _catalog(spark, sf_dir), _queries(spark, sf_dir)
    out = decide.decided(_candidates(spark, sf_dir, q, c), c, q)
    return out.select("query_id", "movie_id", "title", "canonical_id", "confidence", "date_window", "decision")


DECISION_SQL = f"""{CANDIDATES_SQL}, win AS (SELECT *, least(1, composite + CASE WHEN event_type = 'MOVIE' AND n > 1 AND rd = newest THEN 0.05 ELSE 0 END::DOUBLE) AS sure FROM placed WHERE place = 1),
par AS (SELECT c.id, coalesce(p.id, c.id) AS canonical FROM catalog c LEFT JOIN catalog p ON p.id = c.parent_id AND c.parent_id <> c.id)
SELECT q.query_id, coalesce(w.id, 0) AS movie_id, coalesce(w.title, 'Unknown') AS title, coalesce(canonical, 0) AS canonical_id, round(coalesce(sure, 0), 4) AS confidence, coalesce(date_window, 'NONE') AS date_window,
  CASE WHEN w.id IS NULL THEN 'REVIEW' WHEN q.event_type IN ('MULTI_FILM', 'NON_MOVIE') THEN 'REVIEW_' || q.event_type WHEN sure >= 0.9 THEN 'AUTO_ACCEPT' ELSE 'REVIEW' END AS decision
FROM normal q LEFT JOIN win w USING (query_id) LEFT JOIN par ON par.id = w.id"""


def evidence_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = _catalog(spark, sf_dir), _queries(spark, sf_dir)
    out = decide.decided(_candidates(spark, sf_dir, q, c), c, q)
    ids = lambda c: F.array_join(F.transform(F.from_json(c, "array<struct<id: long, title: string, score: double>>"), lambda x: F.concat_ws("=", x["id"].cast("string"), F.format_string("%.4f", x["score"]))), ",")
    return out.select("query_id", ids("fuzzy_top").alias("fuzzy_top"), ids("eliminated").alias("eliminated"))


EVIDENCE_SQL = f"""{CANDIDATES_SQL}, f AS (SELECT query_id, string_agg(id || '=' || printf('%.4f', score), ',' ORDER BY gen) AS fuzzy_top FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gen) AS g FROM placed) WHERE g <= 5 GROUP BY 1),
e AS (SELECT query_id, string_agg(id || '=' || printf('%.4f', composite), ',' ORDER BY place) AS eliminated FROM placed WHERE place BETWEEN 2 AND 5 GROUP BY 1)
SELECT query_id, coalesce(fuzzy_top, '') AS fuzzy_top, coalesce(eliminated, '') AS eliminated FROM normal LEFT JOIN f USING (query_id) LEFT JOIN e USING (query_id)"""


def metadata_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.table(spark, sf_dir, "part")
    rows = p.select("p_partkey", (F.col("p_size") + 80).alias("page_runtime"), (F.col("p_partkey") % 50 + 80).cast("int").alias("master_runtime"), F.col("p_brand").alias("page_director"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).alias("master_director"), F.replace("p_type", F.lit(" "), F.lit(", ")).alias("page_cast"), F.when(F.col("p_partkey") % 3 != 0, F.lit("steel;Brass ; x")).otherwise("").alias("master_cast"))
    return decide.metadata_boost(rows).select("p_partkey", "runtime_label", "director_label", "cast_label", F.round("boost", 6).alias("boost"))


METADATA_SQL = """WITH p AS (SELECT p_partkey, abs(p_size + 80 - (p_partkey % 50 + 80)) AS gap, p_partkey % 2 = 0 AS d, list_distinct(list_filter(list_transform(string_split_regex(lower(replace(p_type, ' ', ', ')), '[,;]'), lambda x: trim(x)), lambda x: x <> '')) AS names, p_partkey % 3 <> 0 AS c FROM part),
l AS (SELECT p_partkey, CASE WHEN gap <= 5 THEN 'RUNTIME_MATCH' ELSE 'RUNTIME_MISMATCH_' || gap || 'min' END AS runtime_label, CASE WHEN d THEN 'DIRECTOR_MATCH' ELSE 'DIRECTOR_UNKNOWN' END AS director_label,
  CASE WHEN NOT c THEN 'CAST_UNKNOWN' WHEN len(list_intersect(names, ['steel', 'brass', 'x'])) > 0 THEN 'CAST_MATCH_' || len(list_intersect(names, ['steel', 'brass', 'x'])) ELSE 'CAST_NO_OVERLAP' END AS cast_label FROM p)
SELECT *, round(CASE runtime_label WHEN 'RUNTIME_MATCH' THEN 0.1 ELSE 0 END + CASE director_label WHEN 'DIRECTOR_MATCH' THEN 0.1 ELSE 0 END + CASE WHEN starts_with(cast_label, 'CAST_MATCH') THEN 0.05 ELSE 0 END, 6)::DOUBLE AS boost FROM l"""


def parent_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.with_parent(catalog(spark, sf_dir)).select("id", "canonical")


def present_in_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = _catalog(spark, sf_dir), _queries(spark, sf_dir)
    r = decide.decided(_candidates(spark, sf_dir, q, c), c, q).select("query_id", "canonical_id", "movie_id")
    return decide.present_in_db(r, c).select("query_id", "mapped_title", "present_in_db")


PRESENT_SQL = f"""WITH decided AS ({DECISION_SQL}), {CATALOG_SQL} SELECT query_id, coalesce(c.title, '') AS mapped_title, CASE WHEN c.id IS NULL THEN 'No' ELSE 'Yes' END AS present_in_db
FROM decided LEFT JOIN catalog c ON c.id = nullif(CASE WHEN canonical_id > 0 THEN canonical_id ELSE movie_id END, 0)"""


def title_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decide.composite(_candidates(spark, sf_dir)).where("place = 1")
    return rows.select("query_id", decide.reasoning(F.col("q"), F.col("title"), F.col("id"), F.col("score"), F.col("date_window")).alias("reasoning"))


REASONING_SQL = f"""{CANDIDATES_SQL} SELECT query_id, 'The title ''' || cleaned || ''' most closely matches ''' || title || ''' (id ' || id || ') with confidence ' || CAST(round_even(100 * score, 0) AS INTEGER) || '%. ' ||
  CASE date_window WHEN 'EXACT' THEN 'Release date matches show date exactly.' WHEN 'NEAR' THEN 'Release date is within 30 days of show date.' WHEN 'YEAR' THEN 'Release date is within one year of show date.' ELSE 'No date proximity signal available.' END AS reasoning FROM placed WHERE place = 1"""


def title_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title for each part, in every third row as it is, else read in the wrong encoding once or twice, and mended."""
    k = F.col("p_partkey")
    whole = F.concat(F.lit("Élodie – “"), "p_name", F.lit("” à "), "p_brand", F.when(k % 2 == 0, F.lit(" 映画")).otherwise(""))
    wrong = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    raw = F.when(k % 3 == 0, whole).when(k % 3 == 1, wrong(whole)).otherwise(wrong(wrong(whole)))
    return inputs.table(spark, sf_dir, "part").select(k.alias("query_id"), repaired(raw).alias("title"))


def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vector_topk by the inverted-file index."""
    v = inputs.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = vector_index.search(v.where("id % 50 = 0").withColumnRenamed("id", "query_id"), vector_index.build(v))
    return found.withColumn("cosine", F.round("cosine", 6))


def pattern_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern for each part, made of its name: empty, with wildcards, of two letters, and as it is."""
    k, name = F.col("p_partkey"), F.col("p_name")
    pattern = (
        F.when(k % 7 == 0, "").when(k % 7 == 1, F.replace(name, F.lit(" "), F.lit("%"))).when(k % 7 == 2, F.concat(F.left(name, F.lit(2)), F.lit("_"), F.substr(name, F.lit(4))))
        .when(k % 7 == 3, F.left(name, F.lit(2))).when(k % 7 == 4, F.upper(name)).when(k % 7 == 5, F.concat(F.right(name, F.lit(4)), F.lit("%"))).otherwise(F.concat(F.lit("%"), F.left(name, F.lit(1)), F.lit("_%"), F.right(name, F.lit(3))))
    )
    q = inputs.table(spark, sf_dir, "part").select(k.alias("query_id"), pattern.alias("q"))
    return retrieve.by_pattern(q, _catalog(spark, sf_dir), empty=True)


PATTERN_SQL = f"""WITH {CATALOG_SQL}, q AS (SELECT p_partkey AS query_id, lower(CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN replace(p_name, ' ', '%') WHEN 2 THEN left(p_name, 2) || '_' || substr(p_name, 4)
  WHEN 3 THEN left(p_name, 2) WHEN 4 THEN upper(p_name) WHEN 5 THEN right(p_name, 4) || '%' ELSE '%' || left(p_name, 1) || '_%' || right(p_name, 3) END) AS q FROM part),
best AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY lower(title) <> q, length(title), id) AS rank FROM (SELECT DISTINCT q FROM q) JOIN catalog ON title ILIKE '%' || q || '%' QUALIFY rank <= 20)
SELECT query_id, id, rank FROM q JOIN best USING (q)"""


def _nearest_titles(spark: SparkSession, sf_dir: str, queries: DataFrame, c: DataFrame, k: int) -> DataFrame:
    """The nearest catalog rows of each query that has a vector; the vector of a part's title is that of its number."""
    v = inputs.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    titles = c.join(v, F.col("id") == F.col("vec_id") + 200000).select("id", "v")
    return retrieve.nearest(queries.join(v, F.col("query_id") == F.col("vec_id")).select("query_id", "v"), titles, k)


def candidates(spark: SparkSession, sf_dir: str, q: DataFrame | None = None, c: DataFrame | None = None) -> DataFrame:
    """Candidates of every query from all ways of retrieval over the whole catalog. q, c: the queries and the catalog, if they
    are there."""
    c, q = c or _catalog(spark, sf_dir), q or _queries(spark, sf_dir)
    return retrieve.generated(q, c, _aliases(c), _nearest_titles(spark, sf_dir, q, c, 20))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by BM25 and vectors together, over the whole catalog."""
    c, q = _catalog(spark, sf_dir), _queries(spark, sf_dir)
    return retrieve.hybrid(retrieve.bm25(q, c), _nearest_titles(spark, sf_dir, q, c, 10)).withColumns({"raw": F.round("raw", 6), "score": F.round("score", 6)})


HYBRID_SQL = f"""WITH {NORMAL_SQL}, {CATALOG_SQL}, {BM25_SQL}, cs AS (SELECT query_id, c.id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine
  FROM normal q JOIN embeddings a ON a.vec_id = query_id, catalog c JOIN embeddings b ON c.id = b.vec_id + 200000),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) AS n FROM cs QUALIFY n <= 10),
h AS (SELECT coalesce(l.query_id, n.query_id) AS query_id, coalesce(l.id, n.id) AS id, coalesce(bm25, 0) + CASE WHEN cosine IS NULL THEN 0 ELSE 1 / (1 + acos(greatest(-1, least(1, cosine)))) END AS raw FROM lexical l FULL JOIN near n ON l.query_id = n.query_id AND l.id = n.id)
SELECT query_id, id, round(raw, 6) AS raw, round(least(raw, 1.0) * 0.6, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, id) AS rank FROM h QUALIFY rank <= 10"""


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidates with the columns that are judged."""
    return _judged(spark, sf_dir, _queries(spark, sf_dir), _catalog(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str, q: DataFrame, c: DataFrame) -> DataFrame:
    found = cut(candidates(spark, sf_dir, q, c), "title-candidates")
    return _shown(found.join(c.select("id", "title", "release_date"), "id").join(q.select("query_id", "q", "ordinal", "edition_markers", "event_type"), "query_id"))


def candidate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).select("query_id", "id", "source", F.round(sim.coverage(F.col("q"), F.col("title")), 6).alias("coverage"))


def candidate_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that pass the guards of the fuzzy search, by their weighted ratio."""
    return retrieve.plausible(_dated(spark, sf_dir).withColumn("score", wratio("q", "title"))).select("query_id", "id", "source", F.round("score", 6).alias("score"))


def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.composite(_dated(spark, sf_dir)).select("query_id", "id", "source", "date_window", F.round("composite", 6).alias("composite"), "place")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = _catalog(spark, sf_dir), _queries(spark, sf_dir)
    return decide.decided(_judged(spark, sf_dir, q, c), c, q)


def candidate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).drop("fuzzy_top", "eliminated")


def candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("query_id", "fuzzy_top", "eliminated")


def candidate_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decide.composite(_dated(spark, sf_dir)).where("place = 1")
    return rows.select("query_id", decide.reasoning(F.col("q"), F.col("title"), F.col("id"), F.col("score"), F.col("date_window")).alias("reasoning"))


_W = f"WITH {NORMAL_SQL}, {CATALOG_SQL}, "
QUERIES = {
    **{k: (_field(f), _field_sql(f)) for k, f in {"title_normalize": "cleaned", "edition_markers": "edition_markers", "event_type": "event_type", "country_code": "country_code", "franchise": "franchise_hint", "ordinal": "ordinal"}.items()},
    "ordinal_conflict": (ordinal_conflict, f"WITH {CATALOG_SQL} SELECT id, wanted, {_conflict_sql('title', 'wanted')} AS conflict FROM catalog, (SELECT unnest(range(1, 6)) AS wanted)"),
    "date_parse": (date_parse, f"WITH {CATALOG_SQL} SELECT id, release_date, CAST({_DATE.format('release_date')} AS VARCHAR) AS parsed FROM catalog"),
    "embed_text": (embed_text, f"WITH {CATALOG_SQL} SELECT id, concat_ws(' ', title, CASE WHEN regexp_matches(release_date, '^[0-9]{{4}}') AND substr(release_date, 1, 4) <> '0000' THEN substr(release_date, 1, 4) END, CASE WHEN id % 2 = 0 THEN 'Canada' END) AS embed_text FROM catalog"),
    "title_lookup_forms": (title_lookup_forms, rf"WITH {NORMAL_SQL} SELECT query_id, trim(regexp_replace(raw, '\s*[\(\[][^\)\]]*[\)\]]\s*', ' ', 'g'), ' -:') AS unbracketed, CASE WHEN trim(string_split(raw, ':')[-1]) <> '' THEN trim(string_split(raw, ':')[-1]) ELSE raw END AS tail FROM normal"),
    "alias_join": (alias_join, ALIAS_SQL),
    "franchise_join": (franchise_join, FRANCHISE_SQL),
    "ilike_search": (ilike_search, f"{_W}{ILIKE_SQL} SELECT * FROM pattern"),
    "trigram_search": (trigram_search, f"{_W}{TRIGRAM_SQL} SELECT * FROM trigram"),
    "db_search_cascade": (db_search_cascade, f"{_W}{ILIKE_SQL}, {TRIGRAM_SQL} SELECT query_id, id, rank, 'pattern' AS method FROM pattern UNION ALL SELECT query_id, id, rank, 'trigram' FROM trigram WHERE query_id NOT IN (SELECT query_id FROM pattern)"),
    "token_coverage": (token_coverage, f"{_W}{BM25_SQL} SELECT query_id, id, CASE WHEN len(w) = 0 THEN 1.0 ELSE round(len(list_intersect(w, c))::DOUBLE / len(w), 6) END::DOUBLE AS coverage FROM (SELECT query_id, id, {_TOKENS.format('cleaned')} AS w, {_TOKENS.format('title')} AS c FROM lexical JOIN normal USING (query_id) JOIN catalog USING (id))"),
    "plausible_pairs": (plausible_pairs, _plausible_sql()),
    "fuzzy_topk": (fuzzy_topk, None),
    "director_ratio": (director_ratio, DIRECTOR_SQL),
    "bm25": (bm25, f"{_W}{BM25_SQL} SELECT query_id, id, round(bm25, 6) AS bm25, rank FROM lexical"),
    "vector_topk": (vector_topk, f"WITH {NEAR_SQL} SELECT query_id, id, round(cosine, 6) AS cosine, rank FROM near"),
    "title_repair": (title_repair, "SELECT p_partkey AS query_id, 'Élodie – “' || p_name || '” à ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' 映画' ELSE '' END AS title FROM part"),
    "vector_index_topk": (vector_index_topk, None),
    "pattern_search": (pattern_search, PATTERN_SQL),
    "hybrid_search": (hybrid_search, HYBRID_SQL),
    "composite_rank": (composite_rank, f"{CANDIDATES_SQL} SELECT query_id, id, date_window, round(composite, 6) AS composite, place FROM placed"),
    "decision": (decision, DECISION_SQL),
    "evidence_struct": (evidence_struct, EVIDENCE_SQL),
    "metadata_checks": (metadata_checks, METADATA_SQL),
    "parent_resolve": (parent_resolve, f"WITH {CATALOG_SQL} SELECT c.id, coalesce(p.id, c.id) AS canonical FROM catalog c LEFT JOIN catalog p ON p.id = c.parent_id AND c.parent_id <> c.id"),
    "present_in_db": (present_in_db, PRESENT_SQL),
    "title_reasoning": (title_reasoning, REASONING_SQL),
    # decisions on candidates of all ways of retrieval, the fuzzy ratio among them; the queries above decide on those of BM25
    **{f.__name__: (f, None) for f in (candidates, candidate_coverage, candidate_plausible, candidate_rank, candidate_decision, candidate_evidence, candidate_reasoning)},
}
