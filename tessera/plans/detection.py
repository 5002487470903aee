"""Queries on normal forms, dictionaries and detection: name -> (callable, DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import detect, dictionary
from tessera.operators import jobs as j
from tessera.plans import duck, inputs

_L, _S, _M, _A = inputs.LISTINGS_SQL, inputs.SCREEN_SQL, inputs.MOVIE_SQL, inputs.ALIASES_SQL


def _normal(form, spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = inputs.listings(spark, sf_dir).groupBy("amenity").count()  # each distinct string once
    return found.select("amenity", form(F.col("amenity")).alias(name), F.col("count").alias("n"))


def _normal_sql(expression: str, name: str) -> str:
    return f"WITH {_L} SELECT amenity, {expression} AS {name}, count(*) AS n FROM listings GROUP BY amenity"


FORMS = {
    "accent_fold": (t.fold_accents, "strip_accents(amenity)"),
    "norm_string": (t.plain, duck.plain("amenity")),
    "norm_track_a": (t.light, duck.light("amenity")),
    "norm_track_b": (t.without_stopwords, duck.without_stopwords("amenity")),
    "norm_track_c": (lambda c: F.array_join(t.tokens(c), ","), f"array_to_string({duck.tokens('amenity')}, ',')"),
    "concat_form": (t.concat_form, duck.concat_form("amenity")),
    "sentinel_clean": (t.unblank, duck.unblank("amenity")),
    "segment_split": (lambda c: F.array_join(t.segments(c), "~"), f"array_to_string({duck.segments('amenity')}, '~')"),
}


def circuit_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inputs.listings(spark, sf_dir).groupBy("circuit").count()
    return detect.resolved_circuit(found, inputs.aliases(spark)).select("circuit", "resolved", F.col("count").alias("n"))


CIRCUIT_SQL = f"""WITH {_L}, {_A}, c AS (SELECT circuit, {duck.strip("coalesce(circuit, '')")} AS s, count(*) AS n FROM listings GROUP BY circuit)
SELECT circuit, lower(coalesce(canonical, lower(s))) AS resolved, n FROM c LEFT JOIN aliases ON alias = lower(s)"""

WORDS_SQL = f"words AS (SELECT *, {duck.light('keyword')} AS norm_a, {duck.without_stopwords('keyword')} AS norm_b, {duck.tokens('keyword')} AS norm_c, {duck.concat_form('keyword')} AS concat FROM dictionary)"


def dict_build_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.last_writer(dictionary.approved(inputs.screen(spark)), "norm_b").select("norm_b", "id", "keyword", "tier")


def dict_build_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.first_writer(dictionary.approved(inputs.movie(spark)), "concat").select("concat", "id", "keyword", "tier")


# a sheet of parts: every 50th row is a tier marker
_SHEET = "CASE WHEN p_partkey % 50 = 1 THEN 'AMENITIES_PRIORITY_' || CAST((p_partkey // 50) % 6 + 1 AS VARCHAR) ELSE p_name END"


def dict_fill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = inputs.table(spark, sf_dir, "part")
    tier = ((F.floor(F.col("p_partkey") / 50)) % 6 + 1).cast("string")
    cell = F.when(F.col("p_partkey") % 50 == 1, F.concat(F.lit("AMENITIES_PRIORITY_"), tier)).otherwise(F.col("p_name"))
    return dictionary.fill_down(part.select(F.col("p_partkey").alias("row_no"), cell.alias("cell"))).select("row_no", "norm", "tier")


FILL_SQL = f"""WITH s AS (SELECT p_partkey AS row_no, {_SHEET} AS cell FROM part),
m AS (SELECT *, TRY_CAST(nullif(regexp_extract(cell, 'AMENITIES_PRIORITY_([0-9]+)', 1), '') AS INTEGER) AS mark FROM s),
f AS (SELECT row_no, cell, mark, last_value(mark IGNORE NULLS) OVER (ORDER BY row_no) AS tier FROM m),
n AS (SELECT row_no, tier, {duck.plain('cell')} AS norm FROM f WHERE mark IS NULL AND tier IS NOT NULL)
SELECT row_no, norm, tier FROM n WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY norm, tier ORDER BY row_no) = 1"""


def dict_na_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = inputs.table(spark, sf_dir, "part")
    words = inputs.screen(spark)
    n = words.count()
    circuit = F.when(F.col("p_partkey") % 4 == 0, "NA").when(F.col("p_partkey") % 4 == 1, " ").otherwise("AMC")
    sheet = part.join(words.select("id", "keyword"), F.col("p_partkey") % (n + 5) == F.col("id")).select(F.col("p_partkey").alias("row_no"), "keyword", circuit.alias("circuit"), F.col("p_brand").alias("format"))
    return dictionary.with_na_default(words, sheet).select("id", "norm", "na_default")


NA_SQL = f"""WITH {_S}, g AS (SELECT {duck.plain('keyword')} AS norm, arg_max(p_brand, p_partkey) AS given FROM part JOIN dictionary ON p_partkey % {len(inputs.SCREEN) + 5} = id WHERE p_partkey % 4 < 2 GROUP BY 1)
SELECT id, {duck.plain('keyword')} AS norm, coalesce(given, na_default) AS na_default FROM dictionary LEFT JOIN g ON g.norm = {duck.plain('keyword')}"""

def _circuit_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a sheet of keywords, of which most rows name a circuit, in spellings that differ by case."""
    k = F.col("p_partkey")
    circuit = F.when(k % 4 == 0, "na").when(k % 9 == 0, F.upper(F.concat(F.lit("Circuit "), k % 20))).when(k % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit(" Circuit "), k % 20, F.lit(" ")))
    return inputs.table(spark, sf_dir, "part").select(k.alias("row_no"), F.when(k % 11 != 0, F.col("p_name")).alias("keyword"), F.when(k % 13 != 0, F.col("p_brand")).otherwise(" ").alias("format"), circuit.alias("circuit"))


_CIRCUITS = """c AS (SELECT p_partkey AS row_no, p_name AS keyword, p_brand AS format, 4 AS tier, CASE WHEN p_partkey % 9 = 0 THEN 'CIRCUIT ' ELSE 'Circuit ' END || p_partkey % 20 AS circuit, 'approved' AS status
  FROM part WHERE p_partkey % 4 <> 0 AND (p_partkey % 9 = 0 OR p_partkey % 7 <> 0) AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0)"""

_PREFIX = detect.PREFIX_LENGTH
SEGS_SQL = f"""p AS (SELECT DISTINCT amenity, circuit FROM listings), e AS (
  SELECT amenity, circuit, unnest({duck.segments("coalesce(amenity, '')")}) AS seg, generate_subscripts({duck.segments("coalesce(amenity, '')")}, 1) - 1 AS pos FROM p
), g AS (SELECT DISTINCT seg FROM e), s AS (SELECT seg, {duck.light('seg')} AS a, {duck.without_stopwords('seg')} AS b, {duck.tokens('seg')} AS c, {duck.concat_form('seg')} AS x FROM g)"""


def _match_sql(exact: bool) -> str:
    x = "(SELECT arg_min(id, struct_pack(tier := tier, id := id)) FROM words WHERE concat = s.x AND concat <> '')" if exact else "NULL"
    return f"""i AS (SELECT seg,
  (SELECT arg_max(id, struct_pack(tier := tier, id := id)) FROM words WHERE norm_a = s.a) AS ia,
  (SELECT arg_max(id, struct_pack(tier := tier, id := id)) FROM words WHERE norm_b = s.b) AS ib, {x} AS ix,
  (SELECT arg_min(id, struct_pack(tier := tier, id := id)) FROM words WHERE len(norm_c) > 0 AND (list_has_all(s.c, norm_c) OR (length(concat) >= {_PREFIX} AND starts_with(s.x, concat)))) AS ic FROM s),
h AS (SELECT seg, coalesce(ia, ib, ix, ic) AS id, CASE WHEN ia IS NOT NULL THEN 'A' WHEN ib IS NOT NULL THEN 'B' ELSE 'C' END AS track FROM i WHERE coalesce(ia, ib, ix, ic) IS NOT NULL)"""


def track_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.listings(spark, sf_dir).select("amenity").distinct()
    parts = rows.select(F.explode(t.segments(F.coalesce("amenity", F.lit("")))).alias("seg"))
    return detect.matched_segments(parts, inputs.screen(spark)).select("seg", "id", "track")


TRACK_SQL = f"WITH {_L}, {_S}, {WORDS_SQL}, {SEGS_SQL}, {_match_sql(False)} SELECT seg, id, track FROM h"


def detect_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect_screen(inputs.listings(spark, sf_dir), inputs.screen(spark), inputs.aliases(spark)).drop("l_partkey")


_BLANK = f"({duck.strip("coalesce(amenity, '')")} = '')"
DETECTED_SQL = f"""{_L}, {_S}, {_A}, {WORDS_SQL}, {SEGS_SQL}, {_match_sql(False)},
r AS (SELECT amenity, circuit, lower(coalesce(canonical, lower({duck.strip("coalesce(circuit, '')")}))) AS resolved FROM p LEFT JOIN aliases ON alias = lower({duck.strip("coalesce(circuit, '')")})),
b AS (SELECT r.amenity, r.circuit, arg_min(struct_pack(tier := w.tier, keyword := w.keyword, format := w.format, own := w.circuit, na := w.na_default, track := h.track),
    struct_pack(t := w.tier, m := CASE WHEN lower(w.circuit) = r.resolved THEN 0 ELSE 1 END, o := CASE WHEN w.circuit IS NOT NULL THEN 0 ELSE 1 END, pos := e.pos)) AS hit
  FROM e JOIN r ON e.amenity IS NOT DISTINCT FROM r.amenity AND e.circuit IS NOT DISTINCT FROM r.circuit JOIN h USING (seg) JOIN words w ON w.id = h.id GROUP BY r.amenity, r.circuit),
f AS (SELECT r.*, b.hit, {_BLANK} AS blank,
  CASE WHEN NOT {_BLANK} AND len(list_filter({duck.segments("coalesce(r.amenity, '')")}, lambda s: contains(lower(s), 'vip'))) > 0 THEN
    CASE r.resolved WHEN 'caribbean cinemas - us territory' THEN 'Caribbean VIP' WHEN 'caribbean cinemas - us territories' THEN 'Caribbean VIP' WHEN 'cineplex entertainment' THEN 'VIP Cineplex' END END AS vip,
  r.resolved = 'imax' AND ({_BLANK} OR b.hit IS NULL OR b.hit.tier > 1) AS imax,
  coalesce((SELECT arg_max(format, struct_pack(tier := tier, id := id)) FROM words w WHERE lower(w.keyword) = lower(b.hit.keyword) AND lower(w.circuit) = r.resolved AND w.circuit <> ''),
    CASE WHEN coalesce(b.hit.own, '') = '' THEN b.hit.format END, nullif(b.hit.na, ''), 'Standard') AS hf
  FROM (SELECT amenity AS amenity, circuit, resolved FROM r) r LEFT JOIN (SELECT amenity AS am, circuit AS ci, hit FROM b) b ON r.amenity IS NOT DISTINCT FROM am AND r.circuit IS NOT DISTINCT FROM ci),
d AS (SELECT amenity, circuit, CASE WHEN vip IS NOT NULL THEN vip WHEN imax THEN 'IMAX' WHEN hit IS NULL THEN 'Standard' ELSE hf END AS screen_format,
  CASE WHEN vip IS NOT NULL THEN 'A' ELSE coalesce(hit.track, 'none') END AS match_track,
  CASE WHEN vip IS NOT NULL THEN 1.0 WHEN hit IS NOT NULL THEN CASE hit.track WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.9 ELSE 0.75 END WHEN blank OR imax THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN vip IS NOT NULL THEN 'VIP' ELSE hit.keyword END AS matched_keyword,
  CASE WHEN vip IS NOT NULL THEN 'VIP Override' WHEN imax THEN 'IMAX Circuit Override' WHEN blank THEN 'Empty Input' WHEN hit IS NULL THEN 'No Match'
    WHEN hit.tier = 6 THEN 'Bucket Priority 6 (Standard)' WHEN hf = 'Standard' THEN 'Bucket Priority ' || hit.tier || ' (Circuit Unscoped → Standard)' ELSE 'Bucket Priority ' || hit.tier END AS match_source,
  NOT blank AND hit IS NULL AND vip IS NULL AND NOT imax AS fired_ai FROM f),
detected AS (SELECT l.row_id, l.l_partkey, d.* FROM listings l JOIN d ON l.amenity IS NOT DISTINCT FROM d.amenity AND l.circuit IS NOT DISTINCT FROM d.circuit)"""


def detect_movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect_movie(inputs.listings(spark, sf_dir).select("row_id", "amenity"), inputs.movie(spark))


MOVIE_SQL = f"""WITH {_L}, {_M}, {WORDS_SQL}, {SEGS_SQL}, {_match_sql(True)},
b AS (SELECT amenity, arg_min(struct_pack(tier := w.tier, keyword := w.keyword, format := w.format, track := h.track), struct_pack(t := w.tier, pos := e.pos)) AS hit FROM e JOIN h USING (seg) JOIN words w ON w.id = h.id GROUP BY amenity)
SELECT row_id, l.amenity, coalesce(hit.format, '2D') AS movie_format, coalesce(hit.track, 'none') AS match_track,
  CASE WHEN hit IS NOT NULL THEN CASE hit.track WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.9 ELSE 0.75 END WHEN {duck.strip('l.amenity')} = '' THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, hit.keyword AS matched_keyword,
  CASE WHEN hit IS NOT NULL THEN 'Bucket Priority ' || hit.tier WHEN {duck.strip('l.amenity')} = '' THEN 'Empty Input' ELSE 'No Match' END AS match_source, {duck.strip('l.amenity')} <> '' AND hit IS NULL AS fired_ai
FROM listings l LEFT JOIN b ON l.amenity = b.amenity"""


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.detect_screen(inputs.listings(spark, sf_dir), inputs.screen(spark), inputs.aliases(spark))
    user = F.when(F.col("l_partkey") % 20 == 0, "Other").when(F.col("l_partkey") % 3 == 0, F.concat(F.lit(" "), F.upper("screen_format"))).otherwise(F.col("screen_format"))
    return rows.withColumn("user_format", user)


_USER = "CASE WHEN l_partkey % 20 = 0 THEN 'Other' WHEN l_partkey % 3 = 0 THEN ' ' || upper(screen_format) ELSE screen_format END"


def batch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.batch_counters(_audited(spark, sf_dir))


COUNTERS_SQL = f"""WITH {DETECTED_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE screen_format <> 'Standard') AS matched, count(*) FILTER (WHERE screen_format = 'Standard') AS standard,
  count(*) FILTER (WHERE fired_ai) AS no_match, count(*) FILTER (WHERE lower(trim({_USER})) <> lower(trim(screen_format))) AS anomalies FROM detected"""


def audit_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.anomalies(_audited(spark, sf_dir)).select("row_id", "user_format", "screen_format")


def top_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.top_unmatched(_audited(spark, sf_dir), 10)


def dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.pending_keys(_audited(spark, sf_dir)).select("key", "n_rows", "first_row")


_PENDING_SQL = f"""SELECT 'class:v1:' || lower(trim(amenity)) || ':' || lower(trim(coalesce(circuit, ''))) AS key, count(*) AS n_rows, min(row_id) AS first_row FROM detected WHERE fired_ai GROUP BY 1"""


def ai_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.sampled_keys(j.pending_keys(_audited(spark, sf_dir)), 50).select("key", "n_rows", "first_row")


def cache_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = inputs.values(spark, "amenity string", inputs.AMENITIES).where("id % 2 = 0").select(F.concat(F.lit("class:v1:"), F.lower(F.trim("amenity")), F.lit(":")).alias("key"), F.concat(F.lit("hit "), "id").alias("payload"))
    return j.prefetched(j.pending_keys(_audited(spark, sf_dir)), cache).select("key", "n_rows", "payload", "cached")


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.review_items(_audited(spark, sf_dir)).select("row_id", "type", "status", "string")


QUERIES = {
    **{k: ((lambda s, d, f=f, k=k: _normal(f, s, d, "form")), _normal_sql(sql, "form")) for k, (f, sql) in FORMS.items()},
    "circuit_resolve": (circuit_resolve, CIRCUIT_SQL),
    "dict_build_last_wins": (dict_build_last_wins, f"WITH {_S}, {WORDS_SQL} SELECT norm_b, id, keyword, tier FROM words QUALIFY row_number() OVER (PARTITION BY norm_b ORDER BY tier DESC, id DESC) = 1"),
    "dict_build_first_wins": (dict_build_first_wins, f"WITH {_M}, {WORDS_SQL} SELECT concat, id, keyword, tier FROM words QUALIFY row_number() OVER (PARTITION BY concat ORDER BY tier, id) = 1"),
    "dict_fill_down": (dict_fill_down, FILL_SQL),
    "dict_na_default": (dict_na_default, NA_SQL),
    "dict_circuits": (lambda s, d: dictionary.of_circuits(_circuit_sheet(s, d)), f"WITH {_CIRCUITS} SELECT * FROM c"),
    "dict_circuit_aliases": (lambda s, d: dictionary.circuit_aliases(dictionary.of_circuits(_circuit_sheet(s, d))), f"WITH {_CIRCUITS} SELECT lower(circuit) AS alias, arg_max(circuit, row_no) AS canonical FROM c GROUP BY 1 UNION ALL SELECT lower(x), x FROM (VALUES ('Caribbean Cinemas - US Territory'), ('Cineplex Entertainment')) v(x)"),
    "track_joins": (track_joins, TRACK_SQL),
    "detect_screen": (detect_screen, f"WITH {DETECTED_SQL} SELECT * EXCLUDE (l_partkey) FROM detected"),
    "detect_movie": (detect_movie, MOVIE_SQL),
    "batch_counters": (batch_counters, COUNTERS_SQL),
    "audit_anomalies": (audit_anomalies, f"WITH {DETECTED_SQL} SELECT row_id, {_USER} AS user_format, screen_format FROM detected WHERE lower(trim({_USER})) <> lower(trim(screen_format))"),
    "top_unmatched": (top_unmatched, f"WITH {DETECTED_SQL} SELECT lower(trim(amenity)) AS string, count(*) AS n FROM detected WHERE fired_ai GROUP BY 1 ORDER BY n DESC, min(row_id) LIMIT 10"),
    "dedup_keys": (dedup_keys, f"WITH {DETECTED_SQL} {_PENDING_SQL}"),
    "ai_sample": (ai_sample, f"WITH {DETECTED_SQL}, k AS ({_PENDING_SQL}) SELECT * FROM k ORDER BY first_row LIMIT 50"),
    "cache_prefetch": (cache_prefetch, f"WITH {DETECTED_SQL}, k AS ({_PENDING_SQL}), c AS (SELECT 'class:v1:' || lower(trim(amenity)) || ':' AS key, 'hit ' || id AS payload FROM amenities WHERE id % 2 = 0) SELECT k.key, n_rows, payload, payload IS NOT NULL AS cached FROM k LEFT JOIN c USING (key)"),
    "review_rows": (review_rows, f"WITH {DETECTED_SQL} SELECT row_id, 'ai_suggestion' AS type, 'pending' AS status, amenity AS string FROM detected WHERE fired_ai"),
}
