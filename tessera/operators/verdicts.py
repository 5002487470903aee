"""Answers of a remote matcher turned into results: payloads, a second opinion, and what a lookup afterwards finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.titles import conflicting_ordinal, without_brackets
from tessera.operators import scoped

# Thresholds and labels of decisions.
ACCEPTED = 0.90
MOST_SURE = 0.97
LOOKUP_INTERNATIONAL, LOOKUP_DOMESTIC = 0.90, 0.75
NEAR_DAYS, FAR_DAYS = 90, 180
CAP_NEAR, CAP_BETWEEN, CAP_FAR = 0.96, 0.70, 0.85


def by_event(event: Column, confidence: Column) -> Column:
    return F.when(event == "NON_MOVIE", "REVIEW_NON_MOVIE").when(event == "MULTI_FILM", "REVIEW_MULTI_FILM").when(confidence >= ACCEPTED, "AUTO_ACCEPT").otherwise("REVIEW")


def payload_result(payloads: DataFrame) -> DataFrame:
    """query_id, movie_id, title, confidence and decision from payloads (query_id, event_type, best_match_index,
    candidates: an array of movie_id, title, confidence). An index beyond the candidates is the first; none: Unknown."""
    n = F.size("candidates")
    at = F.when(F.coalesce("best_match_index", F.lit(0)) >= n, 0).otherwise(F.coalesce("best_match_index", F.lit(0)))
    best = F.when(n > 0, F.get("candidates", at))
    event = F.coalesce("event_type", F.lit("MOVIE"))
    confidence = F.coalesce(best["confidence"], F.lit(0.0))
    return payloads.select(
        "query_id", F.coalesce(best["movie_id"], F.lit(0)).alias("movie_id"), F.when(n > 0, F.coalesce(best["title"], F.lit(""))).otherwise("Unknown").alias("title"),
        confidence.alias("confidence"), F.when(n > 0, by_event(event, confidence)).otherwise("REVIEW").alias("decision"),
    )


def verified(results: DataFrame, verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """results after verdicts (query_id, verdict, verdict_id, verdict_title, verdict_confidence), and outcome.

    A verdict on an id that is no candidate of its query (candidates: query_id, movie_id) and not 0 is discarded.
    CONFIRM takes its confidence, OVERRULE its film too, NO_DB_MATCH the id 0 and leaves the decision; confidence is
    0.97 at most, and decisions by event type stay.
    """
    known = candidates.select(F.col("query_id").alias("_q"), F.col("movie_id").alias("_m")).distinct()
    v = verdicts.withColumn("verdict_id", F.coalesce("verdict_id", F.lit(0)))
    v = v.join(known, (F.col("query_id") == F.col("_q")) & (F.col("verdict_id") == F.col("_m")), "left").withColumn("_valid", F.col("_m").isNotNull() | (F.col("verdict_id") == 0)).drop("_q", "_m")
    both = results.join(v, "query_id", "left")
    use = F.coalesce(F.col("verdict").isNotNull() & F.col("_valid"), F.lit(False))
    kind = F.when(use, F.when(F.col("verdict").isin("CONFIRM", "OVERRULE"), F.col("verdict")).otherwise("NO_DB_MATCH"))
    sure = F.least(F.coalesce("verdict_confidence", "confidence"), F.lit(MOST_SURE))
    event = F.col("decision").isin("REVIEW_NON_MOVIE", "REVIEW_MULTI_FILM")
    named = F.when(F.coalesce("verdict_title", F.lit("")) != "", F.col("verdict_title")).otherwise(F.col("title"))
    return both.select(
        "query_id",
        F.when(kind == "OVERRULE", F.col("verdict_id")).when(kind == "NO_DB_MATCH", 0).otherwise(F.col("movie_id")).alias("movie_id"),
        F.when(kind.isin("OVERRULE", "NO_DB_MATCH"), named).otherwise(F.col("title")).alias("title"),
        F.when(use, sure).otherwise(F.col("confidence")).alias("confidence"),
        F.when(kind.isin("CONFIRM", "OVERRULE") & ~event, F.when(sure >= ACCEPTED, "AUTO_ACCEPT").otherwise("REVIEW")).otherwise(F.col("decision")).alias("decision"),
        F.coalesce(kind, F.when(F.col("verdict").isNotNull(), "discarded"), F.lit("none")).alias("outcome"),
    )


def post_lookup(results: DataFrame, attempts: DataFrame, catalog: DataFrame, international: Column) -> DataFrame:
    """results without a film (movie_id 0) after a lookup of attempts (query_id, rank, title) in catalog (id, title).

    The attempt of least rank with a film of that title (letters of either case; the least id of several) wins. An
    international row then has confidence 0.90 and REVIEW becomes AUTO_ACCEPT, another 0.75 and AUTO_ACCEPT becomes REVIEW.
    """
    names = catalog.groupBy(F.lower(F.trim("title")).alias("_t")).agg(F.min_by(F.struct("id", "title"), "id").alias("_film"))
    hits = attempts.withColumn("_t", F.lower(F.trim("title"))).join(names, "_t").groupBy("query_id").agg(F.min_by("_film", "rank").alias("_film"))
    both = results.join(hits, "query_id", "left")
    hit = F.coalesce((F.col("movie_id") == 0) & F.col("_film").isNotNull(), F.lit(False))
    decision = F.when(international & (F.col("decision") == "REVIEW"), "AUTO_ACCEPT").when(~international & (F.col("decision") == "AUTO_ACCEPT"), "REVIEW").otherwise(F.col("decision"))
    return both.select(
        "query_id", F.when(hit, F.col("_film.id")).otherwise(F.col("movie_id")).alias("movie_id"), F.when(hit, F.col("_film.title")).otherwise(F.col("title")).alias("title"),
        F.when(hit, F.when(international, LOOKUP_INTERNATIONAL).otherwise(LOOKUP_DOMESTIC)).otherwise(F.col("confidence")).alias("confidence"), F.when(hit, decision).otherwise(F.col("decision")).alias("decision"), hit.alias("looked_up"),
    )


def searched_again(results: DataFrame, attempts: DataFrame, catalog: DataFrame, k: int = 20) -> DataFrame:
    """results that name a film without an id, looked up again by title: movie_id, canonical_id, title, confidence,
    decision, reasoning and looked_up after it; all other columns and rows stay.

    results: query_id, movie_id, title, confidence, decision, reasoning, ordinal (of the query or of the title named, if
    either has one), country, international. attempts: query_id, rank, title, the titles to try, least rank first: for an
    international row that of a re-release, then the film named, then its other name. catalog: id, title, master_title,
    country; domestic rows search titles alone, in all rows.

    Each title is searched without its bracketed parts (scoped.by_title, within the row's country). Hits of another
    installment than the ordinal are left out, and the first hit of the first attempt that keeps any is the film. An
    international row is then sure enough to be accepted; another is not, and one that was accepted before goes to
    review. Decisions on other kinds of events stay. Rows with an id, or whose title is blank or Unknown, stay as they are.
    """
    open_rows = results.where((F.col("movie_id") == 0) & (F.trim(F.coalesce("title", F.lit(""))) != "") & (F.col("title") != "Unknown"))
    keys = open_rows.select("query_id", F.col("country").alias("_c"), F.col("international").alias("_i"), F.col("ordinal").alias("_n"))
    bare = without_brackets(F.col("title"))
    tries = attempts.where("title is not null").join(keys, "query_id").select(F.struct("query_id", "rank").alias("query_id"), F.when(bare != "", bare).otherwise(F.col("title")).alias("q"), "_c", "_i", "_n")
    abroad = scoped.by_title(tries.where("_i").select("query_id", "q", F.col("_c").alias("country")), catalog, k)
    home = scoped.by_title(tries.where("not _i").select("query_id", "q", F.lit(None).cast("string").alias("country")), catalog.withColumn("master_title", F.lit(None).cast("string")), k)
    hits = abroad.unionByName(home).select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.rank").alias("attempt"), "rank", "id").join(catalog.select("id", "title"), "id").join(keys, "query_id")
    conflict = F.coalesce((F.col("_n") > 0) & conflicting_ordinal(F.col("title"), F.col("_n")), F.lit(False))
    best = hits.where(~conflict).groupBy("query_id").agg(F.min_by(F.struct("id", "title"), F.struct("attempt", "rank")).alias("_film"))
    both = results.join(best, "query_id", "left")
    hit, inter = F.col("_film").isNotNull(), F.coalesce("international", F.lit(False))
    decision = F.when(inter & (F.col("decision") == "REVIEW"), "AUTO_ACCEPT").when(~inter & (F.col("decision") == "AUTO_ACCEPT"), "REVIEW").otherwise(F.col("decision"))
    why = F.when(decision == "AUTO_ACCEPT", "accepted").when(decision.startswith("REVIEW_"), F.concat(F.lit("left in "), decision, F.lit(" for its kind of event"))).when(inter, "left in REVIEW").otherwise("left in REVIEW, as no country confirms the title")
    reason = F.concat(F.lit("A second search by title found '"), "_film.title", F.lit("' (id "), "_film.id", F.lit("); the row is "), why, F.lit(". Before: "), F.coalesce("reasoning", F.lit("")))
    new = {
        "movie_id": F.when(hit, F.col("_film.id")).otherwise(F.col("movie_id")), "canonical_id": F.when(hit, F.col("_film.id")), "title": F.when(hit, F.col("_film.title")).otherwise(F.col("title")),
        "confidence": F.when(hit, F.when(inter, LOOKUP_INTERNATIONAL).otherwise(LOOKUP_DOMESTIC)).otherwise(F.col("confidence")), "decision": F.when(hit, decision).otherwise(F.col("decision")),
        "reasoning": F.when(hit, reason).otherwise(F.col("reasoning")), "looked_up": hit,
    }
    return both.select(*[F.col(f"`{c}`") for c in results.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def anniversary(show: Column, original: Column, release: Column, ordinal: Column) -> tuple[Column, Column, Column]:
    """(anniversary number, band, cap of the confidence) of a re-release row against a show date.

    Near: at most 90 days apart and the row's ordinal, if any, is the number or one less; far: over 180 days, an
    ordinal that is off by more than one, or a placeholder date; else between. Without a date there is no signal.
    """
    number = F.year(show) - F.year(original)
    days = F.abs(F.datediff(release, show))
    off = F.coalesce(~(number - ordinal).between(0, 1), F.lit(False))
    wrong = F.coalesce(F.abs(number - ordinal) > 1, F.lit(False))
    placeholder = (F.month(release) == 1) & (F.dayofmonth(release) == 1)
    band = F.when(release.isNull(), "no_date").when((days > FAR_DAYS) | wrong | placeholder, "far").when((days <= NEAR_DAYS) & ~off, "near").otherwise("between")
    return number, band, F.when(band == "near", CAP_NEAR).when(band == "far", CAP_FAR).when(band == "between", CAP_BETWEEN).otherwise(0.0)
