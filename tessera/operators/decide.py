"""Scoring of candidates and the decision on each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.fuzzy import ratio
from tessera.functions.text import release_date

ANIMATED = ("animated", "2d animated", "animation", "cartoon")


def date_window(show: Column, release: Column) -> Column:
    days = F.abs(F.datediff(release_date(show), release_date(release)))
    return F.when(days == 0, "EXACT").when(days <= 30, "NEAR").when(days <= 365, "YEAR").otherwise("NONE")


def date_boost(window: Column) -> Column:
    return F.when(window == "EXACT", 0.30).when(window == "NEAR", 0.15).when(window == "YEAR", 0.05).otherwise(0.0)


def edition_penalty(markers: Column, title: Column) -> Column:
    drawn = F.exists(F.array(*map(F.lit, ANIMATED)), lambda h: F.contains(F.lower(title), h))
    return F.when(F.array_contains(markers, "Live Action") & drawn, -0.20).otherwise(0.0)


def metadata_boost(rows: DataFrame) -> DataFrame:
    """rows with runtime_label, director_label, cast_label and boost, from page_ and master_ runtime, director, cast."""
    gap = F.abs(F.col("page_runtime") - F.col("master_runtime"))
    runtime = F.when(gap.isNull(), "RUNTIME_UNKNOWN").when(gap <= 5, "RUNTIME_MATCH").otherwise(F.concat(F.lit("RUNTIME_MISMATCH_"), gap.cast("string"), F.lit("min")))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    like = ratio(F.lower(F.trim("page_director")), F.lower(F.trim("master_director")))
    director = F.when(blank("page_director") | blank("master_director"), "DIRECTOR_UNKNOWN").when(like >= 80, "DIRECTOR_MATCH").otherwise(F.concat(F.lit("DIRECTOR_MISMATCH_"), F.floor(like).cast("string")))
    names = lambda c: F.filter(F.transform(F.split(F.lower(c), "[,;]"), F.trim), lambda x: x != "")
    shared = F.size(F.array_intersect(names("page_cast"), names("master_cast")))
    cast = F.when(blank("page_cast") | blank("master_cast"), "CAST_UNKNOWN").when(shared > 0, F.concat(F.lit("CAST_MATCH_"), shared.cast("string"))).otherwise("CAST_NO_OVERLAP")
    out = rows.withColumns({"runtime_label": runtime, "director_label": director, "cast_label": cast})
    boost = F.when(F.col("runtime_label") == "RUNTIME_MATCH", 0.1).otherwise(0.0) + F.when(F.col("director_label") == "DIRECTOR_MATCH", 0.1).otherwise(0.0) + F.when(F.col("cast_label").startswith("CAST_MATCH"), 0.05).otherwise(0.0)
    return out.withColumn("boost", boost)


def composite(candidates: DataFrame) -> DataFrame:
    """candidates (query_id, id, title, score, gen, show_date, release_date, edition_markers) with date_window, composite and
    place (1 is the winner; ties go to the one generated first)."""
    rows = candidates.withColumn("date_window", date_window(F.col("show_date"), F.col("release_date")))
    raw = F.col("score") + date_boost(F.col("date_window")) + edition_penalty(F.col("edition_markers"), F.col("title"))
    rows = rows.withColumn("composite", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("composite"), "gen")))


def decided(candidates: DataFrame, catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """One row for each of queries (query_id, event_type): the winner with confidence, decision, canonical id and evidence.

    A film's winner gains .05 if it has company and none of it is newer. From .90 on it is accepted, unless the event is
    no single film. Queries without candidates are Unknown. catalog: id, parent_id.
    """
    rows = composite(candidates)
    whole = Window.partitionBy("query_id")
    when = release_date(F.col("release_date"))
    rows = rows.withColumns({"_n": F.count("*").over(whole), "_newest": F.max(when).over(whole)})
    top = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("gen", "id", "title", F.round("score", 4).alias("score")))), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["score"].alias("score"))), 1, 5)
    lost = F.transform(F.filter(F.sort_array(F.collect_list(F.struct("place", "id", "title", F.round("composite", 4).alias("score")))), lambda x: x["place"].between(2, 5)), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["score"].alias("score")))
    best = F.min_by(F.struct("id", "title", "composite", "date_window", F.when((F.col("_n") > 1) & (when == F.col("_newest")), 0.05).otherwise(0.0).alias("recent")), "place")
    won = rows.groupBy("query_id").agg(best.alias("w"), top.alias("fuzzy_top"), lost.alias("eliminated"))
    out = queries.select("query_id", "event_type").join(won, "query_id", "left").join(with_parent(catalog).select(F.col("id").alias("_id"), "canonical"), F.col("w.id") == F.col("_id"), "left")
    sure = F.least(F.lit(1.0), F.col("w.composite") + F.when(F.col("event_type") == "MOVIE", F.col("w.recent")).otherwise(0.0))
    odd = F.col("event_type").isin("MULTI_FILM", "NON_MOVIE")
    return out.withColumn("_sure", F.when(F.col("w").isNotNull(), sure).otherwise(0.0)).select(
        "query_id", F.coalesce("w.id", F.lit(0)).alias("movie_id"), F.coalesce("w.title", F.lit("Unknown")).alias("title"), F.coalesce("canonical", "w.id", F.lit(0)).alias("canonical_id"),
        F.round("_sure", 4).alias("confidence"), F.coalesce("w.date_window", F.lit("NONE")).alias("date_window"),
        F.when(F.col("w").isNull(), "REVIEW").when(odd, F.concat(F.lit("REVIEW_"), "event_type")).when(F.col("_sure") >= 0.9, "AUTO_ACCEPT").otherwise("REVIEW").alias("decision"),
        F.coalesce(F.to_json("fuzzy_top"), F.lit("[]")).alias("fuzzy_top"), F.coalesce(F.to_json("eliminated"), F.lit("[]")).alias("eliminated"),
    )


def with_parent(catalog: DataFrame) -> DataFrame:
    """catalog with canonical: the parent's id where it is another row of the catalog, else its own; one level only."""
    parents = catalog.select(F.col("id").alias("_p")).distinct()
    return catalog.join(parents, (F.col("parent_id") == F.col("_p")) & (F.col("parent_id") != F.col("id")), "left").withColumn("canonical", F.coalesce("_p", "id")).drop("_p")


def present_in_db(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """results (query_id, canonical_id, movie_id) with mapped_title and present_in_db, Yes or No."""
    wanted = F.when(F.col("canonical_id") > 0, F.col("canonical_id")).otherwise(F.col("movie_id"))
    out = results.withColumn("_w", F.when(wanted > 0, wanted)).join(catalog.select(F.col("id").alias("_i"), F.col("title").alias("_t")), F.col("_w") == F.col("_i"), "left")
    return out.withColumns({"mapped_title": F.coalesce("_t", F.lit("")), "present_in_db": F.when(F.col("_i").isNotNull(), "Yes").otherwise("No")}).drop("_w", "_i", "_t")


def reasoning(title: Column, winner: Column, id_: Column, score: Column, window: Column) -> Column:
    said = F.when(window == "EXACT", "Release date matches show date exactly.").when(window == "NEAR", "Release date is within 30 days of show date.").when(window == "YEAR", "Release date is within one year of show date.")
    return F.format_string("The title '%s' most closely matches '%s' (id %d) with confidence %s%%. %s", title, winner, id_, F.bround(100 * score).cast("int").cast("string"), said.otherwise("No date proximity signal available."))
