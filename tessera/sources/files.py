"""Uploaded files as DataFrames: header checks, header aliases, null words, and outputs in the order of their input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.split_csv import read_table

#: Rows of an upload, at most.
MOST_ROWS = 10_000
# Words that stand for no value, in lower case, and what a failed row says of its title.
NULL_WORDS = ("", "null", "undefined")
FAILED_TITLE, FAILED_CONFIDENCE, FAILED_PRESENT = "", 0, "No"


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The rows of uploaded CSV files, all columns as strings under headers in their own case, with row_index in file
    order; read in byte ranges (see split_csv.read_table)."""
    return read_table(spark, path)


# Columns that an upload of titles must have, the column that it must also have for the international
# market, and the other name of the first one.
UPLOAD_COLUMNS, UPLOAD_INTERNATIONAL, UPLOAD_TITLE = ("movie_title", "show_date", "ticketing_url"), "country", "title"


def upload_fields(df: DataFrame) -> dict[str, Column]:
    """movie_title, show_date, ticketing_url and country of an upload, whatever the case of its headers; title serves as
    movie_title where there is none. Null cells and missing columns are blank."""
    by_name = {c.strip().lower(): c for c in df.columns}
    if UPLOAD_TITLE in by_name:
        by_name.setdefault(UPLOAD_COLUMNS[0], by_name[UPLOAD_TITLE])
    return {n: F.coalesce(F.col(f"`{by_name[n]}`"), F.lit("")) if n in by_name else F.lit("") for n in (*UPLOAD_COLUMNS, UPLOAD_INTERNATIONAL)}


def title_upload(df: DataFrame, market: str = "domestic", most: int = MOST_ROWS) -> DataFrame:
    """df as it is, once its headers and its rows have been checked.

    A ValueError names the columns that are missing, in any case of their letters (country only for the international
    market; title serves as movie_title), or says that there are more than `most` rows.
    """
    have = {c.strip().lower() for c in df.columns}
    needed = [*UPLOAD_COLUMNS, *([UPLOAD_INTERNATIONAL] if market == "international" else [])]
    if missing := [c for c in needed if c not in have and not (c == UPLOAD_COLUMNS[0] and UPLOAD_TITLE in have)]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def filled(c: Column) -> Column:
    """The trimmed value, or null for a null word."""
    return F.when(~F.lower(F.trim(c)).isin(*NULL_WORDS), F.trim(c))


def picked(df: DataFrame, aliases: tuple[str, ...]) -> Column:
    """The first value that isn't blank among those of aliases that df has as columns."""
    return F.coalesce(*(F.when(F.trim(F.col(f"`{a}`")) != "", F.col(f"`{a}`")) for a in aliases if a in df.columns), F.lit(None).cast("string"))


def whole_number(c: Column) -> Column:
    """The value as a whole number, or null where it isn't one."""
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c)).try_cast("long")


def mapping_import(df: DataFrame) -> DataFrame:
    """Pending mappings from rows with a keyword and a format; a tier that isn't a number is 4."""
    rows = df.where((F.trim(F.coalesce("keyword", F.lit(""))) != "") & (F.trim(F.coalesce("format", F.lit(""))) != ""))
    return rows.select(F.trim("keyword").alias("keyword"), F.trim("format").alias("format"), F.coalesce(whole_number(F.col("tier")), F.lit(4)).cast("long").alias("tier"), F.lit("pending").alias("status"))


def mapping_export(mappings: DataFrame) -> DataFrame:
    return mappings.where("status = 'approved'").select("keyword", "format", "tier").orderBy("tier", "keyword")


def title_output(rows: DataFrame, results: DataFrame, key: str = "row_index") -> DataFrame:
    """All columns of rows with mapped_title, confidence_score, reasoning and present_in_db of the result of the same key.

    Rows without a result are failed rows: they have the filler that says so. In the order of rows.
    """
    joined = rows.join(results.withColumn("_hit", F.lit(True)), key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    out = {
        "mapped_title": F.when(hit, F.coalesce("mapped_title", F.lit(""))).otherwise(FAILED_TITLE),
        "confidence_score": F.when(hit, F.coalesce("confidence_score", F.lit(0.0))).otherwise(float(FAILED_CONFIDENCE)),
        "reasoning": F.when(hit, F.coalesce("reasoning", F.lit(""))).otherwise("error: no result"),
        "present_in_db": F.when(hit & F.col("present"), "Yes").otherwise(FAILED_PRESENT),
    }
    return joined.select(*rows.columns, *(c.alias(n) for n, c in out.items())).orderBy(key)


def detection_output(rows: DataFrame, name: str = "screen_format") -> DataFrame:
    """circuit_name, amenities and the format of detected rows: those found without a remote answer first, each in order."""
    out = rows.select(F.coalesce("circuit", F.lit("")).alias("circuit_name"), F.coalesce("amenity", F.lit("")).alias("amenities"), F.col(name), "fired_ai", "row_id")
    return out.orderBy("fired_ai", "row_id")


def movie_output(rows: DataFrame, diagnostics: bool = False, audit: bool = False) -> DataFrame:
    """The output of a movie-format job from detected rows (amenity, circuit, movie_format, ...), those found without a
    remote answer first, each in order of row_id.

    diagnostics adds how each format was found, with what a remote answer (ai_format, ai_reasoning, if rows have them)
    suggested; audit gives the user's format (user_format) as movie_format, the detected one beside it, and whether they
    differ by more than case and blanks around them. Nulls are blank.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    out = {"circuit_name": text("circuit")} if "circuit" in rows.columns else {}
    out |= {"amenities_string": text("amenity"), "movie_format": text("user_format") if audit else text("movie_format")}
    if diagnostics:
        out |= {"detected_keyword": text("matched_keyword"), "match_source": text("match_source"), "match_track": text("match_track"), "confidence": F.col("confidence"), "ai_suggested_format": text("ai_format"), "ai_reasoning": text("ai_reasoning")}
    if audit:
        differs = F.lower(F.trim(text("user_format"))) != F.lower(F.trim(text("movie_format")))
        out |= {"detected_format": text("movie_format"), "ai_suggested_format": text("ai_format"), "anomaly": F.when(differs, "TRUE").otherwise("FALSE"), "reasoning": F.when(F.col("fired_ai"), text("ai_reasoning")).otherwise("")}
    return rows.select(*[c.alias(n) for n, c in out.items()], "fired_ai", "row_id").orderBy("fired_ai", "row_id")
