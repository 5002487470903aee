"""Detection of formats in pipe-delimited attribute strings by a prioritised dictionary.

A result depends on the string and circuit alone, so it is found once for each distinct pair and joined back: a string
that a third of all rows share is matched once. Segments go through the same sieve: exact forms by equi-joins first;
what those leave open is looked up by the rarest word of each entry and by its beginnings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import containment
from tessera.operators.dictionary import approved, first_writer, last_writer
from tessera.operators.written import cut

# Circuits with a VIP format of their own, and the shortest concatenated form that matches by prefix.
VIP = (("caribbean cinemas - us territory", "Caribbean VIP"), ("caribbean cinemas - us territories", "Caribbean VIP"), ("cineplex entertainment", "VIP Cineplex"))
PREFIX_LENGTH = 4
DELIBERATE_STANDARD = 6


def matched_segments(parts: DataFrame, mappings: DataFrame, exact_concat: bool = False) -> DataFrame:
    """seg, id (of the mapping), track for each distinct segment of parts (seg) that one fits: A, then B, then C.

    exact_concat: an equal concatenated form counts before token and prefix matches.
    """
    words = approved(mappings)
    segs = parts.select("seg").distinct().withColumns({"a": t.light(F.col("seg")), "b": t.without_stopwords(F.col("seg")), "c": t.tokens(F.col("seg")), "x": t.concat_form(F.col("seg"))})
    by_a = last_writer(words, "norm_a").select(F.col("norm_a").alias("a"), F.col("id").alias("id_a"))
    by_b = last_writer(words, "norm_b").select(F.col("norm_b").alias("b"), F.col("id").alias("id_b"))
    found = segs.join(by_a, "a", "left").join(by_b, "b", "left")
    if exact_concat:
        by_x = first_writer(words.where("concat <> ''"), "concat").select(F.col("concat").alias("x"), F.col("id").alias("id_x"))
        found = found.join(by_x, "x", "left")
    else:
        found = found.withColumn("id_x", F.lit(None).cast("long"))
    exact = found.withColumn("track", F.when(F.col("id_a").isNotNull(), "A").when(F.col("id_b").isNotNull(), "B").when(F.col("id_x").isNotNull(), "C"))
    exact = cut(exact.select("seg", "c", "x", F.coalesce("id_a", "id_b", "id_x").alias("id"), "track"), "segments")
    rest = exact.where("id is null and (size(c) > 0 or length(x) >= %d)" % PREFIX_LENGTH).select(F.col("seg").alias("key"), F.col("c").alias("words"), F.col("x").alias("letters"))
    keys = words.where("size(norm_c) > 0").select("id", "tier", F.col("norm_c").alias("words"), F.col("concat").alias("letters"))
    order = F.struct("tier", "id")
    hits = containment.by_words(rest, keys, order).unionByName(containment.by_head(rest, keys, order, PREFIX_LENGTH))
    loose = hits.groupBy("key").agg(F.min("best")["id"].alias("id")).withColumnRenamed("key", "seg")
    return exact.where("id is not null").select("seg", "id", "track").unionByName(loose.select("seg", "id", F.lit("C").alias("track")))


def _pairs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of columns, written once, as several joins read them."""
    return cut(rows.select(*columns).distinct(), "pairs")


def _joined(rows: DataFrame, results: DataFrame, columns: list[str]) -> DataFrame:
    renamed = results.withColumnsRenamed({c: f"_{c}" for c in columns})
    condition = None
    for c in columns:
        one = F.col(c).eqNullSafe(F.col(f"_{c}"))
        condition = one if condition is None else condition & one
    return rows.join(renamed, condition, "left").drop(*[f"_{c}" for c in columns])


def resolved_circuit(circuits: DataFrame, aliases: DataFrame) -> DataFrame:
    """circuits (circuit) with resolved: its canonical name by alias, or itself, in lower case."""
    norm = F.lower(t.strip(F.coalesce("circuit", F.lit(""))))
    known = aliases.select(F.col("alias").alias("_alias"), "canonical").dropDuplicates(["_alias"])
    return circuits.withColumn("_norm", norm).join(known, F.col("_norm") == F.col("_alias"), "left").withColumn("resolved", F.lower(F.coalesce("canonical", "_norm"))).drop("_norm", "_alias", "canonical")


def detect_screen(rows: DataFrame, mappings: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows (amenity, circuit, ...) with screen_format, match_track, confidence, matched_keyword, match_source, fired_ai.

    The best hit has the least tier, then fits the circuit, then has any circuit, then stands first. VIP circuits and
    the IMAX circuit override it; a keyword of the circuit's own decides the format; blank strings and strings without
    a hit are Standard, the latter with fired_ai. Nulls count as blank.
    """
    pairs = resolved_circuit(_pairs(rows, ["amenity", "circuit"]), aliases)
    pairs = pairs.withColumn("segs", t.segments(F.coalesce("amenity", F.lit(""))))
    blank = t.strip(F.coalesce("amenity", F.lit(""))) == ""
    parts = pairs.select("amenity", "circuit", "resolved", F.posexplode("segs").alias("pos", "seg"))
    words = approved(mappings)
    hits = parts.join(matched_segments(parts, mappings), "seg").join(words.select("id", "tier", "keyword", "format", F.col("circuit").alias("own"), "na_default"), "id")
    rank = F.struct("tier", F.when(F.lower("own") == F.col("resolved"), 0).otherwise(1), F.when(F.col("own").isNotNull(), 0).otherwise(1), "pos")
    best = hits.groupBy("amenity", "circuit").agg(F.min_by(F.struct("id", "tier", "keyword", "format", "own", "na_default", "track"), rank).alias("hit"))
    found = _joined(pairs, best, ["amenity", "circuit"])
    own = last_writer(words.where("circuit is not null and circuit <> ''").withColumns({"_k": F.lower("keyword"), "_c": F.lower("circuit")}), "_k", "_c").select("_k", "_c", F.col("format").alias("own_format"))
    found = found.join(own, (F.lower("hit.keyword") == F.col("_k")) & (F.col("resolved") == F.col("_c")), "left")
    vip = F.create_map(*[F.lit(x) for pair in VIP for x in pair])[F.col("resolved")]
    vip = F.when(~blank & F.exists("segs", lambda s: F.lower(s).contains("vip")), vip)
    imax = (F.col("resolved") == "imax") & (blank | F.col("hit").isNull() | (F.col("hit.tier") > 1))
    hit_format = F.coalesce("own_format", F.when(F.coalesce("hit.own", F.lit("")) == "", F.col("hit.format")), F.nullif("hit.na_default", F.lit("")), F.lit("Standard"))
    source = F.concat(F.lit("Bucket Priority "), F.col("hit.tier").cast("string"))
    source = F.when(F.col("hit.tier") == DELIBERATE_STANDARD, F.concat(source, F.lit(" (Standard)"))).when(hit_format == "Standard", F.concat(source, F.lit(" (Circuit Unscoped → Standard)"))).otherwise(source)
    track = F.when(vip.isNotNull(), "A").otherwise(F.coalesce("hit.track", F.lit("none")))
    sure = F.when(F.col("hit.track") == "A", 1.0).when(F.col("hit.track") == "B", 0.9).otherwise(0.75)
    out = found.select(
        "amenity", "circuit",
        F.when(vip.isNotNull(), vip).when(imax, "IMAX").when(F.col("hit").isNull(), "Standard").otherwise(hit_format).alias("screen_format"),
        track.alias("match_track"),
        F.when(vip.isNotNull(), 1.0).when(F.col("hit").isNotNull(), sure).when(blank | imax, 1.0).otherwise(0.0).alias("confidence"),
        F.when(vip.isNotNull(), "VIP").otherwise(F.col("hit.keyword")).alias("matched_keyword"),
        F.when(vip.isNotNull(), "VIP Override").when(imax, "IMAX Circuit Override").when(blank, "Empty Input").when(F.col("hit").isNull(), "No Match").otherwise(source).alias("match_source"),
        (~blank & F.col("hit").isNull() & vip.isNull() & ~imax).alias("fired_ai"),
    )
    return _joined(rows, out, ["amenity", "circuit"])


def detect_movie(rows: DataFrame, mappings: DataFrame) -> DataFrame:
    """rows (amenity, ...) with movie_format, match_track, confidence, matched_keyword, match_source, fired_ai; no circuits."""
    pairs = _pairs(rows, ["amenity"])
    blank = t.strip(F.coalesce("amenity", F.lit(""))) == ""
    parts = pairs.select("amenity", F.posexplode(t.segments(F.coalesce("amenity", F.lit("")))).alias("pos", "seg"))
    words = approved(mappings).select("id", "tier", "keyword", "format")
    hits = parts.join(matched_segments(parts, mappings, exact_concat=True), "seg").join(words, "id")
    best = hits.groupBy("amenity").agg(F.min_by(F.struct("tier", "keyword", "format", "track"), F.struct("tier", "pos")).alias("hit"))
    found = _joined(pairs, best, ["amenity"])
    sure = F.when(F.col("hit.track") == "A", 1.0).when(F.col("hit.track") == "B", 0.9).otherwise(0.75)
    out = found.select(
        "amenity",
        F.coalesce("hit.format", F.lit("2D")).alias("movie_format"),
        F.coalesce("hit.track", F.lit("none")).alias("match_track"),
        F.when(F.col("hit").isNotNull(), sure).when(blank, 1.0).otherwise(0.0).alias("confidence"),
        F.col("hit.keyword").alias("matched_keyword"),
        F.when(F.col("hit").isNotNull(), F.concat(F.lit("Bucket Priority "), F.col("hit.tier").cast("string"))).when(blank, "Empty Input").otherwise("No Match").alias("match_source"),
        (~blank & F.col("hit").isNull()).alias("fired_ai"),
    )
    return _joined(rows, out, ["amenity"])
