"""The dictionaries that detection probes, one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators.written import cut


def approved(mappings: DataFrame) -> DataFrame:
    """Approved rows of keyword, format, tier, circuit, na_default, id, with their normal forms."""
    rows = mappings.where("status = 'approved'") if "status" in mappings.columns else mappings
    k = F.col("keyword")
    return rows.withColumns({"norm_a": t.light(k), "norm_b": t.without_stopwords(k), "norm_c": t.tokens(k), "concat": t.concat_form(k)})


def last_writer(mappings: DataFrame, *key: str) -> DataFrame:
    """Of rows with the same key, that of the greatest tier, then id: what a map filled in tier order ends up with."""
    order = Window.partitionBy(*key).orderBy(F.col("tier").desc(), F.col("id").desc())
    return mappings.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def first_writer(mappings: DataFrame, *key: str) -> DataFrame:
    """Of rows with the same key, that of the least tier, then id."""
    order = Window.partitionBy(*key).orderBy("tier", "id")
    return mappings.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def fill_down(sheet: DataFrame, order: str = "row_no", cell: str = "cell", marker: str = "AMENITIES_PRIORITY_([0-9]+)") -> DataFrame:
    """Rows below a tier marker get its tier; of equal (normal form, tier) the first row stays; rows above any marker go.

    The sheet is dealt into ranges of its order and written once; each range's last marker, one small row a range, is
    carried forward over the ranges, and the running value is taken within each.
    """
    mark = F.nullif(F.regexp_extract(cell, marker, 1), F.lit("")).try_cast("int")
    rows = cut(sheet.withColumn("_mark", mark).repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "sheet")
    last = F.max(F.when(F.col("_mark").isNotNull(), F.struct(F.col(order).alias("o"), "_mark")))["_mark"]
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("_range").agg(last.alias("_last")).select("_range", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    within = F.last("_mark", ignorenulls=True).over(Window.partitionBy("_range").orderBy(order))
    rows = rows.join(F.broadcast(carried), "_range").withColumn("tier", F.coalesce(within, "_carried")).drop("_range", "_carried")
    rows = rows.where("_mark is null and tier is not null").withColumn("norm", t.plain(t.clean_cell(F.col(cell)))).where("norm <> ''")
    first = Window.partitionBy("norm", "tier").orderBy(order)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_mark")


def with_na_default(mappings: DataFrame, sheet: DataFrame) -> DataFrame:
    """Sheet rows (row_no, keyword, circuit, format) without a circuit give their format, the last by row, to all mappings
    of the same normal form; mappings keep theirs otherwise."""
    blank = F.upper(t.strip(F.coalesce("circuit", F.lit("")))).isin("NA", "")
    given = sheet.where(blank).groupBy(t.plain(F.col("keyword")).alias("norm")).agg(F.max_by("format", "row_no").alias("_given"))
    rows = mappings.withColumn("norm", t.plain(F.col("keyword")))
    return rows.join(given, "norm", "left").withColumn("na_default", F.coalesce("_given", "na_default")).drop("_given")


# Circuits that have an alias whether or not a sheet names them, and the tier of a circuit's own mappings.
ALWAYS_KNOWN, CIRCUIT_TIER = ("Caribbean Cinemas - US Territory", "Cineplex Entertainment"), 4


def of_circuits(sheet: DataFrame) -> DataFrame:
    """row_no, keyword, format, tier, circuit, status: the mappings of a sheet's rows (row_no, keyword, format, circuit) that
    are a circuit's own; cells are cleaned, and rows without a keyword, a format or a circuit (NA is none) left out."""
    cell = lambda c: t.clean_cell(F.coalesce(c, F.lit("")))
    rows = sheet.select("row_no", *[cell(F.col(c)).alias(c) for c in ("keyword", "format", "circuit")])
    rows = rows.where("keyword <> '' and format <> '' and circuit <> '' and upper(circuit) <> 'NA'")
    return rows.select("row_no", "keyword", "format", F.lit(CIRCUIT_TIER).alias("tier"), "circuit", F.lit("approved").alias("status"))


def circuit_aliases(mappings: DataFrame) -> DataFrame:
    """alias, canonical: each circuit of mappings (row_no, circuit) under its name in lower case, of spellings that differ by
    case the last by row, and the circuits that are always known."""
    known = mappings.groupBy(F.lower("circuit").alias("alias")).agg(F.max_by("circuit", "row_no").alias("canonical"))
    always = mappings.sparkSession.createDataFrame([(c.lower(), c) for c in ALWAYS_KNOWN], "alias string, canonical string")
    return known.unionByName(always.join(known, "alias", "left_anti"))
