"""Inputs of the registered queries, derived from the driver's tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A small dictionary, its circuits, and attribute strings with the quirks that detection must bear.
SCREEN = (
    ("4DX", "4DX", 1, None, None), ("MX4D", "MX4D", 1, None, None), ("IMAX", "IMAX", 2, None, None), ("Dolby Cinema", "Dolby Cinema", 2, None, None), ("BTX", "BTX", 3, None, None),
    ("ScreenX", "ScreenX", 3, None, None), ("XL", "XL at AMC", 4, "AMC Entertainment Inc", None), ("XD", "Cinemark XD", 4, "Cinemark Theatres", "XD Strike + Reel"), ("ACX", "ACX Apple", 4, "Apple Cinemas", "ACX"),
    ("GDX", "GDX", 4, None, None), ("CINE XL", "Cine XL Harkins", 4, "Harkins Theatres", None), ("UltraAVX", "UltraAVX", 4, "Cineplex Entertainment", None), ("ACX Infinity", "ACX Infinity", 4, None, None),
    ("DCX", "DCX", 4, None, None), ("RPX", "RPX Regal", 4, "Regal Cinemas", None), ("ACX Infinity 2D", "Standard", 6, None, None), ("Digital 3D", "Standard", 6, None, None), ("70MM", "Standard", 6, None, None),
    ("Digital", "Standard", 6, None, None), ("3D", "Standard", 6, None, None), ("the GDX", "GDX Two", 5, None, None), ("xd", "XD Late", 4, "Cinemark Theatres", None),
)
MOVIE = (("70mm", "70MM", 1), ("35mm", "35MM", 2), ("3d", "3D", 3), ("2d", "2D", 4), ("3-D", "3D Late", 5))
ALIASES = (
    ("amc entertainment inc", "AMC Entertainment Inc"), ("amc", "AMC Entertainment Inc"), ("cinemark theatres", "Cinemark Theatres"), ("cinemark", "Cinemark Theatres"), ("apple cinemas", "Apple Cinemas"),
    ("harkins theatres", "Harkins Theatres"), ("cineplex entertainment", "Cineplex Entertainment"), ("landmark cinemas", "Landmark Cinemas"), ("caribbean cinemas - us territory", "Caribbean Cinemas - US Territory"),
    ("regal cinemas", "Regal Cinemas"), ("regal", "Regal Cinemas"),
)
AMENITIES = (
    "IMAX", "IMAX | 4DX", "Dolby Cinema", "XL", "XD", "ACX", "GDX", "CINE XL", "UltraAVX", "IMAX | VIP 19+", "ACX Infinity 2D", "Digital 3D", "70MM", "Holographic Surround Plus", "", "IMAX | CC | Reserved Seating",
    "Dolby Cinema | IMAX", "I--Maxentral Premium", "GDX | RPX", "CINÉ XL®", "3DPremium", "70 M M Film", "35 mm", "the Dolby Cinema", "Dolby-Cinema at AMC", "Screen X | Laser", "3 D", "3-D | No Passes", "undefined | •",
    "Reserved Seating | Recliners", "MX4D/Prime", "70 mm Film", "xa0IMAX", "ACX Infinity with Dolby", "RPX | XL | BTX", "  imax  ", "Digital | 3D", "N/A", "Caribbean VIP Lounge", "Ultra AVX $5",
)
CIRCUITS = ("AMC", "Cinemark Theatres", " regal ", "Cineplex Entertainment", "IMAX", "Some Random Theatre", "", None, "Harkins Theatres", "Apple Cinemas", "Caribbean Cinemas - US Territory")
TITLES = (
    "KIDSHOW: The Lion King", "$5 The Avengers", "Moana (Live Action)", "Das Boot Germany", "HP 3", "Toy Story 4 3D", "IMAX: Interstellar 70mm", "Harry Potter 7/1", "The Godfather Part 2", "Rocky IV", "Met Live: Carmen Opera",
    "Star Wars Saga Marathon", "Jaws 50th Anniversary", "Batman Begins", "Us", "I, Robot", "2001 A Space Odyssey", "Blade Runner 2049", "RBO Cinema Season 2024-25: Swan Lake", "Flashback: Alien", "ScreenX Dune", "Lion King 25th Anniversary",
    "How to Train Your Dragon", "Summer Kids: Trolls", "Marathon - Fast X", "UFC 300", "Moana 2 Australia", "The Dark Knight Rises", "Avatar (OV)", "D-BOX Gladiator II",
)


def _quoted(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values_sql(name: str, columns: str, rows: tuple) -> str:
    """A DuckDB common table expression of rows, with their numbers from 0 in a first column id."""
    body = ", ".join("(" + ", ".join(_quoted(v) for v in (i, *(r if isinstance(r, tuple) else (r,)))) + ")" for i, r in enumerate(rows))
    return f"{name}(id, {columns}) AS (VALUES {body})"


def values(spark: SparkSession, columns: str, rows: tuple) -> DataFrame:
    """The same rows in Spark; columns with their types."""
    return spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"id long, {columns}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def screen(spark: SparkSession) -> DataFrame:
    return values(spark, "keyword string, format string, tier int, circuit string, na_default string", SCREEN)


def movie(spark: SparkSession) -> DataFrame:
    return values(spark, "keyword string, format string, tier int", MOVIE)


def aliases(spark: SparkSession) -> DataFrame:
    return values(spark, "alias string, canonical string", ALIASES)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, amenity, circuit, l_partkey: an attribute string and a circuit for each row of lineitem, with skewed repeats."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    lines = lines.withColumns({"a": (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % len(AMENITIES), "c": (F.col("l_orderkey") * 3 + F.col("l_linenumber")) % len(CIRCUITS)})
    a = values(spark, "amenity string", AMENITIES).withColumnRenamed("id", "a")
    c = values(spark, "circuit string", CIRCUITS).withColumnRenamed("id", "c")
    return lines.join(a, "a").join(c, "c").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), "amenity", "circuit", "l_partkey")


LISTINGS_SQL = f"""{values_sql("amenities", "amenity", AMENITIES)}, {values_sql("circuits", "circuit", CIRCUITS)}, listings AS (
  SELECT l_orderkey * 8 + l_linenumber AS row_id, amenity, circuit, l_partkey FROM lineitem
  JOIN amenities a ON a.id = (l_orderkey * 7 + l_linenumber) % {len(AMENITIES)} JOIN circuits c ON c.id = (l_orderkey * 3 + l_linenumber) % {len(CIRCUITS)}
)"""
SCREEN_SQL = values_sql("dictionary", "keyword, format, tier, circuit, na_default", SCREEN)
MOVIE_SQL = values_sql("dictionary", "keyword, format, tier", MOVIE)
ALIASES_SQL = values_sql("aliases", "alias, canonical", ALIASES)


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, raw, show_date, p_name: a scraped title for each part: a listing, on every third part with its name appended."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    t = values(spark, "title string", TITLES)
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", "title", "p_name")).otherwise(F.col("title"))
    return parts.join(t, F.col("p_partkey") % len(TITLES) == F.col("id")).select(F.col("p_partkey").alias("query_id"), raw.alias("raw"), "p_name")


TITLED_SQL = f"""{values_sql("titles", "title", TITLES)}, titled AS (
  SELECT p_partkey AS query_id, CASE WHEN p_partkey % 3 = 0 THEN title || ' ' || p_name ELSE title END AS raw, p_name FROM part JOIN titles ON titles.id = p_partkey % {len(TITLES)}
)"""
