"""Normal forms of short attribute strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.unicode_forms import without_marks

# Words that the stopword-free form drops, segments that carry no information, texts that mean blank.
STOPWORDS = ("the", "a", "an", "and", "or", "with", "in", "at", "by")
IGNORED_SEGMENTS = ("cc", "closed caption", "audio description", "reserved seating", "stadium", "no passes", "laser", "amc signature recliners", "prime at amc", "undefined", "•", "")
BLANK_WORDS = ("undefined", "null", "none", "n/a", "na")


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, "(?U)\\s+", " "))


def fold_accents(c: Column) -> Column:
    """Letters of any script without their marks."""
    return without_marks(c)


def pre_normalized(c: Column) -> Column:
    """No-break spaces and their escaped remains, accents, and numbers split from their unit are mended."""
    c = F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), "(?i)xa0", "")
    c = F.regexp_replace(fold_accents(c), "(?U)(\\d+)\\s+([A-Za-z])\\s+([A-Za-z])(?=\\s|$)", "$1$2$3")
    return F.regexp_replace(c, "(?U)(\\d+)\\s+([A-Za-z]+)", "$1$2")


def clean_cell(c: Column) -> Column:
    """A dictionary cell: straight quotes, plain spaces."""
    c = F.translate(c, "‘’“” ", "''\"\" ")
    return strip(F.regexp_replace(c, "(?i)xa0", " "))


def plain(c: Column) -> Column:
    """Lower-case letters and digits, one space between words."""
    return squeeze(F.regexp_replace(F.lower(pre_normalized(c)), "(?U)[^a-z0-9\\s]", " "))


def light(c: Column) -> Column:
    """Track A: lower case; trade marks and $ go, / @ . are spaces, other marks stay."""
    c = F.regexp_replace(pre_normalized(c), "[®™©$]", "")
    return F.lower(squeeze(F.regexp_replace(c, "[/@.]", " ")))


def without_stopwords(c: Column) -> Column:
    """Track B: track A with hyphens as spaces and no stopwords."""
    words = F.split(squeeze(F.replace(light(c), F.lit("-"), F.lit(" "))), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*STOPWORDS) & (w != "")), " ")


def tokens(c: Column) -> Column:
    """Track C: the sorted distinct words of the plain form."""
    return F.array_sort(F.array_distinct(F.filter(F.split(plain(c), " "), lambda w: w != "")))


def concat_form(c: Column) -> Column:
    """Lower-case ASCII letters and digits only, accented letters dropped."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def segments(c: Column) -> Column:
    """The informative parts between pipes."""
    parts = F.transform(F.split(c, "\\|"), strip)
    return F.filter(parts, lambda s: ~F.lower(s).isin(*IGNORED_SEGMENTS))


def unblank(c: Column) -> Column:
    """Empty for null and for words that mean blank; else stripped."""
    c = strip(F.coalesce(c, F.lit("")))
    return F.when(F.lower(c).isin(*BLANK_WORDS), F.lit("")).otherwise(c)


def release_date(c: Column) -> Column:
    """yyyy-m-d as a date; null for sentinels, unparsable texts and years from 2030 on."""
    d = F.try_to_date(c, "yyyy-M-d")
    ok = ~F.substring(c, 1, 4).isin("0000", "9999") & c.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$") & (F.year(d) < 2030)
    return F.when(ok, d)


def embed_text(title: Column, year: Column, director: Column, country: Column) -> Column:
    """What an embedding of a catalog row is made of."""
    year = F.when(year.rlike("^[0-9]{4}") & (F.substring(year, 1, 4) != "0000"), F.substring(year, 1, 4))
    return F.concat_ws(" ", title, year, F.nullif(director, F.lit("")), F.nullif(country, F.lit("")))


def key_hash(c: Column, digits: int = 64) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def cache_key(prefix: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), *[F.lower(strip(p)) for p in parts])


def tier_number(c: Column) -> Column:
    """P3 or 3 -> 3."""
    return F.ltrim(c, F.lit("P")).try_cast("int")


def progress(done: Column, total: Column, digits: int = 3) -> Column:
    return F.when(total > 0, F.round(F.least(F.lit(1.0), done / total), digits)).otherwise(F.lit(0.0))
