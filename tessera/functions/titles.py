"""Scraped titles: what they name, and what was written around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and word lists, in the order in which they apply.
PROMOTIONS = (
    r"MegaReelDeal\s*", r"KIDSHOW\s*[:\-]?\s*", r"\$\d+\s*", r"Summer Kids(?: Movie Series)?\s*[:\-]\s*", r"RBO Cinema Season \d{4}[-–]\d{2,4}\s*[:\-]\s*",
    r"Marathon\s*[:\-]\s*", r"FLASHBACK\s*[:\-]?\s*", r"\(Open Captioning\)\s*", r"\(OV[^)]*\)\s*",
)
FORMATS = (r"^IMAX\s*[:\-]?\s*", r"\s+\d{2}mm\b", r"\bScreenX\b\s*", r"\bD-BOX\b\s*", r"\b4DX\b\s*", r"\bDolby\s+(?:Cinema|Atmos)\b\s*")
COUNTRIES = (("germany", "DE"), ("france", "FR"), ("australia", "AU"), ("uk", "UK"), ("usa", "US"), ("us", "US"), ("canada", "CA"))
EDITIONS = ("Live Action", "25th Anniversary", "30th Anniversary", "4K", "IMAX", "3D", "OV", "ENCORE", "Re-issue", "Reissue", "Flashback", "Special Edition")
FRANCHISES = (
    (r"\bhp\b|harry potter", "harry_potter"), (r"\btoy story\b", "toy_story"), (r"\bmoana\b", "moana"), (r"\bhttyd\b|how to train your dragon", "httyd"), (r"\bbatman\b", "batman"),
)
EVENTS = (
    ("MULTI_FILM", ("double feature", "saga", "marathon", " 1-4", " 1–4", " 5-7", " 5–7", " v vi vii", " ov 1", "parts 1")),
    ("NON_MOVIE", ("season finale", "opera", "ballet", "met live", "roh", "rbo", "concert", "ufc", "wwe", "theatrical event")),
    ("RERELEASE", ("anniversary", "flashback", "re-issue", "reissue", "4k remaster", "encore", "special edition")),
)
ROMANS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def _edges(c: Column) -> Column:
    return F.regexp_replace(c, "^[ .,:\\-]+|[ .,:\\-]+$", "")


def without_promotions(title: Column) -> Column:
    for p in PROMOTIONS:
        title = _strip(F.regexp_replace(title, f"(?iuU){p}", ""))
    return title


def edition_markers(title: Column) -> Column:
    """Keywords found in the title, in list order; a keyword counts inside words too."""
    return F.filter(F.array(*map(F.lit, EDITIONS)), lambda k: F.contains(F.lower(title), F.lower(k)))


def without_formats(title: Column) -> Column:
    for p in FORMATS:
        title = _strip(F.regexp_replace(title, f"(?iuU){p}", " "))
    return _edges(title)


def country_code(title: Column) -> Column:
    """The first listed country that the title has as a word anywhere."""
    return F.coalesce(*[F.when(title.rlike(f"(?iuU)\\b{w}\\b"), F.lit(code)) for w, code in COUNTRIES])


def without_country(title: Column) -> Column:
    """Without any occurrence of the first listed country that it has."""
    out = None
    for w, _ in COUNTRIES:
        pattern = f"(?iuU)\\b{w}\\b"
        cut = _strip(F.regexp_replace(title, pattern, ""))
        out = F.when(title.rlike(pattern), cut) if out is None else out.when(title.rlike(pattern), cut)
    return out.otherwise(title)


def event_type(title: Column) -> Column:
    low, out = F.lower(title), None
    for kind, words in EVENTS:
        found = None
        for w in words:
            found = low.contains(w) if found is None else found | low.contains(w)
        out = F.when(found, kind) if out is None else out.when(found, kind)
    return out.otherwise("MOVIE")


def franchise(title: Column) -> Column:
    return F.coalesce(*[F.when(title.rlike(f"(?iuU){p}"), F.lit(name)) for p, name in FRANCHISES])


def _roman(c: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, ROMANS)), F.lower(c)), F.lit(0))


def ordinal(title: Column) -> Column:
    """The installment that a title names: part N, N/M, a bare number, a Roman numeral; the first within 1 to 20.

    Only the first match of each pattern counts.
    """
    numbers = [F.regexp_extract(title, p, 1).try_cast("long") for p in (r"(?iuU)part\s*(\d+)", r"(?U)(\d+)/(\d+)", r"(?iuU)\b(\d+)\b(?!\s*(?:mm|min|fps))")]
    roman = _roman(F.regexp_extract(title, r"(?iuU)\b(I{1,3}|IV|VI{0,3}|IX|XI{0,2}|XIV|XV)\b", 1))
    return F.coalesce(*[F.when(n.between(1, 20), n) for n in (*numbers, roman)]).cast("int")


def with_normal_form(rows: DataFrame, title: str = "raw") -> DataFrame:
    """rows with cleaned, edition_markers, country_code, event_type, franchise_hint, ordinal of a raw title.

    Each step is a projection of its own, so a form that several columns need is made once for each row.
    """
    rows = rows.withColumn("_bare", without_promotions(F.col(title)))
    rows = rows.withColumn("_name", without_formats(F.col("_bare")))
    rows = rows.withColumn("_rest", without_country(F.col("_name")))
    bare, name, rest = map(F.col, ("_bare", "_name", "_rest"))
    out = {"cleaned": _edges(rest), "edition_markers": edition_markers(bare), "country_code": country_code(name), "event_type": event_type(rest), "franchise_hint": franchise(rest), "ordinal": ordinal(rest)}
    return rows.withColumns(out).drop("_bare", "_name", "_rest")


def conflicting_ordinal(title: Column, wanted: Column) -> Column:
    """True if the title names installments within 1 to 10 and none is the wanted one."""
    numbers = F.transform(F.regexp_extract_all(title, F.lit(r"(?U)\b(\d+)\b"), F.lit(1)), lambda x: x.try_cast("long"))
    romans = F.transform(F.regexp_extract_all(title, F.lit(r"(?iuU)\b(I{1,3}|IV|VI{0,3}|IX)\b"), F.lit(1)), _roman)
    found = F.filter(F.concat(numbers, romans), lambda x: x.between(1, 10))
    return (F.size(found) > 0) & F.forall(found, lambda x: x != wanted)


def without_brackets(title: Column) -> Column:
    """For a second look-up: no (...) and [...] groups, no marks at the ends."""
    return F.regexp_replace(F.regexp_replace(title, "\\s*[\\(\\[][^\\)\\]]*[\\)\\]]\\s*", " "), "^[ \\-:]+|[ \\-:]+$", "")


def after_colon(title: Column) -> Column:
    """What stands after the last colon, if anything does."""
    tail = F.trim(F.element_at(F.split(title, ":"), -1))
    return F.when(tail != "", tail).otherwise(title)
