"""Ticketing URLs and pages: which platform serves them, and what a page says."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Platform and tier by host; any other host is generic, tier T1.
PLATFORMS = (
    ("gqtmovies.com", "CINEMAPLUS", "T1_HTTP"), ("entertainmentcinemas.com", "CINEMAPLUS", "T1_HTTP"), ("tickets.ifccenter.com", "AGILE_TICKETING", "T1_HTTP"), ("pccmovies.com", "GENERIC", "T1_HTTP"),
    ("viff.org", "VIFF", "T1_HTTP"), ("silver.afi.com", "INDY_SYSTEMS", "T2_HEADLESS"), ("wyomovies.com", "INDY_SYSTEMS", "T2_HEADLESS"), ("cinepolisusa.com", "INDY_SYSTEMS", "T2_HEADLESS"),
    ("penncinema.com", "INDY_SYSTEMS", "T2_HEADLESS"), ("tickets.cineplex.de", "CINEPLEX_DE", "T2_HEADLESS"), ("eventcinemas.com.au", "EVENT_CINEMAS", "T2_HEADLESS"), ("kinepolis.fr", "GENERIC", "T3_GEO_PROXY"),
    ("experience.cineworld.co.uk", "GENERIC", "T3_GEO_PROXY"), ("apiv2.megaplextheatres.com", "GENERIC", "T3_GEO_PROXY"),
)


def netloc(url: Column) -> Column:
    """What stands between // and the next / ? or #, lower-cased, without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def routed(df: DataFrame, url: str = "url") -> DataFrame:
    """df with platform and tier."""
    table = df.sparkSession.createDataFrame(PLATFORMS, "_host string, platform string, tier string")  # 14 rows
    out = df.drop("platform", "tier").join(F.broadcast(table), netloc(F.col(url)) == F.col("_host"), "left")
    return out.withColumns({"platform": F.coalesce("platform", F.lit("GENERIC")), "tier": F.coalesce("tier", F.lit("T1_HTTP"))}).drop("_host")


# What of a URL of these platforms leads to a basket, and where the page is instead.
_VIFF_SLUG, _VIFF_PAGE, _INDY_BASKET = r"/checkout/(?:event/)?([^/?#]+)", "/whats-on/", r"(?s)/(checkout|cart).*$"


def repaired_url(url: Column, platform: Column) -> Column:
    """A URL that leads to the page of a showing, not to a basket: by platform, the slug's page, the path before the basket,
    or the URL without its fragment. All others, and those without such a part, stay; a repaired one has its scheme in
    lower case."""
    part = lambda k: F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", k)
    host = F.concat(F.lower(part(1)), F.lit("://"), part(2))
    path = F.regexp_replace(part(3), ";[^/]*$", "")
    slug = F.regexp_extract(path, _VIFF_SLUG, 1)
    viff = (platform == "VIFF") & (path.contains("/checkout/") | path.contains("/cart/")) & (slug != "")
    indy = (platform == "INDY_SYSTEMS") & (path.contains("/checkout") | path.contains("/cart"))
    event = (platform == "EVENT_CINEMAS") & (F.length(part(5)) > 1)
    bare = F.concat(host, part(3), F.when(F.length(part(4)) > 1, part(4)).otherwise(""))
    return F.when(viff, F.concat(host, F.lit(_VIFF_PAGE), slug, F.lit("/"))).when(indy, F.concat(host, F.regexp_replace(path, _INDY_BASKET, ""))).when(event, bare).otherwise(url)


def minutes(html: Column) -> Column:
    """A running time as 1h 30m, else as 90 min, in minutes; null without one."""
    hours, rest = (F.regexp_extract(html, r"(\d+)h\s*(\d+)m", k) for k in (1, 2))
    plain = F.regexp_extract(html, r"(?i)(\d+)\s*(?:minutes|min)", 1)
    return F.when(hours != "", hours.try_cast("long") * 60 + rest.try_cast("long")).when(plain != "", plain.try_cast("long"))


def facts(html: Column) -> dict[str, Column]:
    """has_image, title (raw text of the last title that isn't blank), heading (of the first one), outcome."""
    titles = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<title[^>]*>([^<]*)"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    heading = F.regexp_extract(html, r"(?is)<h1[^>]*>([^<]*)", 1)
    image = F.regexp_extract(html, r'(?is)<meta[^>]*property="og:image"[^>]*content="([^"]+)"', 1)
    title = F.get(titles, F.size(titles) - 1)
    return {"has_image": image != "", "title": title, "heading": F.when(F.trim(heading) != "", F.trim(heading)), "outcome": F.when((image != "") | title.isNotNull(), "SUCCESS").otherwise("FAILED_T1")}


class _Page(HTMLParser):
    """og:image, the last title that isn't blank, and the first heading that isn't, tags within them left out."""

    def __init__(self) -> None:
        super().__init__()
        self.found: dict[str, str | None] = {"og_image": None, "title": None, "heading": None}
        self._open: dict[str, list[str]] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "meta":
            of = dict(attrs)
            if (of.get("property") or "").lower() == "og:image":
                self.found["og_image"] = of.get("content")
        elif tag == "title" or tag == "h1" and self.found["heading"] is None:
            self._open[tag] = []

    def handle_endtag(self, tag: str) -> None:
        if (text := "".join(self._open.pop(tag, [])).strip()):
            self.found["title" if tag == "title" else "heading"] = text

    def handle_data(self, data: str) -> None:
        # a title within a heading is the title's
        for tag in ("title", "h1"):
            if tag in self._open:
                self._open[tag].append(data)
                break


#: Characters of a page that are read where a page is fetched.
MOST_HTML = 50_000
_PARTS = T.StructType([T.StructField(n, T.StringType()) for n in ("og_image", "title", "heading")])


def _found(html: pd.Series, most: int | None) -> pd.DataFrame:
    rows = []
    for text in html:
        page = _Page()
        page.feed((text or "")[:most])
        rows.append(page.found)
    return pd.DataFrame(rows, columns=["og_image", "title", "heading"])


@F.pandas_udf(_PARTS)
def parts(html: pd.Series) -> pd.DataFrame:
    """og_image, title and heading of the first MOST_HTML characters of each page, entities decoded and nested tags left
    out: the title is the last one that isn't blank, the heading the first. Null pages have none."""
    return _found(html, MOST_HTML)


@F.pandas_udf(_PARTS)
def whole_parts(html: pd.Series) -> pd.DataFrame:
    """parts of whole pages of any length, for tables of pages that were fetched before."""
    return _found(html, None)


def outcome(parts: Column) -> Column:
    """SUCCESS where a page has an image or a title."""
    return F.when((F.coalesce(parts["og_image"], F.lit("")) != "") | parts["title"].isNotNull(), "SUCCESS").otherwise("FAILED_T1")


def poster_available(c: Column) -> Column:
    """Not blank, and no stand-in for a missing picture."""
    return (F.trim(F.coalesce(c, F.lit(""))) != "") & ~F.lower(F.coalesce(c, F.lit(""))).contains("noimage")
