"""DuckDB expressions of the normal forms, for the SQL twins of queries."""

from __future__ import annotations

from tessera.functions.text import BLANK_WORDS, IGNORED_SEGMENTS, STOPWORDS


def in_list(words: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def pre(x: str) -> str:
    x = f"strip_accents(regexp_replace(replace({x}, chr(160), ' '), 'xa0', '', 'gi'))"
    x = rf"regexp_replace({x}, '(\d+)\s+([A-Za-z])\s+([A-Za-z])(\s|$)', '\1\2\3\4', 'g')"
    return rf"regexp_replace({x}, '(\d+)\s+([A-Za-z]+)', '\1\2', 'g')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def plain(x: str) -> str:
    return squeeze(rf"regexp_replace(lower({pre(x)}), '[^a-z0-9\s]', ' ', 'g')")


def light(x: str) -> str:
    return "lower(" + squeeze(f"regexp_replace(regexp_replace({pre(x)}, '[®™©$]', '', 'g'), '[/@.]', ' ', 'g')") + ")"


def without_stopwords(x: str) -> str:
    return f"array_to_string(list_filter(string_split({squeeze(f"replace({light(x)}, '-', ' ')")}, ' '), lambda w: w NOT IN {in_list((*STOPWORDS, ''))}), ' ')"


def tokens(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({plain(x)}, ' '), lambda w: w <> '')))"


def concat_form(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def segments(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, '|'), lambda s: {strip('s')}), lambda s: lower(s) NOT IN {in_list(IGNORED_SEGMENTS)})"


def unblank(x: str) -> str:
    return f"CASE WHEN lower({strip(f"coalesce({x}, '')")}) IN {in_list(BLANK_WORDS)} THEN '' ELSE {strip(f"coalesce({x}, '')")} END"
