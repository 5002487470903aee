"""Decomposition of letters in all scripts and repair of mis-decoded texts, as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hangul syllables by the arithmetic of the Unicode standard.
_HANGUL, _LEADS, _VOWELS, _TAILS = 0xAC00, 19, 21, 28
_LAST_HANGUL = _HANGUL + _LEADS * _VOWELS * _TAILS - 1


def _class(codes: list[int]) -> str:
    """A character class of sorted code points."""
    out, start = [], None
    for code, after in zip(codes, [*codes[1:], None], strict=True):
        start = code if start is None else start
        if after != code + 1:
            out.append(f"\\x{{{start:X}}}-\\x{{{code:X}}}")
            start = None
    return f"[{''.join(out)}]"


@cache
def _tables() -> tuple[str, str, dict[str, str], str, str]:
    """Letters with one bare letter and these letters; letters with several; classes of the latter and of marks. Made from
    the Unicode data of the driver's Python, for every code point that has a canonical decomposition."""
    one, several, marks = {}, {}, []
    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.category(ch) == "Mn":
            marks.append(code)
        elif (form := unicodedata.decomposition(ch)) and not form.startswith("<"):
            bare = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
            (one if len(bare) == 1 else several)[ch] = bare
    many = _class(sorted([*map(ord, several), *range(_HANGUL, _LAST_HANGUL + 1)]))
    return "".join(one), "".join(one.values()), several, many, _class(marks)


def without_marks(c: Column) -> Column:
    """The text decomposed canonically, without non-spacing marks: letters of any script are bare, Hangul syllables are
    letters of their own. Most letters are mapped in one pass; only texts that have others are taken apart."""
    marked, bare, several, many, marks = _tables()
    # tables are texts, in which a letter's place says what it becomes: an expression stays small however large they are
    jamo = lambda first, n, at: F.substr(F.lit("".join(chr(first + k) for k in range(n))), at.cast("int") + 1, F.lit(1))
    at = lambda ch: F.ascii(ch) - _HANGUL
    tail = lambda ch: F.when(at(ch) % _TAILS > 0, jamo(0x11A7, _TAILS, at(ch) % _TAILS)).otherwise("")
    hangul = lambda ch: F.concat(jamo(0x1100, _LEADS, F.floor(at(ch) / (_VOWELS * _TAILS))), jamo(0x1161, _VOWELS, F.floor(at(ch) / _TAILS) % _VOWELS), tail(ch))
    place = lambda ch: F.instr(F.lit("".join(several)), ch)
    forms = F.split(F.lit("|".join(several.values())), "\\|")
    apart = lambda ch: F.when(ch.between(chr(_HANGUL), chr(_LAST_HANGUL)), hangul(ch)).when(place(ch) > 0, F.get(forms, place(ch) - 1)).otherwise(ch)
    whole = F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), apart), "")
    taken = F.when(c.rlike(many), whole).otherwise(c)
    return F.when(c.rlike("[^\\x{00}-\\x{7F}]"), F.regexp_replace(F.translate(taken, marked, bare), marks, "")).otherwise(c)  # null stays null


def _one_byte() -> tuple[str, str]:
    """What Windows-1252 has at the bytes 0x80 to 0x9F, and the controls that Latin-1 has there."""
    pairs = [(bytes([b]).decode("cp1252", "ignore"), chr(b)) for b in range(0x80, 0xA0)]
    return "".join(a for a, _ in pairs if a), "".join(b for a, b in pairs if a)


_WINDOWS, _CONTROLS = _one_byte()
_NEXT = "[\\x{80}-\\x{BF}" + "".join(f"\\x{{{ord(ch):X}}}" for ch in _WINDOWS) + "]"
#: Leading bytes of scripts in use, so that a capital before a closing mark isn't taken for one: not those of phonetic
#: letters, modifiers and combining marks, but for the three that Windows-1252 has itself.
_RUN = f"(?:\\x{{C6}}[\\x{{2019}}\\x{{92}}]|\\x{{CB}}[\\x{{2020}}\\x{{86}}\\x{{153}}\\x{{9C}}]|[\\x{{C2}}-\\x{{C5}}\\x{{CE}}-\\x{{D1}}\\x{{D5}}-\\x{{DB}}]{_NEXT}|[\\x{{E0}}-\\x{{EF}}]{_NEXT}{{2}}|[\\x{{F0}}-\\x{{F4}}]{_NEXT}{{3}})+"


def repaired(c: Column, rounds: int = 3) -> Column:
    """The text with UTF-8 that was read as Windows-1252 or Latin-1 read rightly, up to `rounds` times over.

    Stretches of letters are taken back to bytes if they look like UTF-8, and stay if the bytes aren't; the rest of a text
    stays in any case, so a text may be damaged in part. Null stays null.
    """
    for _ in range(rounds):
        data = lambda part: F.encode(F.translate(part, _WINDOWS, _CONTROLS), "ISO-8859-1").cast("string")
        mend = lambda part: F.when(part.rlike(f"^{_RUN}$") & F.is_valid_utf8(data(part)), data(part)).otherwise(part)
        parts = F.regexp_extract_all(c, F.lit(f"(?s){_RUN}|."), F.lit(0))
        c = F.when(c.rlike(_RUN), F.array_join(F.transform(parts, mend), "")).otherwise(c)
    return c
