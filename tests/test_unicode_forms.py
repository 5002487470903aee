"""Decomposition against unicodedata on every assigned code point; repair by round trips of generated damage."""

from __future__ import annotations

import random
import sys
import unicodedata

from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions import unicode_forms


def bare(text):
    return "".join(ch for ch in unicodedata.normalize("NFD", text) if unicodedata.category(ch) != "Mn")


def test_every_assigned_code_point(spark):
    points = [code for code in range(sys.maxunicode + 1) if unicodedata.category(chr(code)) not in ("Cn", "Cs", "Co")]
    df = spark.createDataFrame([(code, chr(code)) for code in points], "code int, ch string").repartition(8)
    got = {r["code"]: r["out"] for r in df.select("code", unicode_forms.without_marks(F.col("ch")).alias("out")).collect()}
    wrong = [(hex(code), got[code], bare(chr(code))) for code in points if got[code] != bare(chr(code))]
    assert not wrong and len(got) > 140_000


def test_words_of_many_scripts(spark):
    texts = ["Ça été Ünïcode Å", "한국어 영화 각", "Ёлка й", "ἄνθρωπος ᾧ", "कि ख़", "কো", "がぎ", "Việt Nam", "עִבְרִית", "á̧b", "𝒜𑂚", "", None, "plain"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    got = {r["k"]: r["y"] for r in df.select("k", t.fold_accents(F.col("x")).alias("y")).collect()}
    assert got == {k: None if x is None else bare(x) for k, x in enumerate(texts)}


CLEAN = ["Amélie", "Los años", "“Quoted” – it’s", "Ödipus ½", "Вой на", "映画 千と", "naïve £5", "Léon: The Professional", "Żółć", "€uro", "emoji 😀 film", "", "plain", "«CAFÉ»", "São João", "ÀÉÎ", "L’été à Nîmes", "日本"]


def damage(text: str, page: str) -> str | None:
    try:
        return text.encode().decode(page)
    except UnicodeDecodeError:
        return None


def test_round_trips(spark):
    rng = random.Random(1)
    cases = [(x, x) for x in CLEAN]
    for x in CLEAN:
        for page in ("latin-1", "cp1252"):
            one = damage(x, page)
            if one is not None:
                cases.append((one, x))
                if (two := damage(one, page)) is not None:
                    cases.append((two, x))
    for _ in range(300):
        # marks of the one-byte page come after a blank: é—™ is itself how another letter would be damaged
        x = "".join(rng.choice([*"abc éüñßçøλжд中😀", " ’", " —", " ™"]) for _ in range(rng.randrange(1, 12)))
        if (one := damage(x, rng.choice(["latin-1", "cp1252"]))) is not None:
            cases.append((one, x))
            cases.append((f"{one} und schön", f"{x} und schön"))
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)], "k int, x string")
    got = {r["k"]: r["y"] for r in df.select("k", unicode_forms.repaired(F.col("x")).alias("y")).collect()}
    wrong = [(a, got[k], b) for k, (a, b) in enumerate(cases) if got[k] != b]
    assert not wrong, wrong[:5]
