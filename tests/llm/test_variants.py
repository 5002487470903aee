"""Spelling variants: signatures, near words and forms against plain loops over all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import queries, variants


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def vocabulary(rng: random.Random, n: int) -> dict[str, int]:
    letters = "abéÿ×cd"
    words: set[str] = set()
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 11)))
        words.add(w)
        for _ in range(3):
            k = rng.randrange(len(w) + 1)
            words.add(rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :], "".join(sorted(w))]))
    return {w: 5 * 3 ** rng.randrange(8) + rng.randrange(3) for w in sorted(words) if len(w) >= 6}


def brute(words: dict[str, int]) -> set[tuple]:
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("levels", [(1, 6), (1, 7), (1, 8), (2, 4), (3, 2)])
def test_near_words_share_a_signature(levels):
    words = sorted(vocabulary(random.Random(2), 250)) + ["aaaaaaaaaaaa" * 8, "aaaaaaaaaaaa" * 8 + "a"]
    found = variants.signatures(words, *levels)
    for i, a in enumerate(words):
        for j, b in enumerate(words[:i]):
            if abs(len(a) - len(b)) < 2 and edits(a, b) == 1:
                assert (found[i] == found[j]).any()


@pytest.mark.parametrize("part", [500, 4])
def test_forms(spark, part, monkeypatch):
    monkeypatch.setattr(variants, "PART", part)
    words = vocabulary(random.Random(1), 400)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [tuple(r) for r in variants.grouped(df).collect()]
    assert len(got) == len(words) and set(got) == brute(words)
    assert any(r[2] not in (r[0], r[1]) for r in got)  # a root beyond its form


def counted(docs) -> Counter:
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    total: Counter = Counter()
    for k, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return Counter({w: n for w, n in total.items() if len(w) >= 6})


@pytest.mark.parametrize("held", [200_000, 50])
def test_counts(spark, sf_dir, held, monkeypatch):
    monkeypatch.setattr(variants, "HELD", held)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r["word"]: r["n"] for r in variants.word_counts(docs, edit=variants.misspelt).collect()}
    assert got == counted([tuple(r) for r in docs.collect()])


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    base = ["windows", "Windöws", "colour", "color", "colours", "ÀÉÎõüÿ", "gather×", "другое", "naïveté"]
    texts = [" ".join(rng.choice(base) for _ in range(40)) + rng.choice([".", "\n", "1 ", "\U0001f600"]) for _ in range(60)]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)] + [(3, None), (4, ""), (5, "x" * 300_000), (5, texts[0]), (5, texts[0])]
    spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("n", "n").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in queries.op12_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == brute({w: n for w, n in counted(rows).items() if n >= 5})
    assert any(r[1] for r in got)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "letter " * 9, 3), (2, "letter " * 9, 3), (3, "lettér", 4)], "doc_id long, text string, word long")
    assert [tuple(r) for r in variants.spelling_variants(df).collect()] == [("letter", None, "letter", 18, 0, None)]
    assert variants.spelling_variants(df.limit(0)).count() == 0
    assert variants.spelling_variants(df.where("doc_id = 3")).count() == 0


def test_signatures_of_nothing():
    assert variants.signatures([], 1, 6).shape[0] == 0
    assert np.array_equal(variants.signatures(["abcdef"], 1, 6), variants.signatures(["fedcba"], 1, 6))
