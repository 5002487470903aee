"""MinHash near duplicates against all pairs of whole shingle sets."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tessera.llm import minhash, queries


def shingles(text, words=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words=4, percent=80):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for k, (own, _) in enumerate(rows):
        r = find(k)
        least[r] = own if least.get(r) is None else least[r] if own is None else min(own, least[r])
    return sorted((repr(own), len(sets[k]), repr(least[find(k)])) for k, (own, _) in enumerate(rows))


def copies(rng, n):
    """Groups of copies of which some are near each other, some only near a third, and some just too far."""
    rows = []
    while len(rows) < n:
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice([3, 5, 12, 60, 140]))]
        for _ in range(rng.choice([1, 2, 9, 25])):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(text) // 22))):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                base = text  # copies of copies drift
            rows.append((len(rows), rng.choice([" ", "\n", " \t"]).join(w.upper() if rng.random() < 0.1 else w for w in text)))
    return rows


def found(spark, rows, words=4):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in minhash.near_duplicates(df, words=words).collect())


@pytest.mark.parametrize("part", [4096, 6])
def test_components(spark, part, monkeypatch):
    monkeypatch.setattr(minhash, "PART", part)
    if part == 6:
        monkeypatch.setattr(minhash, "PART_SHINGLES", 400)
        monkeypatch.setattr(minhash, "MOST_BROADCAST", 3)
    rows = copies(random.Random(part), 420)
    want = brute(rows)
    assert found(spark, rows) == want
    assert len({r[2] for r in want}) < len(want) - 100


def test_links_at_the_bound(spark):
    """Sets of four out of five shingles are linked, of eleven out of fourteen are not."""
    base = "a b c d e f g h".split()
    rows = [(1, " ".join(base)), (2, " ".join(base[:7])), (3, " ".join(f"q{k}" for k in range(17))), (4, " ".join(f"q{k}" for k in range(14)))]
    got = {r[0]: (r[1], r[2]) for r in found(spark, rows)}
    assert got == {"1": (5, "1"), "2": (4, "1"), "3": (14, "3"), "4": (11, "4")}


def test_odd_rows(spark):
    long = " ".join(f"v{k % 5000}" for k in range(60_000))
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one"), (9, "ONE"), (None, "one"), (9, "ONE"), (4, long), (3, long.upper()), (None, "alone here"), (2, "Ä b"), (1, "ä b")]
    assert found(spark, rows) == brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wide = df.selectExpr("*", "7 AS node", "8 AS sig", "9 AS n", "1 AS home", "2 AS token", "3 AS root", "4 AS Kept")
    assert sorted(map(repr, minhash.near_duplicates(wide).collect())) == sorted(map(repr, minhash.near_duplicates(df).collect()))
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert minhash.near_duplicates(df.where("doc_id in (5, 6)")).count() == 2


def test_spanning_search():
    rng = random.Random(1)
    sets = [np.array(sorted(rng.sample(range(40), rng.randrange(1, 14))), np.uint64) for _ in range(90)]
    for percent in (30, 60, 80):
        links = minhash.spanning_links(np.arange(90), sets, percent)
        for u, v in links:
            a, b = set(sets[u].tolist()), set(sets[v].tolist())
            assert 100 * len(a & b) >= percent * len(a | b)
        root = list(range(90))

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for u, v in links:
            root[find(u)] = find(v)
        for i in range(90):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(a & b) >= percent * len(a | b):
                    assert find(i) == find(j)


def test_signatures_agree_as_often_as_sets():
    rng = np.random.default_rng(2)
    every = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = np.sort(every[:3600]), np.sort(every[400:])  # 3200 of 4000
    x, y = minhash.signatures([a, b])
    assert abs(float((x == y).mean()) - 0.8) < 0.15


def test_query_has_its_columns(spark, sf_dir):
    assert queries.op13_minhash(spark, sf_dir).columns == ["doc_id", "n_shingles", "component_id", "kept"]
