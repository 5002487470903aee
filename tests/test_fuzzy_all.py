"""Fuzzy search against brute force over all titles, in any script."""

from __future__ import annotations

from tessera.functions.fuzzy import weighted_ratio
from tessera.operators import retrieve

TITLES = ["Война и мир", "Москва слезам не верит", "千と千尋の神隠し", "Ψυχή στο στόμα", "!!!!", "Toy Story", "Toy Story 2", "The Lion King", "Lion", "Das Boot", *(f"Film number {i}" for i in range(30))]
ASKED = ["Война и мир", "千と千尋の神隠し", "Ψυχή στο στόμα", "!!!!", "toy story", "The Lion King", "Москва"]


def test_every_title_is_compared(spark):
    catalog = spark.createDataFrame(list(enumerate(TITLES)), "id long, title string")
    queries = spark.createDataFrame([(i, q, None) for i, q in enumerate(ASKED)], "query_id long, q string, ordinal int")
    got = sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in retrieve.by_fuzzy(queries, catalog).collect())
    want = []
    for i, q in enumerate(ASKED):
        near = sorted((-weighted_ratio(q, t), j, t) for j, t in enumerate(TITLES))[:15]
        words = set(q.lower().split())
        ok = [(s, j) for s, j, t in near if t.lower() not in retrieve.JUNK and len(t) > 3 and (len(words & set(t.lower().split())) / len(words) >= 0.6 or -s >= 90)]
        want += [(i, n, j, round(-s / 200, 6)) for n, (s, j) in enumerate(ok[:10], 1)]
    assert got == sorted(want)
    assert {r[0] for r in got if r[1] == 1} >= {0, 1, 2, 3}
