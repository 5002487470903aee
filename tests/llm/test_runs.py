"""Periodic runs against all pairs of starts and periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import queries, runs


def brute(words: list, least: int = 24, periods: int = 3) -> list[tuple[int, int, int]]:
    """Maximal stretches of each period; of one stretch the smallest period counts."""
    n, found = len(words), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q) and (i, j + q) not in found:
                found[i, j + q] = q
            i = j
    # a multiple of a smaller period spans the same stretch, so only the smallest stays
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(rng: random.Random, n: int, letters: int) -> list[bytes]:
    words = [b"w%d" % rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        a, p, times = rng.randrange(n), rng.randrange(1, 20), rng.randrange(2, 7)
        root = words[a : a + p]
        words[a : a + p * times] = (root * times)[: len(words[a : a + p * times])]
    return words


def rows(found: np.ndarray) -> list[tuple[int, int, int]]:
    return [tuple(r) for r in found.tolist()]


@pytest.mark.parametrize("letters", [1, 2, 3, 40, 5000])
def test_runs_of_random_texts(letters):
    rng = random.Random(letters)
    texts = [planted(rng, rng.randrange(1, 160), letters) for _ in range(120)] + [[]]
    for words, found in zip(texts, runs.document_runs(texts), strict=True):
        assert rows(found) == brute(words)


def test_all_runs_of_short_bounds():
    rng = random.Random(5)
    for _ in range(300):
        s = [rng.randrange(3) for _ in range(rng.randrange(2, 40))]
        assert rows(runs.stretch_runs(np.array(s), 2, 2)) == brute(s, 2, 2)


def test_suffix_tree_holds_each_suffix():
    rng = random.Random(3)
    for _ in range(100):
        s = [rng.randrange(1, 4) for _ in range(rng.randrange(0, 30))] + [0]
        children, start, end = runs.suffix_tree(s)
        for k in range(len(s)):
            node, at = 0, k
            while at < len(s):
                node = children[node][s[at]]
                size = end[node] - start[node]
                assert s[start[node] : end[node]] == s[at : at + size]
                at += size
            assert not children[node]
        assert sum(not c for c in children) == len(s)


def test_extensions():
    s = np.array([1, 2, 1, 2, 1, 3, 1, 2, 1, 2])
    i, j = np.array([0, 0, 1, 4]), np.array([2, 6, 7, 6])
    assert runs.Extensions(s).of(i, j).tolist() == [3, 4, 3, 1]


def reference_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    text = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


def test_query_against_brute_force(spark, sf_dir):
    docs = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len((r["text"] or "").split()) < 700]
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    assert len(docs) > 100 and any(got[d["doc_id"]][1] for d in docs)
    for d in docs:
        assert got[d["doc_id"]] == reference_row(d["doc_id"], d["text"])


def test_odd_rows(spark):
    again = "one two three four five six seven eight nine ten " * 3
    texts = [None, "", " \n\t", "a " * 24, "a " * 23, again, again + "one", "x " * 30_000, "ä b\x0bc", again]
    df = spark.createDataFrame([(k if k else None, t, k) for k, t in enumerate(texts)], "doc_id long, text string, Runs long")
    found = {r["n"]: r for r in runs.with_runs(df.withColumnRenamed("Runs", "n")).collect()}
    shape = {k: [tuple(x) for x in r["runs"]] for k, r in found.items()}
    assert shape == {0: [], 1: [], 2: [], 3: [(0, 24, 1)], 4: [], 5: [(0, 30, 10)], 6: [(0, 31, 10)], 7: [(0, 30_000, 1)], 8: [], 9: [(0, 30, 10)]}
    assert found[7]["collapsed"] == "x" and found[8]["collapsed"] == "ä b c" and found[0]["collapsed"] == ""
    clash = df.withColumn("collapsed", df["n" if "n" in df.columns else "Runs"] + 1).withColumn("own", df["Runs"])
    out = runs.with_runs(clash, results=("periodic", "short"))
    assert out.columns == ["doc_id", "Runs", "collapsed", "own", "periodic", "short"] and all(r["collapsed"] == r["Runs"] + 1 for r in out.collect())
    assert runs.with_runs(df.limit(0)).count() == 0


def test_edit_that_makes_runs():
    for k in range(400):
        words = [b"%d" % i for i in range(k % 70)]
        edited = runs.repeated_tail(k, list(words))
        h = zlib.crc32(str(k).encode())
        g = h // 10
        if h % 10 or not words:
            assert edited == words
            continue
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        assert edited == [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]


def test_one_long_document(spark):
    """A text of a hundred thousand words whose second half repeats itself with a long period."""
    rng = random.Random(1)
    head = [str(rng.randrange(10**6)) for _ in range(50_000)]
    root = [str(rng.randrange(10**6)) for _ in range(12_500)]
    df = spark.createDataFrame([(1, " ".join(head + root * 4))], "doc_id long, text string")
    r = runs.with_runs(df).first()
    assert [tuple(x) for x in r["runs"]] == [(50_000, 50_000, 12_500)] and r["collapsed"] == " ".join(head + root)
