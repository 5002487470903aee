"""Fuzzy, pattern and vector search against plain loops over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.fuzzy import weighted_ratio
from tessera.operators import fuzzy_search, retrieve, vector_index


def titles(rng: random.Random, n: int) -> list[str]:
    words = ["the", "a", "lion", "king", "story", "toy", "Война", "мир", "千と", "千尋", "of", "night", "knight", "rises", "returns", "ψυχή", "2", "II", "part", "la", "land", "!!!", "moana", "star"]
    words += ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 7]))) for _ in range(n)] + ["", " ", "la la la", "x" * 200, "lion\tking", "a"]


def test_bounds_are_never_below_the_ratio(spark):
    rng = random.Random(3)
    some = titles(rng, 160)
    rows = spark.createDataFrame([(t,) for t in dict.fromkeys(some)], "text string")
    p = fuzzy_search.profiled(rows)
    pack = lambda n: p.select(F.col("text").alias(f"text_{n}"), F.struct("letters", "blanks", "words", "n_words", "size", "set_size").alias(n))
    both = F.array_intersect("q.words", "t.words")
    pairs = pack("q").crossJoin(pack("t")).withColumn("common", fuzzy_search.common_letters("q", "t"))
    pairs = pairs.select("text_q", "text_t", F.size(both).alias("n"), fuzzy_search.bound("q", "t", F.col("common")).alias("alone"), fuzzy_search.bound("q", "t", F.col("common"), F.length(F.array_join(both, " "))).alias("any"))
    checked = 0
    for r in pairs.collect():
        ratio = weighted_ratio(r["text_q"], r["text_t"])
        assert r["any"] >= ratio - 1e-9, r
        if not r["n"]:
            assert r["alone"] >= ratio - 1e-9, r
            checked += 1
    assert checked > 5000


def test_fuzzy_search_is_exact_and_scores_few_pairs(spark):
    rng = random.Random(4)
    catalog = list(enumerate(titles(rng, 1500)))
    asked = list(dict.fromkeys(titles(rng, 30) + [t for _, t in rng.sample(catalog, 20)]))
    q = spark.createDataFrame([(t,) for t in asked], "text string")
    c = spark.createDataFrame([*catalog, (9999, None)], "id long, title string").repartition(4)
    got: dict[str, list] = {}
    for r in fuzzy_search.best(q, c, 15).collect():
        got.setdefault(r["text"], []).append((-round(r["score"], 6), r["id"]))
    for t in asked:
        want = sorted((-round(weighted_ratio(t, x), 6), k) for k, x in catalog)[:15]
        assert sorted(got[t]) == want, t
    real = [t for t in asked if t.strip()]
    distinct = c.where("title is not null").groupBy("title").agg(F.count("*").alias("n"))
    scored = fuzzy_search.scored_pairs(q.where("trim(text) <> ''"), distinct, 15).count()
    assert scored < 0.5 * len(real) * distinct.count()


def test_fuzzy_search_of_few_titles(spark):
    c = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b")], "id long, title string")
    q = spark.createDataFrame([("a b",), ("",), ("a b",)], "text string")
    assert sorted((r["text"], r["id"]) for r in fuzzy_search.best(q, c, 5).collect()) == [(t, k) for t in ("", "a b") for k in (1, 2, 3)]
    assert fuzzy_search.best(q, c.limit(0), 5).count() == 0 and fuzzy_search.best(q.limit(0), c, 5).count() == 0


def like(pattern: str, text: str) -> bool:
    return re.fullmatch("".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in f"%{pattern}%"), text, re.S) is not None


def test_patterns_with_wildcards(spark):
    rng = random.Random(5)
    catalog = [(k, t) for k, t in enumerate(titles(rng, 300) + ["100% real", "under_score", "back\\slash", "Lion\nking"])]
    asked = ["", "%", "_", "li", "LION", "li%ng", "li_n", "l_o%k_ng", "100%", "r_s", "back\\s", "ion_king", "(", "%toy%", "story%the", None, "зна", "ght ris", "nothing like it"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, q string")
    c = spark.createDataFrame([*catalog, (7777, None)], "id long, title string")
    for empty in (False, True):
        got = sorted((r["query_id"], r["rank"], r["id"]) for r in retrieve.by_pattern(q, c, 20, empty).collect())
        want = []
        for k, p in enumerate(asked):
            if p is None or (not p and not empty):
                continue
            hits = sorted((t.lower() != p.lower(), len(t), i) for i, t in catalog if like(p.lower(), t.lower()))[:20]
            want += [(k, n, i) for n, (_, _, i) in enumerate(hits, 1)]
        assert got == sorted(want)
    long = q.where("length(q) > 3 and q not like '%\\\\%%' and q not like '%\\\\_%'")
    plan = retrieve.by_pattern(long, c)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("part", [20_000, 40])
def test_vector_index(spark, part, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", part)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16)) * 2
    which = np.minimum(rng.geometric(0.35, 1500) - 1, 11)  # a third of all rows in one cluster
    v = centres[which] + rng.normal(size=(1500, 16))
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)] + [(5000, [0.0] * 16), (5001, None), (5002, [float(x) for x in v[3]])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(6)
    q = df.where("id % 25 = 0 or id > 4999").withColumnRenamed("id", "query_id")
    index = vector_index.build(df)
    assert index.rows.count() == len(rows) - 1 and index.rows.select("id").distinct().count() == len(rows) - 1
    exact = retrieve.nearest(q.where("v is not null"), df.where("v is not null"), 10)
    some = vector_index.search(q, index, 10)
    assert vector_index.recall(some, exact) >= 0.9
    every = vector_index.search(q, index, 10, probes=10_000)
    rounded = lambda d: sorted((r["query_id"], r["rank"], r["id"], round(r["cosine"], 6)) for r in d.where("query_id <> 5000").collect())
    assert rounded(every) == rounded(exact)
    if part == 40:
        assert index.rows.agg(F.max("parts")).first()[0] > 1


def test_vector_index_of_nothing(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    index = vector_index.build(none)
    assert index.rows.count() == 0
    assert vector_index.search(none.withColumnRenamed("id", "query_id"), index).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    assert vector_index.search(one.withColumnRenamed("id", "query_id"), vector_index.build(one)).count() == 0


def test_recall_of_the_index_on_the_given_vectors(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    assert vector_index.recall(vector_index.search(q, vector_index.build(v)), retrieve.nearest(q, v)) >= 0.9
