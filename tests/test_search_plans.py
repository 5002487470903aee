"""Searches read all parts once, keep their plans small and deal out what is much work; the partial ratio against a plain loop."""

from __future__ import annotations

import random

import pytest

from tessera.functions import fuzzy
from tessera.operators import fuzzy_search, retrieve, scoped
from tessera.plans.registry import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["trigram_search", "plausible_pairs", "db_search_cascade"])
def test_searches_write_what_they_use_again(spark, sf_dir, name):
    plan = _plan(QUERIES[name][0](spark, sf_dir))
    assert "p_partkey" not in plan and len(plan) < 30_000


@pytest.mark.parametrize("name", ["candidates", "candidate_plausible", "candidate_rank", "candidate_decision", "candidate_evidence", "candidate_reasoning"])
def test_candidates_write_what_each_search_finds(spark, sf_dir, name):
    plan = _plan(QUERIES[name][0](spark, sf_dir))
    assert "p_partkey" not in plan and len(plan) < 30_000


def test_pairs_are_scored_over_tasks(spark, monkeypatch):
    plans, cut = {}, fuzzy_search.cut
    monkeypatch.setattr(fuzzy_search, "cut", lambda df, label: plans.update({label: _plan(df)}) or cut(df, label))
    titles = spark.createDataFrame([(f"film number {i}", 1) for i in range(40)], "title string, n long")
    rest = fuzzy_search.scored_pairs(spark.createDataFrame([("film 7",), ("number",)], "text string"), titles, 5)
    assert "RepartitionByExpression" in plans["fuzzy-seeds"] and "RepartitionByExpression" in _plan(rest)


def test_partial_ratio_of_every_stretch():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("ab c") for _ in range(rng.randrange(n)))
    for _ in range(3000):
        short, long = sorted((text(8), text(20)), key=len)
        n = len(short)
        plain = max(fuzzy.indel_ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long))) if n else 0.0 if long else 100.0
        assert fuzzy._partial(short, long) == plain


@pytest.mark.parametrize("name", ["candidates", "alias_join", "ilike_search"])
def test_join_keys_are_columns(spark, sf_dir, name):
    """A key that is an expression is evaluated where the table is held for a broadcast: in the driver, where the first
    lower() of a session fills tables of all letters."""
    joins = [x for x in QUERIES[name][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines() if "Join " in x or "BroadcastExchange" in x]
    assert joins and not any("lower(" in x for x in joins)


def test_scoped_join_keys_are_columns(spark):
    q = spark.createDataFrame([(1, "Film", "DE")], "query_id long, q string, country string")
    rows = spark.createDataFrame([(7, "A film", "DE")], "id long, title string, scope string")
    found = scoped._patterns(q, rows, 5)
    assert [tuple(r) for r in found.collect()] == [(1, 7, 1)]
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins and not any("lower(" in x for x in joins)


def test_candidates_meet_in_few_joins(spark, sf_dir, monkeypatch):
    """Each join of small tables is a job, a broadcast and a thread of the driver: installments are looked up, both windows share a shuffle, and the plans that are written stay small."""
    plans, cut = {}, retrieve.cut
    monkeypatch.setattr(retrieve, "cut", lambda df, label: plans.update({label: _plan(df)}) or cut(df, label))
    plan = _plan(QUERIES["candidates"][0](spark, sf_dir))
    assert plan.count("Join ") == 3 and plan.count("Window ") == 2 and plan.count("RepartitionByExpression [query_id") == 1
    assert set(plans) == {"bm25-hits", "hybrid-hits", "fuzzy-hits"} and plans["hybrid-hits"].count("Join ") == 3


def test_seeds_keep_their_score(spark):
    """Pairs that were scored first are not joined away, and each pair comes once with its ratio."""
    titles = spark.createDataFrame([(f"film number {i}", 1) for i in range(40)], "title string, n long")
    found = fuzzy_search.scored_pairs(spark.createDataFrame([("film 7",), ("number",)], "text string"), titles, 5)
    rows = [tuple(r) for r in found.select("text", "title", "score").collect()]
    assert "LeftAnti" not in _plan(found) and len(rows) == len({r[:2] for r in rows}) >= 10
    assert all(score == fuzzy.weighted_ratio(text, title) for text, title, score in rows)


def test_country_hybrid_asks_with_every_vector(spark, sf_dir, duck):
    """Empty texts are found by their vectors only: each that has one, and all rows to search, has its ten."""
    rows = QUERIES["country_hybrid"][0](spark, sf_dir).where("query_id % 15 = 2 and query_id % 2 = 1").groupBy("query_id").count().collect()
    asked = duck.execute("SELECT p_partkey FROM part JOIN embeddings ON vec_id = p_partkey WHERE p_partkey % 15 = 2 AND p_partkey % 2 = 1").fetchall()
    assert asked and {tuple(r) for r in rows} == {(k, 10) for (k,) in asked}
