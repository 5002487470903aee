"""Candidates from retrieval over the whole catalog, and what is decided on them."""

from __future__ import annotations

import datetime as dt
import json
import re

import pytest

from tessera.functions.fuzzy import weighted_ratio
from tessera.operators import retrieve
from tessera.operators.written import cut
from tessera.plans import titles
from tessera.plans.registry import QUERIES


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    return [r.asDict() for r in QUERIES["candidates"][0](spark, sf_dir).collect()]


def test_all_ways_and_the_whole_catalog(found, spark, sf_dir):
    assert {r["source"] for r in found} == {"alias", "franchise_map", "fuzzy", "hybrid"}
    assert any(r["id"] >= 200000 for r in found) and any(10731 <= r["id"] < 200000 for r in found)
    c, q = titles.catalog(spark, sf_dir), titles._queries(spark, sf_dir)
    for part in (retrieve.by_alias(q, titles._aliases(c), c), retrieve.by_franchise(q, c)):
        want = {(r["query_id"], r["id"]) for r in part.collect()}
        assert want and want <= {(r["query_id"], r["id"]) for r in found}


def test_order_and_number(found, spark, sf_dir):
    c, q = titles.catalog(spark, sf_dir), titles._queries(spark, sf_dir)
    near = titles._nearest_titles(spark, sf_dir, q, c, 20)
    parts = [retrieve.by_alias(q, titles._aliases(c), c), retrieve.by_franchise(q, c), retrieve.by_fuzzy(q, c), retrieve.hybrid(retrieve.bm25(q, c, 20), near, 20)]
    parts = [sorted((r.asDict() for r in p.collect()), key=lambda r: r.get("rank", 0)) for p in parts]
    for query in [r["query_id"] for r in q.select("query_id").collect()]:
        want = []
        for i, rows in enumerate(parts):
            want += [r["id"] for r in rows if r["query_id"] == query and (i < 2 or r["id"] not in want)]
        assert [r["id"] for r in sorted(found, key=lambda r: r["gen"]) if r["query_id"] == query] == want[:10]


def test_every_query_is_decided(found, spark, sf_dir):
    pairs = {(r["query_id"], r["id"]) for r in found}
    everyone = {r["query_id"] for r in titles._queries(spark, sf_dir).collect()}
    got = QUERIES["candidate_decision"][0](spark, sf_dir).collect()
    assert {r["query_id"] for r in got} == everyone
    assert all((r["query_id"], r["movie_id"]) in pairs or r["movie_id"] == 0 for r in got)
    assert {(r["query_id"], r["id"]) for r in QUERIES["candidate_coverage"][0](spark, sf_dir).collect()} == pairs
    assert {(r["query_id"], r["id"]) for r in QUERIES["candidate_plausible"][0](spark, sf_dir).collect()} <= pairs


def _date(text):
    try:
        day = dt.date.fromisoformat(text or "")
    except ValueError:
        return None
    return None if day.year >= 2030 else day


def test_values(spark, sf_dir, monkeypatch):
    """Coverage, guards, composite, decision, evidence and reasoning of all candidates, in plain Python."""
    dated = cut(titles._dated(spark, sf_dir), "dated")
    monkeypatch.setattr(titles, "_dated", lambda s, d: dated)
    rows = [r.asDict() for r in dated.collect()]
    run = lambda name: QUERIES[name][0](spark, sf_dir).collect()
    words = lambda t: set(t.lower().split())
    cover = lambda r: len(words(r["q"]) & words(r["title"])) / len(words(r["q"])) if words(r["q"]) else 1.0
    assert sorted((r["query_id"], r["id"], r["source"], r["coverage"]) for r in run("candidate_coverage")) == sorted((r["query_id"], r["id"], r["source"], round(cover(r), 6)) for r in rows)

    def plausible(r):
        sure = weighted_ratio(r["q"], r["title"])
        numbers = [int(n) for n in re.findall(r"\b(\d+)\b", r["title"])] + [{"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9}[n.lower()] for n in re.findall(r"\b(I{1,3}|IV|VI{0,3}|IX)\b", r["title"], re.I)]
        numbers = [n for n in numbers if 1 <= n <= 10]
        conflict = bool(r["ordinal"] and r["ordinal"] > 0 and numbers and r["ordinal"] not in numbers)
        return r["title"].lower() not in retrieve.JUNK and len(r["title"]) > 3 and (cover(r) >= 0.6 or sure >= 90) and not conflict

    assert sorted((r["query_id"], r["id"], r["source"], r["score"]) for r in run("candidate_plausible")) == sorted((r["query_id"], r["id"], r["source"], round(weighted_ratio(r["q"], r["title"]), 6)) for r in rows if plausible(r))

    for r in rows:
        show, out = _date(r["show_date"]), _date(r["release_date"])
        days = abs((show - out).days) if show and out else None
        r["window"] = "NONE" if days is None or days > 365 else "EXACT" if days == 0 else "NEAR" if days <= 30 else "YEAR"
        drawn = "Live Action" in (r["edition_markers"] or []) and any(w in r["title"].lower() for w in ("animated", "animation", "cartoon"))
        r["composite"] = min(1.0, max(0.0, r["score"] + {"EXACT": 0.30, "NEAR": 0.15, "YEAR": 0.05, "NONE": 0.0}[r["window"]] - (0.2 if drawn else 0.0)))
    by_query = {}
    for r in rows:
        by_query.setdefault(r["query_id"], []).append(r)
    for own in by_query.values():
        for place, r in enumerate(sorted(own, key=lambda r: (-r["composite"], r["gen"])), 1):
            r["place"] = place
    assert sorted((r["query_id"], r["id"], r["source"], r["date_window"], r["composite"], r["place"]) for r in run("candidate_rank")) == sorted((r["query_id"], r["id"], r["source"], r["window"], round(r["composite"], 6), r["place"]) for r in rows)

    parents = {r["id"]: r["parent_id"] for r in titles.catalog(spark, sf_dir).collect()}
    found = {r["query_id"]: r for r in run("candidate_decision")}
    evidence = {r["query_id"]: r for r in run("candidate_evidence")}
    reasons = {r["query_id"]: r["reasoning"] for r in run("candidate_reasoning")}
    assert set(reasons) == set(by_query) and set(by_query) <= set(found)
    for query, own in by_query.items():
        own.sort(key=lambda r: r["place"])
        best = own[0]
        newest = max((d for r in own if (d := _date(r["release_date"]))), default=None)
        sure = min(1.0, best["composite"] + (0.05 if best["event_type"] == "MOVIE" and len(own) > 1 and newest and _date(best["release_date"]) == newest else 0.0))
        parent = parents[best["id"]]
        want = "REVIEW_" + best["event_type"] if best["event_type"] in ("MULTI_FILM", "NON_MOVIE") else "AUTO_ACCEPT" if sure >= 0.9 else "REVIEW"
        got = found[query]
        assert (got["movie_id"], got["title"], got["canonical_id"], got["date_window"], got["decision"]) == (best["id"], best["title"], parent if parent in parents and parent != best["id"] else best["id"], best["window"], want)
        assert abs(got["confidence"] - sure) <= 0.00005 + 1e-9
        top = [(x["id"], x["title"]) for x in json.loads(evidence[query]["fuzzy_top"])]
        lost = [(x["id"], x["title"]) for x in json.loads(evidence[query]["eliminated"])]
        assert top == [(r["id"], r["title"]) for r in sorted(own, key=lambda r: r["gen"])[:5]] and lost == [(r["id"], r["title"]) for r in own[1:5]]
        assert f"(id {best['id']})" in reasons[query] and f"'{best['title']}'" in reasons[query] and f"{round(100 * best['score'])}%" in reasons[query]
    for query, r in found.items():
        if query not in by_query:
            assert (r["movie_id"], r["title"], r["confidence"], r["decision"]) == (0, "Unknown", 0.0, "REVIEW")
