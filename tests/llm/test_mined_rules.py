"""Mined URL rules against all token combinations, and what they decide."""

from __future__ import annotations

import re
from collections import defaultdict
from fractions import Fraction
from itertools import combinations

import pytest

from tessera.llm import queries, url_rules


def plain_tokens(host, path):
    labels = [x for x in host.split(".") if x]
    parts = [p for x in labels if "-" in x for p in x.split("-")]
    segments = [re.sub("[0-9]+", "0", x.lower()) for x in path.split("/") if x]
    return frozenset(["." + x for x in labels] + ["-" + x for x in parts] + ["/" + x for x in segments])


def plain_verdicts(listed, others, support=0.005, confidence=0.9):
    """The verdict of the surest rule for each of others, by counting every combination of two to four tokens."""
    counts, hits = defaultdict(int), defaultdict(int)
    for host, path, action in listed:
        t = sorted(plain_tokens(host, path))
        for n in (2, 3, 4):
            for items in combinations(t, n):
                counts[items] += 1
                hits[items, action] += 1
    rules = {}
    for (items, action), n in hits.items():
        if n >= support * len(listed) and Fraction(n, counts[items]) >= Fraction(confidence).limit_denominator(1000):
            rules[items, action] = (Fraction(n, counts[items]), n)
    kept = [(sure, n, items, action) for (items, action), (sure, n) in rules.items() if not any((sub, action) in rules and rules[sub, action][0] >= sure for k in range(2, len(items)) for sub in combinations(items, k))]
    out = {}
    for host, path in others:
        t = plain_tokens(host, path)
        fits = [(-sure, -n, -len(items), action) for sure, n, items, action in kept if t.issuperset(items)]
        out[host, path] = min(fits)[3] if fits else "allow"
    return out


def test_mined_rules_decide_unlisted_pages(spark):
    found = queries.op7_url_rules(spark, "/root/testdata/sf0.01").collect()
    listed = sorted({(r["host"], r["path"], r["verdict"]) for r in found if r["rule"]})
    others = sorted({(r["host"], r["path"]) for r in found if not r["rule"]})
    want = plain_verdicts(listed, others)
    assert {(r["host"], r["path"]): r["verdict"] for r in found if not r["rule"]} == want
    assert 0 < sum(v == "block" for v in want.values()) < len(want)


def test_a_planted_pair_of_tokens_blocks(spark):
    rows = [(f"http://a{k}.shop-win.com/go/{k}", "block") for k in range(40)] + [(f"http://b{k}.shop.com/go/{k}", "allow") for k in range(40)] + [(f"http://c{k}.win.com/see/{k}", "allow") for k in range(40)]
    labels = spark.createDataFrame(rows, "url string, action string")
    urls = ["http://x.shop-win.com/go/1", "http://y.pay-win.org/go/7", "http://y.win.com/see/7", None, "http://com/en/1"]
    pages = spark.createDataFrame([(k, u, k * 7) for k, u in enumerate(urls)], "page_id long, url string, token long")
    got = {r["page_id"]: r for r in url_rules.judged(pages, labels=labels).collect()}
    assert [got[k]["verdict"] for k in range(5)] == ["block", "block", "allow", "allow", "block"]
    assert got[4]["rule"] == "com/en/" and [got[k]["token"] for k in range(5)] == [0, 7, 14, 21, 28]
    none = {r["page_id"]: r["verdict"] for r in url_rules.judged(pages, labels=labels.limit(0)).collect()}
    assert none == {0: "allow", 1: "allow", 2: "allow", 3: "allow", 4: "block"}


@pytest.mark.parametrize("names", [("t", "items", "count", "a", "id", "_row", "mined", "rule_host", "action", "token")])
def test_clashing_columns(spark, names):
    pages = spark.createDataFrame([("http://x.com/en/1", *range(len(names))), (None, *range(len(names)))], "url string, " + ", ".join(f"`{n}` long" for n in names))
    for r in url_rules.judged(pages).collect():
        assert [r[n] for n in names] == list(range(len(names)))


def test_a_long_shared_path_is_one_group(spark):
    """25 segments that a hundred blocked URLs share: 2 ** 25 combinations of tokens, a few of groups."""
    path = "/".join(f"part{chr(97 + k)}" for k in range(25))
    rows = [(f"http://a{k}.example.org/{path}/x{k}", "block") for k in range(100)] + [(f"http://b{k}.example.org/other/y{k}", "allow") for k in range(100)]
    labels = spark.createDataFrame(rows, "url string, action string")
    urls = ["http://z.net/partc/1/partq", "http://z.net/partc/1", "http://c.example.org/partb/1", "http://c.example.org/other/1", "http://z.net/u/v"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judged(pages, rules=(("block", "none.invalid/"),), labels=labels).collect()}
    assert got == {0: "block", 1: "allow", 2: "block", 3: "allow", 4: "allow"}


def test_groups_decide_as_all_combinations_do(spark):
    listed = [(f"a{k}.x-y.com", f"/s/t/{'u/' if k % 3 else ''}v{chr(97 + k % 4)}", "block" if k % 5 else "allow") for k in range(60)] + [(f"b{k}.x.org", f"/s/{'u' if k % 2 else 'w'}/t", "allow") for k in range(40)]
    others = [(f"c.{h}", p) for h in ("x.com", "x-y.com", "y.org", "x.org") for p in ("/s/t", "/s/u", "/t/va/u", "/w/t", "/vb/vc", "/u")]
    labels = spark.createDataFrame([(f"http://{h}{p}", a) for h, p, a in listed], "url string, action string")
    pages = spark.createDataFrame([(f"http://{h}{p}",) for h, p in others], "url string")
    got = {(r["host"], r["path"]): r["verdict"] for r in url_rules.judged(pages, rules=(("block", "none.invalid/"),), labels=labels, min_support=0.05, min_confidence=0.7).collect()}
    assert got == plain_verdicts(listed, others, 0.05, 0.7) and len(set(got.values())) == 2
