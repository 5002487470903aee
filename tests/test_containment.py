"""Joins by containment against all pairs, on a large dictionary, and without a nested loop."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.operators import containment, detect


def test_both_joins_on_five_thousand_entries(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "bcdfgk" for b in ("ax", "ol", "um", "i", "ento", "a", "dolby")]
    entries = []
    for k in range(5000):
        w = sorted({words[min(int(rng.paretovariate(0.7)) - 1, len(words) - 1)] for _ in range(rng.randrange(0, 5))})
        entries.append((k, rng.randrange(1, 6), w, "".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))))
    texts = []
    for k in range(400):
        texts.append((f"t{k}", sorted(set(rng.choices(words, k=rng.randrange(0, 7)))), "".join(rng.choice("abc") for _ in range(rng.randrange(0, 14)))))
    e = spark.createDataFrame(entries, "id long, tier int, words array<string>, letters string")
    t = spark.createDataFrame(texts, "key string, words array<string>, letters string")
    order = F.struct("tier", "id")
    found = [containment.by_words(t, e, order), containment.by_head(t, e, order, 4)]
    got = [{r["key"]: tuple(r["b"]) for r in f.groupBy("key").agg(F.min("best").alias("b")).collect()} for f in found]
    want = [{}, {}]
    for key, w, x in texts:
        for which, fits in enumerate((lambda n, c: n and set(n) <= set(w), lambda n, c: len(c) >= 4 and x.startswith(c))):
            if hits := [(tier, k) for k, tier, n, c in entries if fits(n, c)]:
                want[which][key] = min(hits)
    assert got == want and len(want[0]) > 200 and len(want[1]) > 20
    for f in found:
        plan = f._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner" in plan and "CartesianProduct" not in f._jdf.queryExecution().executedPlan().toString()


def test_segments_of_a_large_dictionary(spark):
    rng = random.Random(2)
    stems = ["imax", "dolby", "ultra", "screen", "laser", "grand", "xl", "vip", "sound", "70mm"]
    names = sorted({" ".join(rng.sample(stems, rng.randrange(1, 4))) + rng.choice(["", str(rng.randrange(900))]) for _ in range(7000)})[:5000]
    words = spark.createDataFrame([(k, n, "F", 1 + k % 5) for k, n in enumerate(names)], "id long, keyword string, format string, tier int")
    segs = [" ".join(rng.sample(stems, rng.randrange(1, 5))) + rng.choice(["", " x", "9"]) for _ in range(150)]
    parts = spark.createDataFrame([(s,) for s in sorted(set(segs))], "seg string")
    found = detect.matched_segments(parts, words)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")
    table = {r["id"]: r for r in words.selectExpr("id", "tier", "keyword").collect()}
    tokens = {k: set(r["keyword"].split()) for k, r in table.items()}
    for r in found.where("track = 'C'").collect():
        fits = [k for k in table if tokens[k] <= set(r["seg"].split()) or (len(c := table[k]["keyword"].replace(" ", "")) >= 4 and r["seg"].replace(" ", "").startswith(c))]
        assert r["id"] == min(fits, key=lambda k: (table[k]["tier"], k))
