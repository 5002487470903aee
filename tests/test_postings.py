"""Row lists in pieces, a second search by title, and pages with entities and nested tags."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from tessera.operators import postings, verdicts, web


def test_one_key_of_a_hundred_thousand_rows(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 50 == 1, F.col("id") % 7).when(F.col("id") % 50 == 2, F.lit(None)).otherwise(-1).alias("k"), "id")
    pieces = postings.posted(rows.unionByName(rows.limit(10)), F.col("k"), F.col("id"), size=500).cache()
    assert pieces.agg(F.max(F.size("rows"))).first()[0] <= 500
    got = defaultdict(list)
    for r in pieces.collect():
        got[r["key"]] += r["rows"]
    want = defaultdict(list)
    for r in rows.collect():
        want[r["k"]].append(r["id"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    answers = spark.createDataFrame([(-1, "many"), (3, "three"), (None, "none")], "key long, answer string")
    out = postings.answered(pieces, answers)
    assert out.count() == 100_000 and out.where("answer = 'many'").count() == len(want[-1]) and out.where("key is null and answer = 'none'").count() == 2000
    assert postings.posted(rows.limit(0), F.col("k"), F.col("id")).count() == 0


CATALOG = [
    (1, "Creatures", "Criaturas", "Brazil"), (2, "Pequenas Criaturas", "Little Creatures", "Brazil"), (3, "Shrek 25th Anniversary", "Shrek 25th Anniversary", "Peru"), (4, "Shrek", "Shrek", "Peru"),
    (5, "The Odyssey", "The Odyssey", "Chile"), (6, "Saga Part 2", "Saga Part 2", "Chile"), (7, "Saga Part 5", "Saga Part 5", "Chile"), (8, "The Odyssey", "The Odyssey", None),
]


def test_second_search(spark):
    results = [
        # query_id, movie_id, title, confidence, decision, reasoning, ordinal, country, international
        (1, 0, "Tiny Beasts", 0.4, "REVIEW", "r", None, "Brazil", True),  # found by its other name, in the master title
        (2, 0, "Shrek", 0.5, "REVIEW_NON_MOVIE", "r", None, "Peru", True),  # the re-release comes first, the event stays
        (3, 0, "The Odyssey (L'Odyssée)", 0.95, "AUTO_ACCEPT", "r", None, None, False),  # domestic: to review
        (4, 0, "Saga", 0.5, "REVIEW", "r", 5, "Chile", True),  # installment 2 is shorter by id but conflicts
        (5, 0, "Saga", 0.5, "REVIEW", "r", 7, "Chile", True),  # every hit conflicts
        (6, 0, "Unknown", 0.1, "REVIEW", "r", None, "Chile", True),
        (7, 9, "Shrek", 0.9, "AUTO_ACCEPT", "r", None, "Peru", True),
        (8, 0, "Shrek", 0.5, "REVIEW", None, None, "Chile", True),  # of another country
    ]
    tries = [(1, 2, "Tiny Beasts"), (1, 3, "Little Creatures"), (2, 1, "Shrek 25th Anniversary"), (2, 2, "Shrek"), (3, 2, "The Odyssey (L'Odyssée)"), (4, 2, "Saga"), (5, 2, "Saga"), (6, 2, "Saga"), (7, 2, "Shrek"), (8, 2, "Shrek"), (8, 3, None)]
    r = spark.createDataFrame(results, "query_id long, movie_id long, title string, confidence double, decision string, reasoning string, ordinal int, country string, international boolean")
    out = {x["query_id"]: x for x in verdicts.searched_again(r, spark.createDataFrame(tries, "query_id long, rank int, title string"), spark.createDataFrame(CATALOG, "id long, title string, master_title string, country string")).collect()}
    short = {k: (x["movie_id"], x["title"], x["confidence"], x["decision"], x["looked_up"]) for k, x in out.items()}
    assert short == {
        1: (2, "Pequenas Criaturas", 0.9, "AUTO_ACCEPT", True), 2: (3, "Shrek 25th Anniversary", 0.9, "REVIEW_NON_MOVIE", True), 3: (5, "The Odyssey", 0.75, "REVIEW", True), 4: (7, "Saga Part 5", 0.9, "AUTO_ACCEPT", True),
        5: (0, "Saga", 0.5, "REVIEW", False), 6: (0, "Unknown", 0.1, "REVIEW", False), 7: (9, "Shrek", 0.9, "AUTO_ACCEPT", False), 8: (0, "Shrek", 0.5, "REVIEW", False),
    }
    assert out[1]["canonical_id"] == 2 and out[1]["reasoning"].endswith("Before: r") and "accepted" in out[1]["reasoning"] and "REVIEW_NON_MOVIE" in out[2]["reasoning"]
    assert out[5]["reasoning"] == "r" and out[8]["reasoning"] is None and out[5]["canonical_id"] is None


def test_pages(spark):
    pages = [
        "<title>One</title><TITLE> Two &amp; <b>more</b> </TITLE><title> </title><h1> </h1><h1>Caf&eacute; <i>noir</i> &#233;</h1><h1>Other</h1><meta property='OG:Image' content='http://x/a.png?b=1&amp;c=2'>",
        "<h1>Open <b>heading", None, "", "<meta property=og:image content=''>", "x" * 60_000 + "<title>late</title>", "<h1><title>in it</title>rest</h1>",
    ]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, html string").withColumn("p", web.parts(F.col("html")))
    got = {r["k"]: (r["og_image"], r["title"], r["heading"], r["o"]) for r in df.select("k", "p.*", web.outcome(F.col("p")).alias("o")).collect()}
    assert got == {
        0: ("http://x/a.png?b=1&c=2", "Two & more", "Café noir é", "SUCCESS"), 1: (None, None, None, "FAILED_T1"), 2: (None, None, None, "FAILED_T1"), 3: (None, None, None, "FAILED_T1"),
        4: ("", None, None, "FAILED_T1"), 5: (None, None, None, "FAILED_T1"), 6: (None, "in it", "rest", "SUCCESS"),
    }
