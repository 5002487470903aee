"""Columns with the names that operators use inside, ties, and blocks of a test set with repeated rows."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pytest

from tessera.llm import decontaminate, factorisation, language, line_dedup, mixing, quality_rules, simhash

SOURCES = Path(mixing.__file__).parent
#: Every name that appears in quotes in the operators, and their usual variants.
NAMES = sorted({n for p in SOURCES.glob("*.py") for n in re.findall(r"[\"'`]([A-Za-z_][A-Za-z0-9_]{0,20})[\"'`]", p.read_text())} | {"_h0", "rows", "_id", "_row", "last", "whole", "bucket", "picks"})
TEXT = "the first of these sentences has nine plain words . " * 8
ROWS = [(k, f"{k} {TEXT if k % 2 else TEXT.upper()} {k * k}", "en" if k % 3 else None, "s") for k in range(8)]


def whole_rows(df, names):
    return sorted(tuple(repr(r[n]) for n in names) for r in df.collect())


KEEPERS = {
    "drop_contaminated": (lambda d, i: decontaminate.drop_contaminated(d, i), ()),
    "drop_near_duplicates": (lambda d, i: simhash.drop_near_duplicates(d), ()),
    "keep_good": (lambda d, i: quality_rules.keep_good(d, None), ()),
    "mix": (lambda d, i: mixing.mix(d), ()),
    "line_dedup": (lambda d, i: line_dedup.without_repeats(d), line_dedup.RESULTS),
    "contamination": (lambda d, i: decontaminate.contamination(d, i), ("n_words", "hits", "items", "n_hit", "n_items", "items_sha256", "contaminated")),
    "language": (lambda d, i: language.predicted(d, None), ("lang_pred", "score")),
    "rules": (lambda d, i: quality_rules.judged(d, None), ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")),
    "machine": (lambda d, i: factorisation.scored(d, None), ("score", "predicted")),
}


@pytest.mark.parametrize("name", sorted(KEEPERS))
def test_clashing_columns_keep_their_values(name, spark):
    run, results = KEEPERS[name]
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    items = spark.createDataFrame([(1, "nothing of this stands in any of them")], "item_id long, text string")
    extra = [n for n in NAMES if n.lower() not in {"doc_id", "text", "lang", "source", *results}]
    extra = list({n.lower(): n for n in extra}.values())
    wide = plain.selectExpr("*", *(f"doc_id * 1000 + {k} AS `{n}`" for k, n in enumerate(extra)))
    got = run(wide, items)
    kept = run(plain, items)
    own = [c for c in kept.columns]
    assert whole_rows(got, own) == whole_rows(kept, own)
    for r in got.collect():
        assert [r[n] for n in extra] == [r["doc_id"] * 1000 + k for k, n in enumerate(extra)]


def test_mixing_takes_as_many_equal_rows_as_fit(spark):
    rows = [(1, "four words in this", "a")] * 1000 + [(2, "two words", "b")] * 10
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mixed(df).collect()
    for source in ("a", "b"):
        own = [r for r in out if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= own[0]["size"]
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    mix = mixing.mix(df).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in mix} == {s: sum(r["picks"] for r in out if r["source"] == s) for s in ("a", "b")}


def test_repeated_test_rows_make_no_large_block(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(words))] * 500 + [(k, " ".join(words[k : k + 60])) for k in range(300)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    blocks = decontaminate.query_blocks(spark, items, block_words=1024)
    assert len(blocks) > 5
    assert max((b.value.words > 0).sum() for b in blocks) <= 1024
    docs = spark.createDataFrame([(1, "x " + " ".join(words[30:60]) + " y")], "doc_id long, text string")
    one, many = (decontaminate.contamination(docs, items, block_words=b).first() for b in (1 << 20, 1024))
    assert (one["n_hit"], one["n_items"], one["items_sha256"]) == (many["n_hit"], many["n_items"], many["items_sha256"])
    assert one["n_hit"] == 30


def test_matches_of_hashes_alone_do_not_count(monkeypatch):
    monkeypatch.setattr(decontaminate, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) + np.uint64(1))
    import pyarrow as pa

    item = "a bb ccc dd e ff ggg hh i jj kkk ll m"
    block = decontaminate.QueryBlock.of([item, item.replace("a bb", "x yy")], ["1", "2"])
    found = list(decontaminate.scan(pa.array([f"zz {item} zz", item.replace("ggg", "xyz"), ""]), block))
    assert [(n, spans, sorted(items)) for n, spans, items in found] == [(15, [(1, 14)], ["1"]), (13, [], []), (0, [], [])]
