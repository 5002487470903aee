"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator that takes documents."""

from __future__ import annotations

import pytest

from tessera.llm import decontaminate, factorisation, language, licenses, line_dedup, mixing, quality_rules, simhash, token_store
from tessera.llm.queries import tokenizer_path

LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 4000
ROWS = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "", "en", "s", 0), (3, LONG, "en", "t", 9), (4, " \n\t", "de", None, 3), (5, "A B C", "en", "s", 5)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own results.
CLASH = ("fp", "score", "kept", "n_words", "items", "n_chunks", "taken", "start", "root", "size")


def items(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen"), (2, None), (3, ""), (None, "b"), (1, "a")], "item_id long, text string")


OPERATORS = {
    "contamination": (lambda d, s: decontaminate.contamination(d, items(s)), True),
    "drop_contaminated": (lambda d, s: decontaminate.drop_contaminated(d, items(s)), False),
    "blocks": (lambda d, s: decontaminate.contamination(d, items(s), block_words=16), True),
    "store": (lambda d, s: token_store.stored(d, tokenizer_path()), True),
    "licenses": (lambda d, s: licenses.scan(d), False),
    "near_duplicates": (lambda d, s: simhash.near_duplicates(d), True),
    "drop_near_duplicates": (lambda d, s: simhash.drop_near_duplicates(d), False),
    "line_dedup": (lambda d, s: line_dedup.without_repeats(d), True),
    "language": (lambda d, s: language.predicted(d, None), True),
    "rules": (lambda d, s: quality_rules.judged(d, None), True),
    "keep_good": (lambda d, s: quality_rules.keep_good(d, None), False),
    "mixed": (lambda d, s: mixing.mixed(d), True),
    "mix": (lambda d, s: mixing.mix(d), False),
    "machine": (lambda d, s: factorisation.scored(d, None), True),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(name, spark):
    run, whole = OPERATORS[name]
    df = spark.createDataFrame(ROWS, SCHEMA)
    n = run(df, spark).count()
    assert n == len(ROWS) if whole else n <= 2 * len(ROWS)
    assert run(df.limit(0), spark).count() == 0
    wide = df.selectExpr("*", *(f"CAST(7 AS BIGINT) AS {c}" for c in CLASH))
    assert run(wide, spark).count() == n


def test_contamination_in_blocks_is_the_same(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    one, many = (sorted(map(tuple, decontaminate.contamination(df, items(spark), block_words=b).select("n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())) for b in (1 << 20, 16))
    assert one == many


def test_one_of_a_group_stays(spark):
    kept = simhash.drop_near_duplicates(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted(r["doc_id"] is not None and r["doc_id"] for r in kept) == [1, 2, 3]
