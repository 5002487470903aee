"""Ratios against plain dynamic programming and hand-counted values."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import fuzzy

_TEXT = st.text("ab cd é", max_size=12)


def common(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(_TEXT, _TEXT)
def test_ratio_counts_the_common_subsequence(a, b):
    assert fuzzy.indel_ratio(a, b) == (200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0)


@settings(max_examples=200, deadline=None)
@given(_TEXT, _TEXT)
def test_weighted_ratio_is_symmetric_and_no_less_than_the_plain_one(a, b):
    got = fuzzy.weighted_ratio(a, b)
    assert abs(got - fuzzy.weighted_ratio(b, a)) < 1e-9 and 0 <= got <= 100
    assert got >= fuzzy.indel_ratio(a, b) or not a or not b


def test_values():
    assert round(fuzzy.indel_ratio("this is a test", "this is a test!"), 4) == 96.5517  # 28 of 29 letters
    assert fuzzy.weighted_ratio("toy story 2", "2 toy story") == 95.0  # the same words: .95 of 100
    assert fuzzy.weighted_ratio("dune", "dune part two of the story") == 90.0  # a part of a text over 1.5 times as long
    assert fuzzy.weighted_ratio("us", "a very long text where it is bus") == 60.0  # over 8 times as long
    assert fuzzy.weighted_ratio("", "x") == fuzzy.weighted_ratio("", "") == 0.0
    assert fuzzy.weighted_ratio("Dune", "dune") == 75.0  # case counts
