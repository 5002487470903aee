"""String similarities without a built-in form, as pandas UDFs over Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    return _matched(_places(a), len(a), b)


def _places(a: str) -> dict[str, int]:
    """The places of each letter, as bits."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    return at


def _matched(at: dict[str, int], n: int, b: str) -> int:
    """_common of a text of n letters, given by their places, and b."""
    full = (1 << n) - 1
    row = full
    for ch in b:
        both = row & at.get(ch, 0)
        row = ((row + both) | (row - both)) & full
    return n - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 times twice the common subsequence over both lengths; 100 for two empty texts."""
    return 200 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def _partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with any stretch of its length in the longer, cut off at the ends.

    A stretch whose last letter the shorter text lacks is no better than the one that begins a letter earlier.
    """
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n, at, best = len(short), _places(short), 0.0
    for i in range(1 - n, len(long)):
        part = long[max(0, i) : i + n]
        if 200 * len(part) / (n + len(part)) > best and (i + n > len(long) or part[-1] in at):
            best = max(best, 200 * _matched(at, n, part) / (n + len(part)))
    return best


def _token_ratios(a: str, b: str, score) -> float:
    wa, wb = a.split(), b.split()
    by_order = score(" ".join(sorted(wa)), " ".join(sorted(wb)))
    both, only_a, only_b = (sorted(s) for s in (set(wa) & set(wb), set(wa) - set(wb), set(wb) - set(wa)))
    if not wa or not wb:
        return 0.0
    if score is _partial:
        return 100.0 if both else max(by_order, _partial(" ".join(only_a), " ".join(only_b)))
    if both and (not only_a or not only_b):
        return 100.0
    shared = " ".join(both)
    x, y = (" ".join(filter(None, (shared, " ".join(rest)))) for rest in (only_a, only_b))
    return max(by_order, score(x, y), score(shared, x) if both else 0.0, score(shared, y) if both else 0.0)


def weighted_ratio(a: str, b: str) -> float:
    """The weighted ratio of public fuzzy-matching libraries: plain and token ratios for texts of like length, partial
    ones, at .9 or .6, where one is much longer. Case counts."""
    if not a or not b:
        return 0.0
    scale = max(len(a), len(b)) / min(len(a), len(b))
    plain = indel_ratio(a, b)
    if scale < 1.5:
        return max(plain, 0.95 * _token_ratios(a, b, indel_ratio))
    weight = 0.9 if scale <= 8 else 0.6
    return max(plain, weight * _partial(a, b), 0.95 * weight * _token_ratios(a, b, _partial))


@F.pandas_udf(T.DoubleType())
def wratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])
