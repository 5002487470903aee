"""The factorisation machine's parts: class counts by pieces, and its margin against the sum over all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.llm import factorisation


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_class_counts(piece, monkeypatch):
    monkeypatch.setattr(factorisation, "PIECE", piece)
    texts = ["", "Ab 1$.\n", "äöü" * 40, " ", "x" * 100 + "\n\n", ""]
    data = "".join(texts).encode()
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = factorisation._counted(np.frombuffer(data, np.uint8), bounds)
    for row, text in zip(got, texts, strict=True):
        b = text.encode()
        want = [sum(65 <= c <= 90 for c in b), sum(97 <= c <= 122 for c in b), sum(48 <= c <= 57 for c in b), sum(c in b"#*$%&|<>@^_=+~{}[]\\/" for c in b), sum(c in b".!?,;:" for c in b), b.count(10), sum(c > 127 for c in b)]
        assert row.tolist() == want


def test_margin_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    n = factorisation.WIDTH + factorisation.STATS
    m = factorisation.Machine(0.3, rng.normal(size=n), rng.normal(size=(n, 3)), np.zeros(factorisation.STATS), np.ones(factorisation.STATS))
    x = np.zeros((4, n))
    for row in x:
        row[rng.choice(n, 12, replace=False)] = rng.normal(size=12)
    want = []
    for row in x:
        at = np.flatnonzero(row)
        pairs = sum(row[i] * row[j] * (m.factors[i] @ m.factors[j]) for k, i in enumerate(at) for j in at[:k])
        want.append(m.bias + row @ m.linear + pairs)
    assert np.allclose(m.margin(x), want)


def test_a_long_text_in_little_memory():
    import tracemalloc

    data = np.frombuffer(b"some words, And 7 more.\n" * 400_000, np.uint8)  # ten megabytes
    tracemalloc.start()
    factorisation._counted(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
