"""The line model learns from all lines of its texts."""

from __future__ import annotations

import numpy as np

from tessera.llm import quality_rules

CLEAN = "The river runs past the old mill and under the bridge to the sea."
JUNK = b"### $$$ BUY NOW!! CLICK HERE!! $$$ ###"


def clean(k, n):
    return "\n".join(f"{CLEAN[:-1]} {'abcdefghij'[(k + i) % 10] * 3}." for i in range(n)).encode()


def test_junk_after_many_clean_lines_is_learnt():
    good = [clean(k, 30) for k in range(20)]
    bad = [clean(k, 30) + b"\n" + b"\n".join([JUNK] * 10) for k in range(20)]
    model = quality_rules.train(good + bad, [1] * 20 + [0] * 20)
    scores = model.emit[quality_rules.line_features(JUNK)[0]].sum(axis=1)[0]
    assert scores[0] > scores[1] + 1
    assert not model.decode(quality_rules.line_features(b"\n".join([JUNK] * 5))[0]).any()
    assert model.decode(quality_rules.line_features(good[0])[0]).all()


def test_pieces_take_part(monkeypatch):
    texts, labels = [clean(1, 40), clean(2, 3) + b"\n" + JUNK, clean(3, 41)], [1, 0, 1]
    whole = quality_rules.train(texts, labels)
    monkeypatch.setattr(quality_rules, "_BLOCK", 10)
    assert np.allclose(whole.emit, quality_rules.train(texts, labels).emit, atol=1e-6)
