"""The encoder and the chunker by units and slices, against the tokenizer and a chunker of one id at a time."""

import random

import numpy as np
import pyarrow as pa

from tessera.llm import token_store
from tessera.llm.queries import tokenizer_path
from tessera.llm.textblocks import slices, text_buffer

PARTS = [" ", " ", " ", "\n", "\t", "\r\n", "a", "b", "Ze", "é", "ñ", "×", "÷", ".", ",", "'", "'s", "'ll", "$", "12", "7", " ", "　", " ", "—", "’", "漢", "字", "。", "\0", "\x1c", "\x85", "\x0b", "<|endoftext|>", "|", ">", "don't", "_", "🙂", "а", "x" * 20]


def encoded(encoder, texts, most=1 << 20):
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    out = []
    for a, b in slices(offsets, most):
        ids, at = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        out += [ids[x:y].tolist() for x, y in zip(at, at[1:], strict=False)]
    return out


def test_encoder_equals_tokenizer(monkeypatch):
    rng = random.Random(5)
    encoder = token_store.Encoder(tokenizer_path())
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(4000)] + ["", " ", "\n", "x" * 5000 + " y"]
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert encoded(encoder, texts) == want
    assert encoded(encoder, texts, 100) == want
    # a worker that forgets its units at every step, and looks up few at once
    monkeypatch.setattr(token_store, "REMEMBERED", 50)
    monkeypatch.setattr(token_store, "_UNITS", 64)
    assert encoded(encoder, texts) == want


def test_chunk_ends_equal_a_plain_chunker(monkeypatch):
    def rolling(ids, x):
        h = 0
        for k in range(token_store.SPAN):
            m = (int(ids[x - token_store.SPAN + k]) + 1) * 0xD6E8FEB86659FD93 % 2**64
            m ^= m >> 32
            h = (h + m * pow(0x9E3779B97F4A7C15, k, 2**64)) % 2**64
        h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 % 2**64 >> 40
        return h % token_store.MEAN == 0

    def plain(ids):
        ends, last = [], 0
        for x in range(1, len(ids) + 1):
            if x == len(ids) or x - last == token_store.MOST or (x - last >= token_store.LEAST and len(ids) > token_store.LEAST and x >= token_store.SPAN and rolling(ids, x)):
                ends.append(x)
                last = x
        return ends

    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 50_000, n).astype("<u2") for n in (0, 1, 100, 128, 129, 3000, 9000)] + [np.full(5000, 7, "<u2")]
    bounds = np.append(0, np.cumsum([len(d) for d in docs]))
    for block in (token_store._BLOCK, 1000):
        monkeypatch.setattr(token_store, "_BLOCK", block)
        ends, counts = token_store.chunk_ends(np.concatenate(docs), bounds)
        own = [(x - bounds[k]).tolist() for k, x in enumerate(np.split(ends, np.cumsum(counts)[:-1]))]
        assert own == [plain(d) for d in docs]
