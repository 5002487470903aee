"""Planted passages that op5 must remove wherever they stand."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import line_dedup


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(n)) + "."


def planted():
    """(passage, texts with it among others' sentences): 50 to 80 words in 1 to 7 sentences, in lines or in one long line."""
    rng = random.Random(3)
    out = []
    for n in range(1, 8):
        for words in (50, 65, 80):
            for mark in (" ", "\n"):
                sizes = [words // n + (k < words % n) for k in range(n)]
                passage = mark.join(sentence(rng, k) for k in sizes)
                around = lambda: mark.join(sentence(rng, rng.randint(4, 15)) for _ in range(rng.randint(1, 6)))
                out.append((passage, [mark.join([around(), passage, around()]) for _ in range(3)]))
    chinese = lambda n: "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(n))
    passage = "。".join(chinese(30) for _ in range(4)) + "。"
    out.append((passage, [f"{chinese(20)}。{passage}{chinese(25)}。" for _ in range(3)]))
    return out


@pytest.mark.parametrize("bits", [1 << 26, 1 << 6])
def test_planted_passages_go_whole(spark, monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "FILTER_BITS", bits)  # of 64 bits all are set: every text passes
    cases = planted()
    texts = [t for _, ts in cases for t in ts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in line_dedup.without_repeats(df).collect()}
    for k, (passage, ts) in enumerate(cases):
        for j, t in enumerate(ts):
            r = got[3 * k + j]
            want = t if j == 0 else t.replace(passage, "")
            assert r["text"].split() == want.split(), (k, j)
            assert r["cut_bytes"] == len(t.encode()) - len(r["text"].encode()) and r["n_passages"] == (j > 0)


def plain_lines(text):
    """Lines as the operator sees them, by a pattern: (words, line)."""
    found = [x.strip(" \t\n\r\x0b\x0c") for x in re.split(r"(?<=\n)|(?<=[.!?] )|(?<=[。！？।])", text)]
    wide = lambda x: len(re.findall("[\u3000-\u9fff\u0e00-\u0e7f]", x)) // 2
    return [(len(x.split()) + wide(x), x) for x in found if x]


def long_runs(lines, least):
    """The shortest runs of lines of at least `least` words."""
    for a in range(len(lines)):
        words = 0
        for b in range(a, len(lines)):
            words += lines[b][0]
            if words >= least:
                yield tuple(x for _, x in lines[a : b + 1])
                break


def test_no_long_passage_is_left_twice_and_none_is_lost(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in line_dedup.without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).collect()}
    assert sorted(got) == sorted(docs)
    runs = Counter(r for g in got.values() for r in set(long_runs(plain_lines(g["text"] or ""), 60)))
    assert max(runs.values()) == 1
    before = Counter(r for t in docs.values() for r in set(long_runs(plain_lines(t), 60)))
    assert max(before.values()) > 1
    seen, cut_docs = set(), 0
    for k in sorted(docs):
        left = Counter(x for _, x in plain_lines(got[k]["text"] or ""))
        own = Counter(x for _, x in plain_lines(docs[k]))
        gone = own - left
        assert not left - own
        assert all(x in seen or left[x] for x in gone)  # a line that goes stands in an earlier text, or still in this one
        assert bool(gone) == (got[k]["n_passages"] > 0)
        cut_docs += bool(gone)
        if not gone:
            assert (got[k]["text"] or "") == docs[k]
        seen |= set(own)
    assert cut_docs > 5


def test_lines_of_one_hash_and_different_bytes_stay(spark, monkeypatch):
    rows = [(1, b"a"), (1, b"a"), (2, b"b"), (2, b"c"), (2, b"c"), (3, b"d")]
    batches = [pa.RecordBatch.from_arrays([pa.array([h for h, _ in part], pa.int64()), pa.array([b for _, b in part], pa.binary())], ["hash", "body"]) for part in (rows[:3], [], rows[3:])]
    assert [h for b in line_dedup._differing(iter(batches)) for h in b.column(0).to_pylist()] == [2]
    passage, (text, *_) = planted()[10]
    data = np.frombuffer(text.encode(), np.uint8)
    lines = line_dedup.Lines.of(data, np.array([0, len(data)]))
    n = len(lines.starts)
    cuts = pa.array([[{"first": 0, "end": n, "span": True}]], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("span", pa.bool_())])))
    whole, counts = line_dedup._cleaned(data, np.array([0, len(data)]), cuts, np.zeros(0, np.int64), 1)
    assert whole == [b""] and counts.tolist() == [[1, 1, len(data)]]
    left, _ = line_dedup._cleaned(data, np.array([0, len(data)]), cuts, lines.hashes.view(np.int64)[1:2], 1)
    assert left == [data.tobytes()[lines.starts[1] : lines.ends[1]]]


def test_a_passage_of_copied_texts_goes_whole(spark):
    """The first text with a passage has copies, so all its stretches repeat, not only those of the passage."""
    rng = random.Random(8)
    rows, passages = [], []
    for n in range(30):
        passage = " ".join(sentence(rng, rng.randint(6, 12)) for _ in range(7))
        around = lambda: " ".join(sentence(rng, rng.randint(4, 15)) for _ in range(8))
        copied = " ".join([around(), passage, around()])
        passages.append(passage)
        rows += [(10 * n, copied), (10 * n + 1, copied), (10 * n + 2, " ".join([around(), passage, around()]))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for (k, text), passage in zip(rows, [p for p in passages for _ in range(3)], strict=True):
        want = (text, "", text.replace(passage, ""))[k % 10]
        assert got[k].split() == want.split(), k
