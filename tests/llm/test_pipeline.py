"""The pipeline from end to end, each stage held against a plain version on its own input."""

from __future__ import annotations

import os
import re
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from tessera.llm import quality_rules, queries, scratch, simhash

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def plain_contaminated(text, windows):
    words = WORD.findall(lower(text))
    hit = set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(words)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"test-stage-{k}")
        out.append(docs.collect())
    return out


def test_columns_stay(stages):
    for rows in stages[1:5]:
        assert rows and rows[0].__fields__ == stages[0][0].__fields__
        assert {tuple(r) for r in rows} <= {tuple(r) for r in stages[0]}


def test_quality(stages, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = queries.line_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = []
    for r in stages[0]:
        text = (r["text"] or "").encode()
        n, *_, repeated = quality_rules.base_counts(text)
        if n >= 50 and 100 * repeated <= 50 * n:
            features, sizes = quality_rules.line_features(text)
            if sizes[model.decode(features) == 1].sum() >= 0.5 * sizes.sum():
                kept.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[1]) == sorted(kept)


def test_near_dedup(stages):
    rows = sorted(stages[1], key=lambda r: r["doc_id"])
    prints = [int(x) & (2**64 - 1) for x in simhash.shingle_fingerprints([(r["text"] or "").encode() for r in rows])]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(r["doc_id"] for r in stages[2]) == sorted({rows[find(i)]["doc_id"] for i in range(len(rows))})


def test_decontamination(stages, spark, sf_dir):
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = WORD.findall(lower(r["text"] or ""))
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    want = sorted(r["doc_id"] for r in stages[2] if not plain_contaminated(r["text"] or "", windows))
    assert sorted(r["doc_id"] for r in stages[3]) == want


def test_mix_and_tokens(stages):
    size = lambda r: len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))
    before, after = Counter(), Counter()
    for r in stages[3]:
        before[r["source"]] += size(r)
    for r in stages[4]:
        after[r["source"]] += size(r)
    assert max(Counter(r["doc_id"] for r in stages[4]).values()) <= 2
    assert 0 < sum(after.values()) <= 1.5 * sum(before.values()) + max(map(size, stages[3]))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    mix = sorted(stages[4], key=lambda r: r["doc_id"])
    want, start = [], 0
    for r in mix:
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        want.append((r["doc_id"], start, n))
        start += n
    assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in stages[5]) == sorted(want)


def test_run_leaves_only_its_result(spark, sf_dir, stages):
    root = Path(scratch.scratch_root(spark).removeprefix("file:")) / "tessera"
    before = set(os.listdir(root))
    out = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, stages[5]))
    assert len(set(os.listdir(root)) - before) == 1


def test_run_on_no_and_on_odd_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema))
    for name, rows in (("none", docs.limit(0)), ("odd", odd.unionByName(docs).unionByName(docs.limit(3)))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        for other in ("labels", "benchmark"):
            (tmp_path / name / f"{other}.parquet").symlink_to(f"{sf_dir}/{other}.parquet")
        n = corpus_pipeline.run(spark, str(tmp_path / name)).count()
        assert n == 0 if name == "none" else n > 0
