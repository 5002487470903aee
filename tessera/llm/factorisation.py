"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.textblocks import slices, span_hashes, text_buffer, word_spans

#: Hash buckets of words.
WIDTH = 1 << 12
#: Training documents, about.
SAMPLE = 2500
RANK = 8

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CLASSES = np.zeros((256, 7), np.int32)  # upper, lower, digit, symbol, sentence mark, line break, not ASCII
_CLASSES[65:91, 0] = _CLASSES[97:123, 1] = _CLASSES[48:58, 2] = 1
_CLASSES[[ord(c) for c in "#*$%&|<>@^_=+~{}[]\\/"], 3] = 1
_CLASSES[[ord(c) for c in ".!?,;:"], 4] = 1
_CLASSES[10, 5] = 1
_CLASSES[128:, 6] = 1
#: Structure statistics: shares of the classes, sizes of text, words and lines, shares of distinct words and pairs.
STATS = 14


def features(data: np.ndarray, bounds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of WIDTH hashed word weights (a unit vector of square roots of counts) and STATS statistics.

    sizes: the metadata, each document's length in bytes as stored.
    """
    n = len(bounds) - 1
    out = np.zeros((n, WIDTH + STATS), np.float32)
    starts, ends, upto = word_spans(data, bounds, _WORD)
    count = np.diff(upto)
    hashes = span_hashes(_FOLD[data], starts, ends)
    doc = np.repeat(np.arange(n), count)
    bucket = (hashes % np.uint64(WIDTH)).astype(np.int64)
    words = np.sqrt(np.bincount(doc * WIDTH + bucket, minlength=n * WIDTH).reshape(n, WIDTH))
    out[:, :WIDTH] = words / np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-9)
    kinds = _counted(data, bounds)
    lengths = np.diff(bounds)
    stats = out[:, WIDTH:]
    stats[:, :7] = kinds / np.maximum(lengths, 1)[:, None]
    stats[:, 7] = np.log1p(sizes) / 10
    stats[:, 8] = np.log1p(count) / 10
    stats[:, 9] = np.minimum(lengths / np.maximum(count, 1), 40) / 10
    stats[:, 10] = np.log1p(count / (kinds[:, 5] + 1)) / 5
    pairs = hashes[1:] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[:-1] if len(hashes) else hashes
    stats[:, 11] = _distinct(hashes, doc, n) / np.maximum(count, 1)
    stats[:, 12] = _distinct(pairs, doc[1:], n) / np.maximum(count, 1)
    stats[:, 13] = count == 0
    return out


#: Bytes of a text whose classes are counted at once.
PIECE = 1 << 20


def _counted(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of class counts for each document, by pieces of its bytes, so that a long one takes no more memory."""
    out = np.zeros((len(bounds) - 1, _CLASSES.shape[1]), np.int64)
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for at in range(a, b, PIECE):
            out[k] += np.bincount(data[at : min(b, at + PIECE)], minlength=256) @ _CLASSES
    return out


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n)


@dataclass
class Machine:
    """Bias, linear weights, factors; statistics are standardised by middle and scale."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    middle: np.ndarray
    scale: np.ndarray

    def standard(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, WIDTH:] = np.clip((x[:, WIDTH:] - self.middle) / self.scale, -4, 4) / 4
        return x

    def margin(self, x: np.ndarray) -> np.ndarray:
        """All pairs in linear time: half of the squared sum less the sum of squares, in each factor."""
        return self.bias + x @ self.linear + 0.5 * ((x @ self.factors) ** 2 - (x * x) @ (self.factors**2)).sum(axis=1)


def train(texts: list[str], labels: list[int], epochs: int = 12, batch: int = 128, seed: int = 3) -> Machine | None:
    """A machine by Adam on the logistic loss; None without rows of both labels."""
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return None
    x = np.concatenate([f for f in _blocks(*text_buffer(pa.array(texts, pa.string())))])
    middle, scale = x[:, WIDTH:].mean(axis=0), x[:, WIDTH:].std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    m = Machine(float(np.log(y.mean() / (1 - y.mean()))), np.zeros(WIDTH + STATS, np.float32), rng.normal(0, 0.02, (WIDTH + STATS, RANK)).astype(np.float32), middle, scale)
    x = m.standard(x)
    params = [np.float32(m.bias).reshape(1), m.linear, m.factors]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            step += 1
            rows, want = x[order[k : k + batch]], y[order[k : k + batch]]
            sums = rows @ params[2]
            squares = rows * rows
            z = params[0][0] + rows @ params[1] + 0.5 * (sums**2 - squares @ (params[2] ** 2)).sum(axis=1)
            gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - want) / len(rows)
            grads = [gap.sum().reshape(1), gap @ rows + 1e-4 * params[1], rows.T @ (gap[:, None] * sums) - (gap @ squares)[:, None] * params[2] + 1e-4 * params[2]]
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = (params[i] - 0.02 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    m.bias, m.linear, m.factors = float(params[0][0]), params[1], params[2]
    return m


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    sizes = np.diff(offsets)
    for a, b in slices(offsets, 1 << 18):
        for c in range(a, b, 64):
            d = min(b, c + 64)
            yield features(data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c], sizes[c:d])


def scored(docs: DataFrame, machine: Machine | None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without the text, with score (0 to 1: how likely label 1 is) and predicted (1 from threshold on).

    Null texts are scored as empty ones, long ones whole. Without a machine every score is 0.5. Columns named score or
    predicted are replaced by the results, all others are kept; nothing but the text and its length is an input.
    """
    rest = [f for f in docs.schema.fields if f.name not in (text, "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            if machine:
                found = [np.zeros(0), *(1 / (1 + np.exp(-np.clip(machine.margin(machine.standard(x)), -30, 30))) for x in _blocks(*text_buffer(batch.column(at(text)))))]
                score = np.concatenate(found).astype(float)
            else:
                score = np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(at(f.name)) for f in rest), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*(f.name for f in rest), "score", "predicted"])

    schema = T.StructType([*rest, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*(f"`{f.name}`" for f in rest), f"`{text}`").mapInArrow(run, schema)
