"""Quality rules: word and line counts, and a linear-chain conditional random field that tells content from boilerplate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_SYMBOLS = b"#*$%&|<>"
_NOT_IN_WORDS = b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))  # white space, and all but the first byte of a character
_LOWER, _UPPER = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS, _ENDS = b"0123456789", b".!?:;\"'"

#: Buckets of each line feature; a line has one bucket of each.
SIZES = (6, 5, 5, 3, 2, 4, 4, 4)
_OFFSETS = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
_WIDTH = sum(SIZES)


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; words stand between ASCII white space."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _NOT_IN_WORDS))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(triples)) < len(triples):
        hit = bytearray(n)
        seen: dict[tuple[bytes, bytes, bytes], int] = {}
        for i, t in enumerate(triples):
            j = seen.setdefault(t, i)
            if j != i:
                hit[i] = hit[i + 1] = hit[i + 2] = 1
                hit[j] = hit[j + 1] = hit[j + 2] = 1
        repeated = sum(hit)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each line with a word, the bucket of each feature and its number of bytes."""
    rows, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        bare = size - line.count(b" ")
        lower, upper = (size - len(line.translate(None, x)) for x in (_LOWER, _UPPER))
        symbols, digits = (size - len(line.translate(None, x)) for x in (_SYMBOLS, _DIGITS))
        bangs = line.count(b"!!")
        rows.append((
            (n > 1) + (n > 3) + (n > 8) + (n > 20) + (n > 60),
            (symbols > 0) + (50 * symbols > bare) + (20 * symbols > bare) + (8 * symbols > bare),
            (upper > 0) + (10 * upper > lower) + (3 * upper > lower) + (upper > lower),
            1 + (line[-1:] in _ENDS and line[-2:] != b"!!") if bangs == 0 else 0,
            line in seen,
            (digits > 0) + (10 * digits > bare) + (3 * digits > bare),
            (bangs > 0) + (5 * bangs > n) + (2 * bangs > n),
            (len(set(words)) < n) + (20 * len(set(words)) < 13 * n) + (5 * len(set(words)) < 2 * n),
        ))
        sizes.append(size)
        seen.add(line)
    return np.array(rows, np.int64).reshape(-1, len(SIZES)) + _OFFSETS, np.array(sizes, np.int64)


@dataclass(frozen=True)
class LineModel:
    """Weights of a two-state chain, state 1 content: emit by feature bucket, move between lines, start of a text."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi: the likeliest states of a text's lines."""
        scores = self.emit[features].sum(axis=1)
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = (scores[0] + self.start).tolist()
        back = []
        for x, y in scores[1:].tolist():
            back.append((a + m00 < b + m10, a + m01 < b + m11))
            a, b = max(a + m00, b + m10) + x, max(a + m01, b + m11) + y
        path = [int(a < b)]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return np.array(path[::-1])


#: Lines of a piece of a training text, and lines whose gradients are computed at once.
_PIECE, _BLOCK = 256, 1 << 16


def _blocks(sizes: np.ndarray) -> list[np.ndarray]:
    """Places of pieces of like size, so that padding stays small, in blocks of about _BLOCK lines."""
    out, block = [], []
    for i in np.argsort(sizes, kind="stable").tolist():
        if block and (len(block) + 1) * sizes[i] > _BLOCK:
            out.append(np.array(block))
            block = []
        block.append(i)
    return [*out, np.array(block)] if block else out


def _gradient(params: list[np.ndarray], features: np.ndarray, mask: np.ndarray, states: np.ndarray, w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of emit, move and start by forward-backward over a block of pieces at once.

    features (pieces, lines, len(SIZES)), mask and states (pieces, lines), w and first, whether a text starts, (pieces).
    """
    d, length = mask.shape
    emit, move, start = params
    gold = np.eye(2)[states] * mask[..., None]
    scores = emit[features].sum(axis=2)
    forward = np.zeros((length, d, 2))
    forward[0] = scores[:, 0] + start * first[:, None]
    for t in range(1, length):
        new = np.logaddexp(forward[t - 1][:, 0, None] + move[0], forward[t - 1][:, 1, None] + move[1]) + scores[:, t]
        forward[t] = np.where(mask[:, t, None], new, forward[t - 1])
    total = np.logaddexp(forward[-1][:, 0], forward[-1][:, 1])
    backward = np.zeros((length, d, 2))
    pair = np.zeros((2, 2))
    for t in range(length - 1, 0, -1):
        ahead = scores[:, t] + backward[t]
        both = forward[t - 1][:, :, None] + move + ahead[:, None, :] - total[:, None, None]
        use = mask[:, t]
        seen = gold[:, t - 1][:, :, None] * gold[:, t][:, None, :]
        pair += ((seen - np.exp(both)) * (w * use)[:, None, None]).sum(axis=0)
        new = np.logaddexp(move[:, 0] + ahead[:, 0, None], move[:, 1] + ahead[:, 1, None])
        backward[t - 1] = np.where(use[:, None], new, backward[t])
    # a piece's last line keeps a zero backward score: pads only copy it
    odds = np.exp(forward + backward - total[None, :, None]).transpose(1, 0, 2) * mask[..., None]
    gap = (gold - odds) * w[:, None, None]
    by_bucket = np.zeros((_WIDTH, 2))
    for k in range(features.shape[2]):
        for s in (0, 1):
            by_bucket[:, s] += np.bincount(features[:, :, k].ravel(), gap[:, :, s].ravel(), _WIDTH)
    return by_bucket, pair, (gap[:, 0] * first[:, None]).sum(axis=0)


def _fit(texts: list[np.ndarray], states: list[np.ndarray], weights: np.ndarray, steps: int, l2: float) -> LineModel:
    """Penalised maximum likelihood by Adam, over all lines of all texts.

    texts: the features (lines, len(SIZES)) of each, states (lines) of each, weights (texts). Texts of over _PIECE lines
    go as consecutive pieces that all take part.
    """
    pieces = [(i, a) for i, x in enumerate(texts) for a in range(0, len(x), _PIECE)]
    sizes = np.array([min(_PIECE, len(texts[i]) - a) for i, a in pieces])
    w = weights / weights.sum()
    blocks = []
    for at in _blocks(sizes):
        length = sizes[at].max()
        features, mask, gold = np.zeros((len(at), length, len(SIZES)), np.uint8), np.zeros((len(at), length), bool), np.zeros((len(at), length), np.uint8)
        for j, (i, a) in enumerate(pieces[k] for k in at):
            n = min(_PIECE, len(texts[i]) - a)
            features[j, :n], mask[j, :n], gold[j, :n] = texts[i][a : a + n], True, states[i][a : a + n]
        blocks.append((features, mask, gold, np.array([w[pieces[k][0]] for k in at]), np.array([pieces[k][1] == 0 for k in at])))
    params = [np.zeros((_WIDTH, 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        gradients = [-l2 * p for p in params]
        for block in blocks:
            gradients = [g + x for g, x in zip(gradients, _gradient(params, *block), strict=True)]
        for i, g in enumerate(gradients):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] + 0.1 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return LineModel(*params)


def train(texts: list[bytes], good: list[int], steps: int = 50, rounds: int = 2) -> LineModel | None:
    """A model from all lines of texts labelled 1 (good) or 0; None if a class is missing.

    Lines of good texts are content. Lines of others start as boilerplate and are decoded anew in each later round,
    so that clean lines of a mixed text become content.
    """
    found = [(line_features(t)[0].astype(np.uint8), int(y)) for t, y in zip(texts, good, strict=True)]
    found = [(x, y) for x, y in found if len(x)]
    labels = np.array([y for _, y in found])
    if len(set(labels.tolist())) < 2:
        return None
    features = [x for x, _ in found]
    weights = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    states = [np.full(len(x), y) for x, y in found]
    model = None
    for _ in range(rounds):
        if model:
            for i in np.flatnonzero(labels == 0):
                path = model.decode(features[i])
                states[i] = path if (path == 0).any() else np.zeros_like(path)
        model = _fit(features, states, weights, steps, 1e-3)
    return model


def _rules(model: LineModel | None, least_share: float):
    def judge(text: bytes) -> tuple:
        n, chars, symbols, dup, repeated = base_counts(text)
        failed = n < 50 or 100 * repeated > 50 * n
        share = None
        if n and model:
            features, sizes = line_features(text)
            share = float(sizes[model.decode(features) == 1].sum() / sizes.sum())
        return n, chars, symbols, dup, repeated, failed, not failed and (share is None or share >= least_share), share

    return judge


_OUT = T.StructType([
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType()),
])

_TYPES = (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64())


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return (x.as_py() or b"" for x in column)


def judged(docs: DataFrame, model: LineModel | None, text: str = "text", least_share: float = 0.5) -> DataFrame:
    """docs without the text, with its counts, base_failed, kept and content_share (null without a word or a model).

    A null text has no words, so it fails the base rules, as do texts of under 50 words or with over half their words
    in repeated three-word windows. Others are kept if content lines hold `least_share` of the bytes of their lines.
    Texts are read whole, however long. Columns with the name of a result are replaced by it, all others are kept.
    """
    rest = [f for f in docs.schema.fields if f.name != text and f.name not in _OUT.names]
    judge = _rules(model, least_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t) for t in _texts(batch, text)]
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [()] * len(_OUT), _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in rest), *columns], [*(f.name for f in rest), *_OUT.names])

    return docs.select(*(f"`{f.name}`" for f in rest), f"`{text}`").mapInArrow(run, T.StructType([*rest, *_OUT.fields]))


def keep_good(docs: DataFrame, model: LineModel | None, text: str = "text", least_share: float = 0.5) -> DataFrame:
    """The rows of docs that `judged` keeps, all columns unchanged, whatever their names."""
    judge = _rules(model, least_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([judge(t)[6] for t in _texts(batch, text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
