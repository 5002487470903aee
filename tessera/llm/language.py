"""Language identification: family first, then one-versus-one linear support vector machines within the family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.textblocks import slices, text_buffer

#: Hash buckets of byte trigrams.
WIDTH = 1 << 13
#: Training documents of each language, about.
PER_LANGUAGE = 300

# Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "celtic": ("ga", "gd", "cy", "br"),
    "turkic": ("tr", "az", "kk", "uz", "tt", "ky"),
    "indic": ("hi", "bn", "mr", "ne", "gu", "pa", "ur", "sa"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "semitic": ("ar", "he", "mt", "am"),
    "austronesian": ("id", "ms", "tl", "jv"),
}

_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def family(lang: str) -> str:
    """The family of a language code; a code that isn't listed is a family of its own."""
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[[9, 10, 11, 12, 13]] = 32


def trigram_features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Unit vectors of square roots of trigram counts, a row for each document of data."""
    n = len(bounds) - 1
    if len(data) < 3:
        return np.zeros((n, WIDTH), np.float32)
    b = _FOLD[data]
    bucket = ((b[:-2] * 0x9E3779B1 + b[1:-1] * 0x85EBCA77 + b[2:] * 0xC2B2AE3D) >> 15) % WIDTH
    doc = np.repeat(np.arange(n), np.diff(bounds))[: len(bucket)]
    inside = np.arange(len(bucket)) + 2 < bounds[doc + 1]
    counts = np.bincount((doc * WIDTH + bucket)[inside], minlength=n * WIDTH).reshape(n, WIDTH)
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 80) -> np.ndarray:
    """Weights and, last, a bias of a linear SVM with squared hinge loss; classes weigh the same. y: 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    cost = (c * np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    look, t = w, 1.0
    step = 1 / (1 + 4 * c)  # 1 + the largest curvature: rows have a norm of sqrt(2)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ look))
        new = look - step * (look - 2 * ((cost * y * slack) @ x))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    return w


@dataclass(frozen=True)
class LanguageModel:
    """langs, their families, and weights: one machine for each family against the rest, one for each pair within one."""

    langs: list[str]
    families: list[str]
    by_family: np.ndarray
    pairs: dict[str, tuple[list[tuple[str, str]], np.ndarray]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        margins = x @ self.by_family[:, :-1].T + self.by_family[:, -1]
        odds = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
        odds /= odds.sum(axis=1, keepdims=True)
        chosen = odds.argmax(axis=1)
        lang, score = np.empty(n, object), odds[np.arange(n), chosen].astype(float)
        for k, name in enumerate(self.families):
            at = np.flatnonzero(chosen == k)
            own = [x for x in self.langs if family(x) == name]
            if not len(at) or len(own) == 1:
                lang[at] = own[0]
                continue
            pairs, weights = self.pairs[name]
            sure = 1 / (1 + np.exp(-4 * (x[at] @ weights[:, :-1].T + weights[:, -1])))
            votes = np.zeros((len(at), len(own)))
            for j, (a, b) in enumerate(pairs):
                votes[:, own.index(a)] += sure[:, j]
                votes[:, own.index(b)] += 1 - sure[:, j]
            best = votes.argmax(axis=1)
            lang[at] = np.array(own, object)[best]
            score[at] *= votes[np.arange(len(at)), best] / (len(own) - 1)
        return lang.tolist(), score


def _features_of(texts: list[str]) -> np.ndarray:
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    return trigram_features(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """A model from the rows of docs where learn holds, with a text and a language; None if there are none.

    A sample of about per_language documents of each language is drawn by a hash of doc_id. Each machine is fitted in
    a Spark task of its own on whole texts of the languages that it tells apart.
    """
    usable = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(lang) != "und"))
    counts = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}  # one row a language
    if not counts:
        return None
    langs = sorted(counts)
    families = sorted({family(x) for x in langs})
    problems: dict[str, list[tuple[str, int]]] = {x: [] for x in langs}  # the problems that a language's rows take part in
    for f in families if len(families) > 1 else []:
        for x in langs:
            problems[x].append((f"family:{f}", 1 if family(x) == f else -1))
    for f in families:
        for a, b in combinations([x for x in langs if family(x) == f], 2):
            problems[a].append((f"pair:{a}:{b}", 1))
            problems[b].append((f"pair:{a}:{b}", -1))
    spark = docs.sparkSession
    parts = [(x, min(1.0, per_language / counts[x]), [{"problem": p, "y": y} for p, y in problems[x]]) for x in langs]
    plan = spark.createDataFrame(parts, "_lang string, share double, tasks array<struct<problem: string, y: int>>")
    drawn = usable.join(F.broadcast(plan), F.col(lang) == F.col("_lang")).where(F.pmod(F.xxhash64(doc_id, F.lit(5)), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    rows = drawn.select(F.explode("tasks").alias("t"), F.col(text).alias("text")).select("t.problem", "t.y", "text")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["y", "text"])
        w = fit_svm(_features_of(group["text"].tolist()), group["y"].to_numpy(np.float32))
        return pd.DataFrame({"problem": [group["problem"].iloc[0]], "w": [w]})

    weights = {r["problem"]: np.array(r["w"], np.float32) for r in rows.groupBy("problem").applyInPandas(fit, "problem string, w array<float>").collect()}
    zero = np.zeros(WIDTH + 1, np.float32)
    by_family = np.array([weights.get(f"family:{f}", zero) for f in families])
    pairs = {}
    for f in families:
        own = list(combinations([x for x in langs if family(x) == f], 2))
        if own:
            pairs[f] = (own, np.array([weights.get(f"pair:{a}:{b}", zero) for a, b in own]))
    return LanguageModel(langs, families, by_family, pairs)


def predicted(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """docs without the text, with lang_pred and score (0 to 1).

    A null text or one without a letter is `und`, with score 0, and so is any text where there is no model. Texts are
    read whole, however long. Columns named lang_pred or score are replaced by the results, all others are kept;
    nothing but the text is an input.
    """
    rest = [f for f in docs.schema.fields if f.name not in (text, "lang_pred", "score")]
    marked = "_lettered"
    while marked in docs.columns:
        marked += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            data, offsets = text_buffer(batch.column(at(text)))
            lettered = batch.column(at(marked)).to_pylist()
            langs, scores = [], [np.zeros(0)]
            for a, b in slices(offsets, 1 << 18):
                for c in range(a, b, 64):
                    d = min(b, c + 64)
                    if model:
                        lang, score = model.predict(trigram_features(data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c]))
                        langs += lang
                        scores.append(score)
                    else:
                        langs += ["und"] * (d - c)
                        scores.append(np.zeros(d - c))
            scores = np.concatenate(scores)
            if len(lettered):
                scores[~np.array(lettered, bool)] = 0
            langs = [x if ok else "und" for x, ok in zip(langs, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(f.name)) for f in rest), pa.array(langs, pa.string()), pa.array(scores)], [*(f.name for f in rest), "lang_pred", "score"])

    schema = T.StructType([*rest, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    lettered = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias(marked)
    return docs.select(*(f"`{f.name}`" for f in rest), f"`{text}`", lettered).mapInArrow(run, schema)
