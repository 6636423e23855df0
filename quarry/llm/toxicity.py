"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic model
of its distinct words and their stems; the document's is the noisy-or of its
sentences, 1 - prod(1 - p). Only document labels are needed to train it, and the
sentence probabilities then say which sentence offends. A fifth of the training
documents is left out of the fit to calibrate the document's probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import unused

#: Labelled documents that a model is fitted on, at most: those with the smallest hash of their id.
TRAIN = 8_000
#: Characters of their texts together, at most: a document that would go beyond is left out of the fit as a whole.
CHARACTERS = 100_000_000
#: Hashed features: a word, and its first four and five letters.
FEATURES = 1 << 18
EPOCHS = 24
BATCH = 256
RATE = 0.2
#: Training documents that must hold a feature.
LEAST = 5
#: A document is called toxic from this score on.
CUTOFF = 0.3
START = -6.0
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\W\d_]+")
#: Words a scorer remembers before it starts afresh.
MEMO = 300_000


def features(word: str) -> tuple[int, int, int]:
    return tuple(crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in (word, "^4" + word[:4], "^5" + word[:5]))


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-case words) of the sentences of a text that hold a word."""
    out = []
    for m in _SENTENCE.finditer(text):
        if words := set(_WORD.findall(m[0].lower())):
            out.append((m.start(), m.end(), words))
    return out


def fit(texts: list[str | None], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, bias) of the sentence model from document labels alone, by Adam on the noisy-or likelihood."""
    seen: dict[str, tuple[int, int, int]] = {}
    docs: list[tuple[np.ndarray, np.ndarray]] = []  # features, and where sentences start among them
    for text in texts:
        parts, starts, n = [], [], 0
        for _, _, words in sentences(text or ""):
            ids = [f for w in sorted(words) for f in (seen.get(w) or seen.setdefault(w, features(w)))]
            starts.append(n)
            n += len(ids)
            parts.append(np.array(ids, np.int32))
        docs.append((np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(starts, np.int64)))
    # what few documents hold says nothing about others
    spread = np.zeros(FEATURES, np.int32)
    for ids, _ in docs:
        spread[np.unique(ids)] += 1
    kept = np.flatnonzero(spread >= LEAST)
    # the features that take part, and one place without weight for all others
    n = len(kept)
    place = np.full(FEATURES, n, np.int32)
    place[kept] = np.arange(n)
    docs = [(place[ids], starts) for ids, starts in docs]
    common = np.arange(n + 1) < n
    labels = np.asarray(toxic, float)
    some = np.array([k for k, d in enumerate(docs) if len(d[1])], int)
    w, bias, m, v, mb, vb, step = np.zeros(n + 1), START, np.zeros(n + 1), np.zeros(n + 1), 0.0, 0.0, 0
    rng = np.random.default_rng(5)
    rounds = max(EPOCHS, -(-120 * BATCH // max(len(some), 1))) if len(some) else 0
    for epoch in range(rounds):
        rng.shuffle(some)
        for at in range(0, len(some), BATCH):
            batch = some[at : at + BATCH]
            sizes = np.array([len(docs[k][0]) for k in batch])
            count = np.array([len(docs[k][1]) for k in batch])
            ids = np.concatenate([docs[k][0] for k in batch])
            begin = np.concatenate([docs[k][1] + o for k, o in zip(batch, np.cumsum(sizes) - sizes)])
            z = np.add.reduceat(w[ids], begin) + bias
            first = np.cumsum(count) - count
            clean = np.add.reduceat(np.logaddexp(0, z), first)  # -log(1 - P)
            p = 1 / (1 + np.exp(-z))
            y = labels[batch]
            # of -log-likelihood: p where clean; -p (1 - P) / P where toxic
            pull = np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(clean, 50)), 1e-6), 1.0)
            g_z = p * np.repeat(pull, count)
            g = np.bincount(ids, np.repeat(g_z, np.diff(np.append(begin, len(ids)))), n + 1) * common / len(batch) + 1e-6 * w
            gb = g_z.sum() / len(batch)
            step += 1
            rate = RATE * min(1.0, 2 * (1 - epoch / rounds))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-6)
    weights = np.zeros(FEATURES, np.float32)
    weights[kept] = w[:n]
    return weights, float(bias)


def log_odds(z: np.ndarray) -> float:
    """log(P / (1 - P)) of the noisy-or of sentences with log-odds z."""
    s = np.logaddexp(0, z).sum()
    return float(s if s > 30 else np.log(np.expm1(max(s, 1e-12))))


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt scaling, drawn to (1, 0) where there are few documents."""
    theta, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -50, 50)))
        gradient = design.T @ (p - y) + 0.5 * (theta - prior)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return float(max(theta[0], 0.05)), float(theta[1])


class Scorer:
    """Scores texts by a model (weights, bias, slope, shift)."""

    def __init__(self, model: tuple):
        weights, self.bias, self.slope, self.shift = model

        class Words(dict):
            def __missing__(self, word: str) -> float:
                v = float(weights[list(features(word))].sum())
                if len(word) < 64:
                    self[word] = v
                return v

        self.words = Words()

    def __call__(self, text: str | None) -> tuple[float, int | None, int | None]:
        """(score, start, end): the document's score, and the place of the sentence that adds most to it."""
        found = sentences(text or "")
        if not found:
            return 0.0, None, None
        if len(self.words) > MEMO:
            self.words.clear()
        z = np.array([sum(map(self.words.__getitem__, words)) for _, _, words in found]) + self.bias
        worst = found[int(z.argmax())]
        return float(1 / (1 + np.exp(-np.clip(self.slope * log_odds(z) + self.shift, -50, 50)))), worst[0], worst[1]


def fit_calibrated(texts: list[str | None], toxic: np.ndarray) -> tuple:
    """A model whose noisy-or is fitted on four fifths of the documents and calibrated on the rest."""
    y, rest = np.asarray(toxic, float), np.arange(len(texts)) % 5 == 4
    weights, bias = fit([t for t, r in zip(texts, rest) if not r], y[~rest])
    raw = Scorer((weights.astype(float), bias, 1.0, 0.0))
    kept = [(t, v) for t, v, r in zip(texts, y, rest) if r and sentences(t or "")]
    odds = [np.log(max(p, 1e-300) / max(1 - p, 1e-16)) for p in (raw(t)[0] for t, _ in kept)]
    slope, shift = calibrate(np.array(odds), np.array([v for _, v in kept])) if kept else (1.0, 0.0)
    return weights, bias, slope, shift


def held_out(id_col: str) -> F.Column:
    """True where crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN, characters: int = CHARACTERS) -> tuple:
    """A model fitted on at most `most` labelled documents and `characters` of text that are not held out, whatever the size of docs.

    Of rows that share an id the smallest text counts, and the larger label.
    """
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id"))
             .agg(F.max(label_col).alias("y")).orderBy(F.xxhash64("id"), "id").limit(most))
    # no more than `most` ids and bits; then no more than `most` lengths, of which the driver chooses
    one = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    sizes = one.groupBy("id").agg(F.max(F.length("text")).alias("n")).orderBy(F.xxhash64("id"), "id").toPandas()
    total, chosen = 0, []
    for i, n in zip(sizes["id"], sizes["n"].fillna(0)):
        if total + n <= characters:
            total += n
            chosen.append(i)
    if len(chosen) < len(sizes):
        one = one.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in chosen], f"id {dict(docs.dtypes)[id_col]}")), "id")
    sample = one.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).orderBy("id").toPandas()
    return fit_calibrated(list(sample["text"]), sample["y"].to_numpy())


def scored(text: Column, model: tuple) -> Column:
    """struct (score, start, end): the score of a text and the place of the sentence that adds most to it.

    A text without words (null and empty ones too) scores 0 and has no sentence;
    very long texts are read whole.
    """
    weights, *rest = model
    nonzero = np.flatnonzero(weights)
    values = weights[nonzero]

    @F.pandas_udf("score double, start int, end int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w = np.zeros(FEATURES)
        w[nonzero] = values
        scorer = Scorer((w, *rest))
        for texts in batches:
            yield pd.DataFrame([scorer(t) for t in texts], columns=["score", "start", "end"]).astype({"start": "Int32", "end": "Int32"})

    return score(text)


def score(docs: DataFrame, model: tuple, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """docs with a column out_col of scored(); docs must not have one: that is an error."""
    if out_col in docs.columns:
        raise ValueError(f"docs already has a column {out_col}")
    return docs.withColumn(out_col, scored(F.col(text_col), model))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN) -> DataFrame:
    """(id_col, held_out, score, predicted, sentence_start, sentence_end) for every row of docs.

    Repeated rows score alike; a null id is never held out nor trained on. With
    no labelled rows the model is its bias. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), scored(F.col(text_col), train(docs, labels, id_col, text_col, most=most)).alias("t"))
    return rows.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), F.col("t.score").alias("score"), (F.col("t.score") >= CUTOFF).cast("int").alias("predicted"),
                       F.col("t.start").alias("sentence_start"), F.col("t.end").alias("sentence_end"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN) -> DataFrame:
    """The rows of docs that score under CUTOFF, with all their columns, whatever these are called.

    Null and empty texts score 0 and stay; repeated rows go or stay together. An empty table gives an empty result.
    """
    column = unused(docs.columns, "toxicity")
    return score(docs, train(docs, labels, id_col, text_col, most=most), text_col, column).where(F.col(f"{column}.score") < CUTOFF).drop(column)
