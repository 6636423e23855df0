"""Quality by importance resampling.

Two generative models of hashed n-grams (words and word pairs, counted in
BUCKETS buckets) are fitted: one of target text, the documents labelled good,
and one of raw text, all documents. A document's log importance weight is the
log of the ratio of its probabilities under the two. Adding Gumbel noise and
keeping the k largest keys draws k documents without replacement, each draw in
proportion to the weights (Xie et al. 2023).

The sum over n-grams grows with a text's length, so that a few long documents
would decide a sample. The weight is therefore that of SPAN average n-grams of
the document, where the average is taken over its whole text and SPAN n-grams
that say nothing: sum * SPAN / (n + SPAN), one formula for texts of all lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored
from quarry.llm.mixing import uniform
from quarry.llm.toxicity import held_out

#: Labelled good documents whose text makes the target model, at most: those with the smallest hash of their id. The raw model counts all documents.
TARGET = 20_000
#: Buckets of n-grams; a power of two.
BUCKETS = 1 << 16
#: n-grams that a document's weight stands for, and n-grams without evidence that its average takes in.
SPAN = 100
#: Added to every bucket's count.
SMOOTHING = 1.0
#: Bins of a pass of the search for the k-th largest key.
BINS = 4096
#: Words a task remembers before it starts afresh.
MEMO = 500_000
_MIX, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


class Grams:
    """Buckets of the words and word pairs of texts; words are lower-cased and end at white space."""

    def __init__(self):
        class Words(dict):
            def __missing__(self, word: str) -> int:
                v = crc32(word.encode("utf-8", "surrogatepass")) + 1
                if len(word) < 64:
                    self[word] = v
                return v

        self.seen = Words()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        if len(self.seen) > MEMO:
            self.seen.clear()
        h = np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words)) * _MIX
        return np.concatenate([h, (h[:-1] + h[1:] * np.uint64(3)) * _PAIR]) >> _SHIFT


def counts(docs: DataFrame, text_col: str, target_col: str) -> np.ndarray:
    """Array (2, BUCKETS): n-grams of all rows, and of the rows where target_col is true. A task sends BUCKETS rows at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, total = Grams(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, target in zip(batch[text_col], batch[target_col]):
                found = grams(text)
                np.add.at(total[0], found, 1)
                if target:
                    np.add.at(total[1], found, 1)
        some = np.flatnonzero(total[0])
        yield pd.DataFrame({"bucket": some.astype(np.int32), "raw": total[0][some], "target": total[1][some]})

    sums = (docs.select(text_col, target_col).mapInPandas(count, "bucket int, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())  # BUCKETS rows at most
    out = np.zeros((2, BUCKETS))
    out[:, sums["bucket"].to_numpy(int)] = sums[["raw", "target"]].to_numpy(float).T
    return out


def log_ratios(n: np.ndarray) -> np.ndarray:
    """log(P(bucket | target) / P(bucket | raw)); zeros where there is no target text."""
    if not n[1].any():
        return np.zeros(BUCKETS)
    p = np.log(n + SMOOTHING) - np.log(n.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return p[1] - p[0]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TARGET) -> tuple[np.ndarray, float]:
    """(log ratios, share): the model, and the share of labelled rows that are good; 1 if none are labelled.

    Labels are learned only from rows that are not held out (crc32 of the id modulo 4 is not 2).
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).alias("__id"), (F.col(label_col) > 0).alias("__good"))
    share = known.agg(F.avg(F.col("__good").cast("double"))).first()[0]
    target = known.where("__good").select("__id").distinct().orderBy(F.xxhash64("__id"), "__id").limit(most)
    marked = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(  # no more than `most` ids are broadcast
        F.broadcast(target), F.col("__doc") == F.col("__id"), "left").withColumn("__target", F.col("__id").isNotNull())
    return log_ratios(counts(marked, "__text", "__target")), 1.0 if share is None else share


def log_weight(text: Column, ratios: np.ndarray) -> Column:
    """The log importance weight of a text; 0 where it has no words (null and empty texts too)."""

    @F.pandas_udf("double")
    def weight(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams = Grams()
        for texts in batches:
            out = np.zeros(len(texts))
            for k, t in enumerate(texts):
                if len(found := grams(t)):
                    out[k] = ratios[found].sum() * (SPAN / (len(found) + SPAN))
            yield pd.Series(out)

    return weight(text)


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a double column without nulls, None if it has fewer; k counts from 1.

    Each pass counts BINS equal bins of the range that is left and goes on in
    the one that holds the value, until a bin's values are all equal.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low is not None and k > 0:
        left = df.where(F.col(column).between(low, high))
        bins = left.groupBy(F.least(F.floor((F.col(column) - low) / max(high - low, 1e-300) * BINS), F.lit(BINS - 1)).alias("bin")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()  # BINS rows at most
        for b in sorted(bins, key=lambda b: -b.bin):
            if b.n >= k:
                break
            k -= b.n
        else:
            return None
        low, high = b.low, b.high
        if low == high:
            return low
    return None


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", share: float | None = None,
             most: int = TARGET, seed: str = "quality-1:") -> DataFrame:
    """(id_col, log_weight, gumbel_key, kept) for every row of docs.

    kept marks the rows with the k largest keys, k being share of the rows; the
    default share is that of good rows among the labelled ones. Noise comes from
    the id, so that reruns agree; rows of the same id and text tie, and rows that
    tie with the k-th are kept as well. Without good labelled documents in docs
    all weights are 0 and the noise alone decides. An empty table gives an empty
    result.
    """
    ratios, good = train(docs, labels, id_col, text_col, label_col, most)
    scored = docs.select(F.col(id_col), log_weight(F.col(text_col), ratios).alias("log_weight"))
    keyed = stored(scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform(F.col(id_col), seed)))), "quality-keys")
    k = round((good if share is None else share) * keyed.count())
    least = kth_largest(keyed, "gumbel_key", k)
    return keyed.withColumn("kept", F.lit(False) if least is None else F.col("gumbel_key") >= least)
