"""Spelling variants by forward and reversed sorted dictionaries.

Two words are near if one code point inserted, deleted or replaced turns one
into the other. One edit leaves a half of the longer word intact, so near words
share their first half or their last half. Every word stands in a dictionary
sorted by its first half and in one sorted by its reversed last half, once for
the words of its own length and once for those with a code point more; a block
of words that share the half is a range of that dictionary and is scanned as
one.

A block is the window [lo, hi) of positions where the edit may fall, and what
stands before and after it. A block of over BLOCK words is subdivided: its
window is cut in two, and the edit leaves the text of one half intact. A window
of one position holds no more words than there are letters, so every block that
is scanned is small, and no pair is lost. A pair counts in the one window that
holds the first position where its words differ.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, stored

#: Words that are grouped have so many code points and occurrences at least.
LENGTH, LEAST = 5, 3
#: A run whose CRC-32 this divides loses a code point.
DROP = 97
#: A form occurs at least so many times as often as its word.
FACTOR = 2
#: Words of a block that is scanned as it is.
BLOCK = 256
#: Code points of pairs that a scan compares at once.
CELLS = 1 << 22
_RUN = "[a-zÀ-ÿ]+"


def words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, n): the words of whole texts with their occurrences, rare and short ones left out. A null id counts as an empty one."""
    lower = F.translate(F.col(text_col), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(_RUN), F.lit(0))).alias("run"))
    marked = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))).withColumn("size", F.length("run"))
    at = (F.col("h") % F.col("size")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    word = F.when(F.col("h") % DROP == 0, without).otherwise(F.col("run"))
    return marked.select(word.alias("word")).where(F.length("word") >= LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


def _block(m: Column, lo: Column, hi: Column) -> list[Column]:
    """The columns of a word in the block of the window [lo, hi) among words of m code points or one less."""
    word, size = F.col("word"), F.length("word")
    after = F.right(word, m - hi)
    return [m.alias("m"), lo.alias("lo"), hi.alias("hi"), F.concat(F.substring(word, F.lit(1), lo), F.lit("|"), F.reverse(after)).alias("key"),
            F.substring(word, lo + 1, size - (m - hi) - lo).alias("mid"), F.substring(after, 1, 1).alias("next"), "word", "n"]


def _halves(rows: DataFrame) -> DataFrame:
    """The rows (m, lo, hi, word, n) in the blocks of both halves of their windows."""
    middle = F.expr("(lo + hi) div 2").cast("int")
    cut = rows.select("m", "word", "n", F.explode(F.array(F.struct(middle.alias("lo"), "hi"), F.struct("lo", middle.alias("hi")))).alias("w")).select("m", "w.lo", "w.hi", "word", "n")
    return cut.select(_block(F.col("m"), F.col("lo"), F.col("hi")))


def blocks(vocabulary: DataFrame) -> DataFrame:
    """Every word of (word, n) in its blocks, those of over BLOCK words subdivided."""
    size = F.length("word")
    rows = _halves(vocabulary.select(F.explode(F.array(size, size + 1)).alias("m"), "word", "n").select("m", F.lit(0).alias("lo"), F.col("m").alias("hi"), "word", "n"))
    block, ready = ["m", "lo", "hi", "key"], []
    while True:
        rows = stored(rows, "spelling-blocks")
        large = stored(rows.groupBy(block).count().where((F.col("count") > BLOCK) & (F.col("hi") - F.col("lo") > 1)).drop("count"), "spelling-large")
        if large.isEmpty():
            return reduce(DataFrame.union, [*ready, rows])
        ready.append(rows.join(large, block, "left_anti").select(rows.columns))
        rows = _halves(rows.join(large, block, "left_semi"))


def _near(a: np.ndarray, b: np.ndarray, short: np.ndarray, next_: np.ndarray) -> np.ndarray:
    """Which pairs of middles are near, by the window that counts them; a is a whole window long, b too unless it is short."""
    same = a == b
    r = a.shape[1]
    out = (r - same.sum(axis=1, dtype=np.int64)) == 1
    if short.any():
        x, y, before = a[short], b[short], same[short][:, : r - 1]
        shifted = (x[:, 1:] == y[:, : r - 1])[:, ::-1]
        lead = np.where(before.all(axis=1), r - 1, (~before).argmax(axis=1)) if r > 1 else np.zeros(len(x), np.int64)
        trail = np.where(shifted.all(axis=1), r - 1, (~shifted).argmax(axis=1)) if r > 1 else np.zeros(len(x), np.int64)
        # what is equal to the window's end may go on beyond it; another window then holds the first difference
        beyond = (lead == r - 1) & (x[:, r - 1] == next_[short])
        out[short] = (lead + trail >= r - 1) & ~beyond
    return out


def _parts(width: np.ndarray, change: np.ndarray, later: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(window, rows) of the blocks of more than one word, as many blocks at once as have CELLS code points, or one."""
    for r in np.unique(width[later > 0]).tolist():
        mine = np.flatnonzero((width == r) & ((later > 0) | ~change))
        cuts, most = [0], max(1, CELLS // r)
        starts = np.append(np.flatnonzero(change[mine]), len(mine))
        while cuts[-1] < len(mine):
            k = int(np.searchsorted(starts, cuts[-1] + most, "right")) - 1
            cuts.append(int(starts[k]) if starts[k] > cuts[-1] else int(starts[k + 1]))
        yield from ((r, mine[a:b]) for a, b in zip(cuts, cuts[1:]))


def _links(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Both directions of the links within whole blocks, rows sorted by block."""
    change = (pdf[["m", "lo", "hi", "key"]] != pdf[["m", "lo", "hi", "key"]].shift()).any(axis=1).to_numpy()
    start = np.flatnonzero(change)
    end = np.repeat(np.append(start[1:], len(pdf)), np.diff(np.append(start, len(pdf))))
    later = end - np.arange(len(pdf)) - 1  # rows of the block after this one
    width = (pdf["hi"] - pdf["lo"]).to_numpy()
    words_, counts, mids = pdf["word"].to_numpy(), pdf["n"].to_numpy(), pdf["mid"].to_numpy()
    following = np.array([ord(x) if x else 0 for x in pdf["next"]], np.uint8)
    for r, mine in _parts(width, change, later):
        letters = np.array(mids[mine].tolist(), f"U{r}").view(np.uint32).reshape(-1, r).astype(np.uint8)
        short = letters[:, r - 1] == 0
        n = later[mine]
        first = np.cumsum(n) - n
        step = max(1, CELLS // r)
        at = 0
        while at < len(mine):
            to = max(at + 1, int(np.searchsorted(first, first[at] + step)))
            i = np.repeat(np.arange(at, to), n[at:to])
            j = i + 1 + np.arange(len(i)) - (first[i] - first[at])
            keep = ~(short[i] & short[j])
            i, j = i[keep], j[keep]
            i, j = np.where(short[i], j, i), np.where(short[i], i, j)
            found = _near(letters[i], letters[j], short[j], following[mine[i]])
            a, b = mine[i[found]], mine[j[found]]
            if len(a):
                a, b = np.concatenate([a, b]), np.concatenate([b, a])
                yield pd.DataFrame({"word": words_[a], "n": counts[a], "near": words_[b], "near_n": counts[b]})
            at = to


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rest = None
    for pdf in batches:
        if pdf.empty:
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = pdf.iloc[-1]
        # the last block may go on in the next batch; it has BLOCK rows at most
        tail = np.zeros(len(pdf), bool)
        near_end = pdf.iloc[-2 * BLOCK :]
        tail[-len(near_end) :] = ((near_end["key"] == last["key"]) & (near_end["m"] == last["m"]) & (near_end["lo"] == last["lo"]) & (near_end["hi"] == last["hi"])).to_numpy()
        rest = pdf[tail].reset_index(drop=True)
        if not tail.all():
            yield from _links(pdf[~tail].reset_index(drop=True))
    if rest is not None:
        yield from _links(rest)


def links(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of near words of (word, n), once."""
    rows = blocks(vocabulary)
    scanned = rows.repartitionByRange("m", "lo", "hi", "key").sortWithinPartitions("m", "lo", "hi", "key", "word")
    return scanned.mapInPandas(_scan, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form) that have a form, by doubling the steps; forms occur ever more often, so chains end."""
    up = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = up.select(F.col("word").alias("at"), F.col("root").alias("to"))
        after = stored(up.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "spelling-roots")
        discard(up)
        up = after.drop("moved")
        up.quarry_path = after.quarry_path
        if after.where("moved").isEmpty():
            return up


def variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, n, n_near, form, form_n, root), one row per word of at least LENGTH code points and LEAST occurrences.

    Null, empty and letterless texts hold no words; runs of any length are whole
    words; repeated rows count again. Of near words with equal n the smallest in
    code-point order is the form. Other columns of docs are ignored, whatever
    their names. An empty table gives an empty result.
    """
    vocabulary = stored(words(docs, text_col, id_col), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form")))
    near = links(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("own"))
    near = near.select("word", "n_near", F.when(-F.col("best.m") >= FACTOR * F.col("own"), F.struct("best.form", (-F.col("best.m")).alias("form_n"))).alias("f"))
    near = stored(near.select("word", "n_near", F.col("f.form").alias("form"), F.col("f.form_n").alias("form_n")), "spelling-forms")
    last = roots(near.where("form is not null"))
    return vocabulary.join(near, "word", "left").join(last, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
