"""SimHash near-duplicates of texts at a Jaccard similarity: trees of vantage points propose, whole shingle sets confirm.

simhash.near_duplicates links fingerprints; here the texts themselves link, if
the sets of their five-word shingles are at least 0.8 alike. Such pairs differ
in some 15 % of the bits of a SimHash, too many for one radius over all bits. A
fingerprint is therefore as wide as to have many blocks of bits, and a pair is
within RADIUS bits in one of them with a chance of RECALL at least. Every block
has a vantage-point tree, which deals fingerprints to shards by the triangle
bound, as in simhash; shards find the pairs whose first SKETCH bits lie within
what the similarity allows, and return a forest of them. The components of
these forests are what is left to confirm: their texts' shingle sets meet once,
and pairs that are already connected are not compared again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Union, connected_components, first_of_groups, stored
from quarry.llm.simhash import SAMPLE, fit_tree, route

#: Words of a shingle and the similarity that links.
SHINGLE = 5
SIMILAR = 0.8
#: Chance that a pair at SIMILAR less MARGIN is within RADIUS bits in some block; short texts stray from the law of large ones.
RECALL = 0.9995
MARGIN = 0.05
RADIUS = 1
#: Bits, in words of 64, that shards compare, and standard deviations that they may stray.
SKETCH = 192
SLACK = 4
#: Distinct fingerprints of a shard, and home fingerprints of a leaf inside, about.
SHARD = 65_536
LEAF = 64
#: Texts of a candidate component that one task compares; a larger one is cut into tiles.
TILE = 4_096
#: Texts of a task's group of small components, about.
GROUP = 4_096
_ONE = np.uint64(0x0101010101010101)


def differing(similar: float) -> float:
    """The share of bits in which SimHashes of sets of equal size differ on average."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def design(n: int, similar: float = SIMILAR) -> tuple[int, int]:
    """(bits of a block, blocks) for n texts: a block has some 16 unrelated texts a value, and one of a pair's blocks is within RADIUS with a chance of RECALL."""
    bits = max(10, min(28, math.ceil(math.log2(max(n, 1) / 16))) if n > 16 else 10)
    p = differing(similar - MARGIN)
    near = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(RADIUS + 1))
    return bits, max(math.ceil(SKETCH / bits), math.ceil(math.log(1 - RECALL) / math.log(1 - near)))


def reach(similar: float, bits: int) -> int:
    """Of so many bits, those that differ in a pair that may link, at most but for a chance of about 3e-5."""
    p = differing(similar - MARGIN)
    return math.ceil(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64s of a text's shingles; a shorter text is one shingle, one without words none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, n)
    cuts = map(slice, starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.unique(np.fromiter(map(xxh64_intdigest, map(line.__getitem__, cuts), repeat(42)), np.uint64, n - k + 1))


def set_hash(found: np.ndarray) -> int:
    """One signed number for a set of shingles."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes()) - 2**63


def wide_fingerprint(found: np.ndarray, words: int) -> np.ndarray:
    """A SimHash of 64 * words bits of a set of hashes: a bit is 1 if set in over half of the words drawn from each hash."""
    rng = np.random.default_rng(20020519)
    first, second = (rng.integers(0, 2**63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    ones = np.zeros((words, 8, 8), np.int64)
    for at in range(0, len(found), 255):
        x = found[at : at + 255, None] * first
        x ^= x >> np.uint64(32)
        x *= second
        x ^= x >> np.uint64(29)
        for k in range(8):
            # eight bits of every word at once, counted in its eight bytes; 255 hashes fit
            ones[:, :, k] += ((x >> np.uint64(k)) & _ONE).sum(axis=0, dtype=np.uint64).view(np.uint8).reshape(words, 8)
    return np.packbits((2 * ones > len(found)).reshape(words, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]


def block_values(fps: np.ndarray, bits: int, blocks: int) -> Iterator[np.ndarray]:
    """Each block's bits of fingerprints (rows, words) as numbers."""
    spread = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
    powers = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    for b in range(blocks):
        yield (spread[:, b * bits : (b + 1) * bits] * powers).sum(axis=1, dtype=np.uint64)


def met(words: list[np.ndarray], i: np.ndarray, j: np.ndarray, most: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places in i and j of pairs whose first k words differ in most[k - 1] bits at most, for every k."""
    a, b = np.nonzero(np.bitwise_count(words[0][i][:, None] ^ words[0][j][None, :]) <= most[0])
    total = np.bitwise_count(words[0][i[a]] ^ words[0][j[b]]).astype(np.int16)
    for w, limit in zip(words[1:], most[1:]):
        total += np.bitwise_count(w[i[a]] ^ w[j[b]])
        keep = total <= limit
        a, b, total = a[keep], b[keep], total[keep]
    return a, b


def near_pairs(home: np.ndarray, query: np.ndarray, values: np.ndarray, words: list[np.ndarray], mask: int, most: list[int], union: Union) -> None:
    """Add to union edges that connect all of home and query that lie within RADIUS on the block and within most on the sketch.

    Many equal values can't be split by a tree. There a pivot is compared with
    all others first; pairs of which both are near it are connected already.
    """
    rng, m = np.random.default_rng(11), np.uint64(mask)

    def all_of(h: np.ndarray, q: np.ndarray, pivots: int) -> None:
        while len(h) and len(q) and len(h) * len(q) > 1 << 22 and pivots:
            p = h[len(h) // 2 : len(h) // 2 + 1]
            h_near, q_near = np.zeros(len(h), bool), np.zeros(len(q), bool)
            h_near[met(words, p, h, most)[1]] = True
            q_near[met(words, p, q, most)[1]] = True
            for x in (h[h_near], q[q_near]):
                union.add(np.repeat(p, len(x)), x)
            pivots -= 1
            all_of(h[h_near], q[~q_near], pivots)
            h = h[~h_near]
        step = max(1, (1 << 20) // max(len(h), 1))
        for at in range(0, len(q) if len(h) else 0, step):
            part = q[at : at + step]
            i, j = met(words, h, part, most)
            differ = h[i] != part[j]
            union.add(h[i][differ], part[j][differ])

    stack = [(home, query)]
    while stack:
        h, q = stack.pop()
        if not len(h) or not len(q):
            continue
        if len(h) > LEAF:
            split = None
            for _ in range(4):
                v = values[h[rng.integers(len(h))]]
                d = np.bitwise_count((values[h] ^ v) & m).astype(np.int16)
                mu = int(np.median(d))
                mu -= int((d <= mu).all())
                if 0 < (inner := d <= mu).sum() < len(h):
                    split = (v, mu, inner)
                    break
            if split:
                v, mu, inner = split
                d = np.bitwise_count((values[q] ^ v) & m).astype(np.int16)
                stack.append((h[inner], q[d <= mu + RADIUS]))
                stack.append((h[~inner], q[d > mu - RADIUS]))
                continue
        all_of(h, q, 16)


def candidates(classes: DataFrame, bits: int, blocks: int, similar: float) -> DataFrame:
    """Edges (a, b) that connect the reps of classes (rep, fp) whose fingerprints are near."""
    n = classes.count()
    kept = SKETCH // 64
    sample = np.array([np.frombuffer(r.fp, np.uint64) for r in classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.uint64)
    depth = max(0, math.ceil(math.log2(max(1, n / SHARD))))
    mask, most = (1 << bits) - 1, [reach(similar, 64 * k) for k in range(1, kept + 1)]
    trees = [fit_tree(v, mask, depth) for v in (block_values(sample, bits, blocks) if n else ())]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                fps, reps = np.frombuffer(b"".join(pdf["fp"]), np.uint64).reshape(len(pdf), -1), pdf["rep"].to_numpy(np.int64)
                short = np.array([r.tobytes() for r in np.ascontiguousarray(fps[:, :kept])], object)
                for b, (values, tree) in enumerate(zip(block_values(fps, bits, blocks), trees)):
                    rows, leaf, home, _ = route(values, tree, mask, RADIUS)
                    yield pd.DataFrame({"shard": (leaf * blocks + b).astype(np.int32), "home": home, "value": values[rows].astype(np.int32), "sketch": short[rows], "rep": reps[rows]})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        words = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), -1)
        reps, union = pdf["rep"].to_numpy(np.int64), Union(len(pdf))
        near_pairs(np.flatnonzero(pdf["home"].to_numpy()), np.arange(len(pdf)), pdf["value"].to_numpy().astype(np.uint64), [np.ascontiguousarray(w) for w in words.T], mask, most, union)
        label = union.labels()
        rest = np.flatnonzero(label != np.arange(len(pdf)))
        return pd.DataFrame({"a": reps[rest], "b": reps[label[rest]]})

    dealt = classes.select("rep", "fp").mapInPandas(deal, "shard int, home boolean, value int, sketch binary, rep long")
    return stored(dealt.groupBy("shard").applyInPandas(compare, "a long, b long").distinct(), "copies-candidates")


def linked(sets: list[np.ndarray], similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all sets that link.

    The set that has most links among a first one and those beside it takes its
    links along; pairs among these are connected already. All others are compared
    with every set.
    """
    size, n = np.array([len(s) for s in sets]), len(sets)
    token, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]

    def links(i: int) -> np.ndarray:
        lo, hi = np.searchsorted(token, sets[i], "left"), np.searchsorted(token, sets[i], "right")
        k = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
        both = np.bincount(owner[at], minlength=n)
        j = np.flatnonzero(both >= similar * (size + size[i] - both) - 1e-9)
        return j[(j != i) & (size[i] > 0) & (size[j] > 0)]

    known = {0: links(0)}
    if n > 8:
        known |= {int(i): links(int(i)) for i in known[0][:8]}
    centre = max(known, key=lambda i: len(known[i]))
    inside = np.zeros(n, bool)
    inside[[centre, *known[centre]]] = True
    out = []
    for i in [centre, *np.flatnonzero(~inside).tolist()]:
        j = known[i] if i in known else links(i)
        out.append((np.full(len(j), i), j))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def confirmed(docs: DataFrame, classes: DataFrame, members: DataFrame, text_col: str, id_col: str, similar: float, shingle: int) -> DataFrame:
    """Edges (a, b) that connect the reps of candidate components (rep, component) that link."""
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    placed = stored(classes.select("cls", "rep").join(members, "rep").join(sizes, "component").withColumn("parts", F.ceil(F.col("n") / TILE)), "copies-members")
    total = placed.count()

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [shingles(t, shingle) for t in pdf["text"]]
            yield pd.DataFrame({"cls": np.array([set_hash(s) for s in found], np.int64), "held": [s.tobytes() for s in found]})

    needed = placed.select(F.col("rep").alias("__rep")).distinct()
    texts = docs.select(F.col(id_col).alias("__rep"), F.col(text_col).alias("text")).join(needed, "__rep", "left_semi").select("text")
    held = texts.mapInPandas(sets, "cls long, held binary").dropDuplicates(["cls"])
    # every two parts of a component meet; components of one part share groups
    part = F.pmod(F.xxhash64("cls"), F.col("parts"))
    groups = max(1, -(-total // GROUP))
    tiled = (placed.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
             .select("cls", "rep", "component", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"),
                     F.when(F.col("parts") > 1, F.xxhash64("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(groups))).alias("group")))
    rows = tiled.join(held, "cls")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        reps, raw, union = pdf["rep"].to_numpy(np.int64), pdf["held"].to_numpy(), Union(len(pdf))
        for at in pdf.groupby("component").indices.values():
            i, j = linked([np.frombuffer(raw[k], np.uint64) for k in at], similar)
            union.add(at[i], at[j])
        label = union.labels()
        rest = np.flatnonzero(label != np.arange(len(pdf)))
        return pd.DataFrame({"a": reps[rest], "b": reps[label[rest]]})

    return stored(rows.groupBy("group", "p", "q").applyInPandas(compare, "a long, b long"), "copies-edges")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", similar: float = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """One row (id_col, component_id) per row of docs: the smallest id reachable by links, the row's own included.

    Null, empty and blank texts are copies of each other. Rows that share an id
    count as one document. A null id keeps its row, with the component of the
    texts that have the same shingles, null if none of them has an id. Very long
    texts are read whole. Other columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    bits, blocks = design(docs.count(), similar)
    words = -(-max(SKETCH, bits * blocks) // 64)

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [shingles(t, shingle) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "cls": np.array([set_hash(s) for s in found], np.int64), "fp": [wide_fingerprint(s, words).tobytes() for s in found]})

    asked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashed = stored(asked.mapInPandas(signed, "id long, cls long, fp binary"), "copies-sets")
    classes = stored(hashed.groupBy("cls").agg(F.min("id").alias("rep"), F.min("fp").alias("fp")), "copies-classes")
    found = candidates(classes.where("rep is not null"), bits, blocks, similar)
    members = stored(connected_components(found, "copies-cc").withColumnRenamed("node", "rep"), "copies-components")
    edges = confirmed(docs, classes, members, text_col, id_col, similar, shingle)
    ids = hashed.select("id", "cls").join(classes.select("cls", "rep"), "cls")
    # an id with several texts joins the classes of all of them
    repeated = hashed.where("id is not null").groupBy("id").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("id")
    if not repeated.isEmpty():
        edges = edges.union(ids.join(repeated, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    component = connected_components(edges, "copies-cc")
    return ids.join(component, ids["rep"] == component["node"], "left").select(F.col("id").alias(id_col), F.coalesce("component", "rep").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each group of near copies: a row of the smallest id, of several the one with the least hash. Rows without an id stay."""
    return first_of_groups(docs, near_duplicates(docs, text_col, id_col, similar), id_col)
