"""SimHash near-duplicate groups by vantage-point trees over Hamming distance.

Fingerprints are 64-bit SimHashes of word shingles. Two texts link when their
fingerprints differ in at most ``max_bits`` bits. Instead of comparing all
pairs, the 64 bits are cut into ``BLOCKS`` blocks: fingerprints within
``max_bits`` bits agree within ``max_bits // BLOCKS`` bits in at least one
block (pigeonhole), and Hamming distance restricted to a block is a metric. A
vantage-point tree per block deals the distinct fingerprints to shards; by the
triangle bound a fingerprint also visits the shards whose side of a split it
may reach with that radius. Every shard builds its own tree with the same
bounds, compares whole fingerprints at the leaves, and returns a spanning
forest of its links, never the pairs. The trees' vantage points come from a
bounded sample of fingerprints and only steer the balance; no link depends on
them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Union, connected_components, first_of_groups, stored

#: Blocks of the 64 bits; with 4 bits allowed, three blocks leave a radius of 1.
BLOCKS = 3
#: Distinct fingerprints of a shard, about.
SHARD = 16_384
#: Fingerprints that the shards' trees are fitted on, at most.
SAMPLE = 20_000
#: Home fingerprints of one task, at most; a larger shard is cut into tiles.
TILE = 1_000_000
#: Home fingerprints of a leaf inside a shard, about.
LEAF = 64
_SIZES = (22, 21, 21)


def masks() -> list[int]:
    out, low = [], 0
    for size in _SIZES:
        out.append(((1 << size) - 1) << low)
        low += size
    return out


def simhash(text: str | None, shingle: int = 4) -> int:
    """The unsigned SimHash of a text: a bit is 1 if set in over half of the shingles' XXH64 (seed 42)."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, n)
    cuts = map(slice, starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())
    hashes = np.fromiter(map(xxh64_intdigest, map(line.__getitem__, cuts), repeat(42)), np.uint64, n - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 4) -> DataFrame:
    """(id, fp): the signed 64-bit SimHash of every whole text. bytes.lower() touches A-Z only."""

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.fromiter((simhash(x, shingle) for x in batch), np.uint64, len(batch)).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def fit_tree(sample: np.ndarray, mask: int, depth: int, seed: int = 7) -> list:
    """A balanced vantage-point tree as nested lists [vantage point, radius, inner, outer]; None at leaves."""
    rng, m = np.random.default_rng(seed), np.uint64(mask)

    def node(points: np.ndarray, left: int):
        if not left or len(points) < 2:
            return None
        best = None
        for v in rng.choice(points, min(8, len(points)), replace=False):
            d = _bits((points ^ v) & m)
            mu = int(np.median(d))
            for r in (mu - 1, mu):
                gap = abs((d <= r).sum() / len(points) - 0.5)
                if best is None or gap < best[0]:
                    best = (gap, v, r, d <= r)
        if best[0] > 0.45:
            return None
        return [best[1], best[2], node(points[best[3]], left - 1), node(points[~best[3]], left - 1)]

    return node(sample, depth)


def route(fps: np.ndarray, tree, mask: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, leaf, home) of every shard that each fingerprint must be in, and the number of leaves.

    A visitor goes only to leaves after its home: of two fingerprints in reach of
    each other, the triangle bound sends the earlier one to the later one's leaf.
    """
    rows, leaves, homes, count, m = [], [], [], 0, np.uint64(mask)
    stack = [(tree, np.arange(len(fps)), np.ones(len(fps), bool), np.zeros(len(fps), bool))]
    homed = np.zeros(len(fps), bool)  # already met the home leaf, in leaf order
    while stack:
        node, at, home, _ = stack.pop()
        if node is None:
            keep = home | homed[at]
            rows.append(at[keep])
            leaves.append(np.full(keep.sum(), count))
            homes.append(home[keep])
            homed[at[home]] = True
            count += 1
            continue
        v, r, inner, outer = node
        d = _bits((fps[at] ^ v) & m).astype(np.int16)
        near, far = d <= r + radius, d > r - radius
        # inner first: pushed last
        stack.append((outer, at[far], home[far] & (d[far] > r), None))
        stack.append((inner, at[near], home[near] & (d[near] <= r), None))
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes), count


def local_links(home: np.ndarray, query: np.ndarray, mask: int, radius: int, max_bits: int, found) -> None:
    """Call found(i of home, j of query) with all pairs within max_bits that lie within radius on the block."""
    rng, m = np.random.default_rng(11), np.uint64(mask)
    stack = [(np.arange(len(home)), np.arange(len(query)))]
    while stack:
        h, q = stack.pop()
        if not len(h) or not len(q):
            continue
        if len(h) > LEAF:
            split = None
            for _ in range(4):
                v = home[h[rng.integers(len(h))]]
                dh = _bits((home[h] ^ v) & m).astype(np.int16)
                mu = int(np.median(dh))
                mu -= int((dh <= mu).all())
                if 0 < (inner := dh <= mu).sum() < len(h):
                    split = (v, mu, inner)
                    break
            if split:
                v, mu, inner = split
                dq = _bits((query[q] ^ v) & m).astype(np.int16)
                stack.append((h[inner], q[dq <= mu + radius]))
                stack.append((h[~inner], q[dq > mu - radius]))
                continue
        step = max(1, (1 << 21) // len(h))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            i, j = np.nonzero(_bits(home[h][:, None] ^ query[part][None, :]) <= max_bits)
            found(h[i], part[j])


def links(classes: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges (a, b) between the reps of classes (fp, rep) that span every link of at most max_bits bits."""
    spark = classes.sparkSession
    radius, block_masks = max_bits // BLOCKS, masks()
    n = classes.count()
    sample = np.array([r[0] for r in classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(1, n / SHARD)))))
    trees = [fit_tree(sample, m, depth) for m in block_masks]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps, reps = pdf["fp"].to_numpy(np.int64), pdf["rep"].to_numpy(np.int64)
            for b, (mask, tree) in enumerate(zip(block_masks, trees)):
                rows, leaf, home, _ = route(fps.view(np.uint64), tree, mask, radius)
                yield pd.DataFrame({"shard": (leaf * BLOCKS + b).astype(np.int32), "home": home, "fp": fps[rows], "rep": reps[rows]})

    dealt = stored(classes.where("rep is not null").mapInPandas(deal, "shard int, home boolean, fp long, rep long"), "simhash-shards")
    # one row per shard; the number of shards is set by n / SHARD
    parts = {r["shard"]: -(-r["n"] // TILE) for r in dealt.where("home").groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > TILE).collect()}
    tiled = dealt.withColumn("tile", F.lit(0).cast("long")).withColumn("part", F.lit(0).cast("long")).withColumn("parts", F.lit(1).cast("long"))
    if parts:
        g = F.coalesce(F.element_at(F.create_map([F.lit(x).cast("int") for kv in parts.items() for x in kv]), F.col("shard")), F.lit(1)).cast("long")
        part = F.pmod(F.xxhash64("fp"), g)
        # homes of part p meet all parts q >= p as queries, and part p as homes; visitors meet every part
        tiled = (dealt.withColumn("parts", g).withColumn("part", F.when(F.col("home"), part).otherwise(F.lit(-1)))
                 .withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
                 .where("not home or tile <= part"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        b, tile = int(pdf["shard"].iloc[0]) % BLOCKS, pdf["tile"].iloc[0]
        mine = (pdf["home"] & (pdf["part"] == tile)).to_numpy()
        fps, reps = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["rep"].to_numpy(np.int64)
        at, union = np.flatnonzero(mine), Union(len(pdf))
        local_links(fps[at], fps, block_masks[b], radius, max_bits, lambda i, j: union.add(at[i], j))
        label = union.labels()
        rest = np.flatnonzero(label != np.arange(len(pdf)))
        return pd.DataFrame({"a": reps[rest], "b": reps[label[rest]]})

    return stored(tiled.groupBy("shard", "tile").applyInPandas(compare, "a long, b long"), "simhash-edges")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_bits: int = 4, shingle: int = 4) -> DataFrame:
    """One row (id_col, fp, component_id) per row of docs, whatever other columns docs has.

    component_id is the smallest id reachable by links, the row's own included.
    Null, empty and blank texts have fingerprint 0 and link like any other. Rows
    that share an id count as one document, joined through the id. A null id
    keeps its row; it takes the component of its fingerprint's class, null if no
    row of the class has an id. Very long texts are read whole. Empty input
    gives an empty result.
    """
    fps = stored(fingerprints(docs, text_col, id_col, shingle), "simhash-fps")
    classes = stored(fps.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes")
    edges = links(classes, max_bits)
    # an id with several texts joins the classes of all of them
    repeated = fps.where("id is not null").groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("id")
    if not repeated.isEmpty():
        edges = edges.union(fps.join(repeated, "id", "left_semi").join(classes, "fp").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    component = connected_components(edges, "simhash-cc")
    grouped = classes.join(component, classes["rep"] == component["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(grouped, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex_fingerprint(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_bits: int = 4) -> DataFrame:
    """docs with one row of each near-duplicate group: a row of the smallest id, of several the one with the least hash. Rows without an id stay."""
    return first_of_groups(docs, near_duplicates(docs, text_col, id_col, max_bits), id_col)
