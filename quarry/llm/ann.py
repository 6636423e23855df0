"""Approximate nearest neighbours by cross-polytope hashing.

A table turns a unit vector by three rounds of random signs and a fast Hadamard
transform (vectors are padded to a power of two) and assigns it to the nearest
signed axis. One axis has 2d values; beyond some 2d * BLOCK vectors a key may
join as many axes of independent rotations as keep buckets near BLOCK vectors,
so that a query's work does not grow with the table. How many axes it joins, and
how many of the keys nearest to it a query probes in each of TABLES tables, is
measured: of all plans whose recall on a sample of the vectors reaches GOAL the
one is taken that reads the smallest share of them. Neighbours are nearer in the
whole table than in a sample, so the sample's recall is a lower bound. Vectors
without structure get one axis and as many probes as it takes, up to all keys,
which is an exact search. The vectors in the probed buckets are ranked by exact
inner product of the original vectors. A bucket with more than BLOCK vectors or
queries is cut into blocks of either. Tasks return no more than k rows a query,
ties included only in order of id. Queries that find fewer than k this way,
though more vectors have their dimension, are ranked over all of those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored
from quarry.llm.embedding_dedup import pack, usable

TABLES = 12
#: Keys that a query probes in a table, at least; plans try this and its multiples.
PROBES = 12
MULTIPLES = (1, 2, 4, 16)
#: Recall that a plan must reach on the sample.
GOAL = 0.95
#: Vectors of a dimension that plans are measured on, at most, their components together, and queries among them.
SAMPLE, COMPONENTS, ASKED = 4096, 1 << 21, 100
#: Dimensions that are measured, those of the most vectors; queries of others probe all keys.
DIMENSIONS = 16
#: Vectors, or queries, of a bucket that one task ranks at once, about.
BLOCK = 16_384
#: Rows of the small buckets that one group holds, about.
SLOT = 32_768


def joined(n: int, dimension: int) -> int:
    """Axes that a key joins for n vectors: as few as leave BLOCK vectors or fewer to a bucket on average."""
    return max(1, math.ceil(math.log(max(1, n / BLOCK)) / math.log(2 << max(0, (dimension - 1).bit_length()))))


def rotations(x: np.ndarray, tables: int) -> Iterator[np.ndarray]:
    """x under each table's pseudo-rotation; rows are padded to a power of two."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), d))
    padded[:, : x.shape[1]] = x
    rng = np.random.default_rng([d, 20150908])
    for _ in range(tables):
        y = padded
        for _ in range(3):
            y = y * rng.choice([-1.0, 1.0], d)
            h = 1
            while h < d:
                y = y.reshape(len(x), -1, 2, h)
                y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), d)
                h *= 2
            y = y / np.sqrt(d)
        yield y


def nearest_axes(y: np.ndarray, probes: int) -> np.ndarray:
    """The probes signed axes nearest to each row, nearest first: axis, or dimension + axis for its negative."""
    both = np.concatenate([y, -y], axis=1)
    probes = min(probes, both.shape[1])
    top = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, 1), axis=1, kind="stable"), 1)


def probed_keys(turned: list[np.ndarray], probes: int) -> np.ndarray:
    """The probes keys of one signed axis from each of the turned copies of the rows, those of the largest sums first."""
    keys, sums = np.zeros((len(turned[0]), 1), np.int64), np.zeros((len(turned[0]), 1))
    for y in turned:
        axes = nearest_axes(y, probes)
        values = np.take_along_axis(np.concatenate([y, -y], axis=1), axes, 1)
        every = (sums[:, :, None] + values[:, None, :]).reshape(len(y), -1)
        codes = (keys[:, :, None] * (2 * y.shape[1]) + axes[:, None, :]).reshape(len(y), -1)
        best = np.argsort(-every, axis=1, kind="stable")[:, :probes]
        keys, sums = np.take_along_axis(codes, best, 1), np.take_along_axis(every, best, 1)
    return keys


def measured(x: np.ndarray, most_axes: int, k: int, tables: int) -> tuple[int, int]:
    """(axes, probes) of the plan that reads the smallest share of a sample of vectors with a recall of GOAL; few vectors probe all keys of one axis."""
    everything = 1, 2 << max(0, (x.shape[1] - 1).bit_length())
    if len(x) <= 4 * k:
        return everything
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    asked = np.arange(min(ASKED, len(x)))
    dots = x[asked] @ x.T
    dots[asked, asked] = -np.inf
    best = np.argpartition(-dots, k - 1, axis=1)[:, :k]
    plans = [(1.0, *everything)]
    for axes in range(1, most_axes + 1):
        turned = list(rotations(unit, tables * axes))
        groups = [turned[t * axes : (t + 1) * axes] for t in range(tables)]
        keys = [probed_keys(g, 1)[:, 0] for g in groups]
        wide = [probed_keys([y[asked] for y in g], min(PROBES * MULTIPLES[-1], everything[1] ** axes)) for g in groups]
        for probes in (PROBES * m for m in MULTIPLES):
            reached = np.zeros(dots.shape, bool)
            for own, probed in zip(keys, wide):
                for row, some in zip(reached, probed):
                    row |= np.isin(own, some[:probes])
            if np.take_along_axis(reached, best, 1).mean() >= GOAL:
                plans.append((float(reached.mean()), axes, probes))
                break  # more probes read more
    return min(plans)[1:]


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double, the same for the same two vectors wherever they stand."""
    return (a * b).sum(axis=1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           tables: int = TABLES, axes: int | None = None) -> DataFrame:
    """(query_id, rank, id_col, score): the k vectors found with the largest inner product, other than the query's own.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null id, take no part; a query meets vectors of its own
    dimension only. Rows that share an id are one vector, the smallest. Ties
    go to the smaller id. A query has k rows, or all vectors of its dimension if
    they are fewer; one that is alone with its dimension has no row. Other
    columns are ignored, whatever their names. No vectors or no queries give an
    empty result. A key joins no more than axes axes, by default as joined() says;
    how many it joins is measured.
    """

    def one_each(df: DataFrame) -> DataFrame:
        rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
        return rows if rows.groupBy("id").count().where("count > 1").isEmpty() else rows.groupBy("id").agg(F.min("v").alias("v"))

    base = one_each(vectors)
    n = base.count()
    # rows carry vectors at the width they came in
    kind = "f4" if all(df.schema[vector_col].dataType.elementType.typeName() == "float" for df in (vectors, queries)) else "f8"

    dims = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(DIMENSIONS).collect()
    plans = {}
    for dim, count in dims:
        rows = min(SAMPLE, COMPONENTS // dim + 1)
        # some rows more, as hashes stray; no more than the sample come
        drawn = base.where((F.size("v") == dim) & (F.pmod(F.xxhash64("id"), F.lit(1 << 32)) < min(1.0, 1.5 * rows / count) * (1 << 32)))
        sample = drawn.orderBy(F.xxhash64("id"), "id").limit(rows).select("v").toPandas()
        plans[dim] = measured(np.array(sample["v"].tolist(), float), axes or joined(count, dim), k, tables)

    def prepared(df: DataFrame, name: str, asks: bool) -> DataFrame:
        def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at, x in pack(pdf["v"]):
                    unit = x / np.abs(x).max(axis=1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    each, probes = plans.get(x.shape[1], (1, 2 << max(0, (x.shape[1] - 1).bit_length())))
                    most = probes if asks else 1
                    turns = rotations(unit, tables * each)
                    keys = np.concatenate([t * 2**48 + probed_keys([next(turns) for _ in range(each)], most) for t in range(tables)], axis=1)
                    yield pd.DataFrame({"id": pdf["id"].to_numpy()[at], "dim": np.int32(x.shape[1]), "x": [r.tobytes() for r in x.astype(kind)], "keys": list(keys)})

        return stored(df.mapInPandas(hashed, "id long, dim int, x binary, keys array<long>"), name)

    index, asked = prepared(base, "ann-index", False), prepared(one_each(queries), "ann-queries", True)

    def places(df: DataFrame, asks: bool) -> DataFrame:
        return df.select("id", "dim", "x", F.explode("keys").alias("bucket")).withColumn("asks", F.lit(asks))

    # buckets of many vectors or queries; all others stay whole
    sizes = index.select("dim", F.explode("keys").alias("bucket"), F.lit(1).alias("v")).union(asked.select("dim", F.explode("keys").alias("bucket"), F.lit(0).alias("v")))
    sizes = sizes.groupBy("dim", "bucket").agg(F.greatest(F.ceil(F.sum("v") / BLOCK), F.lit(1)).alias("blocks"), F.greatest(F.ceil(F.sum(1 - F.col("v")) / BLOCK), F.lit(1)).alias("parts"))
    large = stored(sizes.where("blocks > 1 or parts > 1"), "ann-large")
    slots = max(1, n * tables // SLOT)
    whole_slot = F.pmod(F.xxhash64("bucket"), F.lit(slots))

    def dealt(df: DataFrame, asks: bool) -> DataFrame:
        """df's rows in groups (dim, slot, block, part): vectors in their block for every part of the queries, and queries the other way round."""
        mine, other = ("parts", "blocks") if asks else ("blocks", "parts")
        own, every = F.pmod(F.xxhash64("id"), F.col(mine)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        return df.select("dim", F.xxhash64("bucket").alias("slot"), *([every.alias("block"), own.alias("part")] if asks else [own.alias("block"), every.alias("part")]), "bucket", "asks", "id", "x")

    if large.isEmpty():
        met = places(index, False).union(places(asked, True)).select("dim", whole_slot.alias("slot"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("part"), "bucket", "asks", "id", "x")
    else:
        split = ["dim", "bucket"]
        small = places(index, False).union(places(asked, True)).join(large.select(*split), split, "left_anti")
        met = small.select("dim", whole_slot.alias("slot"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("part"), "bucket", "asks", "id", "x")
        met = met.union(dealt(places(index, False).join(large, split), False)).union(dealt(places(asked, True).join(large, split), True))

    def merged(asked_ids: np.ndarray, own_ids: np.ndarray, scores: np.ndarray) -> tuple:
        """The k best distinct vectors of each query among rows."""
        order = np.lexsort((own_ids, -scores, asked_ids))
        q, o, s = asked_ids[order], own_ids[order], scores[order]
        if len(q):
            fresh = np.concatenate([[True], (q[1:] != q[:-1]) | (o[1:] != o[:-1])])
            q, o, s = q[fresh], o[fresh], s[fresh]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        return q[place < k], o[place < k], s[place < k]

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, asks, ids = pdf["bucket"].to_numpy(), pdf["asks"].to_numpy(), pdf["id"].to_numpy()
        x = np.frombuffer(b"".join(pdf["x"]), kind).reshape(len(pdf), -1)
        order = np.lexsort((asks, bucket))
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        held: list[tuple] = []
        for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            mine, others = rows[asks[rows]], rows[~asks[rows]]
            own, theirs = ids[others], x[others].astype(np.float64)
            for at in range(0, len(mine) if len(own) else 0, 256):
                part_ids, part = ids[mine[at : at + 256]], x[mine[at : at + 256]].astype(np.float64)
                dots = part @ theirs.T
                dots[part_ids[:, None] == own[None, :]] = -np.inf
                if len(own) > k:
                    last = -np.partition(-dots, k - 1, axis=1)[:, k - 1]
                    i, j = np.nonzero(dots >= (last - 1e-9 * (1 + np.abs(last)))[:, None])
                else:
                    i, j = np.nonzero(dots > -np.inf)
                keep = np.isfinite(dots[i, j])
                i, j = i[keep], j[keep]
                held.append((part_ids[i], own[j], exact_scores(part[i], theirs[j])))
                if sum(len(h[0]) for h in held) > 1 << 20:
                    held = [merged(*map(np.concatenate, zip(*held)))]
        if held:
            out = merged(*map(np.concatenate, zip(*held)))
        cuts = np.flatnonzero(np.diff(out[0])) + 1
        some = [0][: len(out[0])]
        lists = lambda x: pd.Series(np.split(x, cuts) if len(x) else [], dtype=object)
        return pd.DataFrame({"query_id": out[0][np.concatenate([some, cuts]).astype(int)], "ids": lists(out[1]), "scores": lists(out[2])})

    ranked, group = "query_id long, ids array<long>, scores array<double>", ("dim", "slot", "block", "part")
    found = stored(met.groupBy(*group).applyInPandas(rank, ranked), "ann-found")
    # queries short of k are ranked over every vector of their dimension, in blocks
    counted = found.select("query_id", F.explode("ids").alias("id")).distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    whole = stored(index.groupBy("dim").agg(F.count("*").alias("all"), F.ceil(F.count("*") / BLOCK).alias("blocks")), "ann-dimensions")
    own = index.select("id", "dim", F.lit(1).alias("own"))
    short = (asked.select("id", "dim", "x").join(whole, "dim").join(own, ["id", "dim"], "left").join(counted, F.col("id") == F.col("query_id"), "left")
             .where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), F.col("all") - F.coalesce("own", F.lit(0)))))
    short = stored(short.select("dim", "blocks", "id", "x"), "ann-short")
    if not short.isEmpty():
        none = F.lit(0).cast("long")
        asking = short.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        rest = dealt(index.join(whole, "dim").join(asking, "dim").select("dim", "blocks", "parts", none.alias("bucket"), F.lit(False).alias("asks"), "id", "x"), False)
        again = dealt(short.join(asking, "dim").select("dim", "blocks", "parts", none.alias("bucket"), F.lit(True).alias("asks"), "id", "x"), True)
        found = found.union(rest.union(again).groupBy(*group).applyInPandas(rank, ranked))
    # a list of k from each of the tables * probes buckets of a query, or of its blocks, at most
    best = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("c")).groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_set(F.struct((-F.col("c.scores")).alias("less"), F.col("c.ids").alias("id")))), 1, k).alias("top"))
    return best.select("query_id", F.posexplode("top").alias("at", "c")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("c.id").alias(id_col), (-F.col("c.less")).alias("score"))
