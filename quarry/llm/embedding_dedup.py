"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised; a table's key is K quantised random projections
floor((a.x + b) / WIDTH). Equal vectors are one class with a multiplicity.
Vectors that share a key in any table meet in two steps. First their buckets
hold ids and short sketches only, the signs of SKETCH random projections; a
vector with another one in reach of its sketch is marked. Only the marked ones
are then sent, with their vectors, and compared exactly. A pair that meets in
several tables is counted in the first one only, as every row carries its keys
of the tables before. A bucket over TILE rows becomes a triangle of tiles, so
that a hot bucket is spread over many tasks. Tasks return counts and a spanning
forest of the links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Union, connected_components, stored

#: Quantisation width of the projections of unit vectors.
WIDTH = 2.0
#: Chance that a pair at the threshold meets in some table.
RECALL = 0.9995
#: Vectors of unrelated directions that share a bucket, about.
BUCKET = 1024
#: Bits of a sketch, in words of 64.
SKETCH = 128
#: Standard deviations over the mean that the sketches of a pair at the threshold may differ: it is missed with a chance of about 1e-8.
SLACK = 6
#: Rows of a bucket whose sketches one task compares; those of a larger one are all marked.
ROOM = 16_384
#: Rows of a tile's side.
TILE = 2048
#: Rows of the small buckets that one group holds, about.
SLOT = 32_768


def usable(vector: F.Column) -> F.Column:
    """True for vectors without null or non-finite components that are not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def meet(distance: float, width: float = WIDTH) -> float:
    """The chance that two points at a Euclidean distance share one quantised projection (Datar et al., 2004)."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def design(n: int, threshold: float) -> tuple[int, int]:
    """(projections a key, tables) for n vectors: buckets hold about BUCKET unrelated vectors, recall is RECALL."""
    near, far = meet(math.sqrt(2 - 2 * threshold)), meet(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(1, n / BUCKET)) / -math.log(far)))
    return k, math.ceil(math.log(1 - RECALL) / math.log(1 - near**k))


def bucket_keys(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Keys (rows, tables) as 64-bit integers of the unit vectors x; the dimension is part of the key."""
    rng = np.random.default_rng([x.shape[1], 20040608])
    a, b = rng.standard_normal((x.shape[1], k * tables)), rng.uniform(0, WIDTH, k * tables)
    cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), tables, k)
    odd = rng.integers(0, 2**63, k, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (cells * odd).sum(axis=2, dtype=np.uint64) + np.uint64(x.shape[1] * 0x9E3779B97F4A7C15 % 2**64)
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def pack(vectors: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a batch as (positions, matrix of doubles), one for each dimension."""
    size = vectors.map(len).to_numpy()
    return [(at, np.stack([np.asarray(v, np.float64) for v in vectors.iloc[at]])) for d in np.unique(size) if len(at := np.flatnonzero(size == d))]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of a matrix of doubles scaled to length 1; by their largest component first, so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sketches(x: np.ndarray) -> np.ndarray:
    """The signs of SKETCH random projections of each row, as words of 64 bits."""
    rng = np.random.default_rng([x.shape[1], 20020519])
    return np.packbits(x @ rng.standard_normal((x.shape[1], SKETCH)) > 0, axis=1).view(np.uint64)


def reach(threshold: float) -> int:
    """Bits in which the sketches of a pair at the threshold differ, at most but for a chance of about 1e-8."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return min(SKETCH, math.ceil(SKETCH * p + SLACK * math.sqrt(SKETCH * p * (1 - p))))


def marked(hashed: DataFrame, n: int, tables: int, threshold: float) -> DataFrame:
    """(id, t, key): the places in buckets where a vector has another one in reach of its sketch."""
    places = hashed.select("id", "sketch", F.posexplode("keys").alias("t", "key"))
    large = stored(places.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > ROOM).select("t", "key"), "embedding-large")
    most, slots = reach(threshold), max(1, n * tables // SLOT)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        t, key = pdf["t"].to_numpy(), pdf["key"].to_numpy()
        words = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), -1)
        hit = np.zeros(len(pdf), bool)
        order = np.lexsort((key, t))
        for rows in np.split(order, np.flatnonzero(np.diff(key[order]) | np.diff(t[order])) + 1):
            own = [np.ascontiguousarray(words[rows, k]) for k in range(words.shape[1])]
            found = np.zeros(len(rows), bool)
            step = max(1, (1 << 20) // len(rows))
            for at in range(0, len(rows) - 1, step):
                apart = sum(np.bitwise_count(w[at : at + step, None] ^ w[None, at:]) for w in own)
                near = np.triu(apart <= most, 1)
                found[at : at + near.shape[0]] |= near.any(axis=1)
                found[at:] |= near.any(axis=0)
            hit[rows] = found
        return pdf.loc[hit, ["id", "t", "key"]]

    small = places.join(large, ["t", "key"], "left_anti").withColumn("slot", F.pmod(F.xxhash64("t", "key"), F.lit(slots)))
    near = small.groupBy("slot").applyInPandas(compare, "id long, t int, key long")
    return near.union(places.join(large, ["t", "key"]).select("id", "t", "key"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row (id_col, n_links, component_id, kept) for every id.

    n_links counts the other vectors linked directly, component_id is the
    smallest id reachable, kept is id = component_id. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing; nor do
    vectors of different dimension. Rows that share an id are one vector, the
    smallest; equal vectors (ties) link with each other. Each row with a null id
    is kept with no links and null component. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable(F.col(vector_col)), F.col(vector_col)).alias("v"))
    unique = source.where("id is not null")
    if not unique.groupBy("id").count().where("count > 1").isEmpty():
        unique = unique.groupBy("id").agg(F.min("v").alias("v"))
    valid = stored(unique.where("v is not null").withColumn("h", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))), "embedding-valid")
    classes = stored(valid.groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("m")), "embedding-classes")
    n, members = classes.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    k, tables = design(n, threshold)
    # one vector of each class takes part, at the width it came in
    taking = valid.select("id", "v").withColumn("m", F.lit(1).cast("long")) if n == members else valid.select("id", "v").join(classes.select("id", "m"), "id")
    kind = "f4" if valid.schema["v"].dataType.elementType.typeName() == "float" else "f8"

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, x in pack(pdf["v"]):
                u = unit(x)
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[at], "m": pdf["m"].to_numpy()[at], "x": [r.tobytes() for r in x.astype(kind)], "keys": list(bucket_keys(u, k, tables)), "sketch": [r.tobytes() for r in sketches(u)]})

    rows = stored(taking.mapInPandas(hashed, "id long, m long, x binary, keys array<long>, sketch binary"), "embedding-hashed")
    near = stored(marked(rows.select("id", "sketch", "keys"), n, tables, threshold), "embedding-marked")
    # buckets of one vector need no task; g parts of a bucket make tiles (i, j), i <= j
    sizes = near.groupBy("t", "key").agg(F.count("*").alias("n"))
    slots = max(1, near.count() // (SLOT // 4))
    shared = near.join(sizes, ["t", "key"]).groupBy("id").agg(F.collect_list(F.struct("t", "key", "n")).alias("at"))  # a place a table at most
    placed = rows.join(shared, "id").select("id", "m", "x", "keys", F.inline("at")).withColumn("g", F.ceil(F.col("n") / TILE)).withColumn("part", F.pmod(F.xxhash64("id"), F.col("g")))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))
    bucket = F.xxhash64("t", "key")
    placed = placed.select(F.when(F.col("g") > 1, bucket).otherwise(F.pmod(bucket, F.lit(slots))).alias("slot"), F.explode(tiles).alias("tile"), "t", "key", "part", "id", "m", "x", F.slice("keys", F.lit(1), F.col("t")).alias("before"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["tile"].iloc[0]["i"]), int(pdf["tile"].iloc[0]["j"])
        t, key, part, ids, m = (pdf[c].to_numpy() for c in ("t", "key", "part", "id", "m"))
        before, xs = pdf["before"].to_numpy(), pdf["x"].to_numpy()
        count, union = np.zeros(len(pdf), np.int64), Union(len(pdf))
        order = np.lexsort((key, t))
        ends = np.flatnonzero(np.diff(key[order]) | np.diff(t[order])) + 1
        for rows in np.split(order, ends):
            if len(rows) < 2:
                continue
            x, met = unit(np.frombuffer(b"".join(xs[rows]), kind).reshape(len(rows), -1).astype(np.float64)), np.stack(before[rows])
            left, right = np.flatnonzero(part[rows] == i), np.flatnonzero(part[rows] == j)
            for at in range(0, len(left), 256):
                a = left[at : at + 256]
                p, q = np.nonzero(x[a] @ x[right].T >= threshold)
                p, q = a[p], right[q]
                if i == j:
                    once = p < q
                    p, q = p[once], q[once]
                for earlier in range(met.shape[1]):
                    if not len(p):
                        break
                    apart = met[p, earlier] != met[q, earlier]
                    p, q = p[apart], q[apart]
                p, q = rows[p], rows[q]
                if len(p):
                    np.add.at(count, p, m[q])
                    np.add.at(count, q, m[p])
                    union.add(p, q)
        label, hit = union.labels(), np.flatnonzero(count)
        return pd.DataFrame({"id": ids[hit], "n": count[hit], "root": ids[label[hit]]})

    found = stored(placed.groupBy("slot", "tile").applyInPandas(compare, "id long, n long, root long"), "embedding-links")
    component = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "embedding-cc")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    linked = counts.join(component.withColumnRenamed("node", "id"), "id", "left")
    if n == members:
        out = unique.select("id").join(linked, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    else:
        # members of a class have its links and each other
        each = classes.join(linked, "id", "left").where("m > 1 or n is not null").select("h", "m", "n", F.coalesce("component", "id").alias("component"))
        placed_ids = valid.select("id", "h").join(each, "h").select("id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), "component")
        out = unique.select("id").join(placed_ids, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    nulls = source.where("id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(nulls).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
