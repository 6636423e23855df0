"""Neighbours in small tables, the query's recall on its whole table, split buckets, joined axes and edges."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from quarry.llm import ann, queries


def test_neighbours_of_small_tables_are_whole(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 8)
    rng = np.random.default_rng(8)
    x = {k: rng.normal(size=64 if k < 15 else 7) for k in range(45)} | {50: rng.normal(size=3)}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in x.items()], "vec_id long, embedding array<double>")
    got = ann.search(df, df).collect()
    for q, v in x.items():
        others = sorted((-float((v * w).sum()), k) for k, w in x.items() if k != q and len(w) == len(v))[:20]
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert len(mine) == len(others) and (len(others) == 20 or mine == [k for _, k in others])


def test_recall_of_the_query(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = {}
    for r in queries.op10_nearest_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    asked = [q for q in rows if q % 20 == 0]
    assert set(got) == set(asked)
    hits = 0
    for q in asked:
        dots = {i: float((rows[q] * v).sum()) for i, v in rows.items() if i != q}
        best = sorted(dots, key=lambda i: (-dots[i], i))[:20]
        assert sorted(got[q]) == list(range(1, len(best) + 1)) and all(abs(dots[i] - s) < 1e-12 for i, s in got[q].values())
        assert [got[q][k] for k in sorted(got[q])] == sorted(got[q].values(), key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in got[q].values()} & set(best))
    assert hits >= 0.9 * 20 * len(asked)


@pytest.mark.parametrize("block, axes", [(16, 1), (16_384, 2), (16, 2)])
def test_split_buckets_and_joined_axes(spark, monkeypatch, block, axes):
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 32))
    x = np.concatenate([c + 0.15 * rng.normal(size=(30, 32)) for c in centres])
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r.vec_id) for r in ann.search(df, df, 5, axes=axes).collect()}
    dots = x @ x.T
    np.fill_diagonal(dots, -np.inf)
    want = {(q, int(i)) for q in range(len(x)) for i in np.argsort(-dots[q])[:5]}
    assert len(got) == len(want) and len(got & want) >= 0.97 * len(want)


def recall(spark, x, k=20, **options):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    asked = df.where("vec_id % 20 = 0")
    x = x.astype(np.float32).astype(float)
    dots = x[::20] @ x.T
    dots[np.arange(len(dots)), np.arange(len(dots)) * 20] = -np.inf
    want = {(int(q) * 20, int(i)) for q in range(len(dots)) for i in np.argsort(-dots[q], kind="stable")[:k]}
    got = {(r.query_id, r.vec_id) for r in ann.search(df, asked, k, **options).collect()}
    assert len(got) == len(want)
    return len(got & want) / len(want)


@pytest.mark.parametrize("axes", [1, 2, 3])
def test_recall_holds_whatever_axes_may_join(spark, axes):
    """The given vectors have no near neighbours: keys that join axes would find a fifth of them, and the plan knows."""
    path = "/root/testdata/sf0.1/embeddings.parquet"
    x = np.array([r.embedding for r in spark.read.parquet(path).orderBy("vec_id").collect()])
    assert recall(spark, x, axes=axes) >= 0.9


def test_plans_follow_the_vectors():
    rng = np.random.default_rng(6)
    plain = rng.normal(size=(2000, 64))
    near = np.repeat(rng.normal(size=(60, 64)), 40, axis=0) + 0.1 * rng.normal(size=(2400, 64))
    assert ann.measured(plain, 3, 20, 12)[0] == 1 and ann.measured(near, 2, 20, 12)[0] == 2
    assert ann.measured(plain[:50], 2, 20, 12) == (1, 128)  # few vectors: all keys


def test_axes_that_may_join_grow_with_the_vectors():
    assert [ann.joined(n, 64) for n in (0, 500, 51_282, 2_000_000, 3_000_000, 10**9)] == [1, 1, 1, 1, 2, 3]


def test_search_edges(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit("a")).withColumn("score", F.lit(1)).withColumn("x", F.lit(2))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, df.where("vec_id = 2")).collect())
    assert got == [(2, 1, 3, 1.0), (2, 2, 1, 0.5)]
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0
