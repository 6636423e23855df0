"""The pipeline's near-dedup stage against Jaccard similarity over all pairs."""

import numpy as np
import pytest
from conftest import SF
from test_operators import components, docs_of

import corpus_pipeline
from quarry.llm import copies


def words(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return frozenset(" ".join(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def test_stage_equals_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    rows = sorted((r.doc_id, words(r.text)) for r in docs.collect())
    near = [(i, j) for i, (_, a) in enumerate(rows) for j, (_, b) in enumerate(rows[:i]) if len(a & b) >= 0.8 * len(a | b)]
    label = components(len(rows), near)
    want = {rows[k][0] for k in range(len(rows)) if label[k] == k}
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()} == want
    monkeypatch.setattr(copies, "GROUP", 64)
    monkeypatch.setattr(copies, "SHARD", 64)
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()} == want


def test_stage_drops_planted_near_copies(spark):
    rng, rows = np.random.default_rng(6), []
    for k in range(120):
        w = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((k, " ".join(w)))
        for at in (30, 70, 110, 150)[: 1 + k % 4]:
            w[at] = "changed"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000, None), (2001, " "), (2002, "only three words"), (2003, "Only three  words"), (None, "only three words")]
    docs = docs_of(spark, [(i, t, "s") for i, t in rows])
    kept = sorted(r.doc_id or 0 for r in corpus_pipeline.drop_copies(spark, docs, SF).collect())
    assert kept == sorted([*range(120), 2000, 2002, 0])
    assert corpus_pipeline.drop_copies(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("tile", [copies.TILE, 8])
def test_tiles_find_all_links(spark, monkeypatch, tile):
    monkeypatch.setattr(copies, "TILE", tile)
    base = [f"w{x}" for x in range(300)]
    docs = docs_of(spark, [(k, " ".join(base[:k] + ["other"] + base[k + 1 :]), "s") for k in range(90)])
    assert {r.component_id for r in copies.near_duplicates(docs).collect()} == {0}


def test_wide_fingerprints_equal_brute_force():
    for n in (0, 1, 2, 254, 255, 256, 900):
        found = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        rng = np.random.default_rng(20020519)
        first, second = ([int(c) * 2 + 1 for c in rng.integers(0, 2**63, 5, dtype=np.uint64)] for _ in range(2))
        want = []
        for f, s in zip(first, second):
            drawn = []
            for h in map(int, found):
                x = h * f % 2**64
                x ^= x >> 32
                x = x * s % 2**64
                drawn.append(x ^ x >> 29)
            want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in drawn) > len(found)))
        assert copies.wide_fingerprint(found, 5).tolist() == want


def test_design_holds_its_recall():
    rng = np.random.default_rng(1)
    bits, blocks = copies.design(200_000)
    words, hits = -(-max(copies.SKETCH, bits * blocks) // 64), 0
    for _ in range(200):
        a = rng.integers(0, 2**63, 180).astype(np.uint64)
        b = np.concatenate([rng.integers(0, 2**63, 20).astype(np.uint64), a[20:]])
        pair = np.stack([copies.wide_fingerprint(np.unique(x), words) for x in (a, b)])
        near = any(int(np.bitwise_count(v[0] ^ v[1])) <= copies.RADIUS for v in copies.block_values(pair, bits, blocks))
        hits += near and len(copies.met(list(pair.T), np.array([0]), np.array([1]), [copies.reach(0.8, 64 * k) for k in (1, 2, 3)])[0])
    assert hits >= 199


def test_shards_find_all_near_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, (40, 3)).astype(np.uint64)
    words = np.repeat(centres, 30, axis=0)
    words[1::2, 0] ^= np.uint64(1) << rng.integers(0, 60, 600).astype(np.uint64)
    values = words[:, 0] & np.uint64(4095)
    most, everyone = [20, 35, 49], np.arange(len(words))
    union = copies.Union(len(words))
    copies.near_pairs(everyone, everyone, values, list(map(np.ascontiguousarray, words.T)), 4095, most, union)
    label = union.labels()
    assert (label == np.repeat(np.arange(40) * 30, 30)).all()
    hot = copies.Union(5000)
    copies.near_pairs(np.arange(5000), np.arange(5000), np.zeros(5000, np.uint64), [np.repeat(centres[:2, k], 2500) for k in range(3)], 4095, most, hot)
    assert (hot.labels() == np.repeat([0, 2500], 2500)).all()


def test_linked_sets_equal_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.integers(0, 2**63, k % 30).astype(np.uint64), base[k % 30 :]])) for k in range(60)] + [np.empty(0, np.uint64)] * 2
    i, j = copies.linked(sets, 0.8)
    near = [(a, b) for a in range(60) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    assert components(62, list(zip(i.tolist(), j.tolist()))) == components(62, near) and set(zip(np.maximum(i, j).tolist(), np.minimum(i, j).tolist())) <= set(near)
