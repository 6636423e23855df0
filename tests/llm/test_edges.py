"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, where other tests don't cover them; fingerprints and scores by brute force."""

import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F
from test_operators import docs_of

import corpus_pipeline
from quarry.llm import common, mixing, pii, queries, simhash, toxicity

ROWS = [(1, None, "s"), (2, "", "s"), (3, "plain text of a few words", None), (3, "plain text of a few words", None), (None, "plain text of a few words", "t"), (5, "word " * 200_000, "t"), (6, "mail a@b.com", "s")]


def labels_of(spark):
    return spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")


def test_fingerprints_equal_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op1_simhash_near_dedup(spark, SF).collect():
        w = "".join(c.lower() if c.isascii() else c for c in texts[r.doc_id]).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ")
        w = [x for x in w if x]
        hashes = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert int(r.fingerprint, 16) == want and len(r.fingerprint) == 16


def test_scores_equal_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    known = sorted(r.doc_id for r in labels.collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    weights, bias, slope, shift = toxicity.fit_calibrated([texts[i] for i in known], np.array([toxic[i] for i in known]))
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        clean = 1.0
        for _, _, words in toxicity.sentences(text):
            z = bias + sum(float(weights[f]) for w in words for f in toxicity.features(w))
            clean *= 1 - 1 / (1 + np.exp(-z))
        odds = np.log(max(1 - clean, 1e-12) / max(clean, 1e-16))
        want = 1 / (1 + np.exp(-(slope * odds + shift))) if toxicity.sentences(text) else 0.0
        assert abs(got[i].score - want) < 1e-3 and got[i].predicted == int(got[i].score >= 0.3)


def test_toxicity_edges(spark):
    docs = docs_of(spark, ROWS).withColumn("toxicity", F.lit("mine")).withColumn("score", F.lit(1)).withColumn("y", F.lit(2))
    got = toxicity.classify(docs, labels_of(spark))
    assert got.count() == len(ROWS) and {r.score for r in got.collect() if r.doc_id in (1, 2)} == {0.0} and len({r.score for r in got.collect() if r.doc_id == 3}) == 1
    kept = toxicity.drop_toxic(docs, labels_of(spark))
    assert kept.columns == docs.columns and {r.toxicity for r in kept.collect()} == {"mine"}
    with pytest.raises(ValueError):
        toxicity.score(docs, toxicity.train(docs, labels_of(spark)))
    assert toxicity.drop_toxic(docs.limit(0), labels_of(spark)).count() == 0 and toxicity.classify(docs, labels_of(spark).limit(0)).count() == len(ROWS)


def test_toxicity_trains_within_its_bounds(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit_calibrated", lambda texts, y: seen.append((texts, list(y))))
    docs = docs_of(spark, [(0, "b" * 10, "s"), (0, "a" * 10, "s"), (1, "c" * 10, "s"), (4, "d" * 500, "s"), (6, None, "s")])
    toxicity.train(docs, labels_of(spark), characters=30)
    toxicity.train(docs, labels_of(spark))
    assert {t for t in seen[0][0]} == {"a" * 10, "c" * 10, None} and len(seen[1][0]) == 4 and seen[1][1] == [0, 1, 0, 0]


def test_pii_columns(spark):
    docs = docs_of(spark, ROWS).withColumn("pii", F.lit("mine")).withColumn("found", F.lit(1)).withColumn("id", F.lit(2))
    assert pii.redact(docs).where("doc_id = 6").first().text == "mail [EMAIL]" and {r.pii for r in pii.redact(docs).collect()} == {"mine"}
    assert pii.digest(docs).count() == len(ROWS)
    with pytest.raises(ValueError):
        pii.find(docs)


def test_first_rows_do_not_depend_on_order(spark):
    rows = [(1, "one text here for all", "a"), (1, "one text here for all", "b"), (2, "one text here for all", "c"), (None, "one text here for all", "d")]
    kept = [sorted((r.doc_id or 0, r.source) for r in simhash.drop_near_duplicates(docs_of(spark, x)).collect()) for x in (rows, rows[::-1])]
    assert kept[0] == kept[1] and len(kept[0]) == 2


def test_repeated_rows_and_clashes_in_the_mix(spark):
    rows = [(None, "a b c", "s")] * 30 + [(k, "a b c d", "s") for k in range(5)] + [(7, "x " * 50_000, "t"), (8, None, None), (9, "", "t")]
    docs = docs_of(spark, rows).withColumn("size", F.lit("mine")).withColumn("key", F.lit(1)).withColumn("copies", F.lit(2)).withColumn("target", F.lit(3))
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    got = Counter()
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id] += len((r.text or "").split())
        assert r["size"] == "mine"
    assert +got == +taken
    assert mixing.repeated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_at_their_edges(spark, k, tmp_path):
    name, stage = corpus_pipeline.STAGES[k]
    labels_of(spark).withColumn("toxic", F.lit(0)).write.parquet(str(tmp_path / "labels.parquet"))
    docs = docs_of(spark, ROWS).withColumn("toxicity", F.lit(1)).withColumn("pii", F.lit(2)).withColumn("component_id", F.lit(3)).withColumn("length", F.lit(4)).withColumn("size", F.lit(5))
    out = stage(spark, docs, str(tmp_path))
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    if k < 4:
        assert out.columns == docs.columns, name
    assert out.count() == {0: 7, 1: 5, 2: 7}.get(k, out.count()) and out.where("doc_id = 5").count() >= 1


def test_no_local_folder_on_a_cluster():
    def session(master, conf=None, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf or default), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: folder))

    assert common.shared_root(session("spark://h:7077", "hdfs:/shared/")) == "hdfs:/shared" and common.shared_root(session("yarn", None, "hdfs:/given/1")) == "hdfs:/given/1"
    assert common.shared_root(session("local[4]")).startswith("file:///")
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_root(session(master))


def test_scratch_deletes_what_it_stored(spark):
    outer = common.stored(spark.range(3), "outer")
    with common.scratch(spark):
        inner = common.stored(spark.range(4), "inner")
        assert inner.count() == 4
    assert outer.count() == 3 and inner.quarry_path not in common._written
    common.discard(outer)
    assert outer.quarry_path not in common._written
