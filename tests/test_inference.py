"""Models of a worker, batches under a budget, and rate limits over one and four tasks."""

import json
import os
import time

import pytest
from conftest import SF
from pyspark.sql import functions as F

from quarry.operators import inference
from quarry.operators.inference import Limit, Model


def stamped(folder, content=""):
    path = f"{folder}/{time.time_ns()}-{os.getpid()}-{os.urandom(4).hex()}"
    with open(path, "w") as f:
        f.write(content)


def counting_model(folder):
    """Notes every time it is built and every batch it gets."""

    def factory():
        os.makedirs(f"{folder}/built", exist_ok=True)
        os.makedirs(f"{folder}/batches", exist_ok=True)
        stamped(f"{folder}/built", str(os.getpid()))

        def model(texts):
            stamped(f"{folder}/batches", json.dumps([len(t) for t in texts]))
            return [{"n": len(t)} for t in texts]

        return model

    return factory


def read(folder):
    return [open(f"{folder}/{x}").read() for x in sorted(os.listdir(folder))]


def test_a_model_is_built_once_a_worker_and_gets_batches_under_its_budget(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(12)
    found = inference.infer(docs, Model(counting_model(str(tmp_path)), budget=5000, tokens=len)).collect()
    assert len(found) == docs.count() and all(json.loads(r.answer) == {"n": len(r.text)} and r.error is None for r in found)
    built = read(tmp_path / "built")
    # twelve tasks on four threads: a worker process runs several
    assert len(built) == len(set(built)) <= 4
    sizes = [json.loads(x) for x in read(tmp_path / "batches")]
    assert sum(map(len, sizes)) == len(found) and all(len(x) * max(x) <= 5000 or len(x) == 1 for x in sizes)
    assert max(map(len, sizes)) > 3 and {r.batch_tokens for r in found} == {len(x) * max(x) for x in sizes}


def test_batches_of():
    assert list(inference.batches_of([5, 1, 1, 9, 30], 10)) == [[1, 2, 0][:2], [0], [3], [4]]
    assert list(inference.batches_of([], 10)) == [] and sorted(x for b in inference.batches_of([3] * 100, 10) for x in b) == list(range(100))


def test_windows_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(inference, "WINDOW_ROWS", 4)
    monkeypatch.setattr(inference, "WINDOW_CHARACTERS", 10)
    texts = ["a", "b", "c", "d", "e", "x" * 50, None, "y" * 9, "zz", ""]
    batches = [pa.RecordBatch.from_pydict({"text": texts[:3]}), pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())}), pa.RecordBatch.from_pydict({"text": texts[3:]})]
    got = [t.column("text").to_pylist() for t in inference._windows(iter(batches), "text")]
    assert got == [["a", "b", "c", "d"], ["e"], ["x" * 50, None][:1], [None, "y" * 9], ["zz", ""]]


def test_failures_nulls_and_clashes(spark):
    def factory():
        def model(texts):
            if any(t == "bad" for t in texts):
                raise RuntimeError("no")
            return texts if "short" not in texts else []

        return model

    docs = spark.createDataFrame([(1, "bad"), (2, "good"), (3, None), (4, ""), (5, "x" * 100_000), (5, "x" * 100_000)], "id long, text string").coalesce(1)
    rows = sorted(inference.infer(docs, Model(factory, budget=10**9)).collect(), key=lambda r: r.id)
    assert [(r.id, r.answer if r.id != 5 else len(r.answer), r.error_type, r.error) for r in rows] == [(1, None, "RuntimeError", "no"), (2, "good", None, None), (3, None, None, None), (4, "", None, None), (5, 100_000, None, None), (5, 100_000, None, None)]
    assert inference.infer(docs.where("id = 2").select("id", F.lit("short").alias("text")), Model(factory)).first().error == "The model gave 0 answers to 1 texts"
    assert inference.infer(docs.limit(0), Model(factory)).count() == 0
    with pytest.raises(ValueError, match="answer"):
        inference.infer(docs.withColumn("Answer", F.lit(1)), Model(factory))


def test_prompt_makes_what_is_asked(spark):
    docs = spark.createDataFrame([(1, "a")], "id long, text string")
    assert inference.infer(docs, Model(lambda: lambda texts: [t.upper() for t in texts]), prompt=lambda t: f"<{t}>").first().answer == "<A>"


def test_schedule_is_fair_and_within_the_limit():
    assert inference.schedule([[1] * 9, [1], [], [1] * 9], 8, 100, 0) == [[0, 3, 5, 7], [1], [], [2, 4, 6]]
    assert inference.schedule([[1] * 9, [1] * 9], 3, 100, 1) == [[1], [0, 2]]
    # the first waits with its large call, the second goes on
    assert inference.schedule([[60, 60], [30, 5, 5]], 10, 100, 0) == [[0], [1, 2, 3]]
    assert inference.schedule([[100], [1]], 10, 100, 0) == [[0], []]


@pytest.mark.parametrize("tasks", [1, 4])
def test_the_limit_holds_whatever_the_tasks(spark, tmp_path, tasks):
    folder = str(tmp_path)

    async def call(text):
        stamped(folder, text)
        if text == "t7":
            raise ValueError("seven")
        return {"n": len(text)}

    docs = spark.createDataFrame([(k, None if k == 3 else f"t{k}") for k in range(25)], "id long, text string")
    rows = sorted(inference.limited(docs, call, Limit(requests=10, tokens=10**6, period=1.0), tasks=tasks).collect(), key=lambda r: r.id)
    assert [(r.id, r.answer, r.error_type) for r in rows] == [(k, None if k in (3, 7) else json.dumps({"n": len(f"t{k}")}), "ValueError" if k == 7 else None) for k in range(25)]
    begun = sorted(int(x.split("-")[0]) for x in os.listdir(folder))
    assert len(begun) == 24
    # in any second ten calls begin, and one more where a task's clock is late
    assert max(sum(0 <= b - a < 1_000_000_000 for b in begun) for a in begun) <= 11
    assert begun[-1] - begun[0] >= 2_000_000_000


def test_tokens_a_period_hold(spark, tmp_path):
    folder = str(tmp_path)

    def call(text):
        stamped(folder, str(len(text)))
        return text

    docs = spark.createDataFrame([(k, "x" * (40 if k % 3 else 90)) for k in range(9)] + [(9, "y" * 500)], "id long, text string")
    assert inference.limited(docs, call, Limit(requests=1000, tokens=100, period=0.5), tokens=len, tasks=2).where("answer is null").count() == 0
    begun = sorted((int(x.split("-")[0]), min(100, int(open(f"{folder}/{x}").read()))) for x in os.listdir(folder))
    # periods of half a second hold 100 tokens each; a stretch of a quarter meets two periods at most
    assert max(sum(n for t, n in begun if 0 <= t - a < 250_000_000) for a, _ in begun) <= 200 and (begun[-1][0] - begun[0][0]) / 1e9 >= 0.5 * (sum(n for _, n in begun) // 100 - 1)
