"""Rate limits in rounds: what a task is dealt is bounded, and every call is made once."""

import json
import os
import time

from pyspark.sql import functions as F

from quarry.operators import inference
from quarry.operators.inference import Limit


def test_rounds():
    assert list(inference._rounds([("a", 5), ("b", 5), ("c", 1), ("d", 30), ("e", 1)], 10)) == [["a", "b"], ["c"], ["d"], ["e"]]
    assert list(inference._rounds([], 10)) == []


def test_a_task_reads_no_more_than_a_round(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inference, "ROUND_ROWS", 5)
    monkeypatch.setattr(inference, "ROUND_BYTES", 1)
    folder = str(tmp_path)

    def call(text):
        open(f"{folder}/{time.time_ns()}-{os.urandom(4).hex()}", "w").close()
        return {"n": len(text)}

    docs = spark.createDataFrame([(k, None if k == 3 else f"t{k}") for k in range(23)], "id long, text string").coalesce(1)
    found = inference.limited(docs, call, Limit(requests=10, tokens=10**6, period=0.5), tasks=2)
    rows = found.select("id", "answer", F.input_file_name().alias("file")).collect()
    assert {r.id: r.answer for r in rows} == {k: None if k == 3 else json.dumps({"n": len(f"t{k}")}) for k in range(23)} and len(rows) == 23
    assert len({r.file for r in rows}) >= 5 and found.count() == 23
    begun = sorted(int(x.split("-")[0]) for x in os.listdir(folder))
    # two uses of the result, one call a text, and rounds begin no sooner than the period before has ended
    assert len(begun) == 22 and max(sum(0 <= b - a < 500_000_000 for b in begun) for a in begun) <= 11


def test_no_rows_have_no_answers(spark):
    assert inference.limited(spark.createDataFrame([], "id long, text string"), str, Limit()).collect() == []
