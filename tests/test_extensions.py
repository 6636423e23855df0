"""Table functions, the data source of folders, counts of the pass that writes, and merged reports."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, progress, reports
from quarry.sources import folders
from quarry.sql import table_functions


@pytest.fixture
def folder(spark, tmp_path):
    folders.register(spark)
    bodies = {f"predictions/{e}/{n}.json": {"e": e, "n": n} for e in ("one", "two") for n in range(150)} | {f"gold/{n}.json": {"n": n} for n in range(149)} | {"gold/3.schema.json": {"type": "object"}}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(body))
    return tmp_path


def test_evaluation_source_reads_what_the_reader_reads(spark, folder):
    from quarry.sources.files import read_evaluation

    df = spark.read.format("extraction_evaluation").load(str(folder))
    columns = ["engine", "name", "predicted", "gold", "schema"]
    want = sorted(tuple(r) for r in read_evaluation(spark, str(folder)).select(columns).fillna("", ["schema"]).collect())
    assert sorted(tuple(r) for r in df.select(columns).fillna("", ["schema"]).collect()) == want and len(want) == 298
    assert df.rdd.getNumPartitions() == 5


def test_a_filter_opens_that_engines_files_only(spark, folder):
    df = spark.read.format("extraction_evaluation").load(str(folder))
    for bad in folder.glob("predictions/two/*.json"):  # opening one of these would fail
        bad.chmod(0)
        bad.unlink()
        bad.mkdir()
        (bad / "x").write_text("")
    one = df.where("engine = 'one' and name in ('3', '4', '149')").orderBy("name").collect()
    assert [(r.engine, r.name, json.loads(r.predicted)["n"], r.schema) for r in one] == [("one", "3", 3, '{"type": "object"}'), ("one", "4", 4, None)]


def test_partitions_are_planned_after_the_filter():
    names = [f"predictions/e{k}/{n}.json" for k in range(3) for n in range(100)] + [f"gold/{n}.json" for n in range(100)]

    class Source(folders.EvaluationSource):
        options = {"path": "x"}

        def __init__(self):
            pass

    reading = folders._Reading(Source())
    left = list(reading.pushed([folders.EqualTo(("engine",), "e1"), folders.In(("name",), ("5", "6", "none")), folders.EqualTo(("gold",), "x")]))
    assert [f.attribute for f in left] == [("gold",)] and [[(r["engine"], r["name"]) for r in p.rows] for p in reading.planned(names)] == [[("e1", "5"), ("e1", "6")]]


def test_cases_are_written_and_read(spark, tmp_path):
    folders.register(spark)
    rows = [(f"c{k}", None, f"text {k} é", '{"type": "object"}', json.dumps({"k": k})) for k in range(5)]
    df = spark.createDataFrame(rows, "name string, document string, text string, schema string, gold string").repartition(3)
    df.write.format("extraction_cases").mode("append").save(str(tmp_path))
    got = spark.read.format("extraction_cases").load(str(tmp_path)).orderBy("name").collect()
    assert [(r.name, r.document, r.text, r.schema, r.gold) for r in got] == [(n, f"{n}.txt", t, s, g) for n, _, t, s, g in rows]
    assert not [x for x in tmp_path.iterdir() if x.name.startswith("_")]
    with pytest.raises(Exception, match="append"):
        df.write.format("extraction_cases").mode("overwrite").save(str(tmp_path))
    # a job that fails shows none of its files
    broken = df.withColumn("gold", F.when(F.col("name") == "c4", F.raise_error(F.lit("no"))).otherwise(F.col("gold"))).withColumn("name", F.concat(F.lit("x"), "name"))
    with pytest.raises(Exception, match="no"):
        broken.write.format("extraction_cases").mode("append").save(str(tmp_path))
    assert spark.read.format("extraction_cases").load(str(tmp_path)).count() == 5


def test_evaluations_as_a_stream(spark, folder, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    (folder / "gold" / "149.json").unlink(missing_ok=True)

    def run(rows):
        query = spark.readStream.format("extraction_evaluation").load(str(folder)).select("engine", "name").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        for _ in range(100):
            time.sleep(0.5)
            if query.lastProgress and spark.read.schema("engine string, name string").parquet(out).count() >= rows:
                break
        query.stop()

    run(298)
    assert spark.read.parquet(out).count() == 298
    (folder / "gold/149.json").write_text("{}")
    run(300)
    rows = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert len(rows) == len(set(rows)) == 300


@pytest.mark.parametrize("size, overlap", [(10, 2), (3, 0), (7, 6), (100, 5)])
def test_chunk_functions_equal_the_transforms(spark, size, overlap):
    table_functions.register(spark)
    texts = ["abcdefghijklmnopqrstuvwxyz", "", None, "# A\n12345\n## B\n1234567890123\n### C\nx", "pre<h1>a</h1>b<H2 x>c", "é" * 23]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, body string")
    df.createOrReplaceTempView("bodies")
    for function, transform in (("chunk_text", chunking.chunk_text), ("chunk_sections", chunking.chunk_sections)):
        columns = ["id", "idx", "start", "end", "overlap", "strategy", "chunk", "unit"]
        got = spark.sql(f"select * from {function}(table(bodies), 'body', {size}, {overlap})").select(columns)
        want = df.transform(transform("body", max_chars=size, overlap=overlap)).select(columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), function


def test_row_windows(spark):
    table_functions.register(spark)
    spark.createDataFrame([(k % 2, k, f"v{k}") for k in range(9)], "g long, k long, v string").createOrReplaceTempView("lines")
    rows = spark.sql("select g, idx, row_start, row_end, overlap, chunk from chunk_rows(table(lines) partition by (g) order by (k), 3, 1, 'g')").collect()
    assert sorted((r.g, r.idx, r.row_start, r.row_end, r.overlap, [x["k"] for x in json.loads(r.chunk)]) for r in rows) == [(0, 0, 0, 3, 0, [0, 2, 4]), (0, 1, 2, 5, 1, [4, 6, 8]), (1, 0, 0, 3, 0, [1, 3, 5]), (1, 1, 2, 4, 1, [5, 7])]
    for bad in ("0, 0", "3, 3", "3, -1"):
        with pytest.raises(Exception):
            spark.sql(f"select * from chunk_rows(table(lines) partition by (g) order by (k), {bad})").collect()
    with pytest.raises(Exception, match="no column"):
        spark.sql("select * from chunk_text(table(lines), 'none', 5)").collect()


def test_counts_come_from_the_pass_that_writes(spark, tmp_path):
    told, marks = [], str(tmp_path / "rows")

    def slow(batches):
        for b in batches:
            time.sleep(0.4)
            with open(marks, "a") as f:
                f.write("x" * b.num_rows)
            yield b

    df = spark.range(40).repartition(8).withColumn("error", F.when(F.col("id") % 10 == 3, F.lit("odd"))).mapInArrow(slow, "id long, error string")
    found = progress.write_counted(df, str(tmp_path / "out"), on_progress=lambda **x: told.append(x), every=0.05)
    assert found == {"total": 40, "succeeded": 36, "failed": 4} and spark.read.parquet(str(tmp_path / "out")).count() == 40
    assert len(open(marks).read()) == 40  # the rows were made once
    assert told[-1] == {"current": 40, "failed": 4, "done": True} and 0 < told[0]["current"] < 40 and len(told) >= 2
    assert progress.write_counted(df.limit(0), str(tmp_path / "none")) == {"total": 0, "succeeded": 0, "failed": 0}


def test_merged_reports_equal_one_report(spark):
    rng = np.random.default_rng(1)
    rows = [(f"e{k % 3}", None if k % 7 == 0 else f"c{k % 2}", float(k % 5) / 4, int(rng.integers(0, 10_000)), k % 4) for k in range(20_000)]
    df = spark.createDataFrame(rows, "engine string, document_class string, f1 double, latency_ms long, run long")
    whole = reports.shown(reports.cube(df, metrics=["f1"]))
    parts = reports.shown(reports.merged([reports.cube(df.where(F.col("run") == k), metrics=["f1"]) for k in range(4)]))
    key = lambda r: (r.engine or "", r.document_class or "", r.level)
    a, b = sorted(whole.collect(), key=key), sorted(parts.collect(), key=key)
    # three engines, two classes and a null one: 12 cells of all four levels, and the null class apart from the sum
    assert len(a) == len(b) == 16
    for x, y in zip(a, b):
        own = sorted(r[3] for r in rows if (x.level & 2 or r[0] == x.engine) and (x.level & 1 or r[1] == x.document_class))
        assert (x.documents, x.timed) == (y.documents, y.timed) == (len(own), len(own)) and abs(x.f1 - y.f1) < 1e-9
        for got in (x, y):
            for q, v in ((0.5, got.latency_p50), (0.9, got.latency_p90), (0.99, got.latency_p99)):
                assert abs(np.searchsorted(own, v) / len(own) - q) < 0.0266  # twice the sketch's error, as ranks are taken from either side


def test_a_report_without_latencies(spark):
    df = spark.createDataFrame([("e", "c", 1.0, None)], "engine string, document_class string, f1 double, latency_ms long")
    row = reports.shown(reports.cube(df, metrics=["f1"])).where("level = 3").first()
    assert (row.documents, row.f1, row.timed, row.latency_p50) == (1, 1.0, 0, None)
