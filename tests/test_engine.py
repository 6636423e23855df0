"""The engine's queries beside DuckDB, and facts of the semantics on small inputs."""

import json

import pytest
from conftest import SF
from oracle import compare
from pyspark.sql import functions as F

from quarry import queries, queries_calls  # noqa: F401  the second adds to the first's queries
from quarry.functions import payload, text
from quarry.operators import chunking, extraction, routing
from quarry.plans import schema, validate


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    assert compare(spark, name, queries.QUERIES[name], queries.ORACLE[name], SF) == ""


def test_windows_of_letters(spark):
    df = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz"), (2, ""), (3, None)], "doc_id int, text string")
    rows = df.transform(chunking.chunk_text("text", max_chars=10, overlap=2)).orderBy("idx").collect()
    assert [(r["doc_id"], r["start"], r["end"], r["overlap"]) for r in rows] == [(1, 0, 10, 0), (1, 8, 18, 2), (1, 16, 26, 2)]


def test_sections_and_fallback(spark):
    df = spark.createDataFrame([(1, "# A\none\n\n# B\ntwo\n\n# C\nthree"), (2, "plain text without headings")], "doc_id int, text string")
    rows = df.transform(chunking.chunk_sections("text", max_chars=18)).orderBy("doc_id", "idx").collect()
    assert [(r["doc_id"], r["start"], r["strategy"]) for r in rows] == [(1, 0, "section"), (1, 18, "section"), (2, 0, "text"), (2, 18, "text")]


@pytest.mark.parametrize("size, overlap", [(0, 0), (5, -1), (5, 5)])
def test_bad_windows(size, overlap):
    with pytest.raises(ValueError):
        chunking.chunk_text("text", max_chars=size, overlap=overlap)


def test_payloads(spark):
    cases = {'{"a": 1}': '{"a": 1}', '```json\n[1]\n```': "[1]", 'Sure: {"a": 1} ok': '{"a": 1}', "[{\"a\": 1}] and {": '[{"a": 1}]', "nothing": None, '{"a":1} x': '{"a":1}', "5": "5", "": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.p for r in df.select("t", payload.parse_json_payload(F.col("t")).alias("p")).collect()} == cases


def test_values_match(spark):
    pairs = [("2024-01-05", "January 5, 2024", True), ("$1,250.00", "1250", True), (" Acme  Corp ", "acme corp", True), ("INV-001", "ABC-1", True), ("a", "b", False), (None, None, True), (None, "a", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.where(~text.values_match(F.col("a"), F.col("b")).eqNullSafe(F.col("want"))).count() == 0


def test_schemas(tmp_path):
    assert schema.infer_schema({"v": "x", "t": 1.5, "n": 3, "p": False, "z": None, "l": [{"a": 1}], "e": []})["properties"]["e"] == {"type": "array", "items": {}}
    made, computed = schema.template_to_schema({"status": {"type": "string", "required": True, "enum": ["a"]}, "score": {"computed": True}})
    assert made == {"type": "object", "properties": {"status": {"type": "string", "enum": ["a"]}}, "required": ["status"]} and "score" in computed
    (tmp_path / "s.json").write_text('{"type": "object"}')
    assert schema.load_schema(str(tmp_path / "s.json")) == {"type": "object"}
    with pytest.raises(ValueError):
        schema.load_schema("unknown")
    wrapped = schema.rows_wrapper({"type": "object"})
    assert schema.rows_wrapper(wrapped) == wrapped
    assert schema.spark_type(schema.BUILT_IN["invoice"])["line_items"].dataType.elementType["amount"].dataType.simpleString() == "double"


def test_validation_of_unions_and_nulls(spark):
    rules = {"type": "object", "properties": {"a": {"type": ["string", "null"]}, "o": {"type": ["object", "null"], "properties": {"x": {"type": "number"}}}}}
    data = ['{"a": null}', '{"a": 1}', '{"o": null}', '{"o": {"x": "1"}}']
    df = spark.createDataFrame([(k, d) for k, d in enumerate(data)], "k int, d string")
    found = {r.k: r.e for r in df.select("k", validate.errors(F.try_parse_json("d"), rules).alias("e")).collect()}
    assert found == {0: [], 1: ["$.a: expected ['string', 'null'], got int"], 2: ["$.o: expected object, got NoneType"], 3: ["$.o.x: expected number, got str"]}


def test_chunked_extraction_with_failure(spark):
    chunks = spark.createDataFrame([("d", k, t) for k, t in enumerate(["1,2", "bad", "2,3"])], "doc_id string, idx int, chunk string")

    def extractor(text, previous_digest=None):
        return [{"id": int(x)} for x in text.split(",")]

    for sequential in (False, True):
        results = extraction.extract_chunks(chunks, extractor, sequential=sequential)
        report = extraction.document_report(results).first()
        assert (report.succeeded_chunks, report.failed_chunks, report.partial, report.rows_extracted, report.duplicates_removed) == (2, 1, True, 3, 1)
        assert extraction.collected_rows(results).first().rows == ['{"id":1}', '{"id":2}', '{"id":3}']
    with pytest.raises(Exception, match="ValueError"):
        extraction.require_success(results).collect()


def test_router_falls_back_and_agrees(spark):
    def broken(text, schema):
        raise RuntimeError("down")

    router = routing.Router([routing.Engine("lift", ("txt",), broken), routing.Engine("fenic", ("txt",), lambda t, s: {"n": len(t)}), routing.Engine("off", ("txt",), None, False)])
    docs = spark.createDataFrame([(1, "txt", "abc"), (2, "xyz", "abc")], "doc_id int, ext string, text string")
    rows = {r.doc_id: r for r in router.extract(docs, {}).collect()}
    assert rows[1].engine == "fenic" and json.loads(rows[1].data) == {"n": 3}
    assert rows[2].engine is None and rows[2].error == "no engine"
    assert router.extract(docs, {}, hint="lift").where("error is not null").count() == 2
    assert router.compare(docs, {}, ["lift", "fenic"]).count() == 2
    with pytest.raises(ValueError):
        router.get("none")
    with pytest.raises(RuntimeError):
        router.select("txt", "off")
    assert routing.batch_summary(router.extract(docs, {})).first().success_rate == 0.5


def test_stream_of_documents(spark, tmp_path):
    from quarry.streaming import ingest

    spark.createDataFrame([(1, "a" * 25)], "doc_id long, text string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000))).write.parquet(str(tmp_path / "in"))
    chunks = ingest.chunk_stream(ingest.read_stream(spark, str(tmp_path / "in")), max_chars=10)
    ingest.write_each(chunks, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_evaluation_folder(spark, tmp_path):
    from quarry.sources import files

    for name, body in {"predictions/e/x.json": {"a": 1}, "gold/x.json": {"a": 1}, "gold/x.schema.json": {"type": "object"}, "gold/y.json": {}}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(body))
    row = files.read_evaluation(spark, str(tmp_path)).collect()
    assert [(r.engine, r.name, json.loads(r.schema)) for r in row] == [("e", "x", {"type": "object"})]
