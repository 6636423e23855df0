"""Facts of the extraction engine's semantics, on small inputs."""

import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import quarry
from quarry.functions import compare, payload
from quarry.operators import chunking, engines, extraction, results, routing, runner
from quarry.plans import schema, validate
from quarry.sources import files


def test_templates():
    assert schema.field_schema({"type": "array", "items": {"sample": 1}}) == {"type": "array", "items": {"type": "integer"}}
    items = schema.field_schema({"type": "array", "items": {"sku": {"required": True}}})["items"]
    assert "required" not in items and list(items["properties"]) == ["sku"]
    nested = {"o": {"type": "object", "properties": {"a": {"type": "string", "required": True}, "c": {"computed": True}}, "description": "d"}}
    assert schema.template_to_schema(nested)[0]["properties"]["o"] == {"type": "object", "properties": {"a": {"type": "string"}}, "description": "d"}
    made, computed = schema.template_to_schema([{"sku": {"type": "string", "required": True}, "later": {"ComputeField": True}, "n": 1}])
    assert made == {"type": "array", "items": {"type": "object", "properties": {"sku": {"type": "string"}, "n": {"type": "integer"}}, "required": ["sku"]}} and list(computed) == ["later"]
    assert schema.template_to_schema([])[0] == {"type": "array", "items": {"type": "object", "properties": {}}} and schema.infer_schema(object()) == {}
    assert list(schema.BUILT_IN["invoice"]["properties"]) == ["invoice_id", "vendor", "date", "total", "currency", "line_items"]


JSON = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.sampled_from(["x", "1.5"]) | st.just(1.5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "it's"]), x, max_size=3), max_leaves=8)
RULES = [{"type": "object", "required": ["a", "it's"], "properties": {"a": {"type": ["string", "null"]}, "it's": {"type": "array", "items": {"type": "number"}}, "b": {"properties": {"a": {"type": "integer"}}, "required": ["b"]}}},
         {"type": "array", "items": {"type": "object", "required": ["a"]}}, {"type": ["array", "null"], "items": {"type": "string"}}, {"type": "unknown"}, {"required": ["a"]}]


def test_columns_and_rows_validate_alike(spark):
    seen = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(JSON)
    def collect(value):
        seen.append(json.dumps(value))

    collect()
    df = spark.createDataFrame([(t,) for t in sorted(set(seen))], "t string").withColumn("v", F.try_parse_json("t"))
    found = df.select("t", *[validate.errors(F.col("v"), r).alias(f"e{k}") for k, r in enumerate(RULES)]).collect()
    for row in found:
        for k, rule in enumerate(RULES):
            assert (row[f"e{k}"] or []) == validate.violations(json.loads(row.t), rule), (row.t, rule)


def test_kinds_of_large_integers(spark):
    texts = {"12345678901234567890123": "integer", "1": "integer", "1.0": "number", "1.5": "number", "true": "boolean", "null": "null", '"a"': "string"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.k for r in df.select("t", payload.kind(F.try_parse_json("t")).alias("k")).collect()} == texts


def test_strict_objects_and_arrays(spark):
    df = spark.createDataFrame([("[1]",)], "t string")
    assert df.select(payload.parse_object(F.col("t"))).first()[0] is None and df.select(payload.parse_array(F.col("t"), strict=True)).first()[0] == "[1]"
    with pytest.raises(Exception, match="must be an object"):
        df.select(payload.parse_object(F.col("t"), strict=True)).collect()


@pytest.mark.parametrize("text", ["[1,2] garbage", '{"a": 1}', "5"])
def test_chunked_json_must_be_one_array(spark, text):
    with pytest.raises(Exception, match="Extra data|must be an array"):
        spark.createDataFrame([(text,)], "t string").transform(chunking.chunk_json_array("t", max_rows=2)).collect()


@settings(max_examples=40, deadline=None, database=None)
@given(st.integers(1, 9), st.integers(0, 8), st.integers(0, 40))
def test_window_starts(size, overlap, n):
    if overlap < size:
        want, at = [], 0
        while n and (not want or want[-1] + size < n):
            want.append(at)
            at += size - overlap
        assert want == list(range(0, max(n - overlap - 1, 0) + 1, size - overlap))[: len(want)] and (not n or len(want) == len(range(0, max(n - overlap - 1, 0) + 1, size - overlap)))


@pytest.mark.parametrize("size, overlap", [(10, 2), (5, 4), (7, 0), (3, 2), (100, 99)])
def test_windows_equal_slices(spark, size, overlap):
    texts = ["😀é\n" * 9, "a", "ab" * 50, "\r\n" * 7]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rows = df.transform(chunking.chunk_text("t", max_chars=size, overlap=overlap)).collect()
    assert {(r.k, r.idx): (r.start, r.end, r.chunk) for r in rows} == {(k, i): (s, min(s + size, len(t)), t[s : s + size]) for k, t in enumerate(texts) for i, s in enumerate(range(0, max(len(t) - overlap, 1), size - overlap))}
    assert "t" not in rows[0].asDict() and "t" in df.transform(chunking.chunk_text("t", max_chars=size, overlap=overlap, keep_text=True)).columns


def test_long_texts_are_cut_in_linear_time(spark):
    df = spark.range(1).select(F.repeat(F.lit("abcd"), 1_000_000).alias("t"))
    df.transform(chunking.chunk_text("t", max_chars=1000, overlap=100)).count()
    began = time.perf_counter()
    assert df.transform(chunking.chunk_text("t", max_chars=1000, overlap=100)).agg(F.sum(F.length("chunk")), F.count("*")).first()[1] == 4445
    assert time.perf_counter() - began < 4
    heads = spark.range(1).select(F.repeat(F.lit("# h\ntext\n"), 100_000).alias("t")).transform(chunking.chunk_sections("t", max_chars=1000))
    assert heads.agg(F.sum(F.length("chunk"))).first()[0] == 900_000


def test_chunks_to_json_and_resolved(spark):
    df = spark.createDataFrame([("d", '[{"a": 1.0}, {"b": "é"}, 3]')], "doc_id string, text string")
    row = df.transform(chunking.chunk_json_array("text", max_rows=2)).orderBy("idx").select("chunk", chunking.chunk_json().alias("j")).collect()
    assert [r.chunk for r in row] == ['[{"a": 1.0}, {"b": "é"}]', "[3]"]
    assert json.loads(row[1].j) == {"text": "[3]", "index": 1, "start": 2, "end": 3, "strategy": "json_array", "overlap": 0, "metadata": {"unit": "row", "row_start": 2, "row_end": 3}}
    assert chunking.resolve_chunks(df, max_chars=5).count() == 6 and chunking.resolve_chunks(df, chunks=df) is df
    with pytest.raises(ValueError):
        chunking.resolve_chunks(df)


def test_extractors_of_files_and_later_answers(spark):
    class Files:
        extensions = ("txt",)

        async def extract_file(self, path, **_):
            return {"rows": [{"n": len(open(path, encoding="utf-8").read())}]}

    class Pictures(Files):
        extensions = ("png",)

    assert extraction.call(Files(), "abc") == [{"n": 3}]
    with pytest.raises(ValueError):
        extraction.call(Pictures(), "abc")


def test_router_rules(spark, monkeypatch):
    def broken():
        raise OSError

    made = routing.Router([routing.Engine("fenic", ("txt",)), routing.Engine("lift", ("txt", "pdf")), routing.Engine("off", ("md",), None, broken)])
    assert [e.name for e in made.candidates("")] == ["lift", "fenic"] and made.select("txt").name == "fenic"
    monkeypatch.setenv("ENGINE_DEFAULT", "lift")
    assert made.select("txt").name == "lift"
    monkeypatch.setenv("QUARRY_ENGINE", "fenic")
    assert made.select("txt").name == "fenic" and made.select("pdf").name == "lift"
    with pytest.raises(ValueError):
        made.select("md")
    docs = spark.createDataFrame([(1, "", "a"), (1, None, "b"), (2, "PDF", "c"), (3, "xyz", "d")], "doc_id int, ext string, text string")
    assert sorted((r.doc_id, r.engines) for r in made.route(docs).collect()) == [(1, ["lift", "fenic"]), (1, ["lift", "fenic"]), (2, ["lift"]), (3, [])]


def test_batches_tell_their_progress(spark):
    told = []
    made = routing.Router([routing.Engine("fenic", ("txt",), lambda t, s: {"n": 1 // len(t)})])
    docs = spark.createDataFrame([("a", "txt", "x"), ("a", "txt", ""), ("b", "txt", "y")], "doc_id string, ext string, text string")
    found = made.extract_batch(docs, {}, concurrency=2, on_progress=lambda **x: told.append(x))
    assert [x["current"] for x in told] == [1, 2, 3] and {x["total"] for x in told} == {3} and sorted(x["status"] for x in told) == ["failed", "succeeded", "succeeded"]
    assert routing.batch_summary(found).first().failed == 1
    found.unpersist()


def test_provider_and_composite_engines():
    class Answer:
        def model_dump(self):
            return {"data": {"n": 1}, "cost": 2}

    made = engines.provider_engine(lambda **told: Answer() if told["prompt"] == "p!" else "```json\n[1]\n```", prompt_builder=lambda text, **_: text + "!")
    assert made.run("p", {}) == {"data": {"n": 1}, "cost": 2, "metadata": {"provider": "default", "model": "default", "cost": 2}}
    assert made.run("q", {})["data"] == [1] and made.ready() and not engines.provider_engine(None).ready()
    assert not engines.composite_engine(None, made).ready()
    assert engines.questions({"properties": {"total": {}}}) == [{"Text": "What is the total?", "Alias": "total"}]
    assert engines.completion_prompt("t", {}).endswith("JSON:") and engines.message_prompt("t", {})[0]["role"] == "user"
    assert engines.extraction_prompt("t", {}, "document").endswith("Document:\nt")


@pytest.mark.parametrize("predicted, gold, share", [
    ('[{"a": 1, "b": 2}, {"a": 3, "b": 5}]', '[{"a": 1, "b": 2}, {"a": 3, "b": 4}]', 0.75), ('[{"a": 1}, {"b": 9}]', '[{"a": 1}]', 1.0), ("[1, 2]", "[1]", 0.5), ("[{}]", "[{}]", 1.0), ("[]", "[]", 1.0), ("[]", "[1]", 0.0),
    ('[{"a": 1}]', '[{"a": 1}, {"b": 2, "c": 3}]', 1 / 3), ('[[1, 2], {"a": [1]}]', '[[1, 3], {"a": ["1"], "b": {}}]', 1 / 3), ('[{"a": 1}]', "[{}]", 1.0), ("[1]", '[{"a": 1}]', 1.0), ('[{"x": 1}]', '[{"a/b": {"c": 1, "d": 2}}]', 0.0), ("{}", "[]", None)])
def test_alignment_of_lists(spark, predicted, gold, share):
    got = spark.range(1).select(compare.json_alignment(F.lit(predicted), F.lit(gold)).alias("s")).first().s
    assert got == share if share is None else abs(got - share) < 1e-12


@pytest.mark.parametrize("predicted, gold, same", [
    ('{"a": null}', '{"a": "none"}', True), ("{}", '{"a": 1}', False), ("true", '"true"', True), ("true", "1", False), ("1e20", "120", False), ('"1e20"', "120", True), ("1e-07", "0.0000001", True), ("100000000000000000000", "1e20", True),
    ('{"a": {}}', '{"a": {}}', True), ('{"a": {"b": 1}}', '{"a": {}}', False), ('[{"b": 1}]', "[{}]", True), ("[[]]", "[[]]", True), ("[[1]]", "[[]]", False), ('{"a": {"b": 1}}', '{"a": 1}', True), ('{"a": [1]}', '{"a": {"b": 1}}', True),
    ('"05.01.2024"', '"Jan 5, 2024"', True), ('"A  b "', '"a B"', True), ('"-"', '"-"', True), ('"$1,250.00"', "1250", True), (None, "1", None), ("[" * 8 + "7" + "]" * 8, "[" * 8 + '"7"' + "]" * 8, True)])
def test_match_of_nested_values(spark, predicted, gold, same):
    df = spark.createDataFrame([(predicted, gold)], "p string, g string")
    assert df.select(compare.json_match("p", "g").alias("m")).first().m == same


def test_what_is_nested_too_deep_is_an_error(spark):
    deep = F.lit("[" * 9 + "]" * 9)
    with pytest.raises(Exception, match="deeper"):
        spark.range(1).select(compare.json_match(deep, F.lit("[" * 9 + "1" + "]" * 9), depth=6)).collect()


def test_evaluation_folder_to_report(spark, tmp_path):
    bodies = {"predictions/e/x.json": {"a": {"b": [1]}, "t": "y"}, "predictions/f/x.json": {}, "gold/x.json": {"a": {"b": ["1"]}, "t": 2}, "gold/x.schema.json": {"properties": {"t": {"type": "number"}}}, "gold/z.json": {}}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(body))
    told = json.loads(runner.report_json(runner.score_folder(spark, str(tmp_path))))
    assert [(s["engine"], s["field_accuracy"], s["type_correctness"]) for s in told["scores"]] == [("e", 0.5, 0.0), ("f", 0.0, 1.0)]
    assert told["engine_summaries"]["e"]["documents"] == 1.0 and told["timestamp"]
    assert runner.score_folder(spark, str(tmp_path), ["f"]).count() == 1
    (tmp_path / "predictions/e/x.json").write_text("[1]")
    with pytest.raises(Exception, match="Expected a JSON object"):
        runner.score_folder(spark, str(tmp_path)).collect()


def test_result_row_as_json(spark):
    df = spark.createDataFrame([('{"data": {"n": 1.0}, "pages": 2, "metadata": {"m": 1}}', "e")], "p string, engine string")
    row = results.build_results(df, "p", {"type": "object"}).select(results.result_json().alias("j")).first()
    told = json.loads(row.j)
    assert list(told) == list(results.FIELDS) and told["engine_name"] == "e" and told["pages"] == 2 and told["metadata"] == {"m": 1} and told["valid"] is True


def test_agreement_tells_texts_from_numbers(spark):
    df = spark.createDataFrame([("d", "a", '{"x": "5", "y": 1}'), ("d", "b", '{"x": 5, "y": 1}')], "doc_id string, engine string, data string")
    rows = routing.field_agreement(files.json_fields(df, "data", ["doc_id", "engine"], as_json=True)).collect()
    assert {r.field: r.agree for r in rows} == {"x": False, "y": True}


def test_exports():
    assert all(callable(getattr(quarry, name)) for name in quarry.__all__)
