"""Answers of models as text: strict JSON in the JVM, results of fenced, prose and quoted payloads, documents without chunks, the ledger."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import payload as P
from quarry.operators import decoders, engines, extraction, results

SCHEMA = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}


def strictly(text):
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def test_strict_json_equals_the_standard_parser(spark):
    rng = random.Random(5)
    atoms = ["1", "-2.5", "1e9", '"a"', '"x]y"', '"}{"', '"\\""', '"\\u00e9\\\\"', "true", "null", '""', '"é"', "NaN", "-Infinity", "01", "1.", '"\t"', "'a'", "tru", '"\\x"', ".5"]

    def value(depth=0):
        if depth > 3 or rng.random() < 0.4:
            return rng.choice(atoms)
        if rng.random() < 0.5:
            return "[" + ",".join(value(depth + 1) for _ in range(rng.randint(0, 3))) + "]"
        return "{" + ",".join(rng.choice(['"a"', '"b"', '"]"', "a"]) + ": " + value(depth + 1) for _ in range(rng.randint(0, 3))) + "}"

    def broken(text):
        at = rng.randint(0, len(text))
        return text[:at] + rng.choice(["]", "}", "[", "{", ",", " ", '"', "]],[[", '}, {"v":2', "1", "\n", "/*x*/", "\\"]) + text[at:]

    texts = {value() for _ in range(2000)} | {broken(value()) for _ in range(2000)} | {"", " ", "1], [2", '1}, {"v":2', "1] }", "[1]]", '{"a":1} x', "[1] [2]", '"a" "b"', '{"a":1,"a":2}', " [1]\n", "[" * 200 + "]" * 200}
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.strict_json(F.col("t")).alias("g")).collect()
    assert {r.t for r in found if r.g is not None} == {t for t in texts if strictly(t)} and all(r.g in (None, r.t) for r in found)


@pytest.mark.parametrize("text, want", [
    ('```json\n{"n": 1}\n```', {"n": 1}), ('Here it is: {"n": 5} ok', {"n": 5}), (json.dumps('{"n": 2}'), {"n": 2}), (json.dumps('```\n{"n": 3}\n```'), {"n": 3}), ('[{"n": 1}] {', {"rows": [{"n": 1}]}),
    ('{"fields": {"n": {"value": 4}}}', {"n": 4}), ('{"data": null, "result": {"n": 6}}', {"n": 6}), ('{"rows": [1], "data": {"n": 1}}', {"rows": [1]}), ('{"fields": {}, "data": [1]}', {}), ('{"data": {"rows": 1}}', {"rows": 1}),
    ('{"fields": {"n": 4}, "extraction": []}', {"rows": []}), ("nothing", None), ("7", None), ('"7"', None), ('"words"', None), (None, None), ("", None)])
def test_data_of_text_payloads(spark, text, want):
    row = spark.createDataFrame([(text,)], "p string").select(P.normalize_envelopes("p").alias("d")).first()
    assert (row.d and json.loads(row.d)) == want or (want == {} and row.d == "{}")


def test_results_of_text_payloads(spark):
    texts = ['```json\n{"data": {"n": "1 pc"}, "pages": 2, "metadata": {"m": [1.0]}, "provenance": {"n": {"page": 1}}}\n```', 'So: {"fields": {"n": {"value": 5, "confidence": 0.5, "page": 3}, "x": {"value": null, "confidence": "no"}}, "pages": true} ok', json.dumps('{"n": 2}'), "no"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, p string")
    rows = {r.k: r for r in results.build_results(df, "p", SCHEMA).collect()}
    assert [json.loads(rows[k].data) for k in range(3)] == [{"n": 1}, {"n": 5, "x": None}, {"n": 2}] and [rows[k].valid for k in range(4)] == [True, True, True, False]
    assert rows[0].pages == 2 and rows[0].metadata == '{"m":[1.0]}' and rows[0].provenance == {"n": '{"page":1}'} and rows[1].field_confidence == {"n": 0.5}
    assert rows[1].provenance == {"n": '{"page":3}'} and rows[1].pages is None and rows[3].errors == ["$: no payload"] and rows[3].field_confidence == {}


def test_engines_share_the_parser():
    made = engines.provider_engine(lambda **told: 'Here it is: {"n": 5} ok')
    assert made.run("t", {})["data"] == {"n": 5}
    with pytest.raises(ValueError, match="Could not parse JSON payload"):
        engines.provider_engine(lambda **told: "none").run("t", {})


def test_documents_without_chunks_have_results(spark):
    docs = spark.createDataFrame([(1, "abc def"), (2, ""), (3, None), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in extraction.extract_rows_chunked(docs, [{"n": 1}], lambda text: [{"n": len(text)}], max_chars=4).collect()}
    assert sorted(rows) == [1, 2, 3] and json.loads(rows[1].data) == {"rows": [{"n": 4}, {"n": 3}]}
    for k in (2, 3):
        assert (rows[k].data, rows[k].valid, rows[k].total_chunks, rows[k].partial, rows[k].errors) == ('{"rows":[]}', True, 0, False, []) and json.loads(rows[k].metadata)["chunks"] == []
    assert extraction.extract_rows_chunked(docs.limit(0), [{"n": 1}], lambda text: [], max_chars=4).count() == 0


def test_chunks_are_told_and_tell(spark):
    docs = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")

    def extractor(text, chunk, previous_digest=None):
        return {"rows": [{"n": chunk["start"]}], "metadata": {"seen": [chunk["index"], chunk["end"], chunk["strategy"], previous_digest is None]}}

    row = extraction.extract_rows_chunked(docs, [{"n": 1}], extractor, max_chars=5, overlap=1, sequential=True, engine_name="e").first()
    told = json.loads(row.metadata)["chunks"]
    assert [(c["idx"], c["start"], c["end"], c["strategy"], c["overlap"], c["metadata"]["seen"]) for c in told] == [(0, 0, 5, "text", 0, [0, 5, "text", True]), (1, 4, 8, "text", 1, [1, 8, "text", False])]
    assert all(c["processing_time_ms"] >= 0 and c["engine_name"] == "e" for c in told)
    whole = extraction.extract_rows(docs, [{"n": 1}], lambda text: {"rows": [], "metadata": {"cost": 3, "row_schema": "theirs"}}).first()
    assert json.loads(whole.metadata)["cost"] == 3 and isinstance(json.loads(whole.metadata)["row_schema"], dict)


def test_the_first_failure_fails_the_run(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")

    def broken(text):
        raise KeyError("k")

    with pytest.raises(Exception, match="KeyError"):
        extraction.extract_rows_chunked(docs, [{"n": 1}], broken, max_chars=5).collect()
    assert extraction.extract_rows_chunked(docs, [{"n": 1}], broken, max_chars=5, continue_on_error=True).first().failed_chunks == 1


def test_a_broken_run_repeats_no_finished_call(spark, tmp_path):
    """Half of the tasks die for good; the next run asks for what is missing only."""
    calls, ledger, off = str(tmp_path / "calls"), str(tmp_path / "ledger"), str(tmp_path / "off")
    os.mkdir(calls)
    open(off, "w").close()

    def extractor(text):
        if os.path.exists(off) and int(text) % 40 == 39:
            os._exit(1)  # as an executor that is lost
        if text == "17":
            raise ValueError("odd")
        with open(f"{calls}/{text}-{os.urandom(4).hex()}", "w"):
            return [{"n": int(text)}]

    chunks = spark.createDataFrame([(k // 10, k % 10, str(k)) for k in range(200)] + [(20, 0, "5")], "doc_id long, idx int, chunk string")
    with pytest.raises(Exception):
        extraction.answered(chunks, extractor, ledger, parts=6).collect()
    kept = set(spark.read.parquet(ledger).toPandas()["rows"]) if os.path.isdir(ledger) else set()
    os.remove(off)
    rows = extraction.answered(chunks, extractor, ledger, parts=6).collect()
    assert len(rows) == 201 and all(json.loads(r.rows) == [{"n": 5 if r.doc_id == 20 else r.doc_id * 10 + r.idx}] for r in rows if r.rows)
    assert [(r.doc_id, r.idx, r.error_type) for r in rows if r.rows is None] == [(1, 7, "ValueError")]
    made = [x.split("-")[0] for x in os.listdir(calls)]
    # what the ledger held was not asked again; a third run asks for the failure alone
    assert all(made.count(str(json.loads(x)[0]["n"])) == 1 for x in kept)
    before = len(made)
    assert extraction.answered(chunks, extractor, ledger).where("rows is null").count() == 1 and len(os.listdir(calls)) == before
    with pytest.raises(ValueError):
        extraction.answered(chunks, lambda text, chunk: [], ledger)


def test_ledger_in_chunked_results(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abcabc"), (2, "abc"), (3, "")], "doc_id long, text string")
    folder = str(tmp_path / "calls")
    os.mkdir(folder)

    def extractor(text):
        open(f"{folder}/{os.urandom(8).hex()}", "w").close()
        return [{"n": len(text)}]

    for _ in range(2):
        got = {r.doc_id: (r.data, r.total_chunks) for r in extraction.extract_rows_chunked(docs, [{"n": 1}], extractor, max_chars=3, ledger=str(tmp_path / "ledger")).collect()}
        assert got == {1: ('{"rows":[{"n":3}]}', 2), 2: ('{"rows":[{"n":3}]}', 1), 3: ('{"rows":[]}', 0)}
        assert len(os.listdir(folder)) == 1


def test_decoders_keep_types(spark):
    df = spark.createDataFrame([(1, '{"fields": {"a": {"value": 5}, "b": {"value": "5"}, "c": 5, "d": "5", "e": {"value": null}, "f": {"value": [1], "confidence": true}, "g": {"page": 1}}}')], "k long, p string")
    assert {r.field: (r.value, r.confidence, r.provenance) for r in decoders.decode_fields(df, "p", "k").collect()} == {
        "a": ("5", None, None), "b": ('"5"', None, None), "c": ("5", None, None), "d": ('"5"', None, None), "e": (None, None, None), "f": ("[1]", None, None), "g": (None, None, '{"page":1}')}
    df = spark.createDataFrame([(1, '{"entities": [{"type": "a", "normalized_value": null, "value": 3}, {"name": "b", "mention_text": "7", "value": 7, "page": 2}, {"type": "", "value": 1}]}')], "k long, p string")
    assert {r.field: (r.value, r.provenance) for r in decoders.decode_entities(df, "p", "k").collect()} == {"a": (None, None), "b": ('"7"', '{"page":2}')}


def test_each_step_of_a_payload_stands_once_in_the_plan(spark):
    answer = F.col("t")
    plan = spark.createDataFrame([("x",)], "t string").select(P.parse_json_payload(answer))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 2 and plan.count("regexp_extract(") <= 2


def test_a_text_that_holds_the_sign_of_the_end_is_read_right(spark):
    texts = [f'"{P._END}"', f'1,"{P._END}"', f'1,"{P._END}"] and', f'{{"a": "{P._END}"}}', f'[1] "{P._END}"', f'[1,"{P._END}"]']
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.strict_json(F.col("t")).alias("g")).collect()
    assert [r.t for r in found if r.g is not None] == [texts[0], texts[3], texts[5]]
