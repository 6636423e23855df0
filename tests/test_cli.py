"""The command line, results and the benchmark harness with engines that answer from a rule."""

import json

import pytest
from pyspark.sql import functions as F

from quarry import cli
from quarry.operators import benchmark, results
from quarry.operators.routing import Engine, Router
from quarry.plans.validate import violations
from quarry.sources.files import read_cases

INVOICE = {"type": "object", "required": ["invoice_id", "total"], "properties": {"invoice_id": {"type": "string"}, "total": {"type": "number"}, "paid": {"type": "boolean"}}}


def answering(total, **more):
    return lambda text, schema: {"data": {"invoice_id": text.strip(), "total": total}, **more}


@pytest.fixture
def stub(monkeypatch):
    made = Router([Engine("one", ("txt",), answering("$125.50", metadata={"processing_time_ms": 7, "cost_usd": 0.01})), Engine("two", ("txt",), answering(120.0))])
    monkeypatch.setattr(cli, "build_router", lambda clients=None: made)
    return made


@pytest.fixture
def invoice(tmp_path):
    (tmp_path / "inv.txt").write_text("INV-001\n")
    (tmp_path / "inv.schema.json").write_text(json.dumps(INVOICE))
    (tmp_path / "inv.gold.json").write_text('{"invoice_id": "inv-001", "total": 125.5}')
    (tmp_path / "alone.schema.json").write_text("{}")
    return tmp_path


def test_no_command_prints_help(capsys):
    with pytest.raises(SystemExit) as stop:
        cli.main([])
    assert stop.value.code == 0 and "quarry" in capsys.readouterr().out


def test_list_engines(capsys):
    cli.main(["list-engines"])
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 12 and lines[1].split()[:2] == ["lift", "False"] and "Conf" in lines[0]


def test_extract_prints_and_writes(spark, stub, invoice, capsys):
    cli.main(["extract", str(invoice / "inv.txt"), "--schema", str(invoice / "inv.schema.json"), "--engine", "one"])
    got = json.loads(capsys.readouterr().out)
    assert got["data"] == {"invoice_id": "INV-001", "total": 125.5} and got["valid"] and got["engine_name"] == "one"
    cli.main(["extract", str(invoice / "inv.txt"), "--schema", "invoice", "--out", str(invoice / "out")])
    assert json.loads((invoice / "out").read_text())["data"]["invoice_id"] == "INV-001"
    with pytest.raises(ValueError):
        cli.main(["extract", str(invoice / "inv.txt"), "--schema", "invoice", "--engine", "none"])


def test_compare(spark, stub, invoice, capsys):
    cli.main(["compare", str(invoice / "inv.txt"), "--schema", json.dumps(INVOICE), "--engines", "one,two"])
    out = capsys.readouterr().out
    assert "invoice_id: agree=True" in out and "total: agree=False" in out and "two: valid=True" in out


def test_benchmark(spark, stub, invoice, capsys):
    cli.main(["benchmark", str(invoice), "--out", str(invoice / "report")])
    rows = {r["engine"]: r for r in json.loads((invoice / "report").read_text())["rows"]}
    assert set(rows) == {"one", "two"} and rows["one"]["f1"] == 1.0 and rows["one"]["latency_ms"] == 7 and rows["one"]["cost_usd"] == 0.01
    assert rows["two"]["field_accuracy"] == 0.5 and rows["two"]["schema_compliance"] == rows["one"]["schema_compliance"] == 1.0
    assert "0.0100" in capsys.readouterr().out


def test_benchmark_of_an_engine_that_fails(spark, invoice):
    def down(text, schema):
        raise RuntimeError("down")

    router = Router([Engine("one", ("txt",), down)])
    with pytest.raises(Exception, match="down"):
        benchmark.run_benchmark(read_cases(spark, str(invoice)), router).collect()


def test_results(spark):
    cases = {'{"data": {"invoice_id": "A \\"1\\"", "total": "$1,250.50", "paid": "yes"}}': ({"invoice_id": 'A "1"', "total": 1250.5, "paid": True}, []),
             '{"total": "none", "extra": [1, {"x": null}]}': ({"total": "none", "extra": [1, {"x": None}]}, ["$.invoice_id: required field missing", "$.total: expected number, got str"]),
             "5": (None, ["$: no payload"]), "not json": (None, ["$: no payload"])}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: (json.loads(r.data) if r.data else None, r.errors) for r in results.build_results(df, "p", INVOICE).collect()}
    assert got == cases
    assert results.build_results(df.where(F.lit(False)), "p", INVOICE).count() == 0


def test_violations():
    assert not violations({"invoice_id": "a", "total": 1}, INVOICE) and violations({"invoice_id": "a", "total": True}, INVOICE) == ["$.total: expected number, got bool"]
    assert violations([], INVOICE) and not violations([1, None], {"type": "array", "items": {"type": ["integer", "null"]}})
    assert violations(5, {"properties": {}}) == ["$: expected object, got int"] and not violations([1], {"type": ["array", "null"], "items": {"type": "string"}})
