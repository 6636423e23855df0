"""Command line: python -m quarry extract | compare | list-engines | benchmark.

No engine has a client of its own; --clients module:function names a function
that returns Engine objects, which are registered over those of the roster.
"""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import benchmark
from quarry.operators.results import FIELDS, build_results
from quarry.operators.routing import Router, field_agreement, roster
from quarry.plans.schema import load_schema
from quarry.sources.files import json_fields, read_cases, read_documents

#: Extensions that list-engines shows.
SHOWN = 8


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry", description="Schema-guided extraction on Spark.")
    commands = top.add_subparsers(dest="command")
    for name, target, options in (("extract", "file", ("engine", "out")), ("compare", "file", ("engines",)), ("list-engines", None, ()), ("benchmark", "dataset", ("engines", "out"))):
        p = commands.add_parser(name)
        p.add_argument("--clients")
        if target:
            p.add_argument(target)
        if target == "file":
            p.add_argument("--schema", required=True)
        for o in options:
            p.add_argument(f"--{o}")
        if name == "extract":
            p.add_argument("--format", choices=["json"], default="json")
    return top


def build_router(clients: str | None = None) -> Router:
    router = Router(roster())
    if clients:
        module, _, function = clients.partition(":")
        for engine in getattr(importlib.import_module(module), function)():
            router.register(engine)
    return router


def _document(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path).withColumnRenamed("path", "doc_id")


def _emit(text: str, out: str | None) -> None:
    if out:
        with open(out, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)


def extract(spark: SparkSession, router: Router, args: argparse.Namespace) -> None:
    schema = load_schema(args.schema)
    found = router.extract(_document(spark, args.file), schema, args.engine)
    if failed := found.where("error is not null").select("error").head(1):
        raise RuntimeError(f"All engines failed: {failed[0].error}")
    result = build_results(found.withColumnRenamed("data", "raw"), "raw", schema).first()
    parsed = lambda text: None if text is None else json.loads(text)
    told = {c: parsed(result[c]) if c in ("data", "schema", "raw", "metadata") else result[c] for c in FIELDS} | {"errors": result.errors}
    told["provenance"] = {k: json.loads(v) for k, v in result.provenance.items()}
    _emit(json.dumps(told, ensure_ascii=False, indent=2), args.out)


def compare(spark: SparkSession, router: Router, args: argparse.Namespace) -> None:
    schema, docs = load_schema(args.schema), _document(spark, args.file)
    names = args.engines.split(",") if args.engines else [e.name for e in router.candidates(docs.first().ext)]
    results = build_results(router.compare(docs, schema, names).withColumnRenamed("data", "raw"), "raw", schema).persist()
    print("Engine results")
    for r in results.select("engine", "valid", "data").orderBy("engine").collect():
        print(f"{r.engine}: valid={r.valid} data={r.data}")
    print("\nField agreement")
    values = json_fields(results, "data", ["doc_id", "engine"], as_json=True)
    shown = values.groupBy("field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", "value")))).alias("values"))
    for r in field_agreement(values).join(shown, "field").orderBy("field").collect():
        print(f"{r.field}: agree={r.agree} values={json.dumps({e: json.loads(v) for e, v in r['values'].items()}, ensure_ascii=False)}")
    results.unpersist()


def list_engines(router: Router) -> None:
    marks = {"field_confidence": "Conf", "provenance": "Prov", "nested_schemas": "Nest", "batch": "Batch", "local": "Local", "remote": "Remote"}
    print(f"{'Engine':<18}{'Avail':<7}" + "".join(f"{m:<8}" for m in marks.values()) + "Extensions")
    for e in router.engines.values():
        print(f"{e.name:<18}{e.ready()!s:<7}" + "".join(f"{'+' if e.capabilities.get(c) else '-':<8}" for c in marks) + ", ".join(sorted(e.extensions)[:SHOWN]))


def run_benchmark(spark: SparkSession, router: Router, args: argparse.Namespace) -> None:
    report = benchmark.run_benchmark(read_cases(spark, args.dataset), router, args.engines.split(",") if args.engines else None)
    if args.out:
        _emit(json.dumps({"rows": [r.asDict() for r in report.orderBy("document", "engine").toLocalIterator()]}, ensure_ascii=False, indent=2), args.out)
    print(benchmark.report_table(report))
    benchmark.close(report)


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command is None:
        parser().print_help()
        raise SystemExit(0)
    router = build_router(args.clients)
    if args.command == "list-engines":
        return list_engines(router)
    spark = SparkSession.builder.getOrCreate()
    {"extract": extract, "compare": compare, "benchmark": run_benchmark}[args.command](spark, router, args)
