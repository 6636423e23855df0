"""The benchmark harness: every case through every engine, scored against gold."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import payload as P
from quarry.operators.evaluation import field_scores
from quarry.operators.extraction import settled
from quarry.operators.routing import Router
from quarry.plans.validate import coerced, violations
from quarry.sources.files import json_fields

def run_benchmark(cases: DataFrame, router: Router, engines: list[str] | None = None) -> DataFrame:
    """(engine, document, field_accuracy, f1, schema_compliance, latency_ms, cost_usd), one row per case and engine.

    cases holds (name, text, schema, gold) as sources.read_cases gives them. All
    available engines run by default. Latency and cost are those an engine tells
    in metadata (processing_time_ms, cost_usd), else wall clock and 0. There is
    no fallback: an engine's error fails the run.
    """
    names = engines or [e.name for e in router.engines.values() if e.available]
    chosen = {n: router.get(n) for n in names}
    pairs = cases.select("name", "text", "schema", "gold", F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("engine"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, text, schema, gold, engine in zip(pdf["name"], pdf["text"], pdf["schema"], pdf["gold"], pdf["engine"]):
                began = time.perf_counter()
                found = settled(chosen[engine].run(text, json.loads(schema)))
                told = found.get("metadata") if isinstance(found, dict) and isinstance(found.get("metadata"), dict) else {}
                took = told.get("processing_time_ms") or int((time.perf_counter() - began) * 1000)
                out.append((name, engine, json.dumps(found, ensure_ascii=False), schema, gold, took, float(told.get("cost_usd", 0.0))))
            yield pd.DataFrame(out, columns=["name", "engine", "raw", "schema", "gold", "latency_ms", "cost_usd"])

    ran = pairs.repartition("name", "engine").mapInPandas(each, "name string, engine string, raw string, schema string, gold string, latency_ms long, cost_usd double")

    @F.pandas_udf("data string, schema_compliance double")
    def checked(data: pd.Series, schema: pd.Series) -> pd.DataFrame:
        rows = []
        for d, rule in zip(data, map(json.loads, schema)):
            value = coerced(json.loads(d), rule)
            rows.append((json.dumps(value, ensure_ascii=False), float(not violations(value, rule))))
        return pd.DataFrame(rows, columns=["data", "schema_compliance"])

    # engines cost money: their answers are held, not asked for again by each use, until the caller clears them
    asked = ran.withColumn("data", F.coalesce(P.normalize_envelopes(F.col("raw")), F.lit("{}")))
    kept = asked.withColumn("checked", checked("data", "schema")).select("name", "engine", "gold", "latency_ms", "cost_usd", "checked.*").persist()
    keys = ["name", "engine"]
    scored = field_scores(json_fields(kept, "data", keys, as_json=True), json_fields(kept, "gold", keys, as_json=True), keys, nested=True)
    # without fields on either side there is nothing to score
    full = lambda c: F.coalesce(c, F.lit(1.0)).alias(c)
    out = kept.join(scored, keys, "left").select("engine", F.col("name").alias("document"), full("field_accuracy"), full("f1"), "schema_compliance", "latency_ms", "cost_usd")
    out.answers = kept
    return out


def close(report: DataFrame) -> None:
    """Let go of the answers that a report of run_benchmark holds."""
    report.answers.unpersist()


def report_table(report: DataFrame) -> str:
    """The report as text, by document and engine; a benchmark folder's rows fit the driver."""
    heads = {"engine": 16, "document": 16, "field_accuracy": 16, "f1": 8, "schema_compliance": 19, "latency_ms": 12, "cost_usd": 10}
    shown = lambda c, v: f"{v:.4f}" if c == "cost_usd" else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["".join(f"{c:<{w}}" for c, w in heads.items())]
    for r in report.orderBy("document", "engine").toLocalIterator():
        lines.append("".join(f"{shown(c, r[c]):<{w}}" for c, w in heads.items()))
    return "\n".join(line.rstrip() for line in lines)
