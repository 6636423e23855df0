"""Engine choice as a join with the engine table, fallback chains, comparison and agreement."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.extraction import settled

_IMAGES = ("png", "jpg", "jpeg", "tiff", "tif")
#: Engines in order of preference, and the orders of text formats.
PRIORITY = ("lift", "provider_router", "llm_structured", "converted_llm", "llamaextract", "azure_docint", "google_docai", "textract", "nuextract", "instructor", "fenic")
TEXT_PRIORITY = ("provider_router", "nuextract", "llm_structured", "converted_llm", "instructor", "fenic", "lift")
HTML_PRIORITY = ("provider_router", "llm_structured", "converted_llm", "instructor", "fenic", "lift")
CAPABILITIES = ("field_confidence", "provenance", "nested_schemas", "batch", "local", "remote")


def _capable(*names: str) -> dict[str, bool]:
    return {c: c in names for c in CAPABILITIES}


#: The extensions and capabilities of each engine.
ROSTER = {
    "lift": (("pdf", *_IMAGES, "docx", "txt"), _capable("field_confidence", "provenance", "nested_schemas", "remote")),
    "nuextract": (("pdf", *_IMAGES, "docx", "txt", "md"), _capable("nested_schemas", "batch", "local")),
    "provider_router": (("txt", "md", "html", "json", "csv"), _capable("nested_schemas", "batch", "remote")),
    "llm_structured": (("pdf", *_IMAGES, "docx", "txt", "md", "html"), _capable("nested_schemas", "batch", "remote")),
    "instructor": (("pdf", *_IMAGES, "docx", "txt", "md"), _capable("nested_schemas", "batch", "remote")),
    "fenic": (("txt", "md", "html", "json", "csv"), _capable("nested_schemas", "batch", "remote")),
    "llamaextract": (("pdf", *_IMAGES, "docx", "txt"), _capable("nested_schemas", "batch", "remote")),
    "azure_docint": (("pdf", *_IMAGES, "bmp", "docx"), _capable("field_confidence", "provenance", "remote")),
    "google_docai": (("pdf", *_IMAGES, "gif", "bmp", "webp"), _capable("field_confidence", "provenance", "nested_schemas", "remote")),
    "textract": (("pdf", *_IMAGES), _capable("field_confidence", "provenance", "remote")),
    "converted_llm": (("pdf", *_IMAGES, "docx", "txt", "md", "html"), _capable("nested_schemas", "batch", "remote")),
}
#: Environment variables that name the engine select() prefers, in order.
DEFAULTS = ("QUARRY_ENGINE", "ENGINE_DEFAULT")


@dataclass
class Engine:
    """An extractor under a name; run(text, schema) returns the data as a dict, plain or awaitable.

    available may be a rule: a function of nothing that is asked when routes are made.
    """

    name: str
    extensions: tuple[str, ...]
    run: Callable[[str, dict], dict] | None = None
    available: bool | Callable[[], bool] = True
    capabilities: dict[str, bool] = field(default_factory=dict)

    def ready(self) -> bool:
        """What available says; a rule that fails says no."""
        try:
            return bool(self.available() if callable(self.available) else self.available)
        except Exception:  # an availability rule never stops routing
            return False


def roster() -> list[Engine]:
    """The known engines; without a client of one's own none is available."""
    return [Engine(n, extensions, None, False, dict(capabilities)) for n, (extensions, capabilities) in ROSTER.items()]


class Router:
    """Registered engines; the latest of a name counts."""

    def __init__(self, engines: Iterable[Engine] = (), fallback_order: Iterable[str] = (), allowed: Iterable[str] = ()):
        self.engines: dict[str, Engine] = {}
        self.fallback_order, self.allowed = tuple(fallback_order), frozenset(allowed)
        for e in engines:
            self.register(e)

    def register(self, engine: Engine) -> None:
        self.engines[engine.name] = engine

    def get(self, name: str) -> Engine:
        if name not in self.engines:
            raise ValueError(f"Unknown engine: {name}")
        return self.engines[name]

    def order(self, extension: str) -> tuple[str, ...]:
        return self.fallback_order or (TEXT_PRIORITY if extension in ("txt", "md") else HTML_PRIORITY if extension == "html" else PRIORITY)

    def candidates(self, extension: str) -> list[Engine]:
        """Allowed, available engines for an extension, in order of priority and then of registration."""
        names = dict.fromkeys((*self.order(extension), *self.engines))
        fits = lambda e: (not self.allowed or e.name in self.allowed) and e.ready() and (not extension or extension in e.extensions)
        return [self.engines[n] for n in names if n in self.engines and fits(self.engines[n])]

    def select(self, extension: str, hint: str | None = None) -> Engine:
        """The hinted engine, else the first candidate that the environment names, else the first candidate."""
        if hint:
            if not self.get(hint).ready():
                raise RuntimeError(f"Engine is not available: {hint}")
            return self.engines[hint]
        found = self.candidates(extension)
        named = [e for name in map(os.environ.get, DEFAULTS) for e in found if e.name == name]
        if not (chosen := named or found):
            raise ValueError(f"No available engine supports '.{extension}'. Registered: {list(self.engines)}")
        return chosen[0]

    def table(self, spark: SparkSession) -> DataFrame:
        """(extension, engines): the candidates of every extension that an engine takes, and of none; a row each."""
        extensions = sorted({x for e in self.engines.values() for x in e.extensions} | {""})
        return spark.createDataFrame([(x, [e.name for e in self.candidates(x)]) for x in extensions], "extension string, engines array<string>")

    def list_engines(self, spark: SparkSession) -> DataFrame:
        rows = [(e.name, e.ready(), sorted(e.extensions), {c: e.capabilities.get(c, False) for c in CAPABILITIES}) for e in self.engines.values()]
        return spark.createDataFrame(rows, "name string, available boolean, extensions array<string>, capabilities map<string,boolean>")

    def with_routes(self, docs: DataFrame, extension: str = "ext", column: str = "engines") -> DataFrame:
        """docs with the candidates of every row in order, an empty list if it has none; no extension matches all engines.

        The engine table has a row for each extension of the registered engines
        and is broadcast; documents are not shuffled.
        """
        routes = F.broadcast(self.table(docs.sparkSession).select(F.col("extension").alias("__extension"), F.col("engines").alias("__engines")))
        joined = docs.join(routes, F.coalesce(F.lower(F.col(extension)), F.lit("")) == F.col("__extension"), "left")
        return joined.withColumn(column, F.coalesce("__engines", F.array().cast("array<string>"))).drop("__extension", "__engines")

    def route(self, docs: DataFrame, extension: str = "ext", key: str = "doc_id") -> DataFrame:
        """(key, extension, engines): the candidates of every document in order; none gives an empty list."""
        return self.with_routes(docs.select(key, extension), extension)

    def extract(self, docs: DataFrame, schema: dict, hint: str | None = None, key: str = "doc_id", text: str = "text", extension: str = "ext", concurrency: int = 1) -> DataFrame:
        """(key, engine, data as JSON, attempts, error, processing_time_ms), a row per row of docs: the first engine that succeeds; a hint has no fallback.

        A task makes concurrency calls at a time at most.
        """
        engines = self.engines
        chosen = docs.select(key, text, *([extension] if extension in docs.columns else []))
        routed = self.with_routes(chosen, extension) if hint is None else chosen.withColumn("engines", F.array(F.lit(self.select("", hint).name)))

        def one(k: Any, t: str, names: Iterable[str]) -> tuple:
            failed, won, data, began = [], None, None, time.perf_counter()
            for n in names:
                try:
                    data, won = json.dumps(settled(engines[n].run(t, schema)), ensure_ascii=False), n
                    break
                except Exception as e:  # the next engine is tried
                    failed.append(f"{n}: {e}")
            return k, won, data, failed, None if won else "; ".join(failed) or "no engine", int((time.perf_counter() - began) * 1000)

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(concurrency) as pool:
                for pdf in batches:
                    out = list(pool.map(one, pdf[key], pdf[text], pdf["engines"]))
                    yield pd.DataFrame(out, columns=[key, "engine", "data", "attempts", "error", "processing_time_ms"])

        return routed.select(key, text, "engines").mapInPandas(each, f"{key} {dict(docs.dtypes)[key]}, engine string, data string, attempts array<string>, error string, processing_time_ms long")

    def extract_batch(self, docs: DataFrame, schema: dict, hint: str | None = None, key: str = "doc_id", concurrency: int = 3, on_progress: Callable[..., None] | None = None, **columns: str) -> DataFrame:
        """extract() with concurrency, each call made once: its rows are held until the caller unpersists them.

        on_progress is told of every row on the driver, as they come: current
        (from 1), total, file_path (the key), status, result and error. Rows are
        told apart by position, so that repeated keys count each.
        """
        found = self.extract(docs, schema, hint, key, concurrency=concurrency, **columns).persist()
        if on_progress:
            total = found.count()
            for current, r in enumerate(found.toLocalIterator(), 1):
                on_progress(current=current, total=total, file_path=r[key], status="failed" if r.error else "succeeded", result=r.data, error=r.error)
        return found

    def compare(self, docs: DataFrame, schema: dict, engines: Iterable[str], key: str = "doc_id", text: str = "text") -> DataFrame:
        """Rows of extract for every document and named engine; engines that fail are left out."""
        names, chosen = [n for n in engines if self.get(n).ready()], self.engines
        pairs = docs.select(key, text, F.explode(F.array(*map(F.lit, names))).alias("engine"))

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for k, t, n in zip(pdf[key], pdf[text], pdf["engine"]):
                    try:
                        out.append((k, n, json.dumps(settled(chosen[n].run(t, schema)), ensure_ascii=False)))
                    except Exception:  # dropped, as documented
                        continue
                yield pd.DataFrame(out, columns=[key, "engine", "data"])

        return pairs.mapInPandas(each, f"{key} {dict(docs.dtypes)[key]}, engine string, data string")


def batch_summary(results: DataFrame) -> DataFrame:
    """total, succeeded, failed and success_rate of extract's rows."""
    ok = F.count_if(F.col("error").isNull())
    return results.agg(F.count("*").alias("total"), ok.alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.try_divide(ok.cast("double"), F.count("*")), F.lit(0.0)).alias("success_rate"))


def field_agreement(values: DataFrame, engines: int | None = None, key: str = "doc_id") -> DataFrame:
    """(key, field, agree) from rows (key, engine, field, value): agree if all engines of the document give one value.

    A missing field counts as null.
    """
    seen = values.groupBy(key).agg(F.count_distinct("engine").alias("n"))
    per = values.groupBy(key, "field").agg(F.count_distinct(F.coalesce("value", F.lit("null"))).alias("k"), F.count_distinct("engine").alias("given"), F.count_if(F.coalesce("value", F.lit("null")) == "null").alias("nulls"))
    missing = ((F.col("given") < F.col("n")) & (F.col("nulls") == 0)).cast("int")
    return per.join(seen, key).select(key, "field", (F.col("k") + missing <= 1).alias("agree"))
