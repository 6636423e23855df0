"""Row extraction over chunks: extractor, first-wins dedupe, digest chain, counters."""

from __future__ import annotations

import asyncio
import hashlib
import inspect
import json
import tempfile
import threading
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.payload import canonical, canonical_rows, digest
from quarry.operators.chunking import resolve_chunks
from quarry.sources.ledger import LedgerWriter
from quarry.plans import validate
from quarry.plans.schema import row_schema, rows_wrapper

#: What an extractor is given and returns: a text and keywords, and rows (list of dicts) or {"rows": [...]}.
Extractor = Callable[..., object]


_loops = threading.local()


def settled(value: Any) -> Any:
    """The value, or what it comes to if it is awaitable, in the one event loop of this thread."""
    if not inspect.isawaitable(value):
        return value
    if not hasattr(_loops, "runner"):
        _loops.runner = asyncio.Runner()

    async def wait() -> Any:
        return await value

    return _loops.runner.run(wait())


def _wanted(extractor: Callable, context: dict) -> dict:
    """The part of context that an extractor's signature takes."""
    try:
        known = inspect.signature(extractor).parameters.values()
    except (TypeError, ValueError):  # no signature to be seen
        return context
    if any(p.kind is p.VAR_KEYWORD for p in known):
        return context
    return {k: v for k, v in context.items() if k in {p.name for p in known if p.kind is not p.POSITIONAL_ONLY}}


def found_in(extractor: Extractor, text: str, **context) -> tuple[list, dict]:
    """(rows, metadata) of what an extractor returns, plain or awaitable; one with extract_file only gets the text as a file and must take txt.

    Of context an extractor gets what its signature has.
    """
    if hasattr(extractor, "extract_file"):
        if "txt" not in getattr(extractor, "extensions", ("txt",)):
            raise ValueError("The extractor takes neither text nor txt files")
        with tempfile.TemporaryDirectory() as folder:
            path = Path(folder) / "input.txt"
            path.write_text(text, encoding="utf-8")
            found = settled(extractor.extract_file(str(path), **_wanted(extractor.extract_file, context)))
    else:
        found = settled(extractor(text, **_wanted(extractor, context)))
    rows = found.get("rows") if isinstance(found, dict) else found
    if not isinstance(rows, list):
        raise ValueError("Extraction expected a list of rows or an object with a 'rows' list")
    own = found.get("metadata") if isinstance(found, dict) else None
    return rows, own if isinstance(own, dict) else {}


def call(extractor: Extractor, text: str, **context) -> list:
    """The rows of found_in()."""
    return found_in(extractor, text, **context)[0]


_OUT = "rows string, engine_metadata string, error_type string, error string, processing_time_ms long"
_MADE = [c.split()[0] for c in _OUT.split(", ")]
#: Of a chunk's columns, what an extractor is told as its argument chunk, if it takes one.
_TOLD = ("idx", "start", "end", "strategy", "overlap", "unit")


def _attempt(extractor: Extractor, text: str, **context) -> tuple:
    began = time.perf_counter()
    took = lambda: int((time.perf_counter() - began) * 1000)
    try:
        rows, own = found_in(extractor, text, **context)
        return json.dumps(rows, ensure_ascii=False), json.dumps(own, ensure_ascii=False) if own else None, None, None, took()
    except Exception as e:  # a chunk's failure is data
        return None, None, type(e).__name__, str(e), took()


def extract_chunks(chunks: DataFrame, extractor: Extractor, key: str = "doc_id", sequential: bool = False) -> DataFrame:
    """(key, idx, rows as JSON, engine_metadata as JSON, error_type, error, processing_time_ms) of every chunk.

    An extractor that takes an argument chunk is told of its chunk: index, start,
    end, strategy, overlap and unit, as far as chunks has them. In parallel by
    default. With sequential=True the extractor is also given previous_digest,
    so the chunks of a document run in order in one group.
    """
    has = [c for c in _TOLD if c in chunks.columns]
    chosen = chunks.select(key, "chunk", *has)
    schema = f"{key} {dict(chosen.dtypes)[key]}, idx int, {_OUT}"

    def told(row: tuple) -> dict:
        return {"index" if c == "idx" else c: x.item() if hasattr(x, "item") else x for c, x in zip(has, row)}

    def rows_of(pdf: pd.DataFrame) -> Iterator[tuple[str, dict]]:
        return ((text, told(row)) for text, *row in pdf[["chunk", *has]].itertuples(index=False))

    def made(pdf: pd.DataFrame, out: list[tuple]) -> pd.DataFrame:
        return pd.concat([pdf[[key, "idx"]].reset_index(drop=True), pd.DataFrame(out, columns=_MADE)], axis=1)

    if not sequential:

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield made(pdf, [_attempt(extractor, text, chunk=chunk) for text, chunk in rows_of(pdf)])

        return chosen.mapInPandas(each, schema)

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        out, previous = [], None
        pdf = pdf.sort_values("idx")
        for text, chunk in rows_of(pdf):
            out.append(_attempt(extractor, text, chunk=chunk, previous_digest=previous))
            if out[-1][0] is not None:
                previous = hashlib.sha256(canonical(json.loads(out[-1][0])).encode()).hexdigest()
        return made(pdf, out)

    return chosen.groupBy(key).applyInPandas(in_order, schema)


def explode_rows(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, idx, pos, row_key): every row returned, with its canonical JSON."""
    return results.where("rows is not null").select(key, "idx", canonical_rows("rows").alias("keys")).select(key, "idx", F.posexplode("keys").alias("pos", "row_key"))


def first_wins(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows with is_first: true for the first of equal rows of a document by (idx, pos).

    The shuffle goes by document and a hash of the row, so that the rows of a long document are spread.
    """
    same = Window.partitionBy(key, F.xxhash64("row_key"), "row_key").orderBy("idx", "pos")
    return rows.withColumn("is_first", F.row_number().over(same) == 1)


def digest_chain(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """results with digest, null for failed chunks, and previous_digest: that of the last chunk before that succeeded."""
    before = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    with_digest = results.withColumn("digest", F.when(F.col("rows").isNotNull(), digest(F.col("rows"))))
    return with_digest.withColumn("previous_digest", F.last("digest", ignorenulls=True).over(before))


def chunk_report(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per chunk: status, rows_returned, rows_added, duplicates_removed, error."""
    counts = first_wins(explode_rows(results, key), key).groupBy(key, "idx").agg(
        F.count("*").alias("rows_returned"), F.count_if("is_first").alias("rows_added"), F.count_if(~F.col("is_first")).alias("duplicates_removed"))
    zero = {c: 0 for c in ("rows_returned", "rows_added", "duplicates_removed")}
    return (results.select(key, "idx", F.when(F.col("rows").isNull(), "failed").otherwise("succeeded").alias("status"), "error_type", "error")
            .join(counts, [key, "idx"], "left").fillna(zero))


def document_report(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: chunk and row counters, partial where a chunk failed."""
    failed = F.count_if(F.col("status") == "failed")
    return chunk_report(results, key).groupBy(key).agg(
        F.count("*").alias("total_chunks"), F.count_if(F.col("status") == "succeeded").alias("succeeded_chunks"), failed.alias("failed_chunks"), (failed > 0).alias("partial"),
        F.sum("rows_added").alias("rows_extracted"), F.sum("duplicates_removed").alias("duplicates_removed"))


def collected_rows(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, rows array<string>): the kept rows of each document in order."""
    kept = first_wins(explode_rows(results, key), key).where("is_first")
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "pos", "row_key"))), lambda r: r["row_key"]).alias("rows"))


def require_success(results: DataFrame) -> DataFrame:
    """results, failing when read if a chunk failed."""
    return results.withColumn("error", F.when(F.col("rows").isNull(), F.raise_error(F.concat_ws(": ", "error_type", "error"))).otherwise(F.col("error")))


def extract_rows(docs: DataFrame, schema: Any, extractor: Extractor, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, data, errors, valid, error_type, error, processing_time_ms, metadata): the rows of every whole text.

    schema is a JSON Schema or a template of rows; data is {"rows": [...]} and
    is validated against the schema's wrapper. metadata is the engine's own, and
    the row schema and the fields that are computed later.
    """
    row, computed = row_schema(schema)
    found = extract_chunks(docs.select(key, F.lit(0).alias("idx"), F.col(text).alias("chunk")), extractor, key)
    checked = _validated(found.drop("idx").withColumn("data", F.concat(F.lit('{"rows": '), F.col("rows"), F.lit("}"))).drop("rows"), row)
    return checked.withColumn("metadata", _merged(F.col("engine_metadata"), F.lit(_metadata(row, computed)))).drop("engine_metadata")


def _metadata(row: dict, computed: dict) -> str:
    return json.dumps({"row_schema": row, "schema_conversion": {"computed_fields": computed}}, ensure_ascii=False)


def _merged(own: Column, ours: Column) -> Column:
    """The JSON of one object of the members of two, ours last and winning; own may be null."""
    both = F.concat(F.regexp_replace(own, r"\}$", ", "), F.substr(ours, F.lit(2)))
    return F.coalesce(both, ours)


def _validated(df: DataFrame, row: dict) -> DataFrame:
    """df with errors and valid of its column data against the wrapper of a row schema; null data is not valid."""
    parsed = df.withColumn("__v", F.try_parse_json("data"))
    checked = parsed.withColumn("errors", F.when(F.col("data").isNotNull(), validate.errors(F.col("__v"), rows_wrapper(row)))).drop("__v")
    return checked.withColumn("valid", F.coalesce(F.size("errors") == 0, F.lit(False)))


def extract_rows_chunked(docs: DataFrame, schema: Any, extractor: Extractor, text: str = "text", key: str = "doc_id", engine_name: str = "", chunks: DataFrame | None = None,
                         max_chars: int | None = None, overlap: int = 0, sequential: bool = False, continue_on_error: bool = False, ledger: str | None = None) -> DataFrame:
    """One result a document: (key, data, errors, valid, engine_name, metadata, and the counters of document_report).

    data holds the rows of all chunks, the first of equal ones only; a document
    without chunks, as its text is null or empty, has no rows and no errors but
    those of the schema. A result is valid if its rows are and no chunk failed.
    metadata is a JSON text of the row schema and of the chunks in order: where
    they stand, status, rows returned and added, duplicates, validity, engine,
    time, digest before, error, and the engine's own. Without continue_on_error
    the first failure fails the run. With a ledger, a folder, an answer is read
    from there if it is known and else kept there (answered);
    without, answers are held in Spark's cache for the reports of this result.
    """
    row, computed = row_schema(schema)
    planned = resolve_chunks(docs, text, chunks, max_chars, overlap)
    if ledger:
        results = answered(planned, extractor, ledger, key)
    else:
        results = extract_chunks(planned, extractor, key, sequential).persist()  # calls cost money: each is made once, while its answer is held
    if not continue_on_error:
        results = require_success(results)
    rows = collected_rows(results, key).withColumn("data", F.concat(F.lit('{"rows":['), F.array_join("rows", ","), F.lit("]}"))).drop("rows")
    stands = [c for c in ("start", "end", "strategy", "overlap") if c in planned.columns]
    each = chunk_report(results, key).join(digest_chain(results, key).select(key, "idx", "previous_digest", "processing_time_ms", "engine_metadata",
        F.concat(F.lit('{"rows": '), F.col("rows"), F.lit("}")).alias("data")), [key, "idx"]).join(planned.select(key, "idx", *stands), [key, "idx"])
    each = _validated(each, row).withColumn("engine_name", F.lit(engine_name))
    told = F.struct("idx", *stands, "status", "rows_returned", "rows_added", "duplicates_removed", "valid", "engine_name", "processing_time_ms", "previous_digest",
                    F.try_parse_json("engine_metadata").alias("metadata"), "error_type", "error")
    listed = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", F.to_json(told).alias("told")))).alias("told"))
    listed = listed.select(key, F.concat(F.lit("["), F.array_join("told.told", ","), F.lit("]")).alias("chunks"))
    found = document_report(results, key).join(rows, key, "left").join(listed, key)
    counters = {c: 0 for c in ("total_chunks", "succeeded_chunks", "failed_chunks", "rows_extracted", "duplicates_removed")}
    every = docs.select(key).union(planned.select(key)) if chunks is not None else docs.select(key)
    out = every.where(F.col(key).isNotNull()).distinct().join(found, key, "left").fillna(counters).withColumns({
        "partial": F.coalesce("partial", F.lit(False)), "data": F.coalesce("data", F.lit('{"rows":[]}')), "chunks": F.coalesce("chunks", F.lit("[]"))})
    out = _validated(out, row).withColumn("valid", F.col("valid") & ~F.col("partial")).withColumn("engine_name", F.lit(engine_name))
    head = _metadata(row, computed)[:-1]
    return out.withColumn("metadata", F.concat(F.lit(head + ', "chunks": '), F.col("chunks"), F.lit("}"))).drop("chunks")


def answered(chunks: DataFrame, extractor: Extractor, folder: str, key: str = "doc_id", parts: int | None = None) -> DataFrame:
    """extract_chunks() with a ledger: a folder of answers by the digest of their text, in which every text is asked for once.

    Texts that the ledger lacks are asked for by tasks that each write their
    answers as they finish, so that a run that breaks off leaves what it paid
    for, and the next asks for the rest only. Failures are not kept: they are
    asked for again. Equal texts share one answer. Extractors that take chunk or
    previous_digest would not give one answer to one text, and are an error.
    """
    if {"chunk", "previous_digest"} & set(inspect.signature(getattr(extractor, "extract_file", extractor)).parameters):
        raise ValueError("An extractor whose answers depend on more than the text has no ledger")
    spark = chunks.sparkSession
    kept = f"digest string, {_OUT}"
    wanted = chunks.select(key, "idx", F.col("chunk"), F.sha2("chunk", 256).alias("digest"))
    known = _ledger(spark, folder, kept)
    # one text a digest; what is known goes
    asked = wanted.groupBy("digest").agg(F.min("chunk").alias("chunk")).join(known.select("digest"), "digest", "left_anti")
    store = LedgerWriter(folder)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), store.rows):
                part = pdf.iloc[at : at + store.rows]
                out = pd.DataFrame([_attempt(extractor, t) for t in part["chunk"]], columns=_MADE)
                out.insert(0, "digest", part["digest"].to_numpy())
                store.write(out[out["rows"].notna()])
                yield out[out["rows"].isna()]

    # the tasks keep what they are answered; only failures come back, held while the result is read
    failures = (asked.repartition(parts, "digest") if parts else asked).mapInPandas(each, kept).persist()
    failures.count()
    answers = _ledger(spark, folder, kept).dropDuplicates(["digest"]).unionByName(failures)
    return wanted.select(key, F.col("idx").cast("int").alias("idx"), "digest").join(answers, "digest", "left").drop("digest")


def _ledger(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)
