"""Chunk planning: a document row becomes one row per chunk.

A chunk is the columns idx, start, end, overlap, strategy, chunk and unit
("char" or "row"). Texts are cut once from front to back, and chunks carry
neither the text that they come from nor its other chunks.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.payload import spaced_rows
from quarry.functions.text import let

Step = Callable[[DataFrame], DataFrame]


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("window size must be positive")
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    if overlap >= size:
        raise ValueError("overlap must be smaller than the window size")


def starts(length: Column, size: int, overlap: int) -> Column:
    """Starts of windows over length places; the first that reaches the end is the last."""
    return F.sequence(F.lit(0).cast("long"), F.greatest(length - overlap - 1, F.lit(0)).cast("long"), F.lit(size - overlap).cast("long"))


def _windows(text: Column, size: int, overlap: int) -> Column:
    """array<struct<start, end, chunk>> of a text's windows of code points: pieces of one step each, put together again."""
    step = size - overlap
    more = -(-overlap // step)  # pieces after its own that a window reaches into

    def cut(x: Column) -> Column:
        def window(start: Column, i: Column) -> Column:
            pieces = [F.coalesce(F.get(x["pieces"], i + k), F.lit("")) for k in range(1, more + 1)]
            tail = F.left(F.concat(*pieces), F.lit(overlap)) if pieces else F.lit("")
            return F.struct(start.alias("start"), F.least(start + size, x["n"]).alias("end"), F.concat(F.get(x["pieces"], i), tail).alias("chunk"))

        return F.transform(starts(x["n"], size, overlap), window)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    return let(F.struct(pieces.alias("pieces"), F.length(text).cast("long").alias("n")), cut)


def chunk_text(text: str, *, max_chars: int, overlap: int = 0, keep_text: bool = False) -> Step:
    """df.transform(chunk_text("text", max_chars=1000)): windows of code points; empty and null texts have none.

    The text column is left out of the chunks unless keep_text.
    """
    check_window(max_chars, overlap)

    def apply(df: DataFrame) -> DataFrame:
        others = [F.col(f"`{c}`") for c in df.columns if keep_text or c != text]
        at = df.where(F.length(text) > 0).select(*others, F.posexplode(_windows(F.col(text), max_chars, overlap)).alias("idx", "__c"))
        return (at.withColumn("start", F.col("__c.start")).withColumn("end", F.col("__c.end")).withColumn("overlap", F.when(F.col("idx") == 0, 0).otherwise(overlap))
                .withColumn("strategy", F.lit("text")).withColumn("chunk", F.col("__c.chunk")).withColumn("unit", F.lit("char")).drop("__c"))

    return apply


def chunk_array(rows: str, *, max_rows: int, overlap: int = 0, strategy: str = "rows") -> Step:
    """Windows over an array column, as (idx, row_start, row_end, start, end, overlap, strategy, chunk_rows, chunk, unit); chunk is the rows' JSON."""
    check_window(max_rows, overlap)

    def apply(df: DataFrame) -> DataFrame:
        n = F.size(rows)
        texts = strategy == "json_array"
        at = df.where(n > 0).select("*", F.posexplode(starts(n, max_rows, overlap)).alias("idx", "row_start"))
        cut = at.withColumn("chunk_rows", F.slice(rows, (F.col("row_start") + 1).cast("int"), F.lit(max_rows)))
        shown = F.col("chunk_rows") if texts else spaced_rows(F.to_json("chunk_rows"))
        return (cut.withColumn("row_end", F.least(F.col("row_start") + max_rows, n.cast("long"))).withColumn("start", F.col("row_start")).withColumn("end", F.col("row_end"))
                .withColumn("overlap", F.when(F.col("idx") == 0, 0).otherwise(overlap)).withColumn("strategy", F.lit(strategy))
                .withColumn("chunk", F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))).withColumn("unit", F.lit("row")))

    return apply


def chunk_json_array(text: str, *, max_rows: int, overlap: int = 0) -> Step:
    """Windows over a JSON array, chunk_rows as JSON texts; a text that is not exactly one array is an error, null has none."""

    def apply(df: DataFrame) -> DataFrame:
        parsed = df.withColumn("__rows", spaced_rows(F.col(text)))
        return parsed.transform(chunk_array("__rows", max_rows=max_rows, overlap=overlap, strategy="json_array")).drop("__rows")

    return apply


def chunk_table_rows(df: DataFrame, *, key: str, order: list[str], max_rows: int, overlap: int = 0) -> DataFrame:
    """Rows of a table with the windows of their group that hold them: position by a total order, then (idx, pos) rows."""
    check_window(max_rows, overlap)
    step = max_rows - overlap
    by_key = Window.partitionBy(key)
    at = df.withColumn("pos", F.row_number().over(by_key.orderBy(*order)) - 1).withColumn("n", F.count("*").over(by_key))
    last = F.greatest(F.ceil((F.col("n") - overlap) / step), F.lit(1)) - 1
    low = F.greatest(F.ceil((F.col("pos") - max_rows + 1) / step), F.lit(0))
    high = F.least(F.floor(F.col("pos") / step), last)
    return at.where(low <= high).withColumn("idx", F.explode(F.sequence(low, high))).drop("n")


#: Where Markdown and HTML headings begin.
MARKDOWN = r"(?dm)(?=^#{1,6}\s+)"
HTML = r"(?i)(?=<h[1-6][^>]*>)"


def sections(text: Column) -> Column:
    """array<string> of the sections that headings begin; Markdown first, else HTML. What stands before the first is left out."""

    def cut(pattern: str, opens: str) -> Column:
        return F.filter(F.split(text, pattern), lambda s: s.rlike(opens))

    return let(cut(MARKDOWN, r"^#{1,6}\s+"), lambda md: F.when(F.size(md) > 0, md).otherwise(cut(HTML, r"(?i)^<h[1-6][^>]*>")))


def _packed(max_chars: int):
    """The function that packs lengths, in order, into runs (first, count, before, size) of max_chars at most, or of one length."""

    @F.arrow_udf("array<struct<first:int,count:int,before:long,size:long>>")
    def packed(lengths: pa.Array) -> pa.Array:
        out = []
        for row in lengths:
            runs: list[dict] = []
            at = 0
            for k, n in enumerate(row.as_py() or ()):
                if runs and runs[-1]["size"] and runs[-1]["size"] + n <= max_chars:
                    runs[-1]["count"] += 1
                    runs[-1]["size"] += n
                else:
                    runs.append({"first": k + 1, "count": 1, "before": at, "size": n})
                at += n
            out.append(runs)
        return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32()), ("before", pa.int64()), ("size", pa.int64())])))

    return packed


def chunk_sections(text: str, *, max_chars: int, overlap: int = 0) -> Step:
    """Whole sections packed greedily up to max_chars; a text without headings falls back to windows. The text column is left out."""
    check_window(max_chars, overlap)

    def apply(df: DataFrame) -> DataFrame:
        others = [F.col(f"`{c}`") for c in df.columns if c != text]
        cut = df.withColumn("__sections", sections(F.col(text)))
        plain = cut.where(F.coalesce(F.size("__sections") == 0, F.lit(True))).drop("__sections").transform(chunk_text(text, max_chars=max_chars, overlap=overlap))
        found = cut.where(F.size("__sections") > 0).withColumn("__lengths", F.transform("__sections", lambda s: F.length(s)))
        found = found.withColumn("__runs", _packed(max_chars)("__lengths")).withColumn("__begin", F.length(text).cast("long") - F.aggregate("__lengths", F.lit(0).cast("long"), lambda a, n: a + n))
        chunks = F.transform("__runs", lambda r: F.struct(r["before"].alias("before"), r["size"].alias("size"), F.array_join(F.slice("__sections", r["first"], r["count"]), "").alias("chunk")))
        at = found.select(*others, "__begin", F.posexplode(chunks).alias("idx", "__c"))
        at = (at.withColumn("start", F.col("__begin") + F.col("__c.before")).withColumn("end", F.col("start") + F.col("__c.size")).withColumn("overlap", F.lit(0))
              .withColumn("strategy", F.lit("section")).withColumn("chunk", F.col("__c.chunk")).withColumn("unit", F.lit("char")).drop("__c", "__begin"))
        return at.unionByName(plain)

    return apply


def chunk_json() -> Column:
    """A chunk as the JSON text of one object: text, index, start, end, strategy, overlap and metadata."""
    rows = F.col("unit") == "row"
    metadata = F.struct(F.col("unit").alias("unit"), F.when(rows, F.col("start")).alias("row_start"), F.when(rows, F.col("end")).alias("row_end"))
    return F.to_json(F.struct(F.col("chunk").alias("text"), F.col("idx").alias("index"), F.col("start"), F.col("end"), F.col("strategy"), F.col("overlap"), metadata.alias("metadata")))


def resolve_chunks(docs: DataFrame, text: str = "text", chunks: DataFrame | None = None, max_chars: int | None = None, overlap: int = 0) -> DataFrame:
    """The chunks given, else windows of max_chars; an error if there is neither."""
    if chunks is not None:
        return chunks
    if max_chars is None:
        raise ValueError("Chunked extraction needs chunks or max_chars")
    return docs.transform(chunk_text(text, max_chars=max_chars, overlap=overlap))
