"""Chunkers and row extraction as table functions for SQL.

    register(spark)
    select * from chunk_text(table(documents), 'text', 1000, 100)
    select * from chunk_rows(table(lines) partition by (order_id) order by (line), 3, 1)

A function's rows are those of its table without the column that it cuts, and
the chunk's columns beside them. Windows of rows are put out as they fill, so
that a partition is never held whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quarry.operators.chunking import check_window

_INT, _LONG, _STRING = IntegerType(), LongType(), StringType()
_CHUNK = (("idx", _INT), ("start", _LONG), ("end", _LONG), ("overlap", _INT), ("strategy", _STRING), ("chunk", _STRING), ("unit", _STRING))


def _constant(argument: AnalyzeArgument | None, name: str, default: Any = None) -> Any:
    if argument is None:
        return default
    if argument.value is None:
        raise ValueError(f"{name} must be a constant")
    return argument.value


def _beside(table: AnalyzeArgument, without: str | None, columns: tuple) -> AnalyzeResult:
    """The result of a function: its table's columns but one, and columns that the table must not have."""
    if not isinstance(table.dataType, StructType):
        raise ValueError("The first argument must be a table")
    if without is not None and without not in table.dataType.names:
        raise ValueError(f"The table has no column {without}")
    if clash := {n.lower() for n in table.dataType.names if n != without} & {c for c, _ in columns}:
        raise ValueError(f"The table already has columns {sorted(clash)}")
    schema = StructType([f for f in table.dataType.fields if f.name != without])
    for name, kind in columns:
        schema = schema.add(name, kind)
    return AnalyzeResult(schema)


def windows(length: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of windows over length places; the first that reaches the end is the last."""
    start = 0
    while length and (start == 0 or start + overlap < length):
        yield start, min(start + size, length)
        start += size - overlap


class ChunkText:
    """chunk_text(table, text column, max_chars [, overlap]): windows of code points."""

    @staticmethod
    def analyze(table: AnalyzeArgument, text: AnalyzeArgument, max_chars: AnalyzeArgument, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        check_window(_constant(max_chars, "max_chars"), _constant(overlap, "overlap", 0))
        return _beside(table, _constant(text, "text"), _CHUNK)

    def eval(self, row: Row, text: str, max_chars: int, overlap: int = 0) -> Iterator[tuple]:
        whole, others = row[text], [v for k, v in row.asDict(False).items() if k != text]
        for idx, (start, end) in enumerate(windows(len(whole or ""), max_chars, overlap)):
            yield *others, idx, start, end, overlap if idx else 0, "text", whole[start:end], "char"


#: Where headings begin.
_MARKDOWN, _HTML = re.compile(r"^#{1,6}\s+", re.M), re.compile(r"<h[1-6][^>]*>", re.I)


class ChunkSections:
    """chunk_sections(table, text column, max_chars [, overlap]): whole sections packed up to max_chars; texts without headings in windows."""

    analyze = staticmethod(ChunkText.analyze)

    def eval(self, row: Row, text: str, max_chars: int, overlap: int = 0) -> Iterator[tuple]:
        whole = row[text] or ""
        others = [v for k, v in row.asDict(False).items() if k != text]
        cuts = [m.start() for m in _MARKDOWN.finditer(whole)] or [m.start() for m in _HTML.finditer(whole)]
        if not cuts:
            yield from ChunkText().eval(row, text, max_chars, overlap)
            return
        begin, idx = cuts[0], 0
        for at, end in zip(cuts, [*cuts[1:], len(whole)]):
            if at > begin and end - begin > max_chars:
                yield *others, idx, begin, at, 0, "section", whole[begin:at], "char"
                begin, idx = at, idx + 1
        yield *others, idx, begin, len(whole), 0, "section", whole[begin:], "char"


_ROWS = (("idx", _INT), ("row_start", _LONG), ("row_end", _LONG), ("overlap", _INT), ("chunk", _STRING))


class ChunkRows:
    """chunk_rows(table partition by ... order by ..., max_rows [, overlap]): windows over the rows of a partition, chunk the JSON of their rows.

    The columns by which the table is partitioned come with every chunk by
    naming them: chunk_rows(table, max_rows, overlap, 'key').
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, max_rows: AnalyzeArgument, overlap: AnalyzeArgument | None = None, key: AnalyzeArgument | None = None) -> AnalyzeResult:
        check_window(_constant(max_rows, "max_rows"), _constant(overlap, "overlap", 0))
        name = _constant(key, "key")
        if name is not None and name not in table.dataType.names:
            raise ValueError(f"The table has no column {name}")
        schema = StructType([f for f in table.dataType.fields if f.name == name])
        for column, kind in _ROWS:
            schema = schema.add(column, kind)
        return AnalyzeResult(schema)

    def __init__(self):
        self.held: list[str] = []
        self.start = self.idx = self.new = 0
        self.given: tuple = ()

    def eval(self, row: Row, max_rows: int, overlap: int = 0, key: str | None = None) -> Iterator[tuple]:
        self.given = (max_rows, overlap, [row[key]] if key is not None else [])
        self.held.append(json.dumps({k: v for k, v in row.asDict(True).items() if k != key}, ensure_ascii=False, default=str))
        self.new += 1
        if len(self.held) == max_rows:
            yield self._window()
            self.held, self.new = self.held[max_rows - overlap :], 0
            self.start, self.idx = self.start + max_rows - overlap, self.idx + 1

    def terminate(self) -> Iterator[tuple]:
        if self.new:  # rows that no window has held yet
            yield self._window()

    def _window(self) -> tuple:
        _, overlap, key = self.given
        return *key, self.idx, self.start, self.start + len(self.held), overlap if self.idx else 0, "[" + ", ".join(self.held) + "]"


def row_extraction(extractor: Any) -> type:
    """A table function of an extractor: f(table, text column) gives a row for each row found: pos, row as JSON, and error for a text that failed."""

    class ExtractRows:
        @staticmethod
        def analyze(table: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
            return _beside(table, _constant(text, "text"), (("pos", _INT), ("found", _STRING), ("error", _STRING)))

        def eval(self, row: Row, text: str) -> Iterator[tuple]:
            from quarry.functions.payload import canonical
            from quarry.operators.extraction import found_in

            others = [v for k, v in row.asDict(False).items() if k != text]
            try:
                rows = found_in(extractor, row[text])[0]
            except Exception as e:  # a text's failure is data
                yield *others, None, None, f"{type(e).__name__}: {e}"
                return
            for pos, found in enumerate(rows):
                yield *others, pos, canonical(found), None

    return ExtractRows


def register(spark: SparkSession, **extractors: Any) -> None:
    """Make chunk_text, chunk_sections and chunk_rows known to SQL, and each extractor under its name as row_extraction()."""
    for name, made in {"chunk_text": ChunkText, "chunk_sections": ChunkSections, "chunk_rows": ChunkRows, **{n: row_extraction(x) for n, x in extractors.items()}}.items():
        spark.udtf.register(name, udtf(made))


__all__ = ["ChunkRows", "ChunkSections", "ChunkText", "register", "row_extraction", "windows"]
