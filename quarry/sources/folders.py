"""Folders of evaluations and benchmark cases as a Spark data source, and results as folders.

    register(spark)
    spark.read.format("extraction_evaluation").load(folder).where("engine = 'lift'")
    spark.read.format("extraction_cases").load(folder)
    spark.readStream.format("extraction_evaluation").load(folder)
    predictions.write.format("extraction_evaluation").mode("append").save(folder)

A read lists the folder on the driver, drops what filters on engine, name and
document rule out, and deals the rest to partitions of FILES rows; a task opens
only the files of its rows. A write puts a file for every row under a hidden
name, and shows all of them when the job commits, or none.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any
from uuid import uuid4

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a partition.
FILES = 64


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path in it of a local path or a URI."""
    return pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The files under a folder, relative to it, hidden ones left out."""
    system, root = opened(path)
    found = system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = (posixpath.relpath(f.path, root) for f in found if f.type is pyarrow.fs.FileType.File)
    return sorted(n for n in names if not any(p.startswith(("_", ".")) for p in n.split("/")))


def read_text(path: str, name: str | None) -> str | None:
    """A file's text, bytes that are no UTF-8 left out; null for no file."""
    if name is None:
        return None
    system, root = opened(path)
    with system.open_input_stream(f"{root}/{name}") as stream:
        return stream.read().decode("utf-8", "ignore")


def evaluation_rows(names: list[str]) -> list[dict]:
    """Of predictions/<engine>/<name>.json beside gold/<name>.json and gold/<name>.schema.json: the files of each prediction that has gold."""
    known = set(names)
    rows = []
    for n in names:
        parts = n.split("/")
        if len(parts) == 3 and parts[0] == "predictions" and n.endswith(".json"):
            stem = parts[2].removesuffix(".json")
            if (gold := f"gold/{stem}.json") in known:
                schema = f"gold/{stem}.schema.json"
                rows.append({"engine": parts[1], "name": stem, "predicted": n, "gold": gold, "schema": schema if schema in known else None})
    return rows


def case_rows(names: list[str]) -> list[dict]:
    """Of <stem>.schema.json, <stem>.gold.json and the first other file of the stem: the files of each case that has all three."""
    documents: dict[str, str] = {}
    for n in names:
        if not n.endswith((".schema.json", ".gold.json")):
            documents.setdefault(posixpath.splitext(n)[0], n)
    known = set(names)
    return [{"name": posixpath.basename(stem), "document": d, "text": d, "schema": f"{stem}.schema.json", "gold": f"{stem}.gold.json"}
            for stem, d in documents.items() if {f"{stem}.schema.json", f"{stem}.gold.json"} <= known]


@dataclass
class Files(InputPartition):
    rows: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(0)


class _Reading:
    """What batch and stream readers share: rows of files, narrowed by filters, opened in tasks."""

    def __init__(self, source: FolderSource):
        self.path, self.schema_names, self.keys, self.rows_of = source.options["path"], source.names, source.keys, source.rows_of
        self.wanted: dict[str, set] = {}

    def pushed(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name not in self.keys:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[name] = self.wanted.get(name, values) & values

    def planned(self, names: list[str]) -> list[Files]:
        rows = [r for r in self.rows_of(names) if all(r[k] in v for k, v in self.wanted.items())]
        return [Files(rows[at : at + FILES]) for at in range(0, len(rows), FILES)] or [Files()]

    def read(self, partition: Files) -> Iterator[tuple]:
        for row in partition.rows:
            yield tuple(row[n] if n in self.keys else read_text(self.path, row[n]) for n in self.schema_names)


class _Reader(_Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.pushed(filters)

    def partitions(self) -> list[Files]:
        return self.planned(listed(self.path))


class _StreamReader(_Reading, DataSourceStreamReader):
    """A stream's offset is the names that were there: new ones make the next batch. A folder of evaluations is listed anyway."""

    def initialOffset(self) -> dict:
        return {"seen": []}

    def latestOffset(self) -> dict:
        return {"seen": listed(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        before = {json.dumps(r, sort_keys=True) for r in self.rows_of(start["seen"])}
        rows = [r for r in self.rows_of(end["seen"]) if json.dumps(r, sort_keys=True) not in before]
        return [Files(rows[at : at + FILES]) for at in range(0, len(rows), FILES)] or [Files()]

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """A file for each row, shown at commit. Rows of a name that is there replace it."""

    def __init__(self, source: FolderSource):
        self.path, self.hidden, self.files_of = source.options["path"], f"_write-{uuid4().hex}", source.files_of

    def write(self, rows: Iterator[Any]) -> _Written:
        system, root = opened(self.path)
        out = []
        for row in rows:
            for name, text in self.files_of(row.asDict()):
                at = f"{self.hidden}/{uuid4().hex}"
                system.create_dir(f"{root}/{self.hidden}", recursive=True)
                with system.open_output_stream(f"{root}/{at}") as stream:
                    stream.write(text.encode())
                out.append((at, name))
        return _Written(out)

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = opened(self.path)
        for at, name in (f for m in messages if m is not None for f in m.files):
            system.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
            system.move(f"{root}/{at}", f"{root}/{name}")
        self.abort([])

    def abort(self, messages: list) -> None:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{self.hidden}").type is pyarrow.fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.hidden}")


class FolderSource(DataSource):
    names: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()

    def schema(self) -> StructType:
        out = StructType()
        for n in self.names:
            out = out.add(n, "string")
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("A folder is added to, not overwritten: use mode append")
        return _Writer(self)


class EvaluationSource(FolderSource):
    """(engine, name, predicted, gold, schema): a row for each prediction that has gold."""

    names, keys = ("engine", "name", "predicted", "gold", "schema"), ("engine", "name")
    rows_of = staticmethod(evaluation_rows)

    @classmethod
    def name(cls) -> str:
        return "extraction_evaluation"

    @staticmethod
    def files_of(row: dict) -> Iterator[tuple[str, str]]:
        stem = row["name"]
        for name, text in ((f"predictions/{row['engine']}/{stem}.json", row["predicted"]), (f"gold/{stem}.json", row["gold"]), (f"gold/{stem}.schema.json", row["schema"])):
            if text is not None:
                yield name, text


class CaseSource(FolderSource):
    """(name, document, text, schema, gold): a row for each case that is whole."""

    names, keys = ("name", "document", "text", "schema", "gold"), ("name", "document")
    rows_of = staticmethod(case_rows)

    @classmethod
    def name(cls) -> str:
        return "extraction_cases"

    @staticmethod
    def files_of(row: dict) -> Iterator[tuple[str, str]]:
        yield row["document"] or f"{row['name']}.txt", row["text"] or ""
        yield f"{row['name']}.schema.json", row["schema"]
        yield f"{row['name']}.gold.json", row["gold"]


def register(spark: SparkSession) -> None:
    """Make the formats extraction_evaluation and extraction_cases known, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (EvaluationSource, CaseSource):
        spark.dataSource.register(source)
