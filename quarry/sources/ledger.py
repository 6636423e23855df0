"""A ledger of paid answers: small Parquet files that tasks write as they go, in any file system that Arrow opens."""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet


class LedgerWriter:
    """Writes answers of a task into a folder, some rows a file; a file appears whole or not at all.

    folder is a local path or a URI that pyarrow.fs knows (file, hdfs, s3, gs). A
    file is written under a name that Spark does not read and then renamed.
    """

    def __init__(self, folder: str, rows: int = 64):
        self.folder, self.rows = folder, rows

    def write(self, answers: pd.DataFrame) -> None:
        if answers.empty:
            return
        system, root = pa.fs.FileSystem.from_uri(self.folder) if ":/" in self.folder else (pa.fs.LocalFileSystem(), self.folder)
        system.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.parquet"
        schema = pa.schema([(c, pa.int64() if c == "processing_time_ms" else pa.string()) for c in answers.columns])
        with system.open_output_stream(f"{root}/_{name}") as out:
            pa.parquet.write_table(pa.Table.from_pandas(answers, schema, preserve_index=False), out)
        system.move(f"{root}/_{name}", f"{root}/{name}")
