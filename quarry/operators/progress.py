"""Counts and progress of a job from the pass that writes its rows: no second job, and nothing held for one."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F



def batch_counts(error: str = "error") -> dict[str, Column]:
    """total, succeeded and failed of rows with an error column."""
    return {"total": F.count(F.lit(1)), "succeeded": F.count_if(F.col(error).isNull()), "failed": F.count_if(F.col(error).isNotNull())}


def write_counted(df: DataFrame, path: str, counts: dict[str, Column] | None = None, on_progress: Callable[..., None] | None = None, form: str = "parquet", error: str = "error", every: float = 0.2) -> dict[str, Any]:
    """Write df and return counts, aggregates over its rows, made in the same pass.

    on_progress is told on the driver, while the job runs, each time that tasks
    have ended: current rows written and failed ones among them, and at the end
    once more with the final counts. A task that is repeated counts again in
    what is told on the way, never in what is returned.
    """
    counts = counts or batch_counts(error)
    seen = Observation()
    watched = df.observe(seen, *[c.alias(n) for n, c in counts.items()])
    if on_progress is None:
        watched.write.format(form).save(path)
        return seen.get
    context = df.sparkSession.sparkContext
    rows, bad = context.accumulator(0), context.accumulator(0)
    known = error in df.columns

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows.add(batch.num_rows)
            if known:
                column = batch.column(batch.schema.get_field_index(error))
                bad.add(len(column) - column.null_count)
            yield batch

    over, told = threading.Event(), [0]

    def tell() -> None:
        while not over.wait(every):
            if rows.value > told[0]:
                told[0] = rows.value
                on_progress(current=told[0], failed=bad.value, done=False)

    watcher = threading.Thread(target=tell, daemon=True)
    watcher.start()
    try:
        watched.mapInArrow(counted, watched.schema).write.format(form).save(path)
    finally:
        over.set()
        watcher.join()
    found = seen.get
    on_progress(current=rows.value, failed=bad.value, done=True)
    return found
