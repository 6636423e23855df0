"""Model calls at scale: models that live as long as their worker, batches of like lengths, and rate limits that hold over a whole stage.

``infer`` is for a model that runs in the worker: it is built once a worker
process, whatever number of tasks that runs, and gets batches whose padded size
keeps within a budget of tokens. ``limited`` is for a provider that counts
requests and tokens a minute: the tasks of a barrier stage agree in every period
on who may call when, so that the limit holds however many they are.
"""

from __future__ import annotations

import asyncio
import inspect
import json
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any
from uuid import uuid4

import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.sources.files import shared_folder

#: The answers' columns: the answer as JSON text or as the model's own text, or the error.
ANSWER = "answer string, error_type string, error string"
#: How an answer came about: rows of its batch, and their padded tokens.
BATCH = ", batch_rows int, batch_tokens long"
#: Rows and characters that a worker holds to form batches of, at most; a longer text is held alone.
WINDOW_ROWS, WINDOW_CHARACTERS = 2048, 16_000_000

#: Bytes of text that a task of a rate limit is dealt in a round, and rows that a file holds on the way there, at most.
ROUND_BYTES, ROUND_ROWS = 128_000_000, 10_000

#: The models that this worker process has built, by key.
_models: dict[str, Callable[[list[str]], list]] = {}


def estimated_tokens(text: str) -> int:
    """Four characters a token."""
    return max(1, -(-len(text) // 4))


@dataclass(frozen=True)
class Model:
    """A model of a worker: factory() builds it, and it gives the answers to a list of texts, in order.

    budget bounds a batch: its rows times the tokens of its longest text; a text
    over it is a batch alone. Two Models are one if their keys are.
    """

    factory: Callable[[], Callable[[list[str]], list]]
    budget: int = 16_384
    tokens: Callable[[str], int] = estimated_tokens
    key: str = field(default_factory=lambda: uuid4().hex)

    def here(self) -> Callable[[list[str]], list]:
        """The model in this process, built if it is not there yet."""
        if self.key not in _models:
            _models[self.key] = self.factory()
        return _models[self.key]


def batches_of(sizes: list[int], budget: int) -> Iterator[list[int]]:
    """Places of sizes in batches of like sizes: as many as keep the longest times their number within the budget."""
    batch: list[int] = []
    for at in sorted(range(len(sizes)), key=lambda k: (sizes[k], k)):
        if batch and (len(batch) + 1) * sizes[at] > budget:
            yield batch
            batch = []
        batch.append(at)
    if batch:
        yield batch


def told(answer: Any) -> str:
    """An answer as text: a text as it is, else JSON; what has a model_dump by that."""
    plain = answer.model_dump() if hasattr(answer, "model_dump") else answer
    return plain if isinstance(plain, str) else json.dumps(plain, ensure_ascii=False)


def _answered(model: Callable[[list[str]], list], texts: list[str]) -> list[tuple]:
    """(answer, error_type, error) of texts; where a batch fails, each text is tried alone, so that one bad text costs no other its answer."""
    try:
        found = list(model(texts))
        if len(found) != len(texts):
            raise ValueError(f"The model gave {len(found)} answers to {len(texts)} texts")
        return [(told(x), None, None) for x in found]
    except Exception as e:  # a failure is data
        if len(texts) == 1:
            return [(None, type(e).__name__, str(e))]
        return [x for t in texts for x in _answered(model, [t])]


def _windows(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.Table]:
    """The rows of batches, as many at once as WINDOW_ROWS and WINDOW_CHARACTERS allow, in order."""
    held: list[pa.RecordBatch] = []
    rows = characters = 0
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start = 0
        for k, x in enumerate(column):
            n = len(x.as_py() or "")
            if rows and (rows == WINDOW_ROWS or characters + n > WINDOW_CHARACTERS):
                yield pa.Table.from_batches([*held, batch.slice(start, k - start)])
                held, start, rows, characters = [], k, 0, 0
            rows, characters = rows + 1, characters + n
        held.append(batch.slice(start))
    if rows:
        yield pa.Table.from_batches(held)


def _typed(df: DataFrame, columns: str) -> StructType:
    """df's schema with columns that it must not have yet."""
    added = StructType.fromDDL(columns)
    if clash := {f.name.lower() for f in added} & {c.lower() for c in df.columns}:
        raise ValueError(f"The rows already have columns {sorted(clash)}")
    return StructType([*df.schema.fields, *added.fields])


def _with(table: pa.Table, rows: list[tuple], columns: str) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    for k, (name, kind) in enumerate(c.split() for c in columns.split(", ")):
        table = table.append_column(name, pa.array([r[k] for r in rows], kinds[kind]))
    return iter(table.combine_chunks().to_batches())


def infer(df: DataFrame, model: Model, text: str = "text", prompt: Callable[[str], str] | None = None) -> DataFrame:
    """df with answer, error_type, error, batch_rows and batch_tokens: the model's answers to a text column, row by row, in their order.

    A null text is not asked for and has a null answer. prompt makes what the
    model is given of a text. A task keeps WINDOW_ROWS rows at most; a model that
    fails on a batch is asked again text by text.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = model.here()
        for table in _windows(batches, text):
            texts = table.column(text).to_pylist()
            known = [k for k, t in enumerate(texts) if t is not None]
            given = [prompt(texts[k]) if prompt else texts[k] for k in known]
            sizes = [model.tokens(t) for t in given]
            out: list[tuple] = [(None, None, None, None, None)] * len(texts)
            for batch in batches_of(sizes, model.budget):
                for at, answer in zip(batch, _answered(asked, [given[at] for at in batch])):
                    out[known[at]] = (*answer, len(batch), len(batch) * max(sizes[b] for b in batch))
            yield from _with(table, out, ANSWER + BATCH)

    return df.mapInArrow(each, _typed(df, ANSWER + BATCH))


def schedule(wanted: list[list[int]], requests: int, tokens: int, turn: int) -> list[list[int]]:
    """Slots of each task for a period of so many requests and tokens: wanted has the costs of each task's next calls.

    Tasks take turns, beginning with another one each period; a task whose next
    call is over what is left waits. Every task that knows wanted comes to the
    same schedule.
    """
    out: list[list[int]] = [[] for _ in wanted]
    waiting = deque((turn + k) % len(wanted) for k in range(len(wanted)))
    slot = 0
    while waiting and slot < requests:
        task = waiting.popleft()
        if len(out[task]) == len(wanted[task]) or wanted[task][len(out[task])] > tokens:
            continue
        tokens -= wanted[task][len(out[task])]
        out[task].append(slot)
        slot += 1
        waiting.append(task)
    return out


@dataclass(frozen=True)
class Limit:
    """What a provider allows in a period of seconds; a call of more tokens than that counts as all of them."""

    requests: int = 100
    tokens: int = 100_000
    period: float = 60.0


def limited(df: DataFrame, call: Callable[[str], Any], limit: Limit, text: str = "text", tasks: int | None = None, tokens: Callable[[str], int] = estimated_tokens) -> DataFrame:
    """df with answer, error_type and error of call(text), plain or awaitable, all tasks together within the limit.

    The rows are stored in the shared folder and dealt in rounds of ROUND_BYTES a
    task, so that what a task reads is bounded however many rows there are. A
    round is a job of one barrier stage, of as many tasks as the cluster runs at
    once at most, and begins when the last period of the round before has ended;
    its answers are stored. So all calls are made when limited() is called, once,
    and not again by uses of the result. In every period they tell each other what they would ask next
    and take the slots of one schedule; slot k begins k / requests of a period
    after its start, so that no more than limit.requests calls begin in any
    stretch of a period's length. A call that takes longer runs on while others
    begin; a period's calls end before the next is agreed on. A null text is not
    asked for. A lost executor repeats the round, as barrier stages do; behind a
    ledger (extraction.answered) no finished call is repeated.
    """
    spark, kind = df.sparkSession, _typed(df, ANSWER)
    most = spark.sparkContext.defaultParallelism
    n = max(1, min(tasks or most, most))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        me, turn = context.partitionId(), 0
        source = _pending(batches, text, tokens)
        with asyncio.Runner() as runner:
            ready: deque = deque()
            while True:
                while len(ready) < limit.requests and (row := next(source, None)) is not None:
                    ready.append(row)
                wanted = [min(cost, limit.tokens) for _, asked, cost in ready if asked is not None]
                everyone = [json.loads(x) for x in context.allGather(json.dumps([len(ready), wanted[: limit.requests]]))]
                began = time.monotonic()
                if not any(held for held, _ in everyone):
                    return
                slots = deque(schedule([w for _, w in everyone], limit.requests, limit.tokens, turn)[me])
                turn += 1
                due = []
                while ready and (ready[0][1] is None or slots):
                    row, asked, _ = ready.popleft()
                    due.append((row, asked, began + limit.period * slots.popleft() / limit.requests if asked is not None else began))
                answers = runner.run(_called(call, due))
                if due:
                    yield from _with(pa.Table.from_batches([row for row, _, _ in due]), answers, ANSWER)
                if any(len(w) for _, w in everyone):
                    time.sleep(max(0.0, began + limit.period - time.monotonic()))

    folder = shared_folder(spark)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(at)
    system.deleteOnExit(at)
    df.write.option("maxRecordsPerFile", ROUND_ROWS).parquet(f"{folder}/asked")
    asked = spark.read.schema(df.schema).parquet(f"{folder}/asked")
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
    sizes = asked.groupBy(name.alias("file")).agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).orderBy("file").collect()
    for files in _rounds([tuple(r) for r in sizes], n * ROUND_BYTES):
        dealt = spark.read.schema(df.schema).parquet(*[f"{folder}/asked/{f}" for f in files]).repartition(n)
        dealt.mapInArrow(each, kind, barrier=True).write.mode("append").parquet(f"{folder}/answered")
    system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/asked"), True)
    return spark.read.schema(kind).parquet(f"{folder}/answered") if sizes else spark.createDataFrame([], kind)


def _rounds(sizes: list[tuple[str, int]], most: int) -> Iterator[list[str]]:
    """Files of (name, bytes) in order, as many at once as hold at most so many bytes; a larger one alone."""
    held: list[str] = []
    total = 0
    for name, size in sizes:
        if held and total + size > most:
            yield held
            held, total = [], 0
        held.append(name)
        total += size
    if held:
        yield held


def _pending(batches: Iterator[pa.RecordBatch], text: str, tokens: Callable[[str], int]) -> Iterator[tuple]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for k, x in enumerate(column):
            asked = x.as_py()
            yield batch.slice(k, 1), asked, 0 if asked is None else tokens(asked)


async def _called(call: Callable[[str], Any], due: list[tuple]) -> list[tuple]:
    """(answer, error_type, error) of texts, each call begun at its time."""

    async def one(asked: str | None, at: float) -> tuple:
        if asked is None:
            return None, None, None
        await asyncio.sleep(max(0.0, at - time.monotonic()))
        try:
            if inspect.iscoroutinefunction(call):
                return told(await call(asked)), None, None
            found = await asyncio.to_thread(call, asked)
            return told(await found if inspect.isawaitable(found) else found), None, None
        except Exception as e:  # a failure is data
            return None, type(e).__name__, str(e)

    return list(await asyncio.gather(*(one(asked, at) for _, asked, at in due)))
