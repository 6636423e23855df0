"""The digest chain and the first-wins dedupe of chunk results as they arrive: one state a document.

A document's results may come over many micro-batches, out of order and after a
restart. What is known of it is a value, the next place and the digest so far;
a map of the rows that were kept; and a map of results that came before their
turn. A document from which nothing comes for a while, as event times tell, is
closed by a timer: what waits is put out in order, gaps and all, and its state
goes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.functions.payload import canonical

#: The state store that such a query needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: The columns of a result, after the key: kept has the rows kept of it, as canonical JSON.
CHAINED = "idx int, digest string, previous_digest string, rows_returned int, rows_added int, duplicates_removed int, kept array<string>"
_COLUMNS = ["idx", "digest", "previous_digest", "rows_returned", "rows_added", "duplicates_removed", "kept"]


class ChunkChain(StatefulProcessor):
    """Results of one document in order of idx; idle milliseconds without news close it."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chain = handle.getValueState("chain", "next int, digest string")
        self.seen = handle.getMapState("seen", "row_hash string", "idx int")
        self.waiting = handle.getMapState("waiting", "idx int", "rows string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = 0
        for pdf in rows:
            newest = max(newest, int(pdf["ms"].max()))
            for idx, text in zip(pdf["idx"], pdf["rows"]):
                self._place(int(idx), None if pd.isna(text) else text)
        out = []
        while self.waiting.containsKey((self._state()[0],)):
            out.append(self._next(self._state()[0]))
        timers = list(self.handle.listTimers())
        due = max([newest + self.idle, *timers])
        for at in timers:
            self.handle.deleteTimer(at)
        self.handle.registerTimer(due)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        late = sorted(k[0] for k in self.waiting.keys())
        out = [self._next(idx) for idx in late]
        for state in (self.chain, self.seen, self.waiting):
            state.clear()
        yield self._frame(key, out)

    def close(self) -> None:
        pass

    def _state(self) -> tuple[int, str | None]:
        return self.chain.get() if self.chain.exists() else (0, None)

    def _place(self, idx: int, rows: str | None) -> None:
        """A result before its turn waits; one whose turn is over came twice and is dropped."""
        if idx >= self._state()[0] and not self.waiting.containsKey((idx,)):
            self.waiting.updateValue((idx,), (rows,))

    def _next(self, idx: int) -> tuple:
        rows = self.waiting.getValue((idx,))[0]
        self.waiting.removeKey((idx,))
        previous = self._state()[1]
        if rows is None:  # a failed chunk leaves the chain as it is
            self.chain.update((idx + 1, previous))
            return idx, None, previous, 0, 0, 0, []
        found, kept = json.loads(rows), []
        for row in found:
            text = canonical(row)
            mark = (hashlib.sha256(text.encode()).hexdigest(),)
            if not self.seen.containsKey(mark):
                self.seen.updateValue(mark, (idx,))
                kept.append(text)
        digest = hashlib.sha256(canonical(found).encode()).hexdigest()
        self.chain.update((idx + 1, digest))
        return idx, digest, previous, len(found), len(kept), len(found) - len(kept), kept

    def _frame(self, key: Any, out: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=_COLUMNS)
        pdf.insert(0, "key", key[0])
        return pdf


def chain_stream(results: DataFrame, key: str = "doc_id", time: str = "ts", delay: str = "1 hour", idle: int = 3_600_000) -> DataFrame:
    """(key, idx, digest, previous_digest, rows_returned, rows_added, duplicates_removed, kept) of a stream of results (key, idx, rows as JSON, time).

    Null rows are a failed chunk. Rows equal those of digest_chain and first_wins
    over the whole table, whatever the micro-batches; places count from 0, and
    what comes a second time is dropped, as is what comes more than delay behind
    the newest time. A document is closed once the stream is delay and idle
    milliseconds beyond its newest result. The session must have PROVIDER as its
    state store.
    """
    kind = dict(results.dtypes)[key]
    timed = results.where(F.col(key).isNotNull()).withWatermark(time, delay)
    grouped = timed.select(key, "idx", "rows", F.col(time), F.unix_millis(time).alias("ms")).groupBy(key)
    out = grouped.transformWithStateInPandas(ChunkChain(idle), f"key {kind}, {CHAINED}", outputMode="append", timeMode="eventTime")
    return out.withColumnRenamed("key", key)
