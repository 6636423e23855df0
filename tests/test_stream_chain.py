"""The chain over micro-batches and a restart gives the rows of the batch transforms."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarry.operators import extraction
from quarry.streaming.chain import PROVIDER, chain_stream

SCHEMA = "doc_id long, idx int, rows string, ts timestamp"
DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    yield spark
    spark.conf.set(PROVIDER[0], before)


def run(spark, source, sink, checkpoint):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    writer = chain_stream(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    assert writer.trigger(availableNow=True).start().awaitTermination(90)


def put(spark, source, rows, hours=0):
    timed = [(*r, DAY + datetime.timedelta(hours=hours)) for r in rows]
    spark.createDataFrame(timed, SCHEMA).coalesce(1).write.mode("append").parquet(source)


def batch(spark, rows):
    results = spark.createDataFrame(rows, SCHEMA.rpartition(",")[0])
    chained = extraction.digest_chain(results).select("doc_id", "idx", "digest", "previous_digest")
    report = extraction.chunk_report(results.withColumn("error_type", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string")))
    return sorted(tuple(r) for r in chained.join(report, ["doc_id", "idx"]).select("doc_id", "idx", "digest", "previous_digest", "rows_returned", "rows_added", "duplicates_removed").collect())


def read(spark, sink):
    return sorted(tuple(r)[:7] for r in spark.read.parquet(sink).collect())


def test_chain_over_batches_and_a_restart(rocks, tmp_path):
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = [(d, i, None if (d + i) % 4 == 3 else f'[{{"a": {i % 3}}}, {{"a": {d}.0}}, {{"b": "é{i % 2}"}}]') for d in range(6) for i in range(7)]
    # out of order, in three files, one row twice; a restart before the last
    parts = [[r for k, r in enumerate(rows) if k % 3 == n] for n in (2, 0, 1)]
    put(rocks, source, parts[0])
    put(rocks, source, parts[1] + parts[0][:1])
    run(rocks, source, sink, checkpoint)
    assert 0 < rocks.read.parquet(sink).count() < len(rows)
    put(rocks, source, parts[2] + [(None, 0, "[]")])
    run(rocks, source, sink, checkpoint)
    assert read(rocks, sink) == batch(rocks, rows)
    each = rocks.read.parquet(sink).select("doc_id", "idx", F.posexplode("kept").alias("pos", "row"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "pos", "row"))), lambda x: x["row"])
    kept = {r.doc_id: r.rows for r in each.groupBy("doc_id").agg(ordered.alias("rows")).collect()}
    assert kept == {r.doc_id: r.rows for r in extraction.collected_rows(rocks.createDataFrame(rows, SCHEMA.rpartition(",")[0])).collect()}


def test_a_gap_is_closed_by_the_timer(rocks, tmp_path):
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = [(1, 0, '[{"a": 1}]'), (1, 2, '[{"a": 1}, {"a": 2}]'), (1, 4, None), (2, 0, "[]")]
    put(rocks, source, rows)
    run(rocks, source, sink, checkpoint)
    assert len(read(rocks, sink)) == 2
    put(rocks, source, [(3, 0, "[]")], hours=5)
    run(rocks, source, sink, checkpoint)
    assert read(rocks, sink) == batch(rocks, [*rows, (3, 0, "[]")])
    # its state is gone: the same document begins anew
    put(rocks, source, [(1, 0, '[{"a": 1}]')], hours=5)
    run(rocks, source, sink, checkpoint)
    assert [r for r in read(rocks, sink) if r[:2] == (1, 0)] == 2 * [r for r in batch(rocks, rows) if r[:2] == (1, 0)]
