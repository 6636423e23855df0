"""The batch transforms over a stream of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.chunking import chunk_text


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, ts timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def chunk_stream(docs: DataFrame, *, max_chars: int, overlap: int = 0, delay: str = "1 hour") -> DataFrame:
    """Chunks of a stream; a document seen again within the delay is dropped."""
    return docs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["doc_id"]).transform(chunk_text("text", max_chars=max_chars, overlap=overlap))


def write_each(df: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Each batch through a transform into a folder of its own number, so that a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
