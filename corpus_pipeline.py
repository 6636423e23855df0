"""The corpus pipeline: each stage reads what the one before it kept, written as Parquet.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import copies, mixing, packing, pii, toxicity
from quarry.llm.common import discard, stored
from quarry.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity cutoff; the model learns from those of docs that labels covers.

    Null and empty texts score 0 and stay, as do all repeated rows of a clean text.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of five-word shingles at a Jaccard similarity of 0.8: the one with the smallest doc_id.

    SimHash trees propose, whole texts confirm. Null, empty and blank texts are
    copies of each other; of repeated rows one stays; rows without a doc_id stay.
    """
    return copies.drop_near_duplicates(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew; null and empty texts stay as they are, with null and 0 characters."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it, null sources among them; texts without words as often as their source's epochs."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents in sequences of 1024 tokens; a null or empty text is the end id alone, each repetition packed again."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_copies), ("pii", redact), ("mix", mix), ("pack", pack)]

#: A model, fingerprints and token ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents, of any columns beside theirs too; no documents give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
