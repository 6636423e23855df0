"""The evaluation runner: a folder of predictions and gold to scores, summary and report."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarry.functions.compare import variant_match
from quarry.operators.evaluation import engine_summary, map_scores
from quarry.plans.validate import type_share
from quarry.sources.files import members, read_evaluation, require_object


@lru_cache(maxsize=256)
def _read_schema(text: str) -> dict:
    return json.loads(text)


@F.pandas_udf(DoubleType())
def _type_correctness(predicted: pd.Series, schema: pd.Series) -> pd.Series:
    return pd.Series([1.0 if s is None else type_share(json.loads(p), _read_schema(s)) for p, s in zip(predicted, schema)])


def score_pairs(pairs: DataFrame) -> DataFrame:
    """(engine, document, METRICS, type_correctness, error) of rows (engine, name, predicted, gold, schema) of JSON texts.

    type_correctness is 1 where schema is null. A predicted or gold text that is
    no JSON object is an error. error is always null.
    """
    read = pairs.withColumn("predicted", require_object("predicted")).withColumn("gold", require_object("gold"))
    read = read.withColumn("scores", map_scores(members("predicted"), members("gold"), variant_match))
    return read.select("engine", F.col("name").alias("document"), "scores.*", _type_correctness("predicted", "schema").alias("type_correctness"), F.lit(None).cast("string").alias("error"))


def score_folder(spark: SparkSession, path: str, engines: list[str] | None = None) -> DataFrame:
    """score_pairs of predictions/<engine>/*.json beside gold/*.json, with gold/<name>.schema.json where there is one."""
    return score_pairs(read_evaluation(spark, path, engines))


def report(scores: DataFrame) -> dict:
    """timestamp, scores and engine_summaries as plain values; the documents of an evaluation folder fit the driver."""
    return {"timestamp": datetime.now(timezone.utc).isoformat(), "scores": [r.asDict() for r in scores.orderBy("engine", "document").toLocalIterator()],
            "engine_summaries": {r["engine"]: {k: v for k, v in r.asDict().items() if k != "engine"} for r in engine_summary(scores).orderBy("engine").toLocalIterator()}}


def report_json(scores: DataFrame) -> str:
    return json.dumps(report(scores), ensure_ascii=False, indent=2)
