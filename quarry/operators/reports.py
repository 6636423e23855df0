"""Reports that can be merged: a cube of scores over engines and document classes, and latency as a quantile sketch.

A report holds counts, sums and sketches, not means, so that the reports of
several runs add up to the report of all of them without the scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.evaluation import METRICS

#: Levels of a sketch: quantiles are off by some 1.33 % of the ranks at most, with a chance of 0.99.
K = 200


def cube(scores: DataFrame, dims: Sequence[str] = ("engine", "document_class"), metrics: Sequence[str] = METRICS, latency: str = "latency_ms") -> DataFrame:
    """(*dims, level, documents, sum_<metric>, latency) for every combination of dims and of all of them: one shuffle of partial aggregates.

    level has a bit for each of dims that is summed over, the last one the
    lowest, as grouping_id; so a null of dims and a sum over them stay apart.
    Null metrics count as 0.
    """
    sums = [F.coalesce(F.sum(m), F.lit(0.0)).alias(f"sum_{m}") for m in metrics]
    sketch = F.kll_sketch_agg_bigint(F.col(latency).cast("long"), F.lit(K)).alias("latency")
    return scores.cube(*dims).agg(F.grouping_id().alias("level"), F.count("*").alias("documents"), *sums, sketch)


def merged(reports: Sequence[DataFrame], dims: Sequence[str] = ("engine", "document_class")) -> DataFrame:
    """The report of all scores of several reports."""
    rows = reduce(DataFrame.unionByName, reports)
    sums = [F.sum(c).alias(c) for c in rows.columns if c == "documents" or c.startswith("sum_")]
    return rows.groupBy(*dims, "level").agg(*sums, F.kll_merge_agg_bigint("latency", F.lit(K)).alias("latency"))


def shown(report: DataFrame, quantiles: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """A report's means and latency quantiles; a group without latencies has null quantiles."""
    timed = F.kll_sketch_get_n_bigint("latency") > 0
    mean = lambda c: (F.col(c) / F.col("documents")).alias(c.removeprefix("sum_"))
    at: list[Column] = [F.when(timed, F.kll_sketch_get_quantile_bigint("latency", F.lit(float(q)))).alias(f"latency_p{round(q * 100)}") for q in quantiles]
    keep = [c for c in report.columns if c != "latency" and not c.startswith("sum_")]
    return report.select(*keep, *[mean(c) for c in report.columns if c.startswith("sum_")], F.kll_sketch_get_n_bigint("latency").alias("timed"), *at)
