"""Scores of predicted against gold fields, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.compare import json_match
from quarry.functions.text import let, values_match


def field_scores(predicted: DataFrame, gold: DataFrame, keys: list[str], nested: bool = False) -> DataFrame:
    """One row per document: field_accuracy, precision, recall, f1, hallucination_rate.

    Both sides hold rows (*keys, field, value); a field is there if its row is.
    With nested, values are JSON texts of any depth, and compared by their types.
    """
    p = predicted.select(*keys, "field", F.col("value").alias("p"), F.lit(True).alias("in_p"))
    g = gold.select(*keys, "field", F.col("value").alias("g"), F.lit(True).alias("in_g"))
    both = p.join(g, [*keys, "field"], "full_outer").withColumns({"in_p": F.coalesce("in_p", F.lit(False)), "in_g": F.coalesce("in_g", F.lit(False))})
    hit = F.col("in_p") & F.col("in_g") & F.coalesce((json_match if nested else values_match)(F.col("p"), F.col("g")), F.lit(False))
    counts = both.groupBy(*keys).agg(F.count_if(hit).alias("tp"), F.count_if("in_p").alias("n_p"), F.count_if("in_g").alias("n_g"), F.count_if(F.col("in_p") & ~F.col("in_g")).alias("extra"))
    return counts.select(*keys, *scores(F.col("tp"), F.col("n_p"), F.col("n_g"), F.col("extra")))


def map_scores(predicted: Column, gold: Column, match: Callable[[Column, Column], Column] = values_match) -> Column:
    """struct of field_scores' metrics where both sides of a document stand in one row, as maps of fields to values: no join, no shuffle, memory of a row.

    A null map has no fields; match compares two values.
    """

    def counted(s: Column) -> Column:
        shared = F.filter(F.map_entries(s["g"]), lambda e: F.map_contains_key(s["p"], e["key"]))
        hits = lambda both: F.filter(both, lambda e: F.coalesce(match(F.try_element_at(s["p"], e["key"]), e["value"]), F.lit(False)))
        number = lambda found: F.greatest(F.size(found), F.lit(0)).cast("long")
        n_p, n_g = number(s["p"]), number(s["g"])
        return let(shared, lambda both: F.struct(number(hits(both)).alias("tp"), n_p.alias("n_p"), n_g.alias("n_g"), (n_p - number(both)).alias("extra")))

    counts = let(F.struct(predicted.alias("p"), gold.alias("g")), counted)
    return let(counts, lambda c: F.struct(*scores(c["tp"], c["n_p"], c["n_g"], c["extra"])))


def scores(tp: Column, n_p: Column, n_g: Column, extra: Column) -> list[Column]:
    """The metrics from counts; sides without fields have the values that are usual for them."""
    empty = (n_p == 0) & (n_g == 0)
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    precision, recall = F.when(empty, 1.0).otherwise(share(tp, n_p)), F.when(empty, 1.0).otherwise(share(tp, n_g))
    return [F.when(n_g == 0, F.when(n_p == 0, 1.0).otherwise(0.0)).otherwise(share(tp, n_g)).alias("field_accuracy"), precision.alias("precision"), recall.alias("recall"),
            share(2 * precision * recall, precision + recall).alias("f1"), share(extra, n_p).alias("hallucination_rate")]


def array_alignment(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, alignment): matched gold fields of aligned positions, from rows (*keys, pos, field, value).

    Fields that only a prediction has cost nothing; documents of one side only score 0.
    """
    p = predicted.select(*keys, "pos", "field", F.col("value").alias("p"), F.lit(True).alias("in_p"))
    g = gold.select(*keys, "pos", "field", F.col("value").alias("g"), F.lit(True).alias("in_g"))
    both = p.join(g, [*keys, "pos", "field"], "full_outer")
    hit = F.col("in_p").isNotNull() & F.col("in_g").isNotNull() & values_match(F.col("p"), F.col("g"))
    counts = both.groupBy(*keys).agg(F.count_if(hit).alias("hits"), F.count("in_g").alias("n_g"), F.count("in_p").alias("n_p"))
    return counts.select(*keys, F.when((F.col("n_g") == 0) | (F.col("n_p") == 0), 0.0).otherwise(F.col("hits") / F.col("n_g")).alias("alignment"))


METRICS = ("field_accuracy", "precision", "recall", "f1", "hallucination_rate")


def engine_summary(document_scores: DataFrame, engine: str = "engine") -> DataFrame:
    """One row per engine: documents and the mean of every metric."""
    return document_scores.groupBy(engine).agg(F.count("*").cast("double").alias("documents"), *[F.avg(m).alias(m) for m in METRICS])


def summary_table(summary: DataFrame, engine: str = "engine") -> str:
    """The summary as text, sorted by engine, three decimals; one line per engine."""
    rows = summary.orderBy(engine).collect()
    head = f"{'engine':20}" + "".join(f"{m:>20}" for m in METRICS)
    return "\n".join([head] + [f"{r[engine]:20}" + "".join(f"{r[m]:>20.3f}" for m in METRICS) for r in rows])
