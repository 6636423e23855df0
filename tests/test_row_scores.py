"""Scores of both sides of a row: no shuffle, and those of the join over rows of fields."""

import json

from quarry import queries
from quarry.operators import evaluation, runner
from quarry.sources.files import json_fields
from conftest import SF


def test_scores_of_pairs_are_those_of_the_join_without_one(spark):
    sides = [({"a": 1, "b": " X  y", "c": None}, {"a": "1.0", "b": "x y", "c": None}), ({}, {}), ({}, {"a": 1}), ({"a": 1}, {}), ({"a": {"x": [1, "2"]}, "z": 0}, {"a": {"x": ["1", 2]}, "d": "May 5, 2020"}), ({"d": "2020-05-05"}, {"d": "May 5, 2020"})]
    rows = [("e", f"n{k}", json.dumps(p), json.dumps(g), None) for k, (p, g) in enumerate(sides)]
    pairs = spark.createDataFrame(rows, "engine string, name string, predicted string, gold string, schema string")
    scored = runner.score_pairs(pairs)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    got = {r.document: tuple(r[m] for m in evaluation.METRICS) for r in scored.collect()}
    keys = ["engine", "name"]
    want = evaluation.field_scores(json_fields(pairs, "predicted", keys, as_json=True), json_fields(pairs, "gold", keys, as_json=True), keys, nested=True)
    assert {r.name: tuple(r)[2:] for r in want.collect()} == {k: v for k, v in got.items() if k != "n1"} and got["n1"] == (1.0, 1.0, 1.0, 1.0, 0.0)


def test_pairs_of_one_name_are_scored_each(spark):
    rows = [("e", "n", '{"a": 1}', '{"a": 1}', None), ("e", "n", '{"a": 2}', '{"a": 1}', None), ("e", None, '{"a": 2}', '{"a": 1}', None)]
    pairs = spark.createDataFrame(rows, "engine string, name string, predicted string, gold string, schema string")
    assert sorted(r.field_accuracy for r in runner.score_pairs(pairs).collect()) == [0.0, 0.0, 1.0]


def test_orders_are_scored_within_their_row(spark):
    for name in ("field_accuracy", "per_field_prf", "hallucination_rate"):
        assert "Exchange" not in queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
