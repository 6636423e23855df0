"""Engines, routing, extraction and evaluation."""

from quarry.operators.benchmark import run_benchmark
from quarry.operators.evaluation import array_alignment, engine_summary, field_scores, summary_table
from quarry.operators.routing import PRIORITY, ROSTER, Engine, Router, field_agreement, roster
from quarry.operators.runner import report, report_json, score_folder

__all__ = ["PRIORITY", "ROSTER", "Engine", "Router", "array_alignment", "engine_summary", "field_agreement", "field_scores", "report", "report_json", "roster", "run_benchmark", "score_folder", "summary_table"]
