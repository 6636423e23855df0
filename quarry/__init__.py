"""Schema-guided extraction and corpus preparation on Spark."""

from quarry.operators.chunking import chunk_array, chunk_json_array, chunk_sections, chunk_table_rows, chunk_text, resolve_chunks
from quarry.operators.engines import composite_engine, provider_engine
from quarry.operators.extraction import extract_chunks, extract_rows, extract_rows_chunked
from quarry.operators.results import build_results
from quarry.operators.routing import Engine, Router, roster
from quarry.plans.schema import infer_schema, load_schema, template_to_schema

__all__ = [
    "Engine", "Router", "build_results", "chunk_array", "chunk_json_array", "chunk_sections", "chunk_table_rows", "chunk_text", "composite_engine", "extract_chunks",
    "extract_rows", "extract_rows_chunked", "infer_schema", "load_schema", "provider_engine", "resolve_chunks", "roster", "template_to_schema",
]
