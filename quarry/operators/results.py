"""Extraction results: envelope, coercion, validation, confidences and provenance of a payload column."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import payload as P
from quarry.plans import validate

#: The columns of a result, in order.
FIELDS = ("data", "engine_name", "schema", "field_confidence", "provenance", "valid", "raw", "metadata", "pages", "processing_time_ms")


def build_results(df: DataFrame, payload: str, schema: Mapping[str, Any]) -> DataFrame:
    """df with the result row of a JSON payload column: FIELDS, and errors.

    The payload may be fenced, amid prose or quoted; it is read once. Envelopes
    are taken off, text is coerced to the type of its top-level field, and what
    comes out is validated. A payload that holds no object or list has null data
    and is not valid. data, schema, raw and metadata are JSON texts; metadata is
    the payload's own. engine_name and processing_time_ms are those of df's
    columns of these names or engine, else null.
    """
    took = [c for c in ("engine_name", "engine") if c in df.columns][:1]
    read = df.withColumn("__r", P.result_parts(F.col(payload)))
    data = read.withColumn("data", validate.coerce_json(F.col("__r.data"), schema)).withColumn("__v", F.try_parse_json("data"))
    checked = data.withColumn("errors", F.when(F.col("data").isNull(), F.array(F.lit("$: no payload"))).otherwise(validate.errors(F.col("__v"), schema)))
    told = checked.withColumns({
        "valid": F.size("errors") == 0, "schema": F.lit(json.dumps(schema, ensure_ascii=False)), "raw": F.col(payload),
        **{c: F.col(f"__r.{c}") for c in ("field_confidence", "provenance", "metadata")}, "pages": F.col("__r.pages").cast("int"),
        "engine_name": F.col(took[0]) if took else F.lit(None).cast("string"),
    })
    if "processing_time_ms" not in df.columns:
        told = told.withColumn("processing_time_ms", F.lit(None).cast("long"))
    return told.drop("__r", "__v")


def result_json():
    """The result row as the JSON text of one object with FIELDS as keys; data, schema, raw and metadata stay JSON within."""
    nested = {"data", "schema", "raw", "metadata"}
    shown = [F.try_parse_json(c).alias(c) if c in nested else F.col(c) for c in FIELDS]
    return F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})
