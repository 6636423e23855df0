"""Provider payloads to (field, value, confidence, provenance) rows.

value and provenance are JSON texts, so that 5 and "5" stay apart; a JSON null,
and what a field does not say, is null. A field is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.payload import field, kind
from quarry.functions.text import let

#: Where an entity's value may stand, in order.
_VALUES = ("normalized_value", "mention_text", "value")


def _number(v):
    return let(v, lambda x: F.when(kind(x).isin("integer", "number"), F.try_variant_get(x, "$", "double")))


def _json(v):
    """A variant as JSON text; JSON null is null."""
    return F.nullif(F.to_json(v), F.lit("null"))


def decode_fields(df: DataFrame, payload: str, key: str) -> DataFrame:
    """{"fields": {name: {value, confidence, ...}}}: a field that is no object is its own value."""
    fields = field(F.try_parse_json(payload), "fields").try_cast("map<string,variant>")
    at = df.select(key, F.explode(fields).alias("field", "v")).withColumn("m", F.col("v").try_cast("map<string,variant>"))
    own, get = F.col("m").isNull(), lambda n: F.try_element_at("m", F.lit(n))
    return at.select(key, "field", _json(F.when(own, F.col("v")).otherwise(get("value"))).alias("value"), _number(get("confidence")).alias("confidence"), _rest("value", "confidence").alias("provenance"))


def _rest(*without: str):
    """The JSON of the members of m but those named; null if none is left."""
    rest = F.map_filter("m", lambda k, _: ~k.isin(*without))
    return F.when(F.size(rest) > 0, F.to_json(rest))


def decode_entities(df: DataFrame, payload: str, key: str) -> DataFrame:
    """{"entities": [{type, normalized_value | mention_text | value, confidence}]}: of the values the first that is there, null or not; the last of a type wins."""
    entities = field(F.try_parse_json(payload), "entities").try_cast("array<variant>")
    at = df.select(key, F.posexplode(entities).alias("pos", "v")).withColumn("m", F.col("v").try_cast("map<string,variant>"))
    get = lambda n: F.try_element_at("m", F.lit(n))
    value = F
    for n in _VALUES:
        value = value.when(F.map_contains_key("m", n), get(n))
    said = lambda n: let(get(n), lambda x: F.nullif(F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)), F.lit("")))
    rows = at.select(key, "pos", F.coalesce(said("type"), said("name")).alias("field"), _json(value).alias("value"), _number(get("confidence")).alias("confidence"),
                     _rest("type", "name", *_VALUES, "confidence").alias("provenance"))
    return _last(rows, key)


def decode_blocks(df: DataFrame, payload: str, key: str) -> DataFrame:
    """{"Blocks": [...]}: answers to queries by alias, confidence out of 100; the last of an alias wins."""
    blocks = field(F.try_parse_json(payload), "Blocks").try_cast("array<variant>")
    v = F.col("v")
    get = lambda path, to: F.try_variant_get(v, path, to)
    rows = (df.select(key, F.posexplode(blocks).alias("pos", "v")).where(get("$.BlockType", "string") == "QUERY_RESULT")
            .select(key, "pos", F.coalesce(get("$.Query.Alias", "string"), get("$.Alias", "string")).alias("field"), F.coalesce(_json(get("$.Text", "variant")), F.lit('""')).alias("value"),
                    F.round(get("$.Confidence", "double") / 100, 4).alias("confidence"),
                    F.to_json(F.struct(get("$.Page", "int").alias("page"), get("$.Id", "string").alias("block_id")), {"ignoreNullFields": "false"}).alias("provenance")))
    return _last(rows, key)


def _last(rows: DataFrame, key: str) -> DataFrame:
    """The last row by pos of every field."""
    last = rows.where("field <> ''").groupBy(key, "field").agg(F.max_by(F.struct("value", "confidence", "provenance"), "pos").alias("r"))
    return last.select(key, "field", "r.value", "r.confidence", "r.provenance")


def page_count(payload, path: str = "$.pages"):
    """The page count of a payload, if it is a whole number."""
    v = F.try_variant_get(F.try_parse_json(payload), path, "variant")
    return let(v, lambda v: F.when(kind(v) == "integer", F.try_variant_get(v, "$", "int")))
