"""Schemas compiled to Column expressions over VARIANT: validation errors, coercion, type correctness."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.payload import field, kind
from quarry.functions.text import coerce_boolean, coerce_number, let
from quarry.plans.schema import json_kind

_PYTHON = {"object": "dict", "array": "list", "string": "str", "integer": "int", "number": "float", "boolean": "bool", "null": "NoneType"}
_KNOWN = set(_PYTHON)


def _accepted(of: Column, expected: Any) -> Column:
    """matches_type of a kind."""
    names = expected if isinstance(expected, list) else [expected]
    if any(n not in _KNOWN for n in names):
        return F.lit(True)
    accepted = {n for name in names for n in (("integer", "number") if name == "number" else (name,))}
    return F.coalesce(of.isin(*sorted(accepted)), F.lit(False))


def matches_type(v: Column, expected: Any) -> Column:
    """True if a variant has the type; any member of a union will do, and unknown names match all."""
    return _accepted(kind(v), expected)


def errors(v: Column, schema: Mapping[str, Any], path: Column | None = None) -> Column:
    """array<string> of all violations, depth first; a wrong type ends its branch. Each value is read once."""
    return let(F.struct(v.alias("v"), kind(v).alias("kind")), lambda x: _errors(x["v"], x["kind"], schema, F.lit("$") if path is None else path))


def _errors(v: Column, of: Column, schema: Mapping[str, Any], path: Column) -> Column:
    none = F.array().cast("array<string>")
    expected, parts, names = schema.get("type"), [], F.create_map(*[F.lit(x) for kv in _PYTHON.items() for x in kv])

    def wrong(what: Any) -> Column:
        return F.array(F.concat(path, F.lit(f": expected {what}, got "), F.element_at(names, of)))

    if expected == "object" or "properties" in schema:
        for name in schema.get("required", ()):
            parts.append(F.when(field(v, name).isNull(), F.array(F.concat(path, F.lit(f".{name}: required field missing")))).otherwise(none))
        for name, inner in schema.get("properties", {}).items():
            member = F.concat(path, F.lit(f".{name}"))
            parts.append(let(field(v, name), lambda x, inner=inner, member=member: F.when(x.isNotNull(), errors(x, inner, member)).otherwise(none)))
        parts = [F.when(of != "object", wrong("object")).otherwise(F.concat(none, *parts))]
    if expected == "array" and schema.get("items"):
        parts.append(F.flatten(F.transform(v.try_cast("array<variant>"), lambda x, i: errors(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
    below = F.concat(*parts) if parts else none
    if expected is None:
        return below
    return F.when(~_accepted(of, expected), wrong(expected)).otherwise(F.coalesce(below, none))


def violations(value: Any, schema: Mapping[str, Any], path: str = "$") -> list[str]:
    """errors() of one Python value, for schemas that come as rows, where errors() needs one schema for all."""
    own, expected = json_kind(value), schema.get("type")
    allowed = set(expected) if isinstance(expected, list) else {expected}
    known = expected is not None and allowed <= _KNOWN
    if known and own not in allowed and not (own == "integer" and "number" in allowed):
        return [f"{path}: expected {expected}, got {_PYTHON[own]}"]
    found: list[str] = []
    if expected == "object" or "properties" in schema:
        if own != "object":
            return [f"{path}: expected object, got {_PYTHON[own]}"]
        found += [f"{path}.{name}: required field missing" for name in schema.get("required", ()) if name not in value]
        for name, inner in schema.get("properties", {}).items():
            found += violations(value[name], inner, f"{path}.{name}") if name in value else []
    if expected == "array" and schema.get("items"):
        for k, item in enumerate(value):
            found += violations(item, schema["items"], f"{path}[{k}]")
    return found


def quoted(s: Column) -> Column:
    """A text as JSON."""
    return F.regexp_extract(F.to_json(F.array(s)), r"(?s)^\[(.*)\]$", 1)


def _to_kind(s: Column, wanted: Any) -> Column | None:
    """A text coerced to a type, as JSON, null where it can't be; None for types that nothing is coerced to."""
    made = {"number": coerce_number, "integer": lambda s: coerce_number(s, True), "boolean": coerce_boolean}.get(wanted) if isinstance(wanted, str) else None
    return made and made(s).cast("string")


def coerce(v: Column, schema: Mapping[str, Any]) -> Column:
    """map<string, string> of the top-level members as JSON text, text coerced to its field's type.

    Only text is coerced, and only where it can be; fields of a union type stay as they are.
    """
    members = v.try_cast("map<string,variant>")

    def changed(name: Column, x: Column) -> Column:
        s, out = F.try_variant_get(x, "$", "string"), F
        for key, inner in schema.get("properties", {}).items():
            if (to := _to_kind(s, inner.get("type"))) is not None:
                out = out.when((name == key) & (kind(x) == "string"), F.coalesce(to, quoted(s)))
        return F.to_json(x) if out is F else out.otherwise(F.to_json(x))

    return F.transform_values(members, changed)


def coerced(value: dict, schema: Mapping[str, Any]) -> dict:
    """coerce() of one Python object, for schemas that come as rows."""
    out = dict(value)
    for name, inner in schema.get("properties", {}).items():
        text, wanted = out.get(name), inner.get("type")
        if isinstance(text, str) and wanted in ("number", "integer"):
            try:
                number = float(re.sub(r"[^0-9.\-]", "", text))
                out[name] = int(number) if wanted == "integer" else number
            except ValueError:
                pass
        elif isinstance(text, str) and wanted == "boolean":
            out[name] = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}.get(text.strip().lower(), text)
    return out


def coerce_json(data: Column, schema: Mapping[str, Any]) -> Column:
    """coerce() of the JSON text of an object, as JSON text: keys keep their order, and what is not coerced its form."""
    wanted = [(k, s["type"]) for k, s in schema.get("properties", {}).items() if s.get("type") in ("number", "integer", "boolean")]
    if not wanted:
        return data

    def changed(name: Column, raw: Column, x: Column) -> Column:
        out = F
        for key, to in wanted:
            out = out.when(name == key, F.coalesce(_to_kind(raw, to), quoted(raw)))
        return F.when(raw.isNull(), "null").when(F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)), out.otherwise(quoted(raw))).otherwise(raw)

    def joined(read: Column) -> Column:
        pairs = F.transform(F.map_entries(read["raw"]), lambda e: F.concat(quoted(e["key"]), F.lit(":"), changed(e["key"], e["value"], F.try_element_at(read["typed"], e["key"]))))
        return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))

    typed = F.try_parse_json(data).try_cast("map<string,variant>")
    return F.when(data.isNotNull(), let(F.struct(F.from_json(data, "map<string,string>").alias("raw"), typed.alias("typed")), joined))


def type_share(value: Any, schema: Mapping[str, Any]) -> float:
    """type_correctness() of one Python value, for schemas that come as rows."""
    marks = [not violations(value[name], {"type": inner.get("type", "?")}) for name, inner in schema.get("properties", {}).items() if name in value]
    return sum(marks) / len(marks) if marks else 1.0


def type_correctness(v: Column, schema: Mapping[str, Any]) -> Column:
    """The share of the schema's fields present that have their type; 1 if none is present."""
    terms = [let(field(v, name), lambda x, inner=inner: F.when(x.isNotNull(), matches_type(x, inner.get("type", "?")).cast("int"))) for name, inner in schema.get("properties", {}).items()]
    if not terms:
        return F.lit(1.0)
    return let(F.array_compact(F.array(*terms)), lambda t: F.when(F.size(t) == 0, 1.0).otherwise(F.aggregate(t, F.lit(0), lambda a, x: a + x) / F.size(t)))
