"""Scalar comparison and coercion rules as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date shapes tried in order, each with the shape Python's parser accepts.
DATE_FORMATS = (
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("MMMM d, yyyy", r"^[A-Za-z]+ \d{1,2}, \d{4}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def stripped(s: Column) -> Column:
    """Without white space at either end, as Unicode counts it."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def normalize_text(s: Column) -> Column:
    return F.lower(spaced(s))


def numeric(s: Column) -> Column:
    """The number that is left when all but digits, points and hyphens go; null if that is none."""
    return F.regexp_replace(s, r"[^0-9.\-]", "").try_cast("double")


def parse_number(s: Column) -> Column:
    """A number for the comparator: null without a digit."""
    return F.when(s.rlike("[0-9]"), numeric(s))


def spaced(s: Column) -> Column:
    """Without outer white space, and one space for each white space within."""
    return F.regexp_replace(stripped(s), r"(?U)\s+", " ")


def dated(plain: Column) -> Column:
    return F.coalesce(*[F.when(plain.rlike(shape), F.try_to_date(plain, form)) for form, shape in DATE_FORMATS])


def parse_date(s: Column) -> Column:
    return let(spaced(s), dated)


def coerce_number(s: Column, integer: bool = False) -> Column:
    """numeric(s), cut to a whole number if integer; null where the text must stay as it is."""
    n = numeric(s)
    return F.when(F.abs(n) < 9.2e18, n.cast("long")) if integer else n


def coerce_boolean(s: Column) -> Column:
    word = F.lower(stripped(s))
    return F.when(word.isin("true", "yes", "1"), True).when(word.isin("false", "no", "0"), False)


def values_match(predicted: Column, gold: Column) -> Column:
    """True if two scalars, as text, name the same date, else the same number, else the same words.

    A missing value equals a missing one only. Equal texts are not read further,
    others once each.
    """

    def facts(s: Column) -> Column:
        # a date and a number have digits
        plain = F.when(s.rlike(r"(?U)\s"), spaced(s)).otherwise(s)
        read = let(plain, lambda t: F.struct(t.alias("t"), t.rlike("[0-9]").alias("digits")))
        return let(read, lambda x: F.struct(F.when(x["digits"], dated(x["t"])).alias("day"), F.when(x["digits"], numeric(x["t"])).alias("number"), F.lower(x["t"]).alias("words")))

    def same(a: Column, b: Column) -> Column:
        return (F.when(a["day"].isNotNull() & b["day"].isNotNull(), a["day"] == b["day"])
                .when(a["number"].isNotNull() & b["number"].isNotNull(), F.abs(a["number"] - b["number"]) < 1e-6)
                .otherwise(a["words"] == b["words"]))

    read = let(F.struct(facts(predicted).alias("p"), facts(gold).alias("g")), lambda both: same(both["p"], both["g"]))
    return F.when(predicted.isNull() | gold.isNull(), predicted.isNull() & gold.isNull()).when(predicted == gold, True).otherwise(read)
