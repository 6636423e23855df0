"""Comparison of JSON values of any depth, as SQL functions.

Two values are walked side by side, and where the walk ends, at a scalar, at
values of different kinds, at lists of different lengths, at what one side
lacks, stands an end: the JSON texts of both sides there. The ends of a pair are
an array of structs, made in the JVM; whether values match, and how many places
of two lists do, are counts over them. JSON numbers are compared as numbers, and
texts as dates, else as numbers, else as words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import dated, let, numeric, spaced

#: Levels of nesting that a comparison follows; deeper values are an error, never a wrong answer.
DEPTH = 8
_ENDS = "array<struct<unit:string,p:string,g:string>>"


def _facts(text: Column) -> Column:
    """struct (words, number, day) of a JSON text, as far as it has them; the words of null are none.

    What most texts don't need is looked for before it is done: escapes to read, white space to join, digits of a date.
    """
    is_text = text.startswith('"')
    read = F.coalesce(F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), 0), F.lit("None"))
    content = F.when(is_text & ~text.contains("\\"), F.substr(text, F.lit(2), F.length(text) - 2)).when(text.rlike("^-?[0-9]{1,18}$"), text).otherwise(read)
    plain = let(content, lambda c: F.when(c.rlike(r"(?U)\s"), spaced(c)).otherwise(c))

    def of(words: Column, digits: Column) -> Column:
        number = F.when(text.rlike("^[-0-9]"), text.try_cast("double")).when(digits & ~text.rlike("^[tfn]"), numeric(words))
        return F.struct(F.lower(words).alias("words"), number.alias("number"), F.when(is_text & digits, dated(words)).alias("day"))

    return let(let(plain, lambda words: F.struct(words.alias("words"), words.rlike("[0-9]").alias("digits"))), lambda x: of(x["words"], x["digits"]))


def _equal(end: Column) -> Column:
    """True if the two sides of an end say the same; a side that is missing does not."""

    def read(both: Column) -> Column:
        p, g = both["p"], both["g"]
        return (F.when(p["day"].isNotNull() & g["day"].isNotNull(), p["day"] == g["day"]).when(p["number"].isNotNull() & g["number"].isNotNull(), F.abs(p["number"] - g["number"]) < 1e-6)
                .otherwise(p["words"] == g["words"]))

    told = let(F.struct(_facts(end["p"]).alias("p"), _facts(end["g"]).alias("g")), read)
    return F.when(end["p"].isNull(), False).when(end["p"] == end["g"], True).otherwise(told)


def _ends(p: Column, g: Column, unit: Column | None, item: Column, depth: int) -> Column:
    """The ends of two variants, p null if it is missing; item says that they stand in a list.

    unit names the place to which ends count; without one, members of objects
    are places of their own, and all else is one place.
    """
    sides = F.struct(p.alias("p"), g.alias("g"), p.try_cast("map<string,variant>").alias("p_map"), g.try_cast("map<string,variant>").alias("g_map"), p.try_cast("array<variant>").alias("p_list"), g.try_cast("array<variant>").alias("g_list"))

    def walk(s: Column) -> Column:
        objects, lists = s["p_map"].isNotNull() & s["g_map"].isNotNull(), s["p_list"].isNotNull() & s["g_list"].isNotNull()
        apart = lists & (F.size(s["p_list"]) != F.size(s["g_list"]))
        place = unit if unit is not None else F.lit("")
        end = F.array(F.struct(place.alias("unit"), F.when(~apart, F.to_json(s["p"])).alias("p"), F.to_json(s["g"]).alias("g")))
        members = F.transform(F.map_entries(s["g_map"]), lambda e: F.struct(e["key"].alias("key"), F.try_element_at(s["p_map"], e["key"]).alias("p"), e["value"].alias("g"), F.lit(False).alias("item")))
        items = F.transform(s["g_list"], lambda x, i: F.struct(F.lit("").alias("key"), F.get(s["p_list"], i).alias("p"), x.alias("g"), F.lit(True).alias("item")))
        below = F.when(objects & (F.size(s["g_map"]) > 0), members).when(lists & ~apart & (F.size(s["g_list"]) > 0), items)
        if depth == 0:
            deeper = F.when(below.isNotNull(), F.raise_error(F.lit("JSON values are nested deeper than a comparison follows; give it more depth")).cast(_ENDS)).otherwise(end)
        else:
            inner = lambda c: _ends(c["p"], c["g"], unit if unit is not None else F.concat(c["key"], F.lit("/")), c["item"], depth - 1)
            deeper = F.coalesce(F.flatten(F.transform(below, inner)), end)
        # in a list, gold's empty object asks for nothing
        return F.when(item & objects & (F.size(s["g_map"]) == 0), F.array().cast(_ENDS)).otherwise(deeper)

    return let(sides, walk)


def _columns(predicted: Column | str, gold: Column | str) -> tuple[Column, Column]:
    return tuple(F.try_parse_json(F.col(x) if isinstance(x, str) else x) for x in (predicted, gold))


def json_match(predicted: Column | str, gold: Column | str, depth: int = DEPTH) -> Column:
    """True if two JSON texts match: objects by gold's members, lists place by place, scalars as the same date, number or words; null if either is null or no JSON.

    Members that only the prediction has cost nothing, but an empty gold object matches an empty one only, outside lists.
    """
    return let(F.struct(*[c.alias(name) for name, c in zip("pg", _columns(predicted, gold))]), lambda s: variant_match(s["p"], s["g"], depth))


def variant_match(p: Column, g: Column, depth: int = DEPTH) -> Column:
    """json_match() of two variants."""
    return F.when(p.isNotNull() & g.isNotNull(), F.forall(_ends(p, g, F.lit(""), F.lit(False), depth), _equal))


def json_alignment(predicted: Column | str, gold: Column | str, depth: int = DEPTH) -> Column:
    """The share of places of two JSON lists that match; null if either is null or no list.

    Where both items are objects, each of gold's members is a place, else the item is one; an item that a list lacks is an empty object.
    """
    p, g = (x.try_cast("array<variant>") for x in _columns(predicted, gold))
    none = F.try_parse_json(F.lit("{}"))

    def share(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(s["p"]), F.size(s["g"])) - 1)
        item = lambda i: _ends(F.coalesce(F.get(s["p"], i), none), F.coalesce(F.get(s["g"], i), none), None, F.lit(True), depth)
        named = lambda i: F.transform(item(i), lambda e: F.struct(F.concat(i.cast("string"), F.lit("/"), e["unit"]).alias("unit"), e["p"].alias("p"), e["g"].alias("g")))

        def counted(ends: Column) -> Column:
            units = lambda some: F.size(F.array_distinct(F.transform(some, lambda e: e["unit"])))
            return let(units(ends), lambda n: F.when(n == 0, 1.0).otherwise((n - units(F.filter(ends, lambda e: ~_equal(e)))) / n))

        either = (F.size(s["p"]) == 0) | (F.size(s["g"]) == 0)
        return F.when(either, (F.size(s["p"]) == F.size(s["g"])).cast("double")).otherwise(let(F.flatten(F.transform(places, named)), counted))

    return F.when(p.isNotNull() & g.isNotNull(), let(F.struct(p.alias("p"), g.alias("g")), share))
