"""Personal data in SQL functions only: patterns propose, checksums confirm, context words adjust.

A pattern's matches come from regexp_extract_all, their places from the gaps
that split leaves, whose lengths are summed in blocks. Quantifiers are
possessive and a match starts only where a run of its characters starts (or
where the last match ended), so that long runs cost one pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import unused

#: Kinds in order; the first four have base spans.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: Score that a span needs.
CUTOFF = 0.6
#: Code points before and after a match that count as its context.
NEAR = 40
_BLOCK = 256
#: The lengths of the countries' IBANs.
_IBANS = {
    15: "NO", 16: "BE", 18: "DK FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG YE",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """IBANs at the length of their country, whole or in fours; else, of any length, a run or fours with a shorter tail."""
    fixed = [rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{n - 4}}}|(?:\x20[A-Z0-9]{{4}}){{{n // 4 - 1}}}{rf'\x20[A-Z0-9]{{{n % 4}}}' if n % 4 else ''})" for n, c in _IBANS.items()]
    any_length = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*fixed, any_length])})(?![A-Za-z0-9])"


_EMAIL = r"[A-Za-z0-9._%+-]"
_PATTERNS = {
    "email": rf"(?=[A-Za-z0-9._%+-])(?:(?<!{_EMAIL})|\G){_EMAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "grouped": r"(?<![0-9])(?<![0-9A-Z]{4}[\x20-])(?:4[0-9]|5[1-5]|2[2-7]|6[0-9])[0-9]{2}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9]|[\x20-][0-9]{4}(?![0-9]))",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local": r"(?<![0-9A-Za-z+])\(?0[0-9][\x20()./0-9-]{4,20}[0-9](?![0-9A-Za-z])",
    "iban": _iban(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Words that make a kind likelier when near.
_CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write|adresse|correo)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|téléphone|teléfono)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social security|tax id)\b",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if a string of digits passes the Luhn check."""

    def term(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d).cast("long")

    return total(F.transform(F.split(F.reverse(number), ""), term)) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an IBAN, spaces aside, leaves 1 modulo 97 with its first four characters at the end."""

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: step(a, c)) == 1


def located(text: Column, pattern: str, valid: Callable[[Column], Column], made: Callable[[Column, Column, Column, Column, Column], Column], empty: Column) -> Column:
    """made(match, start, end, before, after) of every match of the pattern that is valid, in order.

    before and after are the NEAR code points beside the match, other matches
    among them; a match has two code points at least, so that NEAR / 2 matches
    and the gaps beside them hold what is needed.
    """
    find, most = F.lit(pattern), NEAR // 2

    def places(found: Column) -> Column:
        kept = F.filter(F.transform(found, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda c: valid(c["m"]))
        return let(kept, lambda kept: F.when(F.size(kept) == 0, empty).otherwise(let(F.split(text, find, -1), lambda gaps: with_gaps(found, kept, gaps))))

    def before(found: Column, gaps: Column, i: Column) -> Column:
        first = F.greatest(i - most, F.lit(0))
        earlier = F.transform(F.slice(found, first + 1, i - first), lambda m, t: F.concat(F.right(F.get(gaps, first + t), F.lit(NEAR)), m))
        return F.when(F.length(F.get(gaps, i)) >= NEAR, F.right(F.get(gaps, i), F.lit(NEAR))).otherwise(F.right(F.concat(F.array_join(earlier, ""), F.get(gaps, i)), F.lit(NEAR)))

    def after(found: Column, gaps: Column, i: Column) -> Column:
        later = F.transform(F.slice(found, i + 2, F.lit(most)), lambda m, t: F.concat(m, F.left(F.get(gaps, i + 2 + t), F.lit(NEAR))))
        return F.when(F.length(F.get(gaps, i + 1)) >= NEAR, F.left(F.get(gaps, i + 1), F.lit(NEAR))).otherwise(F.left(F.concat(F.get(gaps, i + 1), F.array_join(later, "")), F.lit(NEAR)))

    def with_gaps(found: Column, kept: Column, gaps: Column) -> Column:
        lengths = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("long"))
        return let(lengths, lambda ls: let(blocks(ls), lambda sums: F.transform(kept, lambda c: spanned(c, found, gaps, ls, sums))))

    def blocks(ls: Column) -> Column:
        n = F.floor(F.size(ls) / _BLOCK).cast("int")
        return F.aggregate(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), F.array(F.lit(0).cast("long")),
                           lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + total(F.slice(ls, b * _BLOCK + 1, F.lit(_BLOCK))))))

    def spanned(c: Column, found: Column, gaps: Column, ls: Column, sums: Column) -> Column:
        b = F.floor(c["i"] / _BLOCK).cast("int")
        start = F.get(sums, b) + total(F.slice(ls, b * _BLOCK + 1, c["i"] % _BLOCK)) + F.length(F.get(gaps, c["i"]))
        return let(start, lambda s: made(c["m"], s, s + F.length(c["m"]), before(found, gaps, c["i"]), after(found, gaps, c["i"])))

    return let(F.regexp_extract_all(text, find, F.lit(0)), lambda found: F.when(F.size(found) == 0, empty).otherwise(places(found)))


def spans(text: Column) -> Column:
    """array<struct<kind int, start long, end long, base boolean, score double>> in order of kind and start.

    kind indexes KINDS. Base spans pass their pattern and check. The others are
    added by the method where check and context give CUTOFF: IBANs, cards in
    four groups of four within a longer run of digits, and, near a context word,
    cards of 13 to 15 digits, national phone numbers and social security numbers.
    An added span that overlaps a base span is left out. A null text has none.
    """
    text = F.coalesce(text, F.lit(""))
    empty = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean,score:double>>")

    def found(kind: str, valid, score: float, lift: float, base=lambda m: F.lit(True), pattern: str = "") -> Column:
        def made(m, start, end, before, after):
            near = F.concat(before, F.lit(" "), after).rlike(_CONTEXT[kind])
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.alias("end"), base(m).alias("base"),
                            (F.lit(score) + F.when(near, lift).otherwise(0.0) + F.when(base(m), 0.4).otherwise(0.0)).alias("score"))

        return located(text, _PATTERNS[pattern or kind], valid, made, empty)

    def octets(m: Column) -> Column:
        return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))

    n = lambda m: F.length(digits(m))
    email = F.when(F.contains(text, F.lit("@")), found("email", lambda m: F.lit(True), 0.5, 0.1)).otherwise(empty)
    numbers = {
        "ip": found("ip", octets, 0.4, 0.2),
        "card": found("card", lambda m: F.length(m).between(13, 37) & n(m).between(13, 19) & luhn(digits(m)), 0.4, 0.2, lambda m: n(m) >= 16),
        "grouped": found("card", lambda m: luhn(digits(m)), 0.6, 0.2, lambda m: F.lit(False), "grouped"),
        "phone": F.when(F.contains(text, F.lit("+")), found("phone", lambda m: n(m).between(8, 15), 0.4, 0.2)).otherwise(empty),
        "local": found("phone", lambda m: n(m).between(8, 13), 0.4, 0.2, lambda m: F.lit(False), "local"),
        "iban": found("iban", mod97, 0.7, 0.2, lambda m: F.lit(False)),
        "ssn": found("ssn", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, 0.4, lambda m: F.lit(False)),
    }

    def settle(all_spans: Column) -> Column:
        fixed = F.filter(all_spans, lambda s: s["base"])
        return let(fixed, lambda fixed: F.array_sort(F.filter(all_spans, lambda s: s["base"] | (
            (s["score"] > CUTOFF - 1e-9) & ~F.exists(fixed, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))))

    every = F.concat(email, F.when(text.rlike("[0-9]"), F.concat(*numbers.values())).otherwise(empty))
    return let(every, lambda xs: F.when(F.size(xs) == 0, empty).otherwise(settle(xs)))


def listed(xs: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """docs with a column out_col of spans(text); null and empty texts have none, repeated rows have theirs each.

    docs must not have a column out_col: that is an error. Any other column is untouched.
    """
    if out_col in docs.columns:
        raise ValueError(f"docs already has a column {out_col}")
    return docs.withColumn(out_col, spans(F.col(text_col)))


def redacted(text: Column, xs: Column) -> Column:
    """text with every span, and what overlapping spans cover together, replaced by [KIND]."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_start = F.array_sort(F.transform(xs, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] >= acc["at"], F.struct((-s["less"]).alias("at"), F.concat(acc["out"], gap, F.get(names, s["kind"])).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], -s["less"]).alias("at"), acc["out"].alias("out")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    return F.when(F.size(xs) == 0, text).otherwise(F.aggregate(by_start, start, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int")))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col replaced by its kind; a null text stays null, and columns of any name stay as they are."""
    column = unused(docs.columns, "pii")
    return find(docs, text_col, column).withColumn(text_col, redacted(F.col(text_col), F.col(column))).drop(column)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the spans of each row, repeated rows and null ids kept; other columns are ignored. An empty table gives an empty result."""
    base = F.filter("found", lambda s: s["base"])

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{KINDS[kind]}")

    found = docs.select(F.col(id_col).alias("id"), spans(F.col(text_col)).alias("found"))
    return found.select(F.col("id").alias(id_col), *map(count, range(4)), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
