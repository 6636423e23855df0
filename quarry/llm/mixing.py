"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in SQL functions only.

Every document draws a key -ln(u) / w, exponential with the rate of its quality
weight w; the documents of a source in order of their keys are a weighted
sample without replacement. A target of T words from a source of S words takes
every document floor(T / S) times, the complete epochs, and then the first
documents in key order up to the rest of the budget. The prefix sums are taken
in two levels: keys are cut into cells of about CELL documents, cell totals are
summed by a window over the cells, and only the cell in which the budget ends
is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words.
SHARE = 1.5
#: A source gives at most so many times its words.
MOST = 2
#: Sources up to which their table (some 100 bytes each) is broadcast; beyond, the joins shuffle.
FEW = 100_000
#: Documents of a cell of keys, about.
CELL = 2000
_WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of an MD5, the same in every run."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def quality(size: Column, chars: Column) -> Column:
    """Between 0.25 and 1: falls as characters a word leave the range of prose, 4 to 8."""
    each = chars / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(0.25), F.least(F.lit(1.0), each / 4.0, 8.0 / F.greatest(each, F.lit(0.1))))


def targets(sources: DataFrame, share: float, weights: tuple[int, ...], most: int) -> DataFrame:
    """sources (source, source_size) with each one's target.

    Raising a common level L until the sum of least(most * size, L * weight) is
    the whole budget reshapes the excess by weight until none is above its cap.
    The capped sources are a prefix in order of most * size / weight.
    """
    everything = Window.partitionBy()
    names = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    listed = sources.withColumn("at", F.row_number().over(names) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")))
    by_level = Window.partitionBy().orderBy(F.col("full_at"), F.col("at"))
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    ordered = (listed.withColumn("cap", F.col("source_size") * float(most)).withColumn("full_at", F.col("cap") / F.col("weight"))
               .withColumn("budget", F.sum("source_size").over(everything) * share))
    # the level if exactly the sources before this one are full
    ordered = ordered.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    fits = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "at", "level"))).over(everything)
    return ordered.withColumn("fit", fits["level"]).select(
        "source", "source_size", F.when(F.col("fit").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("fit") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS,
        share: float = SHARE, most: int = MOST, seed: str = "mix-1:") -> DataFrame:
    """(id_col, source, size, source_size, target, epochs, taken), one row per row of docs.

    size counts the words of the text, 0 if null; taken is size times the number
    of times the mix takes the document. The document in which a budget ends is
    taken if that leaves the source nearer to its target. Rows of the same id
    and source tie on the key; they are ordered by size and then stand in for
    each other. Documents without words and sources without words take 0. An
    empty table gives an empty result.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.coalesce(F.length(text_col), F.lit(0)).alias("chars"))
    keyed = stored(sized.select("id", "source", "size", (-F.log(uniform(F.col("id"), seed)) / quality(F.col("size"), F.col("chars"))).alias("key")), "mix-keys")
    # one row a source
    per_source = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = stored(targets(per_source.select("source", "source_size"), share, weights, most).join(per_source.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), "source_size", "target", F.floor(F.try_divide("target", "source_size")).alias("epochs"),
        F.ceil(F.col("n") / CELL).alias("cells")).withColumn("epochs", F.coalesce("epochs", F.lit(0).cast("long"))).withColumn(
            "rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    small = F.broadcast if goal.count() <= FEW else (lambda df: df)
    cell = F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("cells")), F.col("cells") - 1)
    placed = keyed.join(small(goal), F.col("source").eqNullSafe(F.col("s"))).withColumn("cell", cell)
    totals = placed.groupBy("s", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(upto), F.lit(0).cast("long"))
    border = totals.withColumn("before", before).where("rest > before and rest < before + words").select(
        F.col("s").alias("bs"), F.col("cell").alias("border"), "before")
    # no border: the rest is 0, or ends exactly with a cell
    full = totals.withColumn("before", before).where("before + words <= rest").groupBy(F.col("s").alias("fs")).agg(F.max("cell").alias("full"))
    ends = goal.join(border, F.col("s").eqNullSafe(F.col("bs")), "left").join(full, F.col("s").eqNullSafe(F.col("fs")), "left").select("s", "source_size", "target", "epochs", "rest", "cells", "border", "before", "full")
    dealt = keyed.join(small(ends), F.col("source").eqNullSafe(F.col("s"))).withColumn("cell", cell)
    whole = dealt.where("border is null or cell <> border").withColumn("extra", F.coalesce(F.col("cell") <= F.col("full"), F.lit(False)))
    inside = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = dealt.where("cell = border").withColumn("sum", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long"))).withColumn(
        "extra", F.col("sum") + F.col("size") / 2.0 <= F.col("rest"))
    columns = [F.col("id").alias(id_col), "source", "size", "source_size", "target", "epochs", (F.col("size") * (F.col("epochs") + F.col("extra").cast("long"))).alias("taken"),
               (F.col("epochs") + F.col("extra").cast("long")).alias("copies")]
    return whole.select(columns).union(last.select(columns))


def repeated(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; its columns stay as they are, whatever they are called.

    Rows without words are taken with their source's epochs. Rows that share id,
    source and size tie, and the mix takes them equally often but where a budget
    ends among them, at most once a source: there a running number in order of
    their texts' hashes says which are taken once more. Very long texts count
    whole. An empty table gives an empty result.
    """
    taken = mix(docs, text_col, source_col, id_col, **options)
    # of each tie only the counts, which are two at most
    counts = taken.groupBy(F.col(id_col).alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__s")).agg(
        F.min("copies").alias("__low"), F.max("copies").alias("__high"), F.sum("copies").alias("__sum"), F.count("*").alias("__n"))
    counts = counts.where("__high > 0").withColumn("__more", F.when(F.col("__high") > F.col("__low"), F.expr("(__sum - __low * __n) div (__high - __low)")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    sized = docs.select(F.struct(*columns).alias("__row"), F.col(id_col).alias("__i"), F.col(source_col).alias("__src"), words(F.col(text_col)).alias("__size"), F.xxhash64(text_col).alias("__hash"))
    joined = sized.join(counts, F.col("__i").eqNullSafe(F.col("__id")) & F.col("__src").eqNullSafe(F.col("__source")) & (F.col("__size") == F.col("__s")))
    same = Window.partitionBy("__id", "__source", "__s").orderBy("__hash")
    split = joined.where("__more is not null").withColumn("__times", F.when(F.row_number().over(same) <= F.col("__more"), F.col("__high")).otherwise(F.col("__low")))
    plain = joined.where("__more is null").withColumn("__times", F.col("__high"))
    every = plain.unionByName(split).where("__times > 0")
    return every.withColumn("__t", F.explode(F.array_repeat(F.lit(0), F.col("__times").cast("int")))).select("__row.*")
