"""Packing: the whole query's offsets and bound, rounds of exchange, ties and clashing columns."""

import numpy as np
from conftest import SF
from pyspark.sql import functions as F
from test_operators import docs_of

from quarry.llm import packing, queries


def gapless(rows, length=1024):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        ends = np.cumsum([n for _, n in spans])
        assert [o for o, _ in spans] == [0, *ends[:-1]] and ends[-1] <= length
    return len(by)


def test_whole_query(spark):
    got = queries.op7_best_fit_packing(spark, SF).collect()
    n = gapless(got)
    bound = packing.lower_bound(np.bincount([r.length for r in got], minlength=1025))
    assert bound <= n <= 1.01 * bound + 1
    docs = {}
    for r in got:
        docs.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for pieces in docs.values():
        pieces.sort()
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and all(n == 1024 for _, _, n in pieces[1:])
        assert [s for _, s, _ in pieces] == [0, *np.cumsum([n for _, _, n in pieces])[:-1]]


def test_exchange_goes_on_while_it_saves(spark, monkeypatch):
    rounds, stored = [], packing.stored
    monkeypatch.setattr(packing, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    sizes = np.random.default_rng(9).integers(200, 700, 3000)
    items = spark.createDataFrame([(k, int(s)) for k, s in enumerate(sizes)], "id long, length long")
    got = packing.pack(items, part=300).collect()
    assert len(got) == 3000 and {r.id for r in got} == set(range(3000)) and len(rounds) >= 3
    alone = sum(len(packing.best_fit_decreasing(sizes[k::10], 1024)[2]) for k in range(10))
    assert packing.lower_bound(np.bincount(sizes, minlength=1025)) <= gapless(got) < alone


def test_certified_partitions(spark):
    halves = spark.createDataFrame([(k, 512) for k in range(100)] + [(k, 1024) for k in range(5)], "id long, length long")
    got = packing.pack(halves, part=20).collect()
    assert gapless(got) == 55 and sum(r.certified for r in got) >= 95
    assert gapless(packing.pack(spark.createDataFrame([(1, 7)], "id long, length long")).collect()) == 1


def test_ties_and_clashing_columns(spark):
    docs = docs_of(spark, [(k % 3, "the same text", "s") for k in range(40)]).withColumn("part", F.lit(1)).withColumn("settled", F.lit(2)).withColumn("length", F.lit("x"))
    got = packing.pack_documents(docs, queries.vocabulary()).collect()
    assert len(got) == 40 and gapless(got) == 1 and len({r.ids_crc32 for r in got}) == 1
