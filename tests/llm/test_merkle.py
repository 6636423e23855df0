"""The manifest against trees built by recursion, with nulls, repeated rows, many sources and blocks beyond what the driver gathers."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F
from test_operators import docs_of

from quarry.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def brute(rows, altered):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, h(*map(encoded, r)), h(*map(encoded, altered(r)))))
    trees = {s: (sorted(x), levels([y[2] for y in sorted(x)])) for s, x in by.items()}
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([trees[s][1][-1][0] for s in names])
    out = []
    for rank, s in enumerate(names):
        for place, (known, i, leaf, other) in enumerate(trees[s][0]):
            proof, x = [], other
            for tree, at in ((trees[s][1], place), (top, rank)):
                for level in tree[:-1]:
                    run = level[at // 16 * 16 : at // 16 * 16 + 16]
                    proof += run[: at % 16] + run[at % 16 + 1 :]
                    x = h(*run[: at % 16], x, *run[at % 16 + 1 :])
                    at //= 16
            out.append((i if known else None, leaf, trees[s][1][-1][0], top[-1][0], h(*proof), x, x == top[-1][0]))
    return sorted(out, key=repr)


def lowered(r):
    i, *rest, text = r
    tamper = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    return (i, *rest, "".join(c.lower() if c.isascii() else c for c in text) if tamper and text is not None else text)


def altered():
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf("doc_id", "source", "lang", "n_chars", lower))


def got(docs, **options):
    return sorted((tuple(r)[:7] for r in merkle.manifest(docs, altered=altered(), **options).collect()), key=repr)


ROWS = [(k, ["a", "é", None, "b"][k % 4], "en", 5, f"Text Ä {k}") for k in range(300)] + [(None, "a", None, None, None), (None, "a", None, None, ""), (7, "b", "en", 5, "Twice"), (7, "b", "en", 5, "Twice"), (8, "", "en", None, "X" * 300_000), (9, "lone", "de", 1, "Ü")]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_manifest_equals_recursion(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5).withColumn("at", F.lit("mine")).withColumn("n", F.lit(1)).withColumn("leaf", F.lit(2)).withColumn("path", F.lit(3))
    want = brute(ROWS, lowered)
    assert got(docs) == want and {r[6] for r in want} == {True, False}
    # a row alone, a source alone, no row
    assert got(docs.where("source = 'lone'")) == brute(ROWS[-1:], lowered)
    assert got(docs.where("source = 'a'")) == brute([r for r in ROWS if r[1] == "a"], lowered)
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_more_blocks_or_sources_than_the_driver_gathers(spark):
    """Blocks and sources beyond top are folded by executors, with the same result."""
    rows = [(k, "hot" if k % 4 else f"s{k % 64}", "en", 1, f"T{k}") for k in range(24_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, lowered)
    assert got(docs) == want
    assert got(docs, top=3) == want


def test_proofs_verify(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = merkle.manifest(docs, proofs=True)
    checked = rows.select("root", merkle.verify("leaf", "proof").alias("own"), merkle.verify(F.sha2("leaf", 256), "proof").alias("other"), "verified").collect()
    assert all(r.own == r.root and r.other != r.root and r.verified for r in checked) and len(checked) == len(ROWS)


@pytest.mark.parametrize("rows", [1, 16, 17, 256, 257])
def test_runs_that_are_not_full(spark, rows):
    docs = docs_of(spark, [(k, f"t{k}", "s") for k in range(rows)])
    assert got(docs) == brute([(k, "s", "en", len(f"t{k}"), f"t{k}") for k in range(rows)], lowered)
