"""Spelling variants against brute force, with skewed blocks, nulls, ties and repeated rows."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import docs_of

from quarry.llm import spelling


def near(a, b):
    """By what one edit is: same ends around one replaced code point, or one code point too many."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def brute(rows):
    count = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                k = h % len(run)
                count[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
                run = ""
    kept = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    out = {}
    for w, n in kept.items():
        close = [v for v in kept if abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(close, key=lambda v: (-kept[v], v), default=None)
        out[w] = [n, len(close), *((best, kept[best]) if best and kept[best] >= 2 * n else (None, None))]
    for w, x in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        x.append(root)
    return {w: tuple(x) for w, x in out.items()}


def got(docs):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs).collect()}


def edited(rng, word, letters):
    k = rng.randrange(len(word))
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice(letters) + word[k:], word[:k] + rng.choice(letters) + word[k + 1 :]])


def test_variants_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 8)  # the driver subdivides blocks of over 8 words
    rng = random.Random(1)
    base = ["".join(rng.choices("abé", k=rng.randint(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababababab", "bababababa"]
    words = base + [edited(rng, w, "abéz") for w in base for _ in range(4)]
    rows = [(k, " ".join(rng.choices(words, k=400)).title()) for k in range(20)] + [(20, None), (21, ""), (22, "... 123"), (23, "×÷ÿÀx " * 3), (24, "Q" * 60_000 + " "), (25, ("q" * 60_000 + " ") * 3), (None, "words of nothing " * 4), (1, "double rows " * 3), (1, "double rows " * 3)]
    rows += [(60 + k, "Chainword " * 20 + "chainwerd " * 8 + "chainwerds " * 3) for k in range(2)]
    docs = docs_of(spark, [(i, t, "s") for i, t in rows]).withColumn("word", F.lit("mine")).withColumn("n", F.lit(1)).withColumn("id", F.lit(2)).withColumn("m", F.lit(3))
    want = brute(rows)
    assert got(docs) == want
    assert sum(x[1] > 0 for x in want.values()) > 100 and any(x[2] for x in want.values()) and any(x[2] and x[4] != x[2] for x in want.values())


def test_skewed_block_is_subdivided(spark):
    """A thousand words share their first half; blocks keep within their bound and no link is lost."""
    rng = random.Random(2)
    tails = {"".join(rng.choices("abcdefgh", k=6)) for _ in range(1200)}
    words = ["prefix" + t for t in sorted(tails)]
    vocabulary = spark.createDataFrame([(w, 3 + k % 7) for k, w in enumerate(words)], "word string, n long")
    sizes = spelling.blocks(vocabulary).groupBy("m", "lo", "hi", "key").count().agg(F.max("count")).first()[0]
    assert 1 < sizes <= spelling.BLOCK
    links = sorted((r.word, r.near) for r in spelling.links(vocabulary).collect())
    # by what remains without the code point at a place
    by_rest: dict = {}
    for w in words:
        for k in range(len(w)):
            by_rest.setdefault((k, w[:k] + w[k + 1 :]), []).append(w)
    assert links == sorted({(a, b) for same in by_rest.values() for a in same for b in same if a != b})


def test_no_words(spark):
    docs = docs_of(spark, [(1, "a b c", "s"), (2, None, "s"), (3, "once only here", "s")])
    assert spelling.variants(docs).count() == 0 == spelling.variants(docs.limit(0)).count()


@pytest.mark.parametrize("a, b, want", [("abcde", "abde", True), ("abcde", "abxde", True), ("aaaaa", "aaaa", True), ("abcde", "abced", False), ("abcde", "abcde", False), ("abcde", "abc", False)])
def test_brute_force_itself(a, b, want):
    assert near(a, b) == want
