"""The random field against enumeration, held-out accuracy, and texts that switch between languages."""

import itertools
import zlib

import numpy as np
from conftest import SF
from pyspark.sql import functions as F
from test_operators import docs_of

from quarry.llm import language, queries

A, B = "the cat sat on this mat with that hat and then went there", "der Hund liegt auf dem Bett und schläft nicht sehr gut heute"


def texts_of(seed, n, words=40):
    rng = np.random.default_rng(seed)
    return [(lang, " ".join(rng.choice(text.split(), words))) for _ in range(n) for lang, text in (("en", A), ("de", B))]


def fitted():
    rows = texts_of(0, 30)
    return language.fit([t for _, t in rows], [x for x, _ in rows])


def test_marginals_equal_enumeration(monkeypatch):
    """Blocks and pieces of any size give the marginals of the sum over all labellings."""
    rng = np.random.default_rng(4)
    k, n = 3, 7
    model = {"langs": ["a", "b", "c"], "lexicons": [set()] * 3, "kept": np.zeros(0, np.int64), "weights": np.zeros((1, k)), "start": rng.normal(size=k), "move": rng.normal(size=(k, k))}
    scores = 3 * rng.normal(size=(2 * n, k))
    want = np.zeros((2 * n, k))
    for half in (0, n):
        total = 0.0
        for path in itertools.product(range(k), repeat=n):
            w = np.exp(model["start"][path[0]] + sum(model["move"][x, y] for x, y in zip(path, path[1:])) + sum(scores[half + t, y] for t, y in enumerate(path)))
            total += w
            for t, y in enumerate(path):
                want[half + t, y] += w
        want[half : half + n] /= total
    for block, piece in ((4, 4), (4, 8), (3, 6), (64, 128)):
        monkeypatch.setattr(language, "BLOCK", block)
        monkeypatch.setattr(language, "PIECE", piece)
        labeller = language.Labeller(model)
        labeller.known.table = scores
        found = dict(labeller.marginals(np.arange(2 * n), np.array([0, n])))
        assert np.allclose(np.concatenate([found[at] for at in sorted(found)]), want)


def test_gradient_equals_differences():
    """The fit's expectations are the derivatives of the normaliser."""
    rng = np.random.default_rng(5)
    e, start, move = rng.normal(size=(2, 5, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    marginal, pairs, log = language._chains(e, start, move)
    for at in ((0, 2, 1), (1, 0, 2)):
        more = e.copy()
        more[at] += 1e-5
        assert abs((language._chains(more, start, move)[2].sum() - log.sum()) / 1e-5 - marginal[at]) < 1e-4
    more = move.copy()
    more[1, 2] += 1e-5
    assert abs((language._chains(e, start, more)[2].sum() - log.sum()) / 1e-5 - pairs[1, 2]) < 1e-4


def test_switched_text_is_labelled_by_word():
    labeller = language.Labeller(fitted())
    text = "The cat sat on that mat; der Hund liegt auf dem Bett und schläft. Then the cat went there!"
    spans = labeller.spans(text)
    assert [(text[a:b], lang) for a, b, lang, _ in spans] == [("The cat sat on that mat", "en"), ("der Hund liegt auf dem Bett und schläft", "de"), ("Then the cat went there", "en")]
    assert labeller.spans("") == labeller.spans(None) == labeller.spans("12 ... 34") == []


def test_pieces_do_not_change_a_document(monkeypatch):
    model, text = fitted(), " ".join(t for _, t in texts_of(2, 200))
    whole = list(language.Labeller(model).documents([text, None, "cat", text]))
    monkeypatch.setattr(language, "PIECE", 640)
    monkeypatch.setattr(language, "_CUT", 100)
    cut = list(language.Labeller(model).documents([text, None, "cat", text]))
    assert [x[::2] for x in whole] == [x[::2] for x in cut] and np.allclose([x[1] for x in whole], [x[1] for x in cut])
    assert whole[1] == ("und", 0.0, 0) and whole[0][2] == len(text.split())


def test_edges(spark):
    rows = [(k, t, x) for k, (x, t) in enumerate(texts_of(1, 40))] + [(900, None, "en"), (901, "", "en"), (902, "12 34 %", "de"), (903, A, None), (None, B, "de"), (904, "the cat " * 100_000, "en"), (905, B, "de"), (905, B, "de")]
    docs = spark.createDataFrame([(i, t, x) for i, t, x in rows], "doc_id long, text string, lang string").withColumn("held_out", F.lit("mine")).withColumn("score", F.lit(2)).withColumn("id", F.lit(3))
    got = language.classify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (900, 901, 902)} == {"und"} and {by[i].score for i in (900, 901, 902)} == {0.0}
    assert by[903].lang_pred == "en" and by[None].lang_pred == "de" and by[904].lang_pred == "en" and by[904].n_words == 200_000 and by[905].lang_pred == "de"
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert language.classify(docs.limit(0)).count() == 0
    assert {(r.lang_pred, r.score) for r in language.classify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}
    assert {r.lang_pred for r in language.classify(docs.withColumn("lang", F.lit("xx"))).collect()} == {"xx", "und"}
    runs = language.label_words(docs.where("doc_id in (900, 903)"), language.train(docs)).collect()
    assert [(r.doc_id, r.start, r.end, r.lang) for r in runs] == [(903, 0, len(A), "en")]


def test_what_is_held_out_is_not_learned_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "fit", lambda texts, langs: seen.append(list(zip(texts, langs))))
    docs = spark.createDataFrame([(k, f"t{k} " * (k + 1), "ab"[k % 2]) for k in range(60)], "doc_id long, text string, lang string")
    language.train(docs)
    language.train(docs, most=5)
    language.train(docs, characters=400)
    free = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    assert sorted(seen[0]) == sorted((f"t{k} " * (k + 1), "ab"[k % 2]) for k in free)
    assert len(seen[1]) == 10 and sum(len(t) for t, _ in seen[2]) <= 400 and seen[2]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("lang").alias("gold"))
    rows = queries.op13_language_id(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang_pred == r.gold for r in rows) >= 0.97 * len(rows)


def test_clashing_names(spark):
    docs = docs_of(spark, [(1, A, "s"), (2, B, "s")]).withColumn("lang_pred", F.lit(1)).withColumn("n_words", F.lit(2))
    assert language.classify(docs, model=fitted()).columns == ["doc_id", "held_out", "lang_pred", "score", "n_words"]
