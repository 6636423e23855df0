"""Secret scans: the whole query against brute force over planted texts, the network on findings it has not seen, and edges."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import docs_of

from quarry.llm import queries, secrets

KEYS = ["ghp_9aZk3LmQ8xT2vB7nC4dF6gH1jK5pR0sW", "xoxb-123456789012-abcdefGHIJKL", "AIzaSyA1bQwErTyUiOpAsDfGhJkLzXcVb9", "Zm9vYmFyQmF6UXV4MTIzNDU2Nzg5", "q8Xv2LpT9zRk4WnB", "sk-abcDEadbeefdeadbeefdeadQQQ12"]


def planted():
    rng = np.random.default_rng(12)
    words = "harmless and quiet texts of common words stand around every planted key well-being twenty-first neighbourhood understanding".split()
    rows = []
    for k in range(120):
        w = [words[i] for i in rng.integers(len(words), size=40)]
        if k % 4 == 0:
            w[17] = KEYS[k // 4 % len(KEYS)]
        if k % 5 == 0:
            w[30] = f'token = "{"0a1b2c3d" * 5}"'
        rows.append((k, " ".join(w), "s"))
    return [*rows, (500, None, "s"), (501, "", "s"), (None, "key " + KEYS[0], "s"), (7, rows[8][1], "s"), (502, "plain words " * 100_000 + KEYS[0], "s")]


def test_query_equals_brute_force(spark, tmp_path):
    rows = planted()
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.spans, r.n_token) for r in queries.op6_secret_scans(spark, str(tmp_path)).collect()))
    net = secrets.train(secrets.corpus_findings(docs))
    want = []
    for i, text, _ in rows:
        text, spans = text or "", []
        spans += [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        base, at, added = list(spans), 0, 0
        for token in re.split(r"([^A-Za-z0-9+/_=-])", text):
            mixed = any(c.isdigit() for c in token) and any(c.isalpha() for c in token)
            if len(token) >= 12 and mixed and not any(a <= at and at + len(token) <= b for a, _, b in base):
                if max(net.scores(secrets.encoded(text, at, at + len(token)))) >= net.threshold:
                    spans.append((at, 3, at + len(token)))
                    added += 1
            at += len(token)
        want.append((-1 if i is None else i, ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)), added))
    assert got == sorted(want)
    planted_ids = {k for k in range(0, 120, 4)} | {-1, 7, 502}
    assert sum(n for _, _, n in got) >= 28 and not any(n for i, _, n in got if i not in planted_ids)


@pytest.mark.parametrize("seed", [99, 100])
def test_network_holds_its_recall_over_whole_findings(seed):
    net, found = secrets.train(), secrets.labelled(1000, seed)
    x, of = secrets.windows(found)
    s, y = np.maximum.reduceat(net.scores(x), np.searchsorted(of, np.arange(len(found)))), np.array([f[3] for f in found]) > 0
    assert (s[y] >= net.threshold).mean() > 0.95 and (s[~y] >= net.threshold).mean() < 0.02


def test_candidates():
    def of(text):
        return [text[a:b] for a, _, b in secrets.candidates(text, secrets.base_spans(text))]

    assert of("understanding Neighbourhood well-being-of-all 123456789012") == []
    assert of("a1b2c3d4e5f") == [] and of("a1b2c3d4e5f6") == ["a1b2c3d4e5f6"]
    assert of("sk-abcDEadbeefdeadbeefdeadQQQ12") == ["sk-abcDEadbeefdeadbeefdeadQQQ12"] and of("0123456789abcdef0") == []
    assert of("postgres://joe:longenoughpass@host/db") == ["longenoughpass"] and of("Bearer abcdefghijklmnop.qrs") == ["abcdefghijklmnop.qrs"]


def test_scan_edges(spark):
    docs = docs_of(spark, planted()).withColumn("id", F.lit("x")).withColumn("kept", F.lit(1))
    net = secrets.train()
    out = secrets.scan(docs, net=net)
    assert out.columns == [*docs.columns, "secrets"] and out.count() == docs.count() and out.where("doc_id is null and size(secrets) = 1").count() == 1
    with pytest.raises(ValueError):
        secrets.scan(docs.withColumn("secrets", F.lit(1)), net=net)
    assert secrets.digest(docs.limit(0)).count() == 0 and secrets.digest(docs, net=net).count() == docs.count()
    assert secrets.corpus_findings(docs.limit(0)) == [] and 0 < len(secrets.corpus_findings(docs, sample=10)) <= 20 * secrets.EACH
