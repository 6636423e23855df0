"""Secret scans: patterns and random-looking tokens propose, a character network decides.

Three base patterns give spans that always stay. Further candidates are tokens
of LEAST characters and more that mix letters with digits or cases, keys with a
known prefix, passwords in URLs and values of names that the base does not
know. A convolutional network over the characters of every candidate and its
context, written in numpy, scores them all, base spans too; a candidate beside
the base is reported if its calibrated score reaches the threshold, which is the
highest that keeps RECALL of the labelled secrets left out of training.

Labelled findings are of two sources: a rule draws secrets and harmless tokens
in surroundings of their kind, and a bounded sample of the corpus gives its base
spans as secrets and plain words of its texts as harmless tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A labelled finding: text around it, start and end there, and 1 for a secret.
Finding = tuple[str, int, int, int]
KINDS = ("assign", "access", "hex", "token")
#: Recall that the threshold keeps on labelled secrets left out of training.
RECALL = 0.98
#: Characters of a candidate, at least.
LEAST = 12
#: Documents of the corpus that labelled findings come from, those with the smallest hash of their id, and findings of a kind from each document, at most.
SAMPLE, EACH = 2_000, 4
BEFORE, WIDTH, AFTER = 24, 40, 8
CHANNELS, FILTERS, KERNEL = 10, 24, 5
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-:\"' \n"
_CODE = {c: k + 2 for k, c in enumerate(_ALPHABET)}
_SIZE = len(_ALPHABET) + 2  # 0 pads, 1 is any other character
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Prefixes of the keys of well-known services, and names of secret values beside those of the base.
_PREFIXES = "ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- xoxa- xoxb- xoxp- xoxr- xoxs- sk- sk_live_ sk_test_ rk_live_ pk_live_ AIza ya29. SG. hf_ npm_ pypi- dop_v1_ shpat_ ASIA eyJ".split()
_VALUES = "auth authorization bearer credential credentials pwd passphrase private_key access_key client_secret signature session_id".split()
_CANDIDATES = [
    re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}"),
    re.compile(rf"(?<![A-Za-z0-9_])(?:{'|'.join(map(re.escape, _PREFIXES))})[A-Za-z0-9_.-]{{8,}}"),
    re.compile(rf"""(?i)(?<![A-Za-z0-9])(?:{'|'.join(v.replace('_', '[ _-]?') for v in _VALUES)})["']?(?:\x20*[:=]\x20*|\x20)["']?([A-Za-z0-9+/_.=!@#$%^&*-]{{12,}})"""),
    re.compile(r"://[^\s/:@]+:([^\s/:@]{12,})@"),
]
_PREFIXED = re.compile("|".join(map(re.escape, _PREFIXES)))
_NAMED = re.compile("|".join(v.split("_")[0] for v in _VALUES))
#: A token that is no plain word: letters and digits, or a capital after a small letter, or two capitals before one.
_MIXED = re.compile(r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z][A-Z]|[A-Z]{2,}[a-z]")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order. A run shorter than its length can hold no other match."""
    out = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    lower = text.lower()
    if any(name in lower for name in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what may be a secret beside the base, in order and without overlaps; what lies in a base span is none."""
    found = [(m.start(), m.end()) for m in _CANDIDATES[0].finditer(text) if _MIXED.search(m[0])]
    if _PREFIXED.search(text):
        found += [m.span() for m in _CANDIDATES[1].finditer(text)]
    if _NAMED.search(text.lower()):
        found += [m.span(1) for m in _CANDIDATES[2].finditer(text)]
    if "://" in text:
        found += [m.span(1) for m in _CANDIDATES[3].finditer(text)]
    out, end, k, reach = [], 0, 0, 0
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        while k < len(base) and base[k][0] <= a:
            reach = max(reach, base[k][2])
            k += 1
        if a >= end and b > reach and b - a >= LEAST:
            out.append((a, 3, b))
            end = b
    return out


def encoded(text: str, start: int, end: int) -> np.ndarray:
    """Rows of character codes: the context before, a window of the candidate, the context after.

    A candidate longer than a window has several, side by side, so that all of it is read.
    """
    before = [_CODE.get(c, 1) for c in text[max(0, start - BEFORE) : start]]
    after = [_CODE.get(c, 1) for c in text[end : end + AFTER]]
    before, after = [0] * (BEFORE - len(before)) + before, after + [0] * (AFTER - len(after))
    rows = []
    for at in range(start, end, WIDTH):
        window = [_CODE.get(c, 1) for c in text[at : min(end, at + WIDTH)]]
        rows.append(before + window + [0] * (WIDTH - len(window)) + after)
    return np.array(rows, np.uint8)


class Network:
    """Embedding, one convolution, ReLU, maximum and mean over places, logistic output; trained by Adam."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.3, (_SIZE, CHANNELS)), "k": rng.normal(0, 0.2, (KERNEL * CHANNELS, FILTERS)), "b": np.zeros(FILTERS),
                  "o": rng.normal(0, 0.2, 2 * FILTERS), "c": np.zeros(1)}
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray):
        p, n = self.p, x.shape[1] - KERNEL + 1
        e = p["e"][x]
        cols = np.concatenate([e[:, k : k + n] for k in range(KERNEL)], axis=2)
        a = np.maximum(cols @ p["k"] + p["b"], 0)
        top = a.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(axis=1)], axis=1)
        return cols, a, top, pooled, pooled @ p["o"] + p["c"]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.01) -> None:
        rng, p = np.random.default_rng(4), self.p
        m, v, step = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
        for _ in range(epochs):
            for at in np.split(order := rng.permutation(len(x)), range(batch, len(order), batch)):
                cols, a, top, pooled, z = self.forward(x[at])
                dz = (1 / (1 + np.exp(-z)) - y[at]) / len(at)
                dpool = dz[:, None] * p["o"]
                da = np.repeat(dpool[:, None, FILTERS:] / a.shape[1], a.shape[1], axis=1)
                i, j = np.indices(top.shape)
                da[i, top, j] += dpool[:, :FILTERS]
                da *= a > 0
                dcols = da @ p["k"].T
                dx = np.zeros((*x[at].shape, CHANNELS))
                for k in range(KERNEL):
                    dx[:, k : k + a.shape[1]] += dcols[:, :, k * CHANNELS : (k + 1) * CHANNELS]
                de = np.stack([np.bincount(x[at].ravel(), dx[:, :, c].ravel(), _SIZE) for c in range(CHANNELS)], axis=1)
                g = {"e": de, "k": cols.reshape(-1, KERNEL * CHANNELS).T @ da.reshape(-1, FILTERS), "b": da.sum(axis=(0, 1)), "o": pooled.T @ dz, "c": dz.sum(keepdims=True)}
                step += 1
                for k in p:
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.forward(x[at : at + 512])[4] for at in range(0, len(x), 512)]) if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-(self.slope * z + self.shift)))


def labelled(n: int = 4000, seed: int = 2) -> list[Finding]:
    """Labelled findings (text, start, end, is a secret) drawn from a rule.

    Secrets: random base-64, alphanumeric and hexadecimal strings and keys with
    a prefix, in configuration and prose. Others: words joined by signs, paths,
    dates and versions, placeholders, repeated characters, counters, names in
    mixed case or with a number and file names, in the same surroundings.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(len(alphabet), size=k))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = "the an er on re ti ed es st en th ing tion ou ar de la le que ich der sch ment or is at".split()
    onsets, vowels, codas = "b c d f g h j k l m n p qu r s t v w x y z br ch cr dr fl gr pl pr sh sp st th tr".split(), "a e i o u ea ou ai y".split(), "b ck ct d ft g k l ll m mp n nd ng nt p r rd rn s sh st t x ve".split()
    spoken = lambda: "".join(pick(onsets) + pick(vowels) + (pick(codas) if rng.integers(2) else "") for _ in range(int(rng.integers(1, 4))))
    word = lambda: spoken() if rng.integers(2) else "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    prose = lambda: " ".join(word() for _ in range(int(rng.integers(2, 7))))
    out = []
    for k in range(n):
        size = int(rng.integers(12, 65))
        if secret := k % 2:
            value = pick([lambda: chars(lower + upper + digit + "+/", size), lambda: chars(lower + upper + digit, size), lambda: chars("0123456789abcdef", size),
                          lambda: pick([*_PREFIXES, "AKIA"]) + chars(lower + upper + digit, size), lambda: chars(upper + digit, size)])()
        else:
            value = pick([lambda: pick("-_/").join(word() for _ in range(int(rng.integers(3, 7)))) + "-" + str(rng.integers(1, 2030)), lambda: "/".join(word() for _ in range(5)) + "/" + str(rng.integers(9999)),
                          lambda: pick("xX*a-=_") * size + "1", lambda: f"{word()}-{rng.integers(2000, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}-{word()}",
                          lambda: "your_" + word() + "_" + pick(["key", "token", "password"]) + "_here_" + str(rng.integers(99)), lambda: "".join(word() for _ in range(6)) + str(rng.integers(1, 99)),
                          lambda: "".join(word().title() for _ in range(int(rng.integers(3, 7)))) + pick(["", "", str(rng.integers(99))]),
                          lambda: word() + "".join(word().title() for _ in range(int(rng.integers(2, 6)))), lambda: pick(["IMG", "DSC", "scan", "report", word()]) + f"_{rng.integers(2000, 2030)}{rng.integers(10, 13)}{rng.integers(10, 29)}_{rng.integers(1000, 9999)}",
                          lambda: word() + pick("-_=+/") + word().upper() + pick("-_=+/") + word() + word(), lambda: "".join(pick(["AND", "THE", "FOR", word().upper()]) for _ in range(5)) + word(),
                          lambda: "_".join(pick(["example", "test", "sample", "changeme", "value", "name", "item"]) + str(rng.integers(9)) for _ in range(4))])()
        left = pick([lambda: prose() + " ", lambda: prose() + "\n", lambda: word() + " = ", lambda: word() + ': "', lambda: "key: ", lambda: "", lambda: "export " + word().upper() + "="])()
        out.append((left + value + pick(["", " ", '"', "\n", ". "]) + prose(), len(left), len(left) + len(value), secret))
    return out


def corpus_findings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> list[Finding]:
    """Labelled findings of at most `sample` documents: base spans as secrets, plain words of LEAST letters and more as harmless.

    Words of a text that holds a secret are left out. A finding carries its
    context only, and a document gives EACH of either kind at most.
    """
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample)
    word = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z_/-]{11,}(?![A-Za-z0-9+/_=-])")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["t"]:
                text = text or ""
                base = base_spans(text)
                secret = [(s, e, 1) for s, _, e in base]
                plain = [] if base else [(m.start(), m.end(), 0) for m, _ in zip(word.finditer(text), range(EACH)) if not _MIXED.search(m[0])]
                for s, e, y in secret[:EACH] + plain:
                    e = min(e, s + 8 * WIDTH)
                    at = max(0, s - BEFORE)
                    out.append((text[at : e + AFTER], s - at, e - at, y))
            yield pd.DataFrame(out, columns=["text", "start", "end", "secret"])

    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t")).join(F.broadcast(ids), "__id").select("t")
    found = chosen.mapInPandas(cut, "text string, start int, end int, secret int").distinct().orderBy(F.xxhash64("text", "start"), "text", "start", "end", "secret").toPandas()  # 2 * EACH * sample short rows at most
    return list(found.itertuples(index=False, name=None))


def windows(found: list[Finding]) -> tuple[np.ndarray, np.ndarray]:
    """Encoded windows of findings, and the finding of each; a window of a tail under LEAST characters is left out."""
    rows = [encoded(t, a, b) for t, a, b, _ in found]
    rows = [r[: max(1, (b - a + WIDTH - LEAST) // WIDTH)] for r, (_, a, b, _) in zip(rows, found)]
    return np.concatenate(rows), np.repeat(np.arange(len(found)), [len(r) for r in rows])


def train(more: list[Finding] = ()) -> Network:
    """A network fitted on three quarters of the labelled findings, calibrated and thresholded on the rest.

    A finding's score is the largest of its windows, as in a scan; every window takes part in the fit.
    """
    from quarry.llm.toxicity import calibrate

    found = labelled() + list(more)
    x, of = windows(found)
    y, rest = np.array([s for *_, s in found], float), np.arange(len(found)) % 8 >= 6
    net = Network()
    net.fit(x[~rest[of]], y[of][~rest[of]])
    kept = np.flatnonzero(rest)
    z = np.maximum.reduceat(net.forward(x[rest[of]])[4], np.searchsorted(of[rest[of]], kept))
    net.slope, net.shift = calibrate(z, y[kept])
    secret = np.sort(1 / (1 + np.exp(-(net.slope * z[y[kept] > 0] + net.shift))))
    net.threshold = float(secret[int((1 - RECALL) * len(secret))])
    return net


_SPAN = "array<struct<start:int,end:int,kind:int,base:boolean,score:double>>"


def scored(text: Column, net: Network) -> Column:
    """array of (start, end, kind, base, score) of every base span and candidate of a text, by start and kind; base or score says what is reported."""

    def find(text: str) -> list[tuple]:
        base = base_spans(text)
        spans = base + candidates(text, base)
        if not spans:
            return []
        rows = [encoded(text, s, e) for s, _, e in spans]
        scores = np.maximum.reduceat(net.scores(np.concatenate(rows)), np.cumsum([0] + [len(r) for r in rows[:-1]]))
        return sorted((s, k, e, k < 3, float(p)) for (s, k, e), p in zip(spans, scores))

    @F.pandas_udf(_SPAN)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"start": s, "end": e, "kind": k, "base": b, "score": p} for s, k, e, b, p in find(t or "")] for t in texts])

    return found(text)


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", net: Network | None = None, out_col: str = "secrets") -> DataFrame:
    """docs with an array column out_col of (start, end, kind, base, score): the reported spans, by start and kind.

    Base spans come with the network's score but do not depend on it. A null
    text is empty and has none; very long texts and candidates are read whole.
    Repeated rows and null ids are kept. docs must not have a column out_col:
    that is an error. An empty table gives an empty result.
    """
    if out_col in docs.columns:
        raise ValueError(f"docs already has a column {out_col}")
    net = net or train(corpus_findings(docs, text_col, id_col))
    least = net.threshold
    return docs.withColumn(out_col, F.filter(scored(F.col(text_col), net), lambda s: s["base"] | (s["score"] >= least)))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Network | None = None) -> DataFrame:
    """Counts and digests of the spans of each row of docs, repeated rows and null ids kept; other columns are ignored.

    n_token counts the spans that the network adds, n_candidates what it was
    asked about beside the base, and scores lists its scores of all spans.
    """
    names = F.array(*map(F.lit, KINDS))
    net = net or train(corpus_findings(docs, text_col, id_col))
    least = net.threshold

    def listed(xs: Column) -> Column:
        return F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(xs: Column, kind: int) -> Column:
        return F.size(F.filter(xs, lambda s: s["kind"] == kind)).cast("long")

    every = docs.select(F.col(id_col).alias("id"), scored(F.col(text_col), net).alias("every"))
    kept = every.withColumn("kept", F.filter("every", lambda s: s["base"] | (s["score"] >= least)))
    return kept.select(F.col("id").alias(id_col), *[count(F.col("kept"), k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(listed(F.filter("kept", lambda s: s["base"])), 256).alias("base_sha256"),
                       listed(F.col("kept")).alias("spans"), count(F.col("kept"), 3).alias("n_token"), count(F.col("every"), 3).alias("n_candidates"),
                       F.array_join(F.transform("kept", lambda s: F.format_string("%.3f", s["score"])), ",").alias("scores"))
