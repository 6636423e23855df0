"""Language identification by a linear-chain conditional random field over words.

A word's score in a language is the sum of the weights of its affixes, its
character n-grams and its place in the languages' lexicons; learned transitions
join the words of a text to one chain. Forward-backward gives each word's
probability of each language, so that text that switches between languages is
labelled word by word; a document's language is the one that most of its words
are expected to be in.

The field is fitted on chains spliced from runs of words of different
documents, each labelled with its document's language: so it sees switches
though documents carry one label. Half of the documents give the lexicons and
the other half the chains, as a lexicon would know all words of its own
documents.

A chain of any length is solved exactly by blocks: the transition products of
all blocks are formed at once, messages pass from block to block, and all
blocks are then finished at once.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from hashlib import md5
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of a language that a model is fitted on, at most: those with the smallest hash of their id.
DOCS = 400
#: Characters of all of them together, at most, shared evenly by the languages: a document that would go beyond is left out as a whole.
CHARACTERS = 4_000_000
#: Languages of a model, at most: those of the most documents.
LANGUAGES = 200
#: Words of a language's lexicon, at most: the most frequent.
LEXICON = 20_000
#: Documents that must hold a word of a lexicon.
LEAST = 2
FEATURES = 1 << 18
EPOCHS = 5
#: Words of a chain of the fit, chains of a batch, and words of a run of one document, on average.
CHAIN, BATCH, SPAN = 32, 64, 10
RATE, DECAY = 0.05, 1e-5
#: Words of a block of a chain, and words that are solved at once.
BLOCK, PIECE = 64, 1 << 17
#: Words after which messages are brought back to a sum of 1.
EASE = 8
#: Tokens whose words' scores a worker remembers before it starts afresh.
MEMO = 400_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_CUT = 1 << 20
_memo: dict[str, Words] = {}


def tokens(text: str) -> Iterator[list[str]]:
    """The parts of a text between white space, in pieces cut between words."""
    at = 0
    while at < len(text):
        to = min(at + _CUT, len(text))
        while to < len(text) and text[to].isalpha():
            to += 1
        yield text[at:to].split()
        at = to


def words(text: str) -> list[str]:
    return [w for piece in tokens(text) for token in piece for w in _WORD.findall(token)]


def features(word: str, lexicons: list[set[str]]) -> list[str]:
    """Features of a lower-case word: affixes, n-grams and the lexicons that hold it."""
    w = f"^{word}$"
    # with its mark at an end, an n-gram is an affix
    names = [w[:4], w[-4:], *map("".join, zip(w, w[1:])), *map("".join, zip(w, w[1:], w[2:]))]
    return names + [f"in {k}" for k, known in enumerate(lexicons) if word in known]


class Grams(dict):
    """Numbers of features among the kept hashes of a model; the number of hashes for those it does not hold."""

    def __init__(self, kept: np.ndarray):
        super().__init__()
        self.at, self.rest = {h: n for n, h in enumerate(kept.tolist())}, len(kept)

    def __missing__(self, name: str) -> int:
        n = self.at.get(crc32(name.encode("utf-8", "surrogatepass")) % FEATURES, self.rest)
        if len(self) < MEMO:
            self[name] = n
        return n


class Words(dict):
    """Numbers of tokens, given as they come, and once scored() was called the scores of their words: those of token t are rows first[t] to first[t + 1] of table."""

    def __init__(self, model: dict):
        super().__init__()
        self.model, self.grams = model, Grams(model["kept"])
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.table, self.first, self.held = np.zeros((1024, len(self.model["langs"]))), np.zeros(1024, np.int64), 0

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        self.new.append(token)
        return n

    def scored(self) -> None:
        if not self.new:
            return
        found = [_WORD.findall(t.lower()) for t in self.new]
        count = np.fromiter(map(len, found), np.int64, len(found))
        each = [list(map(self.grams.__getitem__, features(w, self.model["lexicons"]))) for ws in found for w in ws]
        size = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter(chain.from_iterable(each), np.int64, size.sum())
        need, known = self.held + len(each), len(self)
        self.table = _roomy(self.table, self.held, need)
        self.first = _roomy(self.first, known - len(found) + 1, known + 1)
        if len(each):
            self.table[self.held : need] = np.add.reduceat(self.model["weights"][flat], np.cumsum(size) - size, axis=0)
        self.first[known - len(found) + 1 : known + 1] = self.held + np.cumsum(count)
        self.held, self.new = need, []

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """The rows of table of the words of tokens."""
        begin = self.first[ids]
        count = self.first[ids + 1] - begin
        if (count == 1).all():
            return begin
        return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())


def _roomy(x: np.ndarray, held: int, need: int) -> np.ndarray:
    if need <= len(x):
        return x
    out = np.zeros((max(need, 2 * len(x)), *x.shape[1:]))
    out[:held] = x[:held]
    return out.astype(x.dtype)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)


def _chains(emission: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, expected moves, log-likelihood's normaliser) of B chains of T words: emission (B, T, K) of log scores."""
    b, t, k = emission.shape
    top = emission.max(axis=2, keepdims=True)
    e = np.exp(emission - top)
    alpha, beta, log = np.empty((b, t, k)), np.ones((b, t, k)), top.sum(axis=(1, 2))
    x = e[:, 0] * np.exp(start)
    a = np.exp(move)
    for i in range(t):
        if i:
            x = (alpha[:, i - 1] @ a) * e[:, i]
        s = x.sum(axis=1, keepdims=True)
        log += np.log(s[:, 0])
        alpha[:, i] = x / s
    for i in range(t - 2, -1, -1):
        beta[:, i] = _normal((e[:, i + 1] * beta[:, i + 1]) @ a.T)
    marginal = _normal(alpha * beta)
    pair = alpha[:, :-1, :, None] * a * (e * beta)[:, 1:, None, :]
    pair /= np.maximum(pair.sum(axis=(2, 3), keepdims=True), 1e-300)
    return marginal, pair.sum(axis=(0, 1)), log


def fit(texts: list[str], langs: list[str]) -> dict:
    """A model of the languages of texts; the same texts in the same order give the same model."""
    names = sorted(set(langs))
    k, y = len(names), np.array([names.index(x) for x in langs])
    found = [words(t.lower()) for t in texts]
    # of each language every other document for the lexicon; all of them where there is one
    turn = np.zeros(len(texts), int)
    for c in range(k):
        turn[y == c] = np.arange((y == c).sum()) % 2
    lexicons = []
    for c in range(k):
        own = [i for i in np.flatnonzero(y == c) if turn[i] == 0 and (y == c).sum() > 1]
        spread = Counter(w for i in own for w in set(found[i]))
        lexicons.append({w for w, n in sorted(spread.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if n >= LEAST})
    place: dict[str, int] = {}
    rng = np.random.default_rng(3)
    spans: list[tuple[np.ndarray, int]] = []
    for i, ws in enumerate(found):
        if turn[i] or (y == y[i]).sum() == 1:
            ids = np.array([place.setdefault(w, len(place)) for w in ws], np.int64)
            at = 0
            while at < len(ids):
                n = int(rng.geometric(1 / SPAN))
                spans.append((ids[at : at + n], int(y[i])))
                at += n
    model = {"langs": names, "lexicons": lexicons, "kept": np.zeros(0, np.int64), "weights": np.zeros((1, k)), "start": np.zeros(k), "move": np.zeros((k, k))}
    if not spans or k < 2:
        return model
    each = [np.array([crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in features(w, lexicons)]) for w in place]
    kept = np.unique(np.concatenate(each))
    each = [np.searchsorted(kept, f) for f in each]
    size, flat = np.array([len(f) for f in each]), np.concatenate(each)
    first = np.cumsum(size) - size
    w, start, move = np.zeros((len(kept), k)), np.zeros(k), np.zeros((k, k))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, start, move)]
    step, total = 0, EPOCHS * max(1, sum(len(s) for s, _ in spans) // (CHAIN * BATCH))
    for _ in range(EPOCHS):
        order = rng.permutation(len(spans))
        ids = np.concatenate([spans[j][0] for j in order])
        label = np.repeat([spans[j][1] for j in order], [len(spans[j][0]) for j in order])
        t = min(CHAIN, len(ids))
        n = len(ids) // t
        ids, label = ids[: n * t].reshape(n, t), label[: n * t].reshape(n, t)
        for at in range(0, n, BATCH):
            x, gold = ids[at : at + BATCH], label[at : at + BATCH]
            types, back = np.unique(x, return_inverse=True)
            back = back.reshape(x.shape)
            rows = np.concatenate([flat[first[u] : first[u] + size[u]] for u in types])
            begin = np.cumsum(size[types]) - size[types]
            score = np.add.reduceat(w[rows], begin, axis=0)
            marginal, pairs, _ = _chains(score[back], start, move)
            marginal[np.arange(len(x))[:, None], np.arange(t), gold] -= 1
            by_type = np.stack([np.bincount(back.ravel(), marginal[:, :, c].ravel(), len(types)) for c in range(k)], axis=1)
            spread = np.repeat(by_type, size[types], axis=0)
            g_w = np.stack([np.bincount(rows, spread[:, c], len(kept)) for c in range(k)], axis=1) / x.size + DECAY * w
            g_start = marginal[:, 0].sum(axis=0) / len(x)
            np.subtract.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
            step += 1
            rate = RATE * min(1.0, 2 * (1 - step / (total + 1)) + 0.02)
            for p, g, (m, v) in zip((w, start, move), (g_w, g_start, pairs / x.size + DECAY * move), state):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model | {"kept": kept, "weights": np.vstack([w, np.zeros((1, k))]).astype(np.float32).astype(float), "start": start, "move": move}


class Labeller:
    """Marginals of words under a model; the worker keeps what it knows of words for its next task."""

    def __init__(self, model: dict):
        self.model, self.k = model, len(model["langs"])
        key = md5(model["weights"].tobytes() + repr([model["langs"], model["move"].tolist()]).encode()).hexdigest()
        if key not in _memo:
            _memo.clear()
            _memo[key] = Words(model)
        self.known = _memo[key]

    def ids(self, text: str | None) -> np.ndarray:
        """Numbers of a text's words, that is rows of the table of scores."""
        out = array("i")
        for piece in tokens(text or ""):
            out.extend(map(self.known.__getitem__, piece))
        self.known.scored()
        return self.known.rows(np.frombuffer(out, np.int32)) if out and self.k else np.zeros(0, np.int64)

    def fresh(self) -> None:
        """Forget all tokens if they are many; numbers given before are void then."""
        if len(self.known) > MEMO:
            self.known.forget()

    def marginals(self, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(place, probabilities) of pieces of a row of chains, the last piece first; first has the places of the words that begin a chain."""
        start, move = np.exp(self.model["start"] - self.model["start"].max()), np.exp(self.model["move"])
        places = range(0, len(ids), PIECE)
        ahead, piece = [np.ones(self.k)], None
        for at in places:
            piece = self._blocks(ids, first, at, start, move)
            ahead.append(_through(ahead[-1], piece[2]))
        behind = np.ones(self.k)
        for at in reversed(places):
            e, begins, product = piece or self._blocks(ids, first, at, start, move)
            piece = None
            n = e.shape[1]
            alpha, beta = np.empty((n, self.k)), np.empty((n, self.k))
            x = ahead[at // PIECE]
            for j, p in enumerate(product):
                alpha[j] = x
                x = x @ p
                x /= x.sum()
            for j in range(n - 1, -1, -1):
                beta[j] = behind
                behind = product[j] @ behind
                behind /= behind.sum()
            out = np.empty(e.shape)
            for i, rows in enumerate(begins):
                np.matmul(alpha, move, out=out[i])
                out[i][rows] = start
                out[i] *= e[i]
                if i % EASE == EASE - 1:
                    out[i] /= out[i].sum(axis=1, keepdims=True)
                alpha = out[i]
            for i in range(BLOCK - 1, -1, -1):
                b = e[i] * beta
                out[i] *= beta
                beta = b @ move.T
                if len(begins[i]):
                    beta[begins[i]] = (b[begins[i]] @ start)[:, None]
                if i % EASE == 0:
                    beta /= beta.sum(axis=1, keepdims=True)
            yield at, _normal(out.transpose(1, 0, 2).reshape(-1, self.k)[: len(ids) - at])

    def _blocks(self, ids: np.ndarray, first: np.ndarray, at: int, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Of the piece at a place: scores as exponentials by place in the block and block, at each place the blocks where a chain begins, and each block's transition product.

        What fills the last block up is a chain of its own, so that nothing comes back from it.
        """
        own = ids[at : at + PIECE]
        n, k = -(-len(own) // BLOCK), self.k
        e = np.ones((n * BLOCK, k))
        scores = self.known.table[own]
        e[: len(own)] = np.exp(scores - scores.max(axis=1, keepdims=True))
        e = e.reshape(n, BLOCK, k).transpose(1, 0, 2).copy()
        starts = first[np.searchsorted(first, at) : np.searchsorted(first, at + len(own))] - at
        if len(own) % BLOCK:
            starts = np.append(starts, len(own))
        row, place = np.divmod(starts, BLOCK)
        begins = [np.zeros(0, np.int64)] * BLOCK
        if len(place):
            order = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[order], np.arange(BLOCK + 1))
            begins = [row[order[a:b]] for a, b in zip(cuts, cuts[1:])]
        product = np.tile(np.eye(k), (n, 1, 1))
        for i, rows in enumerate(begins):
            ended = product[rows].sum(axis=2, keepdims=True)
            product = (product.reshape(-1, k) @ move).reshape(n, k, k)
            product[rows] = ended * start
            product *= e[i][:, None, :]
            if i % EASE == EASE - 1:
                product /= product.max(axis=(1, 2), keepdims=True)
        return e, begins, product

    def documents(self, texts: list[str | None]) -> Iterator[tuple[str, float, int]]:
        """(language, score, words) of texts: the mean probability of the language that most words are expected to be in."""
        held: list[np.ndarray] = []
        size = 0
        for text in texts:
            if size > PIECE:
                yield from self._solved(held)
                held, size = [], 0
            if not held:
                self.fresh()
            held.append(self.ids(text))
            size += len(held[-1])
        yield from self._solved(held)

    def _solved(self, held: list[np.ndarray]) -> Iterator[tuple[str, float, int]]:
        if not held:
            return
        size = np.array([len(x) for x in held])
        begin = np.cumsum(size) - size
        ids = np.concatenate(held)
        total = np.zeros((len(held), self.k))
        doc = np.repeat(np.arange(len(held)), size)
        for at, p in self.marginals(ids, begin[size > 0]) if len(ids) else ():
            own = doc[at : at + len(p)]
            for c in range(self.k):
                total[:, c] += np.bincount(own, p[:, c], len(held))
        for n, sums in zip(size.tolist(), total):
            best = int(sums.argmax()) if n else 0
            yield (self.model["langs"][best], min(1.0, float(sums[best] / n)), n) if n else (UNKNOWN, 0.0, 0)

    def spans(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, language, score) of the longest runs of words of one language."""
        self.fresh()
        ids = self.ids(text)
        if not len(ids):
            return []
        p = np.concatenate([x for _, x in sorted(self.marginals(ids, np.zeros(1, np.int64)), key=lambda x: x[0])])
        label = p.argmax(axis=1)
        places = np.array([m.span() for m in _WORD.finditer(text)])
        cut = np.append(np.flatnonzero(np.diff(label, prepend=-1)), len(label))
        return [(int(places[a, 0]), int(places[b - 1, 1]), self.model["langs"][label[a]], float(p[a:b, label[a]].mean())) for a, b in zip(cut, cut[1:])]


def _through(x: np.ndarray, product: np.ndarray) -> np.ndarray:
    for p in product:
        x = x @ p
        x = x / x.sum()
    return x


def held_out(id_col: str) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most: int = DOCS, characters: int = CHARACTERS) -> dict:
    """A model fitted on at most `most` documents a language and `characters` of text that are not held out, whatever the size of docs.

    Documents without id, text or language are left out; of rows that share an
    id the smallest language and text count.
    """
    known = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # a row a language, LANGUAGES at most
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return fit([], [])
    share = F.element_at(F.create_map([F.lit(x) for r in counts for x in (r["lang"], min(1.0, 3 * most / r["count"]))]), F.col("lang"))
    mark = F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    drawn = known.where(mark < share * (1 << 32))
    # some 3 x most lengths a language, of which the driver chooses
    sizes = drawn.groupBy("id").agg(F.min("lang").alias("lang"), F.max(F.length("text")).alias("n")).withColumn("mark", mark).orderBy("mark", "id").toPandas()
    chosen = []
    for _, own in sizes.groupby("lang", sort=True):
        room = characters // len(counts)
        for i, n in zip(own["id"][:most], own["n"]):
            if n <= room:
                room -= n
                chosen.append(i)
    one = drawn.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in chosen], f"id {dict(known.dtypes)['id']}")), "id")
    sample = one.groupBy("id").agg(F.min("lang").alias("lang"), F.min("text").alias("text")).orderBy("id").toPandas()
    return fit(list(sample["text"]), list(sample["lang"]))


def classify(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", model: dict | None = None) -> DataFrame:
    """(id_col, held_out, lang_pred, score, n_words), one row per row of docs; without a model one is trained on docs.

    Null, empty and letterless texts, and all texts where no language was
    learned, are `und` with score 0. Very long texts are read whole; repeated
    rows score alike; a null id is never held out nor trained on. Other columns
    are ignored, whatever their names. An empty table gives an empty result.
    """
    model = train(docs, text_col, lang_col, id_col) if model is None else model

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model)
        for texts in batches:
            yield pd.DataFrame(list(labeller.documents(list(texts))), columns=["lang", "score", "n"])

    found = _series_udf(label, "lang string, score double, n long")
    rows = docs.select(F.col(id_col).alias("id"), found(F.col(text_col)).alias("l"))
    return rows.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"), F.col("l.n").alias("n_words"))


def _series_udf(f, schema: str):
    @F.pandas_udf(schema)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from f(texts)

    return run


def label_words(docs: DataFrame, model: dict, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, end, lang, score), a row for each longest run of words of one language: code points, end exclusive.

    Texts without words have no row; a text's runs ascend.
    """

    @F.pandas_udf("array<struct<start:int,end:int,lang:string,score:double>>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labeller = Labeller(model)
        for texts in batches:
            yield pd.Series([labeller.spans(t) for t in texts], dtype=object)

    return docs.select(F.col(id_col).alias("id"), F.explode(label(F.col(text_col))).alias("s")).select(F.col("id").alias(id_col), "s.*")
