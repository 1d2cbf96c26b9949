"""Toxic spans and document scores by a linear-chain conditional random field.

Two labels per token (0 clean, 1 toxic).  The emission of a token is the sum
of hashed weights of its word form and prefixes, the transitions are one 2 x 2
table.  Labelled tokens come from labelled documents: every token of a clean
document is clean; a token of a toxic document is toxic if one of its features
is strongly tied to toxic documents (a likelihood-ratio test on document
counts).  Emissions, transitions and the start are fitted together on the
conditional likelihood of these labels, which is concave, until it no longer
rises.  Forward-backward marginals give toxic spans with their offsets, and a
logistic layer over the marginals of a document gives its score.  Very long
texts are tagged whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import crc_mod, numbered

#: Labelled documents of each class that the model is fitted on at most, and the longest text among them.
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 20_000
#: Size of the hashed weight table.
WEIGHTS = 1 << 18
#: Likelihood ratio from which a feature marks tokens of toxic documents as toxic.
EVIDENCE = 18.0
#: Fitting: strength of the Gaussian prior on all parameters, most steps, relative gain that ends it.
PRIOR, STEPS, GAIN = 1.0, 150, 1e-5
#: Tokens of the whole documents that the fit looks at together, which bounds its memory.
SLAB = 200_000
#: Words a worker remembers; tokens scored at once.
CACHE_WORDS, TOKENS_AT_ONCE = 300_000, 1_500_000

_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def features(word: str) -> list[int]:
    """Hashed features of a word form: a bias, the stripped lower-case form and its prefixes."""
    w = _EDGE.sub("", word.lower())
    forms = ["", "=" + w] + [w[:k] for k in range(3, 9) if k < len(w)] + ([w] if 3 <= len(w) <= 8 else [])
    return [zlib.crc32(f.encode()) % (WEIGHTS - 1) + 1 if f else 0 for f in forms]


class Words:
    """Feature lists of the word forms seen so far, numbered."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.lists: list[list[int]] = []

    def __call__(self, words: list[str]) -> np.ndarray:
        number = self.number
        try:
            return np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        except KeyError:
            for w in words:
                if w not in number:
                    number[w] = len(self.lists)
                    self.lists.append(features(w))
            return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def flat(self, since: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(type, feature) pairs of the types from ``since`` on."""
        part = self.lists[since:]
        sizes = np.array([len(x) for x in part], np.int64)
        return np.repeat(np.arange(len(part)), sizes), np.array([f for x in part for f in x], np.int64)


def passes(emission: np.ndarray, first: np.ndarray, a: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of label 1 for each token of consecutive documents (``first`` marks their first tokens).

    The recursions are ratios of two states.  All tokens are cut into equal
    blocks that run side by side; each block starts from its predecessor's end,
    and passes repeat until no block's start changes.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros(0)
    e = np.exp(np.clip(emission, -30, 30))
    width = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // width)
    pad = blocks * width - n
    grid = np.concatenate((e, np.ones(pad))).reshape(blocks, width).T.copy()
    new = np.concatenate((first, np.ones(pad, bool))).reshape(blocks, width).T.copy()

    def settle(step, order, shift):
        held, out = np.ones(blocks), np.empty((width, blocks))
        for _ in range(blocks + 1):
            x = held
            for k in order:
                x = step(k, x)
                out[k] = x
            following = shift(x)
            if np.allclose(following, held, rtol=1e-12, atol=0):
                break
            held = following
        return out

    alpha = settle(lambda k, x: grid[k] * np.where(new[k], start, (a[0, 1] + x * a[1, 1]) / (a[0, 0] + x * a[1, 0])),
                   range(width), lambda x: np.concatenate(([1.0], x[:-1])))
    # beta of a token looks at the next token; rows are shifted by one token.
    after_e = np.concatenate((grid.T.ravel()[1:], [1.0])).reshape(blocks, width).T.copy()
    after_new = np.concatenate((new.T.ravel()[1:], [True])).reshape(blocks, width).T.copy()

    def back(k, y):
        z = after_e[k] * y
        return np.where(after_new[k], 1.0, (a[1, 0] + a[1, 1] * z) / (a[0, 0] + a[0, 1] * z))

    beta = settle(back, range(width - 1, -1, -1), lambda y: np.concatenate((y[1:], [1.0])))
    return alpha.T.ravel()[:n], beta.T.ravel()[:n]


def chain(emission: np.ndarray, first: np.ndarray, a: np.ndarray, start: float) -> np.ndarray:
    """Marginal odds of label 1 for each token of consecutive documents."""
    alpha, beta = passes(emission, first, a, start)
    return alpha * beta


class Likelihood:
    """Minus the log-likelihood of token labels, less the log prior, with its gradient.

    The parameters are one vector: a weight per feature, the logs of the four
    transitions (from clean to clean, to toxic, from toxic to clean, to toxic)
    and of the odds of a toxic start.  ``type_of`` and ``feature_of`` pair word
    forms with their features, ``tokens`` are word forms.
    """

    def __init__(self, type_of, feature_of, features: int, tokens, label, first, prior: float = PRIOR):
        self.type_of, self.feature_of, self.features, self.tokens, self.first, self.prior = type_of, feature_of, features, tokens, first, prior
        self.types = int(type_of.max()) + 1 if len(type_of) else 0
        both = (2 * label[:-1].astype(np.int8) + label[1:].astype(np.int8))[~first[1:]]
        self.pairs = np.bincount(both, minlength=4).astype(float)
        self.starts = float(label[first].sum())
        self.marked = np.bincount(tokens, label, self.types)
        begins = np.append(np.flatnonzero(first), len(tokens))
        edges = np.unique(np.append(begins[np.searchsorted(begins, np.arange(0, len(tokens), SLAB))], len(tokens)))
        self.slabs = [slice(i, j) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def by_type(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.type_of, weights[self.feature_of], self.types)

    def odds(self, weights: np.ndarray, a: np.ndarray, start: float) -> np.ndarray:
        """Marginal odds of all tokens."""
        emission = self.by_type(weights)
        return np.concatenate([chain(emission[self.tokens[k]], self.first[k], a, start) for k in self.slabs])

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        moves, start = theta[-5:-1], np.exp(theta[-1])
        a, emission = np.exp(moves).reshape(2, 2), self.by_type(theta[:-5])
        value = -(self.marked @ emission + self.pairs @ moves + self.starts * theta[-1])
        gap, pairs, starts = -self.marked, -self.pairs, -self.starts
        for k in self.slabs:
            tokens, first = self.tokens[k], self.first[k]
            e, inside, last = emission[tokens], ~first[1:], np.append(first[1:], True)
            alpha, beta = passes(e, first, a, start)
            x, z = alpha[:-1][inside], (np.exp(np.clip(e, -30, 30)) * beta)[1:][inside]
            value += np.log(a[0, 0] + x * a[1, 0]).sum() + np.log1p(alpha[last]).sum()
            mass = a[0, 0] + a[0, 1] * z + x * (a[1, 0] + a[1, 1] * z)
            pairs = pairs + [(a[0, 0] / mass).sum(), a[0, 1] * (z / mass).sum(), a[1, 0] * (x / mass).sum(), a[1, 1] * (x * z / mass).sum()]
            marginal = alpha * beta
            marginal /= 1 + marginal
            gap = gap + np.bincount(tokens, marginal, self.types)
            starts += marginal[first].sum()
        slope = np.concatenate((np.bincount(self.feature_of, gap[self.type_of], self.features), pairs, [starts]))
        return float(value + self.prior / 2 * (theta @ theta)), slope + self.prior * theta


def minimise(f, x: np.ndarray, steps: int = STEPS, gain: float = GAIN, held: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent, until a step lowers ``f`` by no more than the share ``gain``."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, shares = -slope, []
        for s, y, r in reversed(past):
            shares.append(r * (s @ way))
            way = way - shares[-1] * y
        if past:
            s, y, r = past[-1]
            way = way / (r * (y @ y))
        for (s, y, r), share in zip(past, reversed(shares)):
            way = way + (share - r * (y @ way)) * s
        fall, size = way @ slope, 1.0 if past else 1 / max(1.0, np.abs(slope).sum())
        while True:
            ahead, slope_ahead = f(x + size * way)
            if ahead <= value + 1e-4 * size * fall or size < 1e-12:
                break
            size /= 2
        if ahead >= value:
            break
        s, y = size * way, slope_ahead - slope
        if s @ y > 0:
            past = [*past[1 - held:], (s, y, 1 / (s @ y))]
        done = value - ahead <= gain * abs(value)
        x, value, slope = x + s, ahead, slope_ahead
        if done and len(past) > 1:
            break
    return x


def _document_features(odds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per document: bias, log of the summed odds, log of the largest odds, log of its length."""
    sizes = np.diff(ends, prepend=0)
    out = np.zeros((len(ends), 4))
    out[:, 0] = 1
    out[:, 1:3] = -12
    some = np.flatnonzero(sizes)
    if len(some):
        begin = ends[some] - sizes[some]
        total = np.add.reduceat(odds, begin)
        out[some, 1] = np.log(np.maximum(total, 1e-9))
        out[some, 2] = np.log(np.maximum(np.maximum.reduceat(odds, begin), 1e-9))
        out[some, 3] = np.log1p(sizes[some])
    return np.clip(out, -12, 12)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model:
    """Fitted weights; scores lists of texts."""

    def __init__(self, weights, a, start, layer, prior):
        self.weights, self.a, self.start, self.layer, self.prior = weights, a, start, layer, prior

    def score(self, texts: list[str], known: dict, span_from: float = 0.5):
        """(scores, spans) of texts; ``known`` remembers emissions between calls."""
        words = [t.split() for t in texts]
        if len(known) > CACHE_WORDS:
            known.clear()
        flat = [w for ws in words for w in ws]
        try:
            emission = np.fromiter(map(known.__getitem__, flat), float, len(flat))
        except KeyError:
            for w in dict.fromkeys(flat):
                if w not in known:
                    known[w] = float(self.weights[features(w)].sum())
            emission = np.fromiter(map(known.__getitem__, flat), float, len(flat))
        ends = np.cumsum([len(ws) for ws in words]) if words else np.zeros(0, np.int64)
        first = np.zeros(len(flat), bool)
        first[(ends - np.diff(ends, prepend=0))[np.diff(ends, prepend=0) > 0]] = True
        odds = chain(emission, first, self.a, self.start)
        x = _document_features(odds, ends)
        scores = 1 / (1 + np.exp(-np.clip(x @ self.layer, -30, 30))) if self.layer is not None else np.full(len(texts), self.prior)
        bad, spans = odds >= span_from / (1 - span_from), []
        for t, end, ws in zip(texts, ends.tolist(), words):
            mine = bad[end - len(ws):end]
            spans.append(",".join(f"{m.start()}:{m.end()}" for m, b in zip(re.finditer(r"\S+", t), mine) if b) if mine.any() else "")
        return scores, spans


def fit(sample: list[tuple[str, int]], n_clean: int, n_toxic: int) -> Model:
    """Fits on (text, toxic) rows; the counts are those of all labelled rows, for the prior."""
    prior = n_toxic / max(1, n_clean + n_toxic)
    y = np.array([t for _, t in sample], np.int64)
    if not len(y) or not 0 < y.sum() < len(y):
        return Model(np.zeros(WEIGHTS), np.full((2, 2), 0.5), 1.0, None, float(prior))
    words = Words()
    docs = [words(t.split()) for t, _ in sample]
    type_of, feature_of = words.flat()
    types = len(words.lists)
    del words
    # Documents of each class that hold a feature.
    by_type = np.argsort(type_of, kind="stable")
    type_of, feature_of = type_of[by_type], feature_of[by_type]
    at = np.searchsorted(type_of, np.arange(types + 1))
    seen = np.zeros((2, WEIGHTS))
    for d, label in zip(docs, y):
        own = np.unique(d)
        held = np.concatenate([feature_of[at[w]:at[w + 1]] for w in own.tolist()]) if len(own) else np.zeros(0, np.int64)
        seen[label, np.unique(held)] += 1
    share = y.mean()
    total = seen.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(seen[1] > 0, seen[1] * np.log(seen[1] / (total * share)), 0)
                     + np.where(seen[0] > 0, seen[0] * np.log(seen[0] / (total * (1 - share))), 0))
    marks = (ratio >= EVIDENCE) & (seen[1] / np.maximum(total, 1) > (1 + 3 * share) / (1 + 3))
    marked = np.zeros(types, bool)
    np.logical_or.at(marked, type_of, marks[feature_of])
    tokens = np.concatenate(docs).astype(np.int32)
    label = np.concatenate([marked[d] & (t == 1) for d, t in zip(docs, y)])
    ends = np.cumsum([len(d) for d in docs])
    sizes = np.diff(ends, prepend=0)
    del docs
    first = np.zeros(len(tokens), bool)
    first[(ends - sizes)[sizes > 0]] = True
    if not label.any():
        return Model(np.zeros(WEIGHTS), np.full((2, 2), 0.5), 1.0, None, float(prior))
    used, place = np.unique(feature_of, return_inverse=True)
    likelihood = Likelihood(type_of, place, len(used), tokens, label, first)
    theta = minimise(likelihood, np.zeros(len(used) + 5))
    w = np.zeros(WEIGHTS, np.float32)
    w[used] = theta[:-5]
    a, start = np.exp(theta[-5:-1]).reshape(2, 2), float(np.exp(theta[-1]))
    x = _document_features(likelihood.odds(w[used].astype(float), a, start), ends)
    weight = np.where(y == 1, n_toxic / y.sum(), n_clean / (len(y) - y.sum()))
    return Model(w, a, start, _logistic(x, y, weight / weight.mean()), float(prior))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", held_out: int = 2, of: int = 4, sample_docs: int = SAMPLE_DOCS,
          sample_chars: int = SAMPLE_CHARS) -> Model:
    """Model from labelled documents whose crc32(id) mod ``of`` is not ``held_out``.

    The fit reads at most ``sample_docs`` documents of each class (those with
    the smallest hash of their id among texts of at most ``sample_chars``
    characters), which bounds what reaches the driver; the class counts, which
    set the prior, cover all labelled rows, longer texts too.  NULL labels and ids are no labels;
    of repeated labels the larger counts; of rows with one id the smallest text
    is read.
    """
    marks = (labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull())
             .groupBy(labels[id_col].cast("long").alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
             .where(crc_mod(F.col("id"), of) != held_out))
    texts = (numbered(docs, id_col, text_col).where(F.col("id").isNotNull() & (F.length("text") <= sample_chars))
             .where(crc_mod(F.col("id"), of) != held_out))
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # Which ids: a threshold on the hash, from the class counts, then an exact top-k of ids; texts come last.
    order = F.xxhash64("id")
    ids = texts.select("id").join(marks, "id")
    picked = None
    for y in (0, 1):
        top = ids.where(F.col("y") == y).distinct().orderBy(order, "id").limit(sample_docs)
        picked = top if picked is None else picked.unionAll(top)
    rows = (texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
            .select("id", "text", "y").orderBy("id").collect())
    return fit([(r["text"], r["y"]) for r in rows], counts.get(0, 0), counts.get(1, 0))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id",
                    text_col: str = "text", row_col: str | None = None, held_out: int = 2, of: int = 4) -> DataFrame:
    """Scores every whole text.

    Returns per row: (row_col,) the id, held_out, score (0 to 1), predicted
    (1 if score >= threshold) and spans (start:end of toxic tokens in code
    points, end exclusive, comma-joined).  NULL and empty texts have no tokens
    and get the score of an empty document; NULL and repeated ids and repeated
    rows are scored like any other; other columns are dropped.
    """

    def run(batches):
        known: dict[str, float] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= 6 * TOKENS_AT_ONCE):
                    size += len(texts[end])
                    end += 1
                scores, spans = model.score(texts[at:end], known)
                yield pa.RecordBatch.from_arrays([batch.column("row")[at:end], batch.column("id")[at:end], pa.array(scores, pa.float64()), pa.array(spans, pa.string())],
                                                 ["row", "id", "score", "spans"])
                at = end

    keep = [F.col("row").alias(row_col)] if row_col else []
    return (numbered(docs, id_col, text_col, row_col)
            .mapInArrow(run, "row long, id long, score double, spans string")
            .select(*keep, F.col("id").alias(id_col), (crc_mod(F.col("id"), of) == held_out).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"), "spans"))
