"""Toxicity: a counterfactually regularised linear classifier over the words of a text.

A sparse logistic model of words and word beginnings (insults take endings), each by the
steps 1, 2 and 4 of its count, is fitted on a bounded sample of labelled documents.  Its
documents that mention an identity term are copied with all mentions swapped for another
term of its group, and the change of the score is penalised over every count step that
changes, so that mentions of a group move no score by themselves; terms are put into the documents
that mention none.  The training set is ``PER_CLASS`` labelled documents of
each class at most, by hash order of the id; the driver holds their distinct words only.

Defined results: words are runs of letters in lower case; a null text is empty; an empty
text gets the model's bias; repeated rows get equal scores; without training rows of both
classes the score is the share of toxic training rows (0 if none).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm import common as C
from lexiflow.llm import pieces as P

PER_CLASS = 2000  # labelled documents of each class in the training sample
MIN_DF = 3  # sampled documents that hold a feature word
L1 = 0.001
COUNTERFACTUAL = 1.0  # weight of the mean squared score change under a swap
STEPS = 300
THRESHOLD = 0.5

# Identity terms, by group: a term is swapped for another of its group.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "bisexual", "queer", "straight", "homosexual", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists", "sikhs"),
    ("black", "white", "asian", "african", "latino", "hispanic", "arab", "european"),
    ("immigrants", "refugees", "migrants", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
)

FIELDS = T.StructType([T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])

_LETTERS = re.compile(r"[^\W\d_]+")


PREFIXES = (4, 5, 6)
LEVELS = (1, 2, 4)  # a feature counts at each of these counts that it reaches


def features_of(word: str) -> list[str]:
    """The word and its proper beginnings, marked by ``^``."""
    return [word, *["^" + word[:n] for n in PREFIXES if len(word) > n]]


def letters_of(piece: bytes) -> list[str]:
    """The letter runs of a piece; pieces of the fast path are one run or none."""
    if P.is_odd(piece):
        return [w.lower() for w in _LETTERS.findall(piece.decode())]
    return [piece.decode()] if piece[0] >= 0x61 and piece[:1] not in b"{|}~\x7f" else []


def sentences(text: str) -> list[list[str]]:
    return [[w.lower() for w in _LETTERS.findall(s)] for s in re.split(r"[.!?\n]+", text)]


def swaps(found: dict[str, int], seed: int) -> list[tuple[str, str, int]]:
    """(term, term it is swapped for, mentions) of every identity term of the counted words."""
    out: list[tuple[str, str, int]] = []
    for w, n in found.items():
        g = _GROUP_OF.get(w)
        if g is not None:
            ring = IDENTITY_GROUPS[g]
            out.append((w, ring[(ring.index(w) + 1 + (seed + len(out)) % (len(ring) - 1)) % len(ring)], n))
    return out


_GROUP_OF = {w: g for g, ring in enumerate(IDENTITY_GROUPS) for w in ring}


class ToxicWords:
    """Weights of words and word beginnings, one for each of LEVELS."""

    def __init__(self, weights: dict[str, tuple[float, ...]], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: pa.Array) -> np.ndarray:
        pieces, first = P.cut(text)
        code, distinct = C.codes(pieces)
        n_docs = len(first) - 1
        names = list(self.weights)
        place = {w: i for i, w in enumerate(names)}
        parts = [[place[f] for w in letters_of(p) for f in features_of(w) if f in place] for p in distinct.to_pylist()]
        hit = np.array([bool(p) for p in parts], bool)
        at = np.flatnonzero(hit[code]) if len(code) else np.zeros(0, np.int64)
        doc = np.searchsorted(first, at, "right") - 1
        doc, column = columns(doc, code[at], np.ones(len(at), np.int64), parts, max(1, len(names)))
        w = np.array([x for f in names for x in self.weights[f]] or [0.0])
        z = self.bias + np.bincount(doc, w[column], n_docs)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def columns(doc: np.ndarray, code: np.ndarray, count: np.ndarray, parts: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, column) pairs: column ``f * len(LEVELS) + l`` if the words of feature f
    occur LEVELS[l] times or more; ``parts`` has the features of each word code."""
    return reached(*totals(doc, code, count, parts, n), n)


def totals(doc: np.ndarray, code: np.ndarray, count: np.ndarray, parts: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted ``document * n + feature``, occurrences of the feature's words)."""
    size = np.array([len(p) for p in parts], np.int64)
    flat = np.array([f for p in parts for f in p], np.int64)
    start = np.cumsum(size) - size
    k = size[code]
    feature = flat[np.repeat(start[code] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
    pair, at = np.unique(np.repeat(doc, k) * n + feature, return_inverse=True)
    return pair, np.bincount(at, np.repeat(count, k), len(pair))


def reached(pair: np.ndarray, total: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    docs, cols = [], []
    for lvl, least in enumerate(LEVELS):
        some = pair[total >= least]
        docs.append(some // n)
        cols.append(some % n * len(LEVELS) + lvl)
    return np.concatenate(docs), np.concatenate(cols)


Swap = tuple[list[int], list[int], float]  # columns that a swap takes off, that it adds, weight


def fit(doc_of: np.ndarray, word_of: np.ndarray, y: np.ndarray, n_words: int, swaps_: list[Swap]) -> tuple[np.ndarray, float]:
    """Weights and bias: logistic loss (classes weighed alike) + L1 + mean squared change of
    the score over the counterfactual swaps, by accelerated
    proximal gradient steps; each coordinate's step is one over the row sum that bounds
    its curvature, so the steps cannot diverge."""
    n = len(y)
    rate = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    wide = rate * (np.bincount(doc_of, minlength=n) + 1)
    curve = 0.25 * np.bincount(word_of, wide[doc_of], n_words)
    row = np.array([i for i, (a, b, _) in enumerate(swaps_) for _ in [*a, *b]], np.int64)
    col = np.array([c for a, b, _ in swaps_ for c in [*a, *b]], np.int64)
    sign = np.array([x for a, b, _ in swaps_ for x in [1.0] * len(a) + [-1.0] * len(b)])
    weight = np.array([w for _, _, w in swaps_]) / max(sum(w for _, _, w in swaps_), 1e-12)
    size = np.bincount(row, minlength=len(swaps_))
    curve += 2 * COUNTERFACTUAL * np.bincount(col, (weight * size)[row], n_words) if len(row) else 0
    step, step_b = 1 / np.maximum(curve, 1e-4), 1 / max(0.25 * wide.sum(), 1e-4)
    theta, bias = np.zeros(n_words), 0.0
    look, look_b, t = theta, bias, 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(look_b + np.bincount(doc_of, look[word_of], n), -500, 500)))
        err = rate * (p - y)
        grad = np.bincount(word_of, err[doc_of], n_words)
        if len(row):  # the change of the score under each swap
            gap = 2 * COUNTERFACTUAL * weight * np.bincount(row, sign * look[col], len(swaps_))
            grad += np.bincount(col, sign * gap[row], n_words)
        new = look - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
        new_b = look_b - step_b * err.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_b = new + (t - 1) / t_new * (new - theta), new_b + (t - 1) / t_new * (new_b - bias)
        theta, bias, t = new, new_b, t_new
    return theta, float(bias)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> ToxicWords:
    """Fit on a bounded sample of the labelled rows of ``labels`` (doc_id, toxic)."""
    ids = C.sampled_ids(labels, "toxic", per_class)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), "_id")

    def features(batches):
        for batch in batches:
            for part, text in C.slices(batch, 1):
                words, counts, terms, swapped, mentions = [], [], [], [], []
                for i, s in zip(part.column(0).to_pylist(), text.to_pylist(), strict=True):
                    found = Counter(w for x in sentences(s) for w in x)
                    words.append(list(found))
                    counts.append(list(found.values()))
                    pair = swaps(found, i) or swaps({_absent(i): 0}, i)
                    terms.append([a for a, _, _ in pair])
                    swapped.append([b for _, b, _ in pair])
                    mentions.append([n for _, _, n in pair])
                lists, longs = pa.list_(pa.string()), pa.list_(pa.int64())
                cols = [pa.array(words, lists), pa.array(counts, longs), pa.array(terms, lists), pa.array(swapped, lists), pa.array(mentions, longs)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *cols], names=["id", "y", "words", "counts", "term", "swapped", "mentions"])

    schema = "id long, y int, words array<string>, counts array<long>, term array<string>, swapped array<string>, mentions array<long>"
    rows = chosen.select("_id", "_text", "_y").mapInArrow(C.task(features), schema).toArrow().combine_chunks().sort_by("id")
    y = rows["y"].to_numpy()
    if len(y) == 0 or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return ToxicWords({}, float(np.log((p + 1e-9) / (1 - p + 1e-9))))
    flat = lambda c: pc.list_flatten(rows[c]).to_pylist()
    doc = np.repeat(np.arange(len(y)), pc.list_value_length(rows["words"]).to_numpy())
    code, distinct = C.codes(pc.list_flatten(rows["words"]).combine_chunks())
    count = pc.list_flatten(rows["counts"]).to_numpy()
    of = np.repeat(np.arange(len(y)), pc.list_value_length(rows["term"]).to_numpy()).tolist()
    return learn(doc, code, count, distinct.to_pylist(), y, list(zip(of, flat("term"), flat("swapped"), flat("mentions"), strict=True)))


def learn(doc: np.ndarray, code: np.ndarray, count: np.ndarray, words: list[str], y: np.ndarray, swapped: list[tuple[int, str, str, int]]) -> ToxicWords:
    """Fit from (document, word code, count) rows and the (document, term, term it is
    swapped for, mentions) of the copies; a term without a mention is put in once."""
    place: dict[str, int] = {}
    parts = [[place.setdefault(f, len(place)) for f in features_of(w)] for w in words]
    terms = [w for ring in IDENTITY_GROUPS for w in ring]
    for w in terms:
        for f in features_of(w):
            place.setdefault(f, len(place))
    pair, total = totals(doc, code, count, parts, len(place))
    doc, column = reached(pair, total, len(place))
    use = np.bincount(column, minlength=len(place) * len(LEVELS)) >= MIN_DF
    merged: Counter = Counter()
    for d, a, b, n in swapped:
        cols = _changed([place[f] for f in features_of(a)], [place[f] for f in features_of(b)], n, d * len(place), pair, total)
        merged[cols] += max(n, 1)
    use[[place[f] * len(LEVELS) for w in terms for f in features_of(w)]] = True
    use[[c for off, on in merged for c in (*off, *on)]] = True
    number = np.cumsum(use) - 1
    held = use[column]
    pairs = [([int(number[c]) for c in off], [int(number[c]) for c in on], float(n)) for (off, on), n in sorted(merged.items())]
    theta, bias = fit(doc[held], number[column[held]], y.astype(np.float64), int(use.sum()), pairs)
    full = np.zeros(len(use))
    full[use] = theta
    grid = full.reshape(-1, len(LEVELS))
    return ToxicWords({f: tuple(grid[i].tolist()) for f, i in place.items() if grid[i].any()}, bias)


def _changed(a: list[int], b: list[int], n: int, key: int, pair: np.ndarray, total: np.ndarray) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Columns that a document loses and gains if all its ``n`` mentions of a term (features
    ``a``) become another (``b``); ``key`` is its first place in ``pair``."""
    off, on = [], []
    for f in sorted({*a, *b}):
        at = int(np.searchsorted(pair, key + f))
        rest = (int(total[at]) if at < len(pair) and pair[at] == key + f else 0) - n * (f in a)
        old, new = rest + max(n, 1) * (f in a), rest + max(n, 1) * (f in b)
        off += [f * len(LEVELS) + i for i, least in enumerate(LEVELS) if new < least <= old]
        on += [f * len(LEVELS) + i for i, least in enumerate(LEVELS) if old < least <= new]
    return tuple(off), tuple(on)


def _absent(i: int) -> str:
    """A term for a sampled document that mentions none: its sentences are copied with the
    term put in, and with another of its group."""
    ring = IDENTITY_GROUPS[i % len(IDENTITY_GROUPS)]
    return ring[(i // len(IDENTITY_GROUPS)) % len(ring)]


def predict(docs: DataFrame, model: ToxicWords, text_col: str = "text", into: str = "_toxic") -> DataFrame:
    """All columns of ``docs`` and the struct ``into`` (score, predicted)."""
    weights, bias = model.weights, model.bias

    def make():
        own = ToxicWords(weights, bias)

        def kernel(text):
            s = own.score(text)
            return [s, (s >= THRESHOLD).astype(np.int32)]

        return kernel

    return C.annotate(docs, text_col, make, FIELDS, into)


def query(spark, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    docs = C.source_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = C.source_table(spark, sf_dir, "labels").where(C.fold("doc_id", 5) != 0)
    out = predict(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(C.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "_toxic.*")
