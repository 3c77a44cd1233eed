"""Quality rules: a linear-chain conditional random field labels lines.

Every line with a word is content or boilerplate.  A line that repeats an earlier line of
its document is boilerplate; Viterbi decoding of a two-label chain over line features
labels the others, and the share of a document's words on content lines decides whether it
is kept.  The field is fitted on a bounded sample of labelled documents (``per_class`` of
each label, by hash order of the id): their lines count as content in a good document, as
boilerplate in a bad one.

Defined results: a null or empty text has no word and fails the base rules; words are
``[^\\x20\\x09-\\x0D]+``; repeated rows get the same verdict each; without labelled rows
of both classes the field is all zero and keeps every document that passes the base
rules.  Each document is handled alone, so no key can be hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm import common as C

PER_CLASS = 1500  # labelled documents of each class in the training sample
TRAIN_LINES = 64  # a longer document is several training chains
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"

FIELDS = T.StructType([
    T.StructField("n_words", T.LongType(), False), T.StructField("word_chars", T.LongType(), False),
    T.StructField("n_symbols", T.LongType(), False), T.StructField("n_dup_lines", T.LongType(), False),
    T.StructField("n_repeat_words", T.LongType(), False), T.StructField("base_failed", T.BooleanType(), False),
    T.StructField("kept", T.BooleanType(), False), T.StructField("content_share", T.DoubleType(), False),
    T.StructField("content_lines", T.LongType(), False), T.StructField("n_lines", T.LongType(), False),
])

_SYM = np.zeros(256, bool)
_SYM[list(SYMBOLS)] = True
N_FEATURES = 16


def repeat_cover(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Flags the words inside a 3-word window that its document holds twice or more.

    Windows are compared by a 64-bit hash first; those that seem to repeat are then
    compared by their words.
    """
    n = len(word)
    covered = np.zeros(n, bool)
    if n < 4:
        return covered
    at = np.flatnonzero(doc[2:] == doc[:-2])
    with np.errstate(over="ignore"):
        key = C.mix64(C.mix64(C.mix64(doc[at].astype(np.uint64)) + word[at].astype(np.uint64)) + word[at + 1].astype(np.uint64))
        key = C.mix64(key + word[at + 2].astype(np.uint64))
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if len(twice) == 0:
        return covered
    at = at[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
    cols = (word[at + 2], word[at + 1], word[at], doc[at])
    order = np.lexsort(cols)
    same = np.ones(len(at) - 1, bool)
    for c in cols:
        same &= c[order][1:] == c[order][:-1]
    hit = np.zeros(len(at), bool)
    hit[1:] |= same
    hit[:-1] |= same
    at = at[order][hit]
    for k in range(3):
        covered[at + k] = True
    return covered


class Lines:
    """Base counts of the documents of a slice and features of their lines."""

    def __init__(self, text: pa.Array):
        buf, off = C.bounds(text)
        n_docs = len(off) - 1
        ws = C.WS[buf]
        points = ((buf & 0xC0) != 0x80) & ~ws
        sym = _SYM[buf]
        starts, ends, first = C.word_bounds(buf, off)
        n_words = np.diff(first)
        doc = np.repeat(np.arange(n_docs), n_words)
        word, _ = C.codes(C.pick(buf, starts, ends))
        cover = repeat_cover(word, doc)
        self.n_words, self.word_chars, self.n_symbols = n_words, C.per_doc(points, off), C.per_doc(sym, off)
        self.n_repeat_words = C.per_doc(cover, first)

        # lines with a word: cut at newlines and at document ends
        cuts = np.unique(np.concatenate([off[:-1], np.flatnonzero(buf == 0x0A) + 1, off[-1:]]))
        line_of = np.searchsorted(cuts, starts, "right") - 1
        new = np.ones(len(starts), bool)
        new[1:] = line_of[1:] != line_of[:-1]
        lead = np.flatnonzero(new)  # first word of each line
        lines = line_of[lead]
        begin, stop = cuts[lines], np.minimum(cuts[np.minimum(lines + 1, len(cuts) - 1)], len(buf))
        self.doc = doc[lead] if len(lead) else np.zeros(0, np.int64)
        stop = np.where((stop > begin) & (buf[stop - 1] == 0x0A), stop - 1, stop) if len(lead) else stop
        self.words = np.diff(np.append(lead, len(starts)))
        code, _ = C.codes(C.pick(buf, begin, stop)) if len(lead) else (np.zeros(0, np.int64), None)
        # a line that an earlier line of its document equals
        order = np.lexsort((np.arange(len(code)), code, self.doc))
        dup = np.zeros(len(code), bool)
        if len(code) > 1:
            dup[order[1:]] = (code[order][1:] == code[order][:-1]) & (self.doc[order][1:] == self.doc[order][:-1])
        self.dup = dup
        twin = dup.copy()  # equal to any other line of its document
        if len(code) > 1:
            twin[order[:-1]] |= dup[order[1:]]
        self.n_dup_lines = np.bincount(self.doc[dup], minlength=n_docs)
        self.first_line = np.searchsorted(self.doc, np.arange(n_docs + 1))
        self.chain = np.flatnonzero(~dup)
        self.first_link = np.searchsorted(self.doc[self.chain], np.arange(n_docs + 1))
        self.x = self._features(buf, points, sym, begin, stop, lead, word, cover, twin) if len(lead) else np.zeros((0, N_FEATURES), np.float32)

    def labels(self, field: LineField) -> np.ndarray:
        """1 for boilerplate, per line: repeated lines, and what the chain says of the others."""
        out = np.ones(len(self.doc), np.int8)
        out[self.chain] = field.viterbi(self.x[self.chain], self.first_link)
        return out

    def _features(self, buf, points, sym, begin, stop, lead, word, cover, twin) -> np.ndarray:
        def span(flags):
            total = np.zeros(len(flags) + 1, np.int64)
            np.cumsum(flags, out=total[1:])
            return total[stop] - total[begin]

        lines = np.repeat(np.arange(len(lead)), self.words)
        chars = np.maximum(span(points), 1)
        high = np.zeros(len(buf), bool)  # capitals of Latin-1
        high[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
        upper = span(((buf >= 65) & (buf <= 90)) | high) / chars
        symbols = span(sym) / chars
        digits = span((buf >= 48) & (buf <= 57)) / chars
        shouts = span(buf == 33) / np.maximum(self.words, 1)
        ends = np.append(lead[1:], len(word))
        total = np.zeros(len(word) + 1, np.int64)
        np.cumsum(cover, out=total[1:])
        # a repeated line says so by itself; here count the repeats of other lines
        repeated = np.where(twin, 0, (total[ends] - total[lead]) / self.words)
        order = np.lexsort((word, lines))
        fresh = np.ones(len(word), bool)
        fresh[1:] = (word[order][1:] != word[order][:-1]) | (lines[order][1:] != lines[order][:-1])
        distinct = np.bincount(lines[order][fresh], minlength=len(lead)) / self.words
        mean = chars / self.words
        plain = (symbols <= 0.02) & (upper <= 0.3) & (repeated <= 0.3) & ~twin
        f = [
            np.ones(len(lead)), symbols > 0.02, symbols > 0.08, symbols > 0.2, upper > 0.3, upper > 0.7,
            digits > 0.2, shouts > 0.3, repeated > 0.3, repeated > 0.7, (distinct < 0.6) & (self.words >= 8),
            (distinct < 0.35) & (self.words >= 8), (mean > 14), self.words < 4,
            plain & (self.words >= 8), plain & (self.words >= 30),
        ]
        return np.column_stack(f).astype(np.float32)


class LineField:
    """Two-label chain: 0 content, 1 boilerplate.  ``emit`` weighs the features of label 1,
    ``move[a, b]`` the step from label a to b."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros(N_FEATURES) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move

    def viterbi(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best labels of all chains at once; chain i is rows ``first[i]:first[i + 1]``."""
        e = x @ self.emit
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        long = length[order]
        out = np.zeros(len(x), np.int8)
        if len(x) == 0:
            return out
        alive = np.searchsorted(-long, -np.arange(long[0]), "left")  # chains longer than t
        base = first[:-1][order]
        back = np.zeros((len(x), 2), np.int8)
        score = np.zeros((len(order), 2))
        for t in range(long[0]):
            n = alive[t]
            rows = base[:n] + t
            if t:
                step = score[:n, :, None] + self.move
                back[rows] = step.argmax(1)
                score[:n] = step.max(1)
            score[:n, 1] += e[rows]
        label = score.argmax(1).astype(np.int8)
        for t in range(long[0] - 1, -1, -1):
            n = alive[t]
            rows = base[:n] + t
            out[rows] = label[:n]
            label[:n] = back[rows, label[:n]]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, first: np.ndarray, steps: int = 150, l2: float = 1e-3, rate: float = 0.15):
        """Maximum conditional likelihood by Adam; forward-backward over padded chains."""
        cuts = np.concatenate([np.arange(a, b, TRAIN_LINES) for a, b in zip(first[:-1], first[1:], strict=True)] or [[]]).astype(np.int64)
        if len(cuts) == 0:
            return cls()
        ends = np.minimum(cuts + TRAIN_LINES, first[np.searchsorted(first, cuts, "right")])
        length = ends - cuts
        width = int(length.max())
        grid = cuts[:, None] + np.minimum(np.arange(width), length[:, None] - 1)
        mask = np.arange(width) < length[:, None]
        gx, gy = x[grid].astype(np.float64), np.where(mask, y[grid], 0)
        pairs = mask[:, 1:]
        seen = np.array([[(pairs & (gy[:, :-1] == a) & (gy[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
        want = np.einsum("ntf,nt->f", gx, np.where(mask, gy, 0))
        theta, m, v = np.zeros(N_FEATURES + 4), 0.0, 0.0
        for k in range(1, steps + 1):
            move = theta[N_FEATURES:].reshape(2, 2)
            e = np.stack([np.zeros(gy.shape), gx @ theta[:N_FEATURES]], 2)
            e[~mask] = 0
            alpha = np.zeros((width, len(cuts), 2))
            beta = np.zeros_like(alpha)
            alpha[0] = e[:, 0]
            for t in range(1, width):
                step = np.logaddexp(alpha[t - 1][:, 0, None] + move[0], alpha[t - 1][:, 1, None] + move[1]) + e[:, t]
                alpha[t] = np.where(mask[:, t, None], step, alpha[t - 1])
            for t in range(width - 2, -1, -1):
                nxt = beta[t + 1] + e[:, t + 1]
                step = np.logaddexp(move[None, :, 0] + nxt[:, :1], move[None, :, 1] + nxt[:, 1:])
                beta[t] = np.where(mask[:, t + 1, None], step, beta[t + 1])
            z = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
            p1 = np.exp(np.clip(alpha[:, :, 1] + beta[:, :, 1] - z, -700, 0)).T
            pair = np.zeros((2, 2))
            for t in range(1, width):
                q = alpha[t - 1][:, :, None] + move + (e[:, t] + beta[t])[:, None, :] - z[:, None, None]
                pair += np.where(mask[:, t, None, None], np.exp(np.minimum(q, 0)), 0).sum(0)
            n = mask.sum()
            grad = np.concatenate([want - np.einsum("ntf,nt->f", gx, np.where(mask, p1, 0)), (seen - pair).ravel()]) / n - l2 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        return cls(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> LineField:
    """Fit the field.  Features are made where the documents lie; the driver gets the
    features of the sampled documents only."""
    ids = C.sampled_ids(labels, "quality", per_class)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), "_id")

    def features(batches):
        for batch in batches:
            for part, text in C.slices(batch, 1):
                ls = Lines(text)
                bad = part.column(2).to_numpy(zero_copy_only=False) == 0
                y = bad[ls.doc[ls.chain]]
                rows = np.packbits(ls.x[ls.chain].astype(bool), axis=1)
                cut = ls.first_link
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([rows[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                        pa.array([y[a:b].astype(np.uint8).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    ],
                    names=["id", "x", "y"],
                )

    rows = chosen.select("_id", "_text", "_y").mapInArrow(C.task(features), "id long, x binary, y binary").collect()
    rows.sort(key=lambda r: (r["id"], r["x"]))
    rows = [r for r in rows if len(r["y"])]
    if not rows or len({b for r in rows for b in r["y"]}) < 2:
        return LineField()
    width = (N_FEATURES + 7) // 8
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.uint8).reshape(-1, width), axis=1)[:, :N_FEATURES]
    y = np.frombuffer(b"".join(bytes(r["y"]) for r in rows), np.uint8).astype(np.int64)
    first = np.concatenate([[0], np.cumsum([len(r["y"]) for r in rows])])
    return LineField.fit(x, y, first)


def base_failed(n_words, n_repeat):
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def judge(docs: DataFrame, field: LineField, text_col: str = "text", into: str = "_rules", min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """All columns of ``docs`` and the struct ``into`` with the base counts and the verdict."""
    emit, move = field.emit, field.move

    def make():
        own = LineField(emit, move)

        def kernel(text):
            ls = Lines(text)
            label = ls.labels(own)
            content = C.per_doc(np.where(label == 0, ls.words, 0), ls.first_line)
            share = content / np.maximum(ls.n_words, 1)
            failed = base_failed(ls.n_words, ls.n_repeat_words)
            return [
                ls.n_words, ls.word_chars, ls.n_symbols, ls.n_dup_lines, ls.n_repeat_words, failed,
                ~failed & (share >= min_share), share, C.per_doc(label == 0, ls.first_line), np.diff(ls.first_line),
            ]

        return kernel

    return C.annotate(docs, text_col, make, FIELDS, into)


def label_lines(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, n_words, content) of every line with a word, in order."""
    emit, move = field.emit, field.move

    def run(batches):
        own = LineField(emit, move)
        for batch in batches:
            for part, text in C.slices(batch, 1):
                ls = Lines(text)
                label = ls.labels(own)
                number = np.arange(len(ls.doc)) - ls.first_line[ls.doc]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(ls.doc)), pa.array(number), pa.array(ls.words), pa.array(label == 0)],
                    names=["id", "line_no", "n_words", "content"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(C.task(run), f"id {id_type}, line_no long, n_words long, content boolean")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with the columns they came with."""
    C.prepare(spark)
    field = train(docs, C.source_table(spark, sf_dir, "labels"))
    into = C.fresh(docs, "_rules")
    return judge(docs, field, into=into).where(F.col(into)["kept"]).drop(into)


def query(spark, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    docs = C.source_table(spark, sf_dir, "documents")
    field = train(docs, C.source_table(spark, sf_dir, "labels"))
    out = judge(docs.select("doc_id", "text"), field)
    return out.select("doc_id", "_rules.*")
