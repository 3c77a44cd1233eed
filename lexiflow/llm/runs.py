"""Periodic runs of words: sparse diagonal dynamic programming.

A *run* is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are
equal) and length at least ``max(MIN_LENGTH, 2 q)`` that neither neighbour extends.  Words
``i`` and ``i - d`` that are equal lie on diagonal ``d``; a run with period ``q`` is a stretch
of matches of at least ``max(MIN_LENGTH - q, q)`` words on diagonal ``q``.

For every word its earlier occurrences raise the match lengths of their lags; a diagonal that
meets no match ends and emits its run if it is long enough.  Counted word by word, a document
of one repeated word has a square of active lags.  So lags are taken by octave, and a lag of
``2^k`` to ``2^(k+1) - 1`` counts in blocks of ``2^(k-1)`` words: any stretch that is long
enough for such a lag holds a whole aligned block, whose earlier occurrences (equal blocks,
named exactly by pairs of half-size names, never by hashes) raise the lag's match length by a
block.  The ends of a diagonal are then extended by halves of a block.  An octave has at most
two pairs per word, whatever the text, and blocks that occur once in a document drop out, so
ordinary text has hardly any.  A lag that is a multiple of the smallest period gives the
same stretch; the smallest lag of a stretch is its period.

All is computed row by row in Arrow batches; nothing is shuffled.

Defined results: a null, empty or white-space text has no words, no runs and an empty
collapsed text; repeated rows, null ids and further columns pass through unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm import common as C

MIN_LENGTH = 12
#: lags below this are one group, counted in blocks of 2 words
FIRST_OCTAVE = 8

RUN = T.StructType([T.StructField(f, T.LongType(), False) for f in ("start", "length", "period")])
FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("runs", T.ArrayType(RUN, False), False),
        T.StructField("collapsed", T.StringType(), False),
    ]
)


class Names:
    """Names of the word blocks of a slice: ``of(s)[i]`` is the name of the ``s`` words from
    ``i`` on, equal for equal blocks of one document, -1 for a block that occurs once in its
    document or leaves it.  ``s`` is a power of two."""

    def __init__(self, code: np.ndarray, first: np.ndarray):
        self.n = len(code)
        self.doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.by_size: dict[int, np.ndarray] = {}
        self.order: dict[int, np.ndarray] = {}
        span = int(code.max()) + 1 if self.n else 1
        self._add(1, np.arange(self.n), self.doc * span + code)

    def _add(self, size: int, at: np.ndarray, key: np.ndarray) -> None:
        name = np.full(self.n, -1, np.int32)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        group = np.cumsum(new) - 1
        again = np.bincount(group, minlength=1)[group] > 1 if len(key) else new
        self.order[size] = at[order[again]]  # by name, then place
        name[self.order[size]] = group[again]
        self.by_size[size] = name

    def of(self, size: int) -> np.ndarray:
        if size not in self.by_size:
            half = size // 2
            name = self.of(half)
            at = np.flatnonzero(name[: self.n - half] >= 0) if self.n > half else np.zeros(0, np.int64)
            at = at[(name[at + half] >= 0) & (self.doc[at + half] == self.doc[at])]
            self._add(size, at, name[at].astype(np.int64) * (self.n + 1) + name[at + half])
        return self.by_size[size]


def diagonals(names: Names, first: np.ndarray, size: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lag, start, end) of all stretches of matches on diagonals ``lo`` to ``hi - 1`` that hold
    an aligned block of ``size`` words, extended to both sides as far as words match."""
    name, n = names.of(size), names.n
    held = names.order[size]
    if not len(held):
        return (np.zeros(0, np.int64),) * 3
    begin, stop = first[:-1], first[1:]
    key = name[held].astype(np.int64) * n + held
    at = np.sort(held)
    at = at[(at - begin[names.doc[at]]) % size == 0]
    base = name[at].astype(np.int64) * n
    left = np.searchsorted(key, base + np.maximum(at - hi + 1, 0), "left")
    right = np.maximum(np.searchsorted(key, base + np.maximum(at - lo, -1), "right"), left)
    right[at < lo] = left[at < lo]
    many = right - left
    total = int(many.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3
    place = np.repeat(at, many)
    earlier = held[np.repeat(left - (np.cumsum(many) - many), many) + np.arange(total)]
    lag = place - earlier
    order = np.lexsort((place, lag))
    lag, place = lag[order], place[order]
    new = np.ones(total, bool)
    new[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + size) | (names.doc[place[1:]] != names.doc[place[:-1]])
    lead = np.flatnonzero(new)
    lag, start, end = lag[lead], place[lead], place[np.append(lead[1:], total) - 1] + size
    doc = names.doc[start]
    low, high = begin[doc], stop[doc]
    step = size // 2
    while step:
        name = names.of(step)
        can = end + step <= high
        i = np.where(can, end, 0)
        end = end + step * (can & (name[i] >= 0) & (name[i] == name[np.where(can, end - lag, 0)]))
        can = start - step - lag >= low
        i = np.where(can, start - step, 0)
        start = start - step * (can & (name[i] >= 0) & (name[i] == name[np.where(can, start - step - lag, 0)]))
        step //= 2
    return lag, start, end


def find_runs(code: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of every run, by document, start, period.

    ``code``: equal integers for equal words; document ``d`` has places ``first[d]`` to
    ``first[d + 1] - 1``.  ``min_length`` is 10 at least, so that short lags hold a block.
    """
    if min_length < FIRST_OCTAVE + 2:
        raise ValueError(f"min_length must be {FIRST_OCTAVE + 2} at least")
    none = (np.zeros(0, np.int64),) * 4
    longest = int(np.diff(first).max()) if len(code) else 0
    if longest < 2:
        return none
    names = Names(code, first)
    found = []
    size, lo, hi = 2, 1, FIRST_OCTAVE
    while 2 * lo <= longest:
        lag, start, end = diagonals(names, first, size, lo, hi)
        enough = end - start >= np.maximum(min_length - lag, lag)
        found.append((start[enough] - lag[enough], end[enough], lag[enough]))
        size, lo, hi = (4 if lo == 1 else 2 * size), hi, 2 * hi
        if not len(names.order[max(names.order)]):
            break  # no block repeats, so no longer one does
    start, end, lag = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(start):
        return none
    order = np.lexsort((lag, end, start))
    start, end, lag = start[order], end[order], lag[order]
    one = np.ones(len(start), bool)
    one[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, lag = start[one], end[one], lag[one]
    order = np.lexsort((lag, start))
    start, end, lag = start[order], end[order], lag[order]
    doc = names.doc[start]
    return doc, start - first[:-1][doc], end - start, lag


def _kernel(min_length: int):
    longs = pa.int64()

    def make():
        def run(text: pa.Array):
            buf, off = C.bounds(text)
            starts, ends, first = C.word_bounds(buf, off)
            words = C.pick(buf, starts, ends)
            code, _ = C.codes(words)
            doc, start, length, period = find_runs(code, first, min_length)
            n_docs = len(text)
            edge = np.zeros(len(code) + 1, np.int64)
            place = first[:-1][doc] + start
            np.add.at(edge, place + period, 1)
            np.add.at(edge, place + length, -1)
            kept = np.cumsum(edge[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(kept)])[first]
            lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(kept)))
            collapsed = pc.binary_join(lists, b" ").cast(pa.string())
            spans = pa.StructArray.from_arrays(
                [pa.array(x, longs) for x in (start, length, period)],
                fields=[pa.field(f.name, longs, False) for f in RUN],
            )
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))])
            kind = pa.list_(pa.field("element", spans.type, False))
            runs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans, type=kind)
            return [np.diff(first), runs, collapsed]

        return run

    return make


def annotate_runs(docs: DataFrame, text_col: str = "text", into: str = "periodic", min_length: int = MIN_LENGTH) -> DataFrame:
    """All columns and a struct ``into`` with ``n_words``, ``runs`` (by start, then period;
    starts are word numbers from 0) and ``collapsed``: the words that no run contains after its
    first period, joined by one space."""
    return C.annotate(docs, text_col, _kernel(min_length), FIELDS, into)


def tail_repeated(text: Column, id_col: Column) -> Column:
    """The texts that the query searches: for a tenth of the documents (crc32 of the id), the
    words from place ``a`` on repeat the ``p`` words that begin there."""
    h = F.crc32(id_col.cast("string").cast("binary"))
    g = F.floor(h / 10)
    w = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    n = F.size(w)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
    made = F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")
    has_words = F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    return F.when((F.coalesce(h, F.lit(1)) % 10 == 0) & has_words, made).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    docs = C.source_table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", tail_repeated(F.col("text"), F.col("doc_id")).alias("text"))
    found = annotate_runs(docs).select("doc_id", "periodic.*")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
        "n_words",
    )
