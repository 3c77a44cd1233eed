"""Terms counted where the texts lie, a slice of the documents at a time.

Rows ``(document, term, count)`` are many times the texts they come from (three character
n-grams per character), so they are never shuffled.  Documents are hashed into slices of a few
MB.  A slice sends each distinct term once, however many of its documents hold it; the table of
terms (document frequencies, weights, ids) is joined to these, and the answers meet the slice's
documents again in a cogroup, where the per-document rows are made.  What is shuffled is the
texts and the distinct terms of every slice; a task holds one slice.

Documents with one id count as one document.  An id whose repeated rows outgrow a slice has no
bounded group: :func:`plan` then gives None, and callers group by Spark rows instead.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import text as T

SLICE_BYTES = 4 << 20  # characters of the texts of a slice
LEAST_BYTES = 1 << 19  # smaller slices are not cut to fill the task slots
PAIRS = 1 << 21  # (document, term) rows that a task expands at a time
_LOW = 20  # bits of a count packed beside its key


def slots(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def plan(docs: DataFrame, id_col: str, text_col: str) -> int | None:
    """Number of slices; None if the rows of one repeated id are more than a slice."""
    sizes = docs.groupBy(F.col(id_col)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text_col)).alias("b"))
    r = sizes.agg(F.sum("b").alias("b"), F.max(F.when(F.col("n") > 1, F.col("b"))).alias("most")).first()
    if (r["most"] or 0) > SLICE_BYTES:
        return None
    return count_slices(r["b"], docs)


def count_slices(size: int | None, docs: DataFrame) -> int:
    """Slices for texts of ``size`` characters in all."""
    total = int(size or 0)
    return max(1, -(-total // SLICE_BYTES), min(4 * slots(docs), -(-total // LEAST_BYTES)))


def sliced(docs: DataFrame, n: int, analyzer: Callable[[Column], Column], id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(_slice, id, tokens, *keep); ``tokens`` are words where the analyzer cuts these into grams."""
    chars = analyzer is T.char_wb_ngrams
    tokens = T.tokens(F.lower(F.col(text_col))) if chars else analyzer(F.col(text_col))
    at = F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("_slice")
    return docs.select(at, F.col(id_col).alias("_id"), tokens.alias("_tokens"), *keep)


def _flat(col) -> tuple[pa.Array, np.ndarray]:
    """(values, sizes) of a column of string lists."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(col), sizes


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    d = values.dictionary_encode(null_encoding="encode")
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _word_grams(words: list[str], n_min: int = 3, n_max: int = 5) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(offsets, gram numbers, distinct grams): the grams of each blank-padded word, repeats kept."""
    text = "".join(f" {w} " for w in words)
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(size)
    end = np.repeat(ends, size)
    owner = np.repeat(np.arange(len(words)), size)
    at = np.flatnonzero(np.arange(len(cp)) + n_min <= end)
    code = cp[at]
    for i in range(1, n_min - 1):
        code = np.unique(code << 21 | cp[at + i], return_inverse=True)[1]
    owners, numbers, grams = [], [], []
    for n in range(n_min, n_max + 1):
        if n > n_min:
            longer = at + n <= end[at]
            at, code = at[longer], code[longer]
        # a code names the first n - 1 characters: 21 bits more name the gram
        _, first, code = np.unique(code << 21 | cp[at + n - 1], return_index=True, return_inverse=True)
        owners.append(owner[at])
        numbers.append(code + len(grams))
        grams.extend(text[a : a + n] for a in at[first].tolist())
    who, what = np.concatenate(owners), np.concatenate(numbers)
    order = np.argsort(who, kind="stable")
    off = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(words)))])
    return off, what[order], grams


class Terms:
    """The documents of a slice: ``ids`` of the documents, ``terms`` (distinct), and their pairs."""

    def __init__(self, ids, tokens, chars: bool):
        flat, sizes = _flat(tokens)
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        group, self.ids = _codes(ids)
        code, words = _codes(flat)
        self._words = max(1, len(words))
        key, self._count = np.unique(np.repeat(group, sizes) * self._words + code, return_counts=True)
        self._row, self._word = key // self._words, key % self._words
        self._off = None
        if chars and len(words):
            self._off, self._gram, grams = _word_grams(words.to_pylist())
            words = pa.array(grams, pa.string())
        self.terms = words

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document number, term number, count) ordered by both; whole documents at a time."""
        if not len(self._row):
            return
        size = np.ones(len(self._row), np.int64) if self._off is None else np.diff(self._off)[self._word]
        total = np.cumsum(size)
        last = np.append(np.flatnonzero(np.diff(self._row)), len(self._row) - 1)  # last word of each document
        a, done = 0, 0
        while a < len(self._row):
            i = max(int(np.searchsorted(last, a)), int(np.searchsorted(total[last], done + PAIRS, "right")) - 1)
            b = int(last[i]) + 1
            yield self._block(a, b, size[a:b])
            a, done = b, int(total[b - 1])

    def _block(self, a: int, b: int, size: np.ndarray):
        row, word, n = self._row[a:b], self._word[a:b], self._count[a:b]
        if self._off is None:
            return row, word, n
        start = np.cumsum(size) - size
        place = np.repeat(self._off[word] - start, size) + np.arange(int(size.sum()))
        wide = len(self.terms)
        key, n = np.repeat(row - row[0], size) * wide + self._gram[place], np.repeat(n, size)
        if int(n.max()) < 1 << _LOW and int(row[-1] - row[0] + 1) * wide < 1 << 62 - _LOW:
            packed = np.sort(key << _LOW | n)
            key, n = packed >> _LOW, packed & (1 << _LOW) - 1
        else:
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key = key[first]
        return row[0] + key // wide, key % wide, np.add.reduceat(n, first)

    def frequency(self) -> np.ndarray:
        """Documents of the slice that hold each term."""
        out = np.zeros(len(self.terms), np.int64)
        for _, term, _ in self.pairs():
            out += np.bincount(term, minlength=len(out))
        return out


def _table(schema_names: list[str], parts: list[list]) -> pa.Table:
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in p], names=schema_names) for p in parts])


def slice_terms(rows: DataFrame, analyzer: Callable[[Column], Column]) -> DataFrame:
    """(_slice, term, n): the distinct terms of every slice, and its documents that hold each."""
    chars = analyzer is T.char_wb_ngrams

    def run(t: pa.Table) -> pa.Table:
        x = Terms(t["_id"], t["_tokens"], chars)
        n = x.frequency()
        at = pa.array(np.full(len(n), t["_slice"][0].as_py(), np.int32))
        return _table(["_slice", "term", "n"], [[at, x.terms.cast(pa.string()), n]])

    return rows.select("_slice", "_id", "_tokens").groupBy("_slice").applyInArrow(run, "_slice int, term string, n long")


def profile(rows: DataFrame, analyzer: Callable[[Column], Column], id_type: str) -> DataFrame:
    """(id, n, n_distinct): terms of every document that has one, and its distinct terms."""
    chars = analyzer is T.char_wb_ngrams

    def run(t: pa.Table) -> pa.Table:
        x = Terms(t["_id"], t["_tokens"], chars)
        n, distinct = np.zeros(len(x.ids), np.int64), np.zeros(len(x.ids), np.int64)
        for row, _, tf in x.pairs():
            n += np.bincount(row, tf, len(n)).astype(np.int64)
            distinct += np.bincount(row, minlength=len(n))
        some = np.flatnonzero(n)
        return _table(["id", "n", "n_distinct"], [[x.ids.take(pa.array(some)), n[some], distinct[some]]])

    return rows.select("_slice", "_id", "_tokens").groupBy("_slice").applyInArrow(run, f"id {id_type}, n long, n_distinct long")


def weigh(rows: DataFrame, needs: DataFrame, idf: DataFrame, analyzer: Callable[[Column], Column], id_col: str, id_type: str, summary: bool = False) -> DataFrame:
    """TF-IDF of unit length over the terms of ``idf`` (term, df, idf): (id, term, tf, df, idf,
    tfidf), or with ``summary`` one row (id, n_features, l1, max_w) per document."""
    chars = analyzer is T.char_wb_ngrams
    answers = needs.select("_slice", "term").join(idf.select("term", "df", "idf"), "term")
    names = ["id", "n_features", "l1", "max_w"] if summary else ["id", "term", "tf", "df", "idf", "tfidf"]
    kinds = ["long", "double", "double"] if summary else ["string", "long", "long", "double", "double"]
    schema = ", ".join(f"{a} {b}" for a, b in zip(names, [id_type, *kinds], strict=True))

    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        x = Terms(t["_id"], t["_tokens"], chars)
        at = pc.index_in(x.terms.cast(pa.string()), value_set=known["term"].combine_chunks().cast(pa.string()))
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
        df, idf = known["df"].to_numpy(), known["idf"].to_numpy()
        empty = [pa.array([], x.ids.type), *(pa.array([], {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[k]) for k in kinds)]
        parts = [empty]
        for row, term, tf in x.pairs():
            has = at[term] >= 0
            row, term, tf = row[has], term[has], tf[has]
            if not len(row):
                continue
            first = np.flatnonzero(np.diff(row, prepend=-1))
            size = np.diff(np.append(first, len(row)))
            w = tf * idf[at[term]]
            v = w / np.repeat(np.sqrt(np.add.reduceat(w * w, first)), size)
            if summary:
                parts.append([x.ids.take(pa.array(row[first])), size, np.add.reduceat(v, first), np.maximum.reduceat(v, first)])
            else:
                words = x.terms.take(pa.array(term)).cast(pa.string())
                parts.append([x.ids.take(pa.array(row)), words, tf, df[at[term]], idf[at[term]], v])
        return _table(names, parts)

    left = rows.select("_slice", "_id", "_tokens").groupBy("_slice")
    out = left.cogroup(answers.select("_slice", "term", "df", "idf").groupBy("_slice")).applyInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def translate(rows: DataFrame, vocab: DataFrame, id_col: str, id_type: str) -> DataFrame:
    """(id, ids): the tokens of every row of ``rows`` (_slice, _id, _tokens) in their order as the
    ``tid`` of ``vocab`` (term, tid); unknown tokens are dropped."""
    needs = rows.groupBy("_slice").applyInArrow(_distinct, "_slice int, term string")

    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        flat, sizes = _flat(t["_tokens"])
        code, words = _codes(flat)
        at = pc.index_in(words.cast(pa.string()), value_set=known["term"].combine_chunks().cast(pa.string()))
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)[code]
        ends = np.concatenate([[0], np.cumsum(at >= 0)])[np.concatenate([[0], np.cumsum(sizes)])]
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(known["tid"].to_numpy()[at[at >= 0]], pa.int64()))
        return _table(["id", "ids"], [[pa.concat_arrays(t["_id"].chunks), ids]])

    answers = needs.join(vocab.select("term", "tid"), "term").select("_slice", "term", "tid")
    out = rows.groupBy("_slice").cogroup(answers.groupBy("_slice")).applyInArrow(run, f"id {id_type}, ids array<long>")
    return out.withColumnRenamed("id", id_col)


def _distinct(t: pa.Table) -> pa.Table:
    words = _codes(_flat(t["_tokens"])[0])[1]
    return _table(["_slice", "term"], [[pa.array(np.full(len(words), t["_slice"][0].as_py(), np.int32)), words.cast(pa.string())]])


PACKED = "_slice int, part int, y binary, w binary, size binary, cols binary, vals binary, scale binary"
_COUNTS = (np.uint8, np.uint16, np.uint32)


def packed_row(at: int, part: int, y, w, size, cols, vals, scale) -> list:
    """Documents of a matrix as one row: labels, weights, number of terms, columns (32 bit), values
    and a factor per document.  Counts are kept in as few bytes as hold them; the first byte of
    ``vals`` tells the kind (3: doubles)."""
    parts = [np.asarray(y, np.int32), np.asarray(w, np.float64), np.asarray(size, np.int64), np.asarray(cols, np.int32)]
    blobs = [*(x.tobytes() for x in parts), _small(np.asarray(vals)), np.asarray(scale, np.float64).tobytes()]
    return [pa.array([at], pa.int32()), pa.array([part], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)]


def _small(vals: np.ndarray) -> bytes:
    kind = 3
    if vals.dtype.kind in "iu":
        top = int(vals.max()) if len(vals) else 0
        kind = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2
        vals = vals.astype(_COUNTS[kind])
    return bytes([kind]) + vals.tobytes()


def _read(x, kind) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


def _read_small(x) -> np.ndarray:
    raw = x.as_buffer()
    return np.frombuffer(raw, np.float64 if raw[0] == 3 else _COUNTS[raw[0]], offset=1)


def unpacked(y, w, size, cols, vals, scale) -> tuple[np.ndarray, ...]:
    return _read(y, np.int32), _read(w, np.float64), _read(size, np.int64), _read(cols, np.int32), _read_small(vals), _read(scale, np.float64)


FACTORED = "_slice int, y binary, w binary, size binary, words binary, counts binary, scale binary, grams binary, cols binary"


def factors(y, w, size, words, counts, scale, grams, cols) -> tuple[np.ndarray, ...]:
    """The arrays of a row of :func:`factored`."""
    docs = _read(y, np.int32), _read(w, np.float64), _read(size, np.int64), _read(words, np.int32), _read_small(counts), _read(scale, np.float64)
    return *docs, _read(grams, np.int64), _read(cols, np.int32)


def factored(rows: DataFrame, needs: DataFrame, vocab: DataFrame, analyzer: Callable[[Column], Column]) -> DataFrame:
    """The matrix of :func:`matrix` as a product, a row (:data:`FACTORED`) per slice: documents x
    their distinct words (``size`` words a document, ``counts``) and words x their terms (``grams``
    terms a word, columns with repeats).  A word has its grams once, however many documents hold
    it.  The value of a term is its count over the words x idf x ``scale`` of the document."""
    chars = analyzer is T.char_wb_ngrams
    answers = needs.select("_slice", "term").join(vocab.select("term", "tid", "idf"), "term").select("_slice", "term", "tid", "idf")

    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        t = t.sort_by("_id")
        x = Terms(t["_id"], t["_tokens"], chars)
        at = pc.index_in(x.terms.cast(pa.string()), value_set=known["term"].combine_chunks().cast(pa.string()))
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
        tid, idf = known["tid"].to_numpy(), known["idf"].to_numpy()
        n = len(x.ids)
        square = np.zeros(n)
        for row, term, tf in x.pairs():
            has = at[term] >= 0
            v = tf[has] * idf[at[term[has]]]
            square += np.bincount(row[has], v * v, n)
        grams, off = (at, np.arange(len(at) + 1)) if x._off is None else (at[x._gram], x._off)
        ends = np.concatenate([[0], np.cumsum(grams >= 0)])[off]
        parts = [
            t["y"].to_numpy().astype(np.int32), t["w"].to_numpy().astype(np.float64), np.bincount(x._row, minlength=n).astype(np.int64), x._word.astype(np.int32),
            x._count, 1 / np.sqrt(np.where(square > 0, square, 1.0)), np.diff(ends).astype(np.int64), tid[grams[grams >= 0]].astype(np.int32),
        ]
        blobs = [_small(p) if i == 4 else p.tobytes() for i, p in enumerate(parts)]
        at_slice = pa.array([t["_slice"][0].as_py()] if n else [], pa.int32())
        return _table([f.split()[0] for f in FACTORED.split(", ")], [[at_slice, *(pa.array([b] if n else [], pa.binary()) for b in blobs)]])

    left = rows.select("_slice", "_id", "_tokens", "y", "w").groupBy("_slice")
    return left.cogroup(answers.groupBy("_slice")).applyInArrow(run, FACTORED)


def matrix(rows: DataFrame, needs: DataFrame, vocab: DataFrame, analyzer: Callable[[Column], Column], packed: bool) -> DataFrame:
    """Unit length TF-IDF of documents with distinct ids, from ``rows`` (_slice, _id, _tokens, y, w)
    and ``vocab`` (term, tid, idf).  ``packed``: rows as :data:`PACKED`, values are counts and the
    factor one over the norm, so the value of a term is count x idf x factor; else (id, y, w, cols,
    vals), a row per document."""
    chars = analyzer is T.char_wb_ngrams
    answers = needs.select("_slice", "term").join(vocab.select("term", "tid", "idf"), "term").select("_slice", "term", "tid", "idf")
    names = [f.split()[0] for f in PACKED.split(", ")] if packed else ["id", "y", "w", "cols", "vals"]

    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        t = t.sort_by("_id")
        x = Terms(t["_id"], t["_tokens"], chars)
        at = pc.index_in(x.terms.cast(pa.string()), value_set=known["term"].combine_chunks().cast(pa.string()))
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
        tid, idf = known["tid"].to_numpy(), known["idf"].to_numpy()
        y, w, slice_ = t["y"].to_numpy(), t["w"].to_numpy(), t["_slice"][0].as_py() if t.num_rows else 0
        parts, bare = [], np.ones(len(y), bool)

        def add(doc, size, cols, tf, v, scale):
            if packed:
                parts.append(packed_row(slice_, len(parts), y[doc], w[doc], size, cols, tf, scale))
                return
            off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(off, pa.array(c)) for c in (cols.astype(np.int64), v * np.repeat(scale, size))]
            parts.append([x.ids.take(pa.array(doc)).cast(pa.int64()), pa.array(y[doc], pa.int32()), pa.array(w[doc], pa.float64()), *lists])

        for row, term, tf in x.pairs():
            place = at[term]
            row, place, tf = row[place >= 0], place[place >= 0], tf[place >= 0]
            if not len(row):
                continue
            order = np.lexsort((tid[place], row))
            row, place, tf = row[order], place[order], tf[order]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            v = tf * idf[place]
            doc = row[first]
            bare[doc] = False
            add(doc, np.diff(np.append(first, len(row))), tid[place], tf, v, 1 / np.sqrt(np.add.reduceat(v * v, first)))
        rest = np.flatnonzero(bare)
        if len(rest):
            none = np.zeros(0, np.int64)
            add(rest, np.zeros(len(rest), np.int64), none, none, np.zeros(0), np.ones(len(rest)))
        return _table(names, parts)

    left = rows.select("_slice", "_id", "_tokens", "y", "w").groupBy("_slice")
    schema = PACKED if packed else "id long, y int, w double, cols array<long>, vals array<double>"
    return left.cogroup(answers.groupBy("_slice")).applyInArrow(run, schema)
