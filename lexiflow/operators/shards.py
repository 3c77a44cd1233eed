"""Documents in shards where they lie, their terms in buckets, and what crosses between the two.

A task packs its documents into shards of a few tens of MB: a row with the counts of words in
documents and the distinct terms in the order of a 64-bit hash.  A bucket is a range of hashes.
Every shard sends a bucket its distinct terms of that range, packed, and gets one answer per
term back in the same order, so texts are never shuffled, a term crosses once per shard that
holds it, and no term is a row.  Shards and buckets have a bounded size, whatever the corpus;
their number grows with it.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.operators import slices as SL
from lexiflow.session import scratch_path

SHARD_BYTES = 24 << 20  # Arrow bytes of the tokens of a shard
FIT_BYTES = 8 << 20  # of one that is fitted: its matrix is a row that is cached, joined and sent to Python in every pass
BUCKET_TERMS = 1 << 18  # (shard, term) pairs of a bucket
LEAST_TERMS = 1 << 12  # fewer are not cut to fill the task slots

_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))


def rows_of(names: list[str], cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)


def array(blob, kind=np.float64) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), kind)


def squeezed(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes: the high ones are mostly alike."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return x.nbytes.to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(x) else b"")


def restored(blob, kind) -> np.ndarray:
    raw = blob.as_buffer()
    size = int.from_bytes(raw.slice(0, 8).to_pybytes(), "little")
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw.slice(8), size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed(strings: pa.Array) -> tuple[bytes, bytes]:
    """(lengths in bytes, characters) of strings without nulls."""
    strings = strings.cast(pa.string())
    if not len(strings):
        return b"", b""
    off = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return np.diff(off).tobytes(), strings.buffers()[2].slice(int(off[0]), int(off[-1] - off[0])).to_pybytes() if strings.buffers()[2] else b""


def unpacked(lens, chars) -> pa.Array:
    size = array(lens, np.int32)
    off = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(off.tobytes()), chars.as_buffer())


def hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings by their bytes, the same in every process."""
    lens, chars = packed(strings)
    size, b = np.frombuffer(lens, np.int32).astype(np.int64), np.frombuffer(chars, np.uint8)
    first = np.cumsum(size) - size
    place = np.arange(len(b)) - np.repeat(first, size)
    out, some = size.astype(np.uint64), np.flatnonzero(size)
    if len(some):
        out[some] += np.add.reduceat((b.astype(np.uint64) + np.uint64(1)) * _POWERS[place % len(_POWERS)], first[some])
    for shift, by in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9), (32, 1)):
        out = (out ^ out >> np.uint64(shift)) * np.uint64(by)
    return out


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def count_buckets(pairs: int, spark) -> int:
    slots = spark.sparkContext.defaultParallelism
    return max(1, -(-pairs // BUCKET_TERMS), min(2 * slots, -(-pairs // LEAST_TERMS)))


def free(spark) -> None:
    """Shuffle files go when the driver collects the plans that made them: what the finished
    jobs have shuffled would stay on the executors' disks through all later ones."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(spark, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


PACKED = "shard long, docs long, n_terms long, size binary, words binary, counts binary, off binary, gram binary, lens binary, terms binary, freq binary"
_NAMES = [f.split()[0] for f in PACKED.split(", ")]


def pack(df: DataFrame, text: Column, analyzer, keep: list[str], clean: bool = False, most: int = 0) -> tuple[DataFrame, str]:
    """(table, its folder): a row (:data:`PACKED`) per shard, and arrays ``_k0``, ``_k1``, ... of the
    columns ``keep`` of its documents.  ``words`` are numbers of terms, or with character grams of words whose
    terms are ``gram`` between the ends ``off``; ``freq`` is the documents of the shard that hold a term."""
    spark, chars, most = df.sparkSession, analyzer is T.char_wb_ngrams, most or SHARD_BYTES
    # words of a clean text lie between single blanks
    plain = clean and analyzer is T.word_features
    most = max(1, most * 5 // 8) if plain else most  # a blank stands for the four bytes of an offset
    tokens = T.clean_text(text) if clean else text
    tokens = tokens if plain else T.tokens(F.lower(tokens)) if chars else analyzer(tokens)
    src = df.select(tokens.alias("_tokens"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)])
    kinds = "".join(f", _k{i} array<{df.schema[c].dataType.simpleString()}>" for i, c in enumerate(keep))

    def shard(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        x = SL.Terms(pa.array(np.arange(t.num_rows)), _words(t["_tokens"]) if plain else t["_tokens"], chars)
        n = len(x.terms)
        order = np.argsort(hashes(x.terms), kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        word, off, gram = (place[x._word] if n else x._word, b"", np.zeros(0)) if x._off is None else (x._word, x._off.astype(np.int64).tobytes(), place[x._gram])
        size = np.bincount(x._row, minlength=t.num_rows).astype(np.int32)
        lens, terms = packed(x.terms.take(pa.array(order)))
        freq = x.frequency()[order].astype(np.int32)
        blobs = [size.tobytes(), squeezed(word.astype(np.int32)), squeezed(x._count.astype(np.uint32)), off, squeezed(gram.astype(np.int32)), lens, terms, freq.tobytes()]
        lists = [pa.concat_arrays(t[c].chunks) for c in t.column_names[1:]]
        lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), c) for c in lists]
        numbers = [pa.array([v], pa.int64()) for v in (number, t.num_rows, n)]
        return rows_of([*_NAMES, *t.column_names[1:]], [*numbers, *(pa.array([b], pa.binary()) for b in blobs), *lists])

    def run(batches):
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column(0).nbytes
            if size >= most:
                yield shard(held, number)
                held, size, number = [], 0, number + 1
        if held:
            yield shard(held, number)

    path = scratch_path(spark, "shards")
    out = src.mapInArrow(run, PACKED + kinds)
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path), path


def _words(texts: pa.ChunkedArray) -> pa.Array:
    """The words of two characters or more of clean texts (:func:`lexiflow.functions.text.word_features`)."""
    lists = pc.split_pattern(pc.fill_null(pa.concat_arrays(texts.chunks), ""), " ")
    flat, off = lists.values, lists.offsets.to_numpy()
    long = pc.greater_equal(pc.utf8_length(flat), 2)
    ends = np.concatenate([[0], np.cumsum(long.to_numpy(zero_copy_only=False))])[off]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(long))


def sent(shards: DataFrame, buckets: int) -> DataFrame:
    """(bucket, shard, lens, terms, freq): the terms of every shard, by bucket and hash."""

    def run(batches):
        for b in batches:
            for shard, lens, chars, freq in zip(*b.columns, strict=True):
                terms, freq = unpacked(lens, chars), array(freq, np.int32)
                cut = np.searchsorted(bucket_of(hashes(terms), buckets), np.arange(buckets + 1)).tolist()
                some = [i for i in range(buckets) if cut[i] < cut[i + 1]]
                parts = [packed(terms.slice(cut[i], cut[i + 1] - cut[i])) for i in some]
                yield rows_of(
                    ["bucket", "shard", "lens", "terms", "freq"],
                    [pa.array(some, pa.int32()), pa.array([shard.as_py()] * len(some), pa.int64()), *(pa.array([p[i] for p in parts], pa.binary()) for i in (0, 1)), pa.array([freq[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())],
                )

    return shards.select("shard", "lens", "terms", "freq").mapInArrow(run, "bucket int, shard long, lens binary, terms binary, freq binary")


def vocabulary(shards: DataFrame, buckets: int, min_df: int) -> DataFrame:
    """Written by kind: ``terms`` (bucket, n, lens, terms, df), a row per bucket with the terms that
    ``min_df`` documents or more hold; and ``answers`` (bucket, shard, idx, df, shared) to the terms that a shard sent: number in
    the bucket (-1: dropped), document frequency, and whether it is kept and other shards hold it too."""
    names = ["kind", "bucket", "shard", "n", "lens", "terms", "df", "idx", "shared"]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("shard")
        sent = [unpacked(a, b) for a, b in zip(t["lens"], t["terms"], strict=True)]
        d = pa.concat_arrays(sent).dictionary_encode()
        code, n = d.indices.to_numpy(), len(d.dictionary)
        df = np.bincount(code, np.concatenate([array(f, np.int32) for f in t["freq"]]), n).astype(np.int64)
        holders = np.bincount(code, minlength=n)
        kept = df >= min_df
        idx = np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32)
        ends = np.cumsum([0, *map(len, sent)])
        parts = [code[a:e] for a, e in zip(ends[:-1], ends[1:], strict=True)]
        lens, chars = packed(d.dictionary.filter(pa.array(kept)))
        none, k = [None] * len(sent), len(sent)
        cols = [
            pa.array(["terms", *["answers"] * k]), pa.array([t["bucket"][0].as_py()] * (k + 1), pa.int32()), pa.array([None, *t["shard"].to_pylist()], pa.int64()),
            pa.array([int(kept.sum()), *none], pa.int64()), pa.array([lens, *none], pa.binary()), pa.array([chars, *none], pa.binary()),
            pa.array([df[kept].tobytes(), *(df[p].tobytes() for p in parts)], pa.binary()), pa.array([None, *(idx[p].tobytes() for p in parts)], pa.binary()),
            pa.array([None, *(((holders > 1) & kept)[p].tobytes() for p in parts)], pa.binary()),
        ]
        return pa.Table.from_batches([rows_of(names, cols)])

    kinds = "kind string, bucket int, shard long, n long, lens binary, terms binary, df binary, idx binary, shared binary"
    return sent(shards, buckets).groupBy("bucket").applyInArrow(run, kinds)


MATRIX = "shard long, y binary, w binary, size binary, words binary, counts binary, scale binary, grams binary, cols binary, buckets binary, idx binary, df binary, shared binary, n_docs long"


def matrix(shards: DataFrame, answers: DataFrame, labels: list[str], weights: list[float], n_docs: int) -> DataFrame:
    """A row (:data:`MATRIX`) per shard: classes and weights of its documents, counts of words in documents (``size``
    words each), terms of words (``grams`` terms each; none if words are the terms), and of its terms,
    bucket by bucket, the number there, document frequency and whether other shards hold it.  The value of a term in a
    document is its count x idf x ``scale``; dropped terms have none."""
    names = [f.split()[0] for f in MATRIX.split(", ")]

    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("bucket")
        row = {c: t[c][0] for c in t.column_names}
        idx = np.concatenate([np.zeros(0, np.int32), *(array(v, np.int32) for v in known["idx"])])
        df = np.concatenate([np.zeros(0, np.int64), *(array(v, np.int64) for v in known["df"])])
        shared = np.concatenate([np.zeros(0, bool), *(array(v, bool) for v in known["shared"])])
        buckets = np.stack([known["bucket"].to_numpy(), [len(v.as_buffer()) // 4 for v in known["idx"]]]).astype(np.int32)
        idf = idf_of(df, n_docs, idx >= 0)
        y = pc.index_in(row["_k0"].values.cast(pa.string()), value_set=pa.array(labels, pa.string())).to_numpy().astype(np.int32)
        counted = counts_of(row)
        scale = 1 / norms(counted, idf)
        size, words, counts, grams, cols = counted
        grams, cols = (np.zeros(0, np.int64) if grams is None else grams), (np.zeros(0, np.int32) if cols is None else cols)
        blobs = [*(x.tobytes() for x in (y, np.asarray(weights)[y], size)), squeezed(words), squeezed(counts), scale.tobytes(), squeezed(grams), squeezed(cols)]
        blobs += [buckets.tobytes(), squeezed(idx), squeezed(df.astype(np.int32)), np.packbits(shared).tobytes()]
        return pa.Table.from_batches([rows_of(names, [pa.array([row["shard"].as_py()], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs), pa.array([n_docs], pa.int64())])])

    left = shards.select("shard", "size", "words", "counts", "off", "gram", "_k0").groupBy("shard")
    return left.cogroup(answers.select("shard", "bucket", "idx", "df", "shared").groupBy("shard")).applyInArrow(run, MATRIX)


def idf_of(df: np.ndarray, n_docs: int, kept: np.ndarray | bool = True) -> np.ndarray:
    return np.where(kept, np.log((n_docs + 1) / (df + 1)) + 1, 0.0)


def counts_of(row: dict) -> tuple:
    """(size, words, counts, grams, cols) of a packed row; the last two None if words are the terms."""
    size, words, counts = array(row["size"], np.int32).astype(np.int64), restored(row["words"], np.int32), restored(row["counts"], np.uint32)
    off = array(row["off"], np.int64)
    return (size, words, counts, np.diff(off), restored(row["gram"], np.int32)) if len(off) else (size, words, counts, None, None)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; an empty run has none."""
    out, some = np.zeros(len(sizes)), np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def norms(counted: tuple, idf: np.ndarray) -> np.ndarray:
    """Lengths of the documents' rows of counts x idf; one for a row without a term."""
    size, words, counts, grams, cols = counted
    if grams is None:
        v = counts * idf[words]
        square = sums(v * v, size)
    else:
        x = SL.Terms.__new__(SL.Terms)
        x._row, x._word, x._count, x.terms = np.repeat(np.arange(len(size)), size), words, counts.astype(np.int64), idf
        x._off, x._gram, square = np.concatenate([[0], np.cumsum(grams)]), cols, np.zeros(len(size))
        for doc, term, tf in x.pairs():
            v = tf * idf[term]
            square += np.bincount(doc, v * v, len(size))
    return np.sqrt(np.where(square > 0, square, 1.0))


class Shard:
    """A row of :func:`matrix`: products of its documents x terms matrix and its transpose."""

    def __init__(self, row: dict):
        self.y, self.w, self.scale = array(row["y"], np.int32), array(row["w"]), array(row["scale"])
        self.size, self.words, self.counts = array(row["size"], np.int64), restored(row["words"], np.int32), restored(row["counts"], np.uint32)
        self.grams, self.cols = restored(row["grams"], np.int64), restored(row["cols"], np.int32)
        self.idx, buckets = restored(row["idx"], np.int32), array(row["buckets"], np.int32).reshape(2, -1)
        self.bucket, self.idf = np.repeat(*buckets), idf_of(restored(row["df"], np.int32), row["n_docs"].as_py(), self.idx >= 0)
        self.shared = np.unpackbits(array(row["shared"], np.uint8), count=len(self.idx)).astype(bool)
        self.chars = len(self.grams) > 0

    def back(self, e: np.ndarray) -> np.ndarray:
        """(rows of ``e`` x terms): sums over documents."""
        out = np.empty((len(e), len(self.idf)))
        for c, r in enumerate(e):
            v = np.bincount(self.words, np.repeat(r * self.scale, self.size) * self.counts, len(self.grams) if self.chars else len(self.idf))
            out[c] = np.bincount(self.cols, np.repeat(v, self.grams), len(self.idf)) if self.chars else v
        return out * self.idf

    def forth(self, g: np.ndarray) -> np.ndarray:
        """(rows of ``g`` x documents): sums over terms."""
        out = np.empty((len(g), len(self.y)))
        for c, r in enumerate(g * self.idf):
            v = sums(r[self.cols], self.grams) if self.chars else r
            out[c] = sums(v[self.words] * self.counts, self.size) * self.scale
        return out

    def parts(self, which: np.ndarray) -> list[tuple[int, int, int]]:
        """(bucket, first, end) of the buckets that hold the terms ``which``."""
        b = self.bucket[which]
        cut = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)] if len(b) else [0]
        return [(int(b[a]), a, e) for a, e in zip(cut[:-1], cut[1:], strict=True)]


def classify(shards: DataFrame, terms: DataFrame, keep: list, n_classes: int, bias: list[float], labels: list[str], pairs: int) -> DataFrame:
    """The columns ``keep`` (fields) of packed documents and the label of their largest margin, by
    ``terms`` (term, idf, coef).  Margins are those above the last class's; equal ones go to the first label."""
    from pyspark.sql.types import StringType, StructField, StructType

    n = count_buckets(pairs, shards.sparkSession)
    r, last = n_classes - 1, n_classes - 1

    def cut(batches):
        for b in batches:
            at = bucket_of(hashes(b.column(0)), n).astype(np.int32)
            yield rows_of(["bucket", "term", "idf", "coef"], [at, *b.columns])

    def look(t: pa.Table, known: pa.Table) -> pa.Table:
        coef = pa.concat_arrays(known["coef"].chunks).flatten().to_numpy().reshape(-1, n_classes) if known.num_rows else np.zeros((0, n_classes))
        # by term: the factors of the margins, and last the idf; a term that is not known has none
        table = np.vstack([np.column_stack([(coef[:, :last] - coef[:, last:]), known["idf"].to_numpy()]), np.zeros(n_classes)])
        value_set = known["term"].combine_chunks().cast(pa.string())
        out = []
        for lens, chars in zip(t["lens"], t["terms"], strict=True):
            at = pc.fill_null(pc.index_in(unpacked(lens, chars), value_set=value_set), len(table) - 1).to_numpy()
            out.append(np.ascontiguousarray(table[at].T).tobytes())
        return pa.table({"shard": t["shard"], "bucket": t["bucket"], "v": pa.array(out, pa.binary())})

    def answer(t: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("bucket")
        row = {c: t[c][0] for c in t.column_names}
        v = np.concatenate([np.zeros((r + 1, 0)), *(array(x).reshape(r + 1, -1) for x in known["v"])], 1)
        size, words, counts, grams, cols = counted = counts_of(row)
        idf = v[r]
        scale = 1 / norms(counted, idf)
        z = np.zeros((n_classes, len(size)))
        for c in range(r):
            x = v[c] * idf
            x = x if grams is None else sums(x[cols], grams)
            z[c] = sums(x[words] * counts, size) * scale
        z += (np.asarray(bias) - bias[last])[:, None]
        kept = [row[f"_k{i}"].values for i in range(len(keep))]
        return pa.Table.from_batches([rows_of([*(f"_k{i}" for i in range(len(keep))), "predicted"], [*kept, pa.array(labels, pa.string()).take(pa.array(z.argmax(0)))])])

    known = terms.select("term", "idf", "coef").mapInArrow(cut, "bucket int, term string, idf double, coef array<double>")
    asked = sent(shards, n).select("bucket", "shard", "lens", "terms")
    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(look, "shard long, bucket int, v binary")
    fields = StructType([*(StructField(f"_k{i}", f.dataType) for i, f in enumerate(keep)), StructField("predicted", StringType())])
    left = shards.select("shard", "size", "words", "counts", "off", "gram", *[f"_k{i}" for i in range(len(keep))])
    out = left.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(answer, fields)
    return out.toDF(*[f.name for f in keep], "predicted")
