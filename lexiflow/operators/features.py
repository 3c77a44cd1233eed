"""TF-IDF features in long form ``(id, term, ...)`` and vocabulary encoding.

Weights follow the smoothed definition ``idf = ln((1+n)/(1+df)) + 1`` with raw
counts as tf and an L2 norm per document.

Scale notes: documents are repartitioned by ``id`` before tokens are exploded,
so the per-document count ``groupBy(id, term)`` reuses that partitioning (no
second shuffle of the exploded rows) and the exploded form is never cached.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.operators import slices as SL


def _spread(docs: DataFrame, id_col: str, partitions: int | None) -> DataFrame:
    if partitions is None:
        partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(partitions, id_col)


def term_counts(
    docs: DataFrame,
    analyzer: Callable[[Column], Column] = T.word_features,
    id_col: str = "id",
    text_col: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """(id, term, tf) — one row per distinct term of each document."""
    spread = _spread(docs.select(id_col, text_col), id_col, partitions)
    rows = getattr(analyzer, "rows", None)
    if rows is not None:
        exploded = rows(spread, id_col, text_col)
    else:
        exploded = spread.select(id_col, F.explode(analyzer(F.col(text_col))).alias("term"))
    return exploded.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_df(
    docs: DataFrame, analyzer: Callable[[Column], Column] = T.word_features, min_df: int = 1, id_col: str = "id", text_col: str = "text"
) -> DataFrame:
    """(term, df) straight from the texts: an analyzer that gives a term array is made
    distinct inside the row, so no text is shuffled and only terms are counted."""
    if getattr(analyzer, "rows", None) is not None:
        return gram_df(docs, analyzer, min_df, id_col, text_col)
    terms = docs.select(F.explode(F.array_distinct(analyzer(F.col(text_col)))).alias("term"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.where(F.col("df") >= min_df) if min_df > 1 else df


def document_frequency(counts: DataFrame, min_df: int = 1) -> DataFrame:
    """(term, df): number of documents containing the term, kept when df >= min_df."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.where(F.col("df") >= min_df) if min_df > 1 else df


def with_idf(df: DataFrame, n_docs: int) -> DataFrame:
    return df.withColumn("idf", F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1)


def idf_table(counts: DataFrame, n_docs: int, min_df: int = 1) -> DataFrame:
    return with_idf(document_frequency(counts, min_df), n_docs)


HOT_SHARE = 0.01  # terms in this share of the documents or more are joined by broadcast


def join_idf(counts: DataFrame, idf: DataFrame, n_docs: int, id_col: str = "id", extra: list[str] | None = None) -> DataFrame:
    """``counts`` with the ``df`` and ``idf`` (and ``extra`` columns) of their terms; unseen
    terms are dropped.

    A term that every document holds would put a row per document in one task.  Terms of
    HOT_SHARE of the documents or more are few whatever the corpus (at most 1 / HOT_SHARE
    times the mean number of distinct terms of a document): they are broadcast, and their
    rows are spread by document in the shuffle join that serves the rest.
    """
    least = max(2.0, HOT_SHARE * n_docs)
    cols = ["df", "idf", *(extra or [])]
    hot = idf.where(F.col("df") >= least).select("term", *[F.col(c).alias(f"_h_{c}") for c in cols])
    cold = idf.where(F.col("df") < least).select(F.col("term").alias("_k"), *[F.col(c).alias(f"_c_{c}") for c in cols])
    x = counts.join(F.broadcast(hot), "term", "left")
    spread = F.concat(F.lit("\u0000"), F.xxhash64(id_col).cast("string"))
    x = x.withColumn("_k", F.when(F.col("_h_idf").isNull(), F.col("term")).otherwise(spread))
    x = x.join(cold, "_k", "left")
    x = x.withColumns({c: F.coalesce(f"_h_{c}", f"_c_{c}") for c in cols})
    return x.where(F.col("idf").isNotNull()).drop("_k", *[f"_h_{c}" for c in cols], *[f"_c_{c}" for c in cols])


def tfidf(counts: DataFrame, idf: DataFrame, id_col: str = "id", n_docs: int | None = None) -> DataFrame:
    """(id, term, tf, df, idf, tfidf) normalised to unit L2 norm per document.

    Terms unseen in the IDF table are dropped before normalising (transform
    semantics of a fitted vectoriser).  With ``n_docs``, the number of fitted
    documents, frequent terms are kept out of the shuffle join (:func:`join_idf`).
    """
    joined = counts.join(idf, "term") if n_docs is None else join_idf(counts, idf, n_docs, id_col)
    raw = joined.withColumn("_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return raw.withColumn("tfidf", F.col("_w") / norm).drop("_w")


def term_profile(
    docs: DataFrame, analyzer: Callable[[Column], Column] = T.word_features, id_col: str = "id", text_col: str = "text"
) -> DataFrame:
    """(id, n, n_distinct): terms and distinct terms of every document that has one."""
    n = SL.plan(docs, id_col, text_col)
    if n is None:
        counts = term_counts(docs, analyzer, id_col, text_col)
        return counts.groupBy(id_col).agg(F.sum("tf").cast("long").alias("n"), F.count(F.lit(1)).alias("n_distinct"))
    rows = SL.sliced(docs, n, analyzer, id_col, text_col)
    return SL.profile(rows, analyzer, docs.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)


def gram_df(
    docs: DataFrame, analyzer: Callable[[Column], Column], min_df: int = 1, id_col: str = "id", text_col: str = "text"
) -> DataFrame:
    """(term, df) over documents with distinct ids, counted slice by slice."""
    n = SL.plan(docs, id_col, text_col)
    if n is None:
        return document_frequency(term_counts(docs, analyzer, id_col, text_col), min_df)
    return _summed(SL.slice_terms(SL.sliced(docs, n, analyzer, id_col, text_col), analyzer), min_df)


def _summed(needs: DataFrame, min_df: int) -> DataFrame:
    df = needs.groupBy("term").agg(F.sum("n").alias("df"))
    return df.where(F.col("df") >= min_df) if min_df > 1 else df


def fit_transform_tfidf(
    fit_docs: DataFrame,
    docs: DataFrame | None = None,
    analyzer: Callable[[Column], Column] = T.word_features,
    min_df: int = 1,
    id_col: str = "id",
    text_col: str = "text",
    summary: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Fit the IDF on ``fit_docs``; transform ``docs`` (default: the same docs).

    Returns (idf table, long-form tfidf); with ``summary`` the second is (id, n_features, l1,
    max_w), the sum and maximum of a document's weights, without its rows.  The table of terms
    is written once.  The counts of a document are made in the task that weighs them
    (:mod:`lexiflow.operators.slices`) and never shuffled.
    """
    from lexiflow.session import scratch_path

    spark = fit_docs.sparkSession
    n_docs = fit_docs.select(id_col).count()
    path = scratch_path(spark, "idf")
    target = fit_docs if docs is None else docs
    n = SL.plan(target, id_col, text_col)
    if n is None:
        with_idf(term_df(fit_docs, analyzer, min_df, id_col, text_col), n_docs).write.parquet(path)
        idf = spark.read.parquet(path)
        long_form = tfidf(term_counts(target, analyzer, id_col, text_col), idf, id_col, n_docs)
        if summary:
            sums = [F.count(F.lit(1)).alias("n_features"), F.sum("tfidf").alias("l1"), F.max("tfidf").alias("max_w")]
            long_form = long_form.groupBy(id_col).agg(*sums)
        return idf, long_form
    rows = SL.sliced(target, n, analyzer, id_col, text_col)
    needs_path = scratch_path(spark, "slice-terms")
    SL.slice_terms(rows, analyzer).write.parquet(needs_path)
    needs = spark.read.parquet(needs_path)
    if docs is None and getattr(analyzer, "rows", None) is not None:
        df = _summed(needs, min_df)
    else:
        df = term_df(fit_docs, analyzer, min_df, id_col, text_col)
    with_idf(df, n_docs).write.parquet(path)
    idf = spark.read.parquet(path)
    id_type = target.schema[id_col].dataType.simpleString()
    return idf, SL.weigh(rows, needs, idf, analyzer, id_col, id_type, summary)


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Balanced weights ``n / (k * n_c)`` per class (one row per class)."""
    c = df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    c = c.withColumn("n", F.sum("n_c").over(w)).withColumn("k", F.count(F.lit(1)).over(w))
    return c.select(label_col, "n_c", (F.col("n") / (F.col("k") * F.col("n_c"))).alias("weight"))


def dense_ids(df: DataFrame, order: list[Column], id_name: str = "tid", start: int = 0) -> DataFrame:
    """Dense 0..n-1 ids in a global order without a single-partition window.

    A distributed sort, then per-partition row counts turned into offsets.  The
    sorted rows are written once, with their partition id and in-partition
    position captured as columns, to a table in the shared checkpoint folder:
    this cuts the lineage (a recomputed sort may cut its ranges differently) and,
    unlike an eager ``checkpoint()``, does not compute the sort a second time to
    save it.  Offsets and ids are then read from the stored columns.
    """
    from lexiflow.session import scratch_path

    sorted_ = df.orderBy(*order).withColumn("_pid", F.spark_partition_id()).withColumn(
        "_mono", F.monotonically_increasing_id()
    )
    path = scratch_path(df.sparkSession, "dense-ids")
    sorted_.write.mode("overwrite").parquet(path)
    sorted_ = df.sparkSession.read.parquet(path)
    offsets = sorted_.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    # one row per sorted partition: bounded by the partition count, safe to broadcast
    out = sorted_.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
    rid = F.col("_off") + (F.col("_mono") - F.shiftleft(F.col("_pid").cast("long"), 33)) + F.lit(start)
    return out.withColumn(id_name, rid).drop("_pid", "_mono", "_off")


def build_vocabulary(docs: DataFrame, id_col: str = "id", text_col: str = "text", start: int = 1) -> DataFrame:
    """(term, cnt, tid) over whitespace tokens; ids by (count desc, term); id 0 = padding.
    Tokens are counted where their texts lie; only partial counts are shuffled."""
    counts = docs.select(F.explode(T.tokens(F.col(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("cnt"))
    return dense_ids(counts, [F.desc("cnt"), F.asc("term")], "tid", start)


VOCAB_BROADCAST_BYTES = 64 << 20


def vocabulary_bytes(vocab: DataFrame) -> int:
    """Measured in-memory size of a (term, tid) table (one pass over the vocabulary,
    which is far smaller than the token stream it encodes)."""
    st = vocab.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("term")).alias("chars")).first()
    return int(st["n"] or 0) * 48 + int(st["chars"] or 0) * 2


def encode(
    docs: DataFrame,
    vocab: DataFrame,
    id_col: str = "id",
    text_col: str = "text",
    max_broadcast_bytes: int = VOCAB_BROADCAST_BYTES,
) -> DataFrame:
    """(id, ids array<long>) in token order; unknown tokens are dropped, a null text has none.

    A vocabulary under ``max_broadcast_bytes`` (measured, not estimated) is broadcast and
    every row is encoded where it lies (Arrow hash lookup of its tokens): no token or text
    is shuffled.  A larger vocabulary is joined to the distinct tokens of slices of the rows
    (:mod:`lexiflow.operators.slices`), so that a frequent token crosses once per slice.
    """
    from lexiflow.session import scratch_path

    v = vocab.select("term", "tid")
    if vocabulary_bytes(v) <= max_broadcast_bytes:
        return _encode_rows(docs, v, id_col, text_col)
    path = scratch_path(docs.sparkSession, "encode-rows")
    n = SL.count_slices(docs.agg(F.sum(F.length(text_col))).first()[0], docs)
    at = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    rows = docs.select(at.alias("_slice"), F.col(id_col).alias("_id"), T.tokens(F.col(text_col)).alias("_tokens"))
    rows.write.parquet(path)  # so that a row stays in its slice
    rows = docs.sparkSession.read.parquet(path)
    return SL.translate(rows, v, id_col, docs.schema[id_col].dataType.simpleString())


def _encode_rows(docs: DataFrame, vocab: DataFrame, id_col: str, text_col: str) -> DataFrame:
    import pyarrow as pa
    import pyarrow.compute as pc

    table = vocab.toArrow()
    terms = table["term"].combine_chunks()
    shared = docs.sparkSession.sparkContext.broadcast((terms, table["tid"].to_numpy()))
    rows = docs.select(F.col(id_col), T.tokens(F.col(text_col)).alias("_t"))

    def run(batches):
        import numpy as np

        terms, tids = shared.value
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = pc.index_in(pc.list_flatten(lists), value_set=terms)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            ids = tids[pc.drop_null(at).to_numpy()]
            ends = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(sizes)])]
            out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=[id_col, "ids"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, ids array<long>")


TRIGRAM_SLICE = 1 << 20  # characters that a task hashes at a time
TRIGRAM_MEMO = 1 << 20  # grams whose bucket a task remembers


class TrigramBuckets:
    """Buckets of character trigrams by md5; a gram is hashed once per task."""

    def __init__(self, dim: int):
        self.dim, self.memo = dim, {}

    def _bucket(self, code: int) -> int:
        import hashlib

        gram = chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF)
        return int(hashlib.md5(gram.encode()).hexdigest()[:4], 16) % self.dim

    def __call__(self, texts: list[str]):
        """(texts x dim) counts."""
        import numpy as np

        size = np.fromiter(map(len, texts), np.int64, len(texts))
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.flatnonzero(np.arange(len(cp)) + 3 <= np.repeat(np.cumsum(size), size))
        row = np.repeat(np.arange(len(texts)), size)[at]
        grams, code = np.unique(cp[at] << 42 | cp[at + 1] << 21 | cp[at + 2] if len(at) else at, return_inverse=True)
        memo = self.memo
        if len(memo) > TRIGRAM_MEMO:
            memo.clear()
        bucket = np.zeros(len(grams), np.int64)
        for i, g in enumerate(grams.tolist()):
            b = memo.get(g)
            if b is None:
                b = memo[g] = self._bucket(g)
            bucket[i] = b
        return np.bincount(row * self.dim + bucket[code], minlength=len(texts) * self.dim).reshape(len(texts), self.dim).astype(np.float64)


def hashed_trigrams(df: DataFrame, dim: int = 64, text_col: str = "text") -> DataFrame:
    """All columns but the text, and ``vec``: counts of the character trigrams of the
    lower-cased, blank-padded text in ``dim`` buckets by md5; a null text has a zero vector.

    Rows are encoded where they lie; no gram is a row and nothing is shuffled.
    """
    import numpy as np
    import pyarrow as pa

    rest = [c for c in df.columns if c != text_col]
    text = F.concat(F.lit(" "), F.lower(F.col(text_col)), F.lit(" "))
    src = df.select(*rest, F.coalesce(text, F.lit("")).alias("_s"))
    most = TRIGRAM_SLICE

    def run(batches):
        kernel = TrigramBuckets(dim)
        for batch in batches:
            texts = batch.column(len(rest)).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            a = 0
            while a < len(texts):
                done = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, done + most, "right")))
                vec = kernel(texts[a:b])
                out = pa.ListArray.from_arrays(np.arange(0, (b - a + 1) * dim, dim, dtype=np.int32), pa.array(vec.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(rest))), out], names=[*rest, "vec"])
                a = b

    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest]
    return src.mapInArrow(run, ", ".join([*fields, "vec array<double>"]))
