"""Variant classifier: TF-IDF features + multinomial logistic regression.

Feature weights follow ``tf * (ln((1+n)/(1+df)) + 1)`` with an L2 norm.  The vocabulary
holds every term with ``df >= min_df``, ordered by term; nothing is dropped beyond that.

The training rows are kept for the fit as counts of words in documents and of terms in words
(:mod:`lexiflow.operators.shards`): a term's weight is added up once per distinct word of a
shard, not once per document that holds the word.  The objective is the mean weighted log loss plus
``1 / (2 n) * |W|^2`` with a free intercept (an L2 penalty with C = 1), minimised
in the space of the features themselves.  (Spark ML's own solver rescales features to
unit deviation, which conditions rare terms so badly that it stops far from the optimum.)

Up to ``MAX_COEFFICIENTS`` (two classes mirror each other and have one row) the solver is L-BFGS and every evaluation one Spark pass in which each partition sums
its gradient; the partial gradients are added on Spark, block by block in a tree of fixed
order, so that the driver gets one gradient only, and the result is a Spark ML pipeline
model.  Beyond, nothing of the size of the vocabulary is on the driver
(:mod:`lexiflow.operators.subspace`, or :mod:`lexiflow.operators.blocked` for many classes), and
the result is a :class:`BlockModel`: a table of terms with their coefficients, met by the distinct
terms of the shards to predict.  Balanced training weighs rows by ``n / (k * n_c)``.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext, keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, IndexToString, Normalizer
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.operators import blocked as BL
from lexiflow.operators import features as FE
from lexiflow.operators import shards as SH
from lexiflow.operators import slices as SL
from lexiflow.operators import subspace as SS
from lexiflow.session import scratch_path

# coefficients of a fit on the driver, which holds some 25 vectors of them, and their terms; beyond,
# they stay in blocks
MAX_COEFFICIENTS = 1 << 20
PARTITION_VALUES = 1 << 21  # stored feature values of a training partition
BLOCK = 1 << 14  # coefficients of a block of a gradient
FAN = 32  # partial blocks that one task adds
TOLERANCE = 1e-5


NotConverged = BL.NotConverged


class TextTokens(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Column tokenizer stage: ``word`` (runs of >= 2 word chars), ``char_wb``
    (3-5 word-bounded char grams), optionally cleaning the text first."""

    analyzer = Param(Params._dummy(), "analyzer", "word or char_wb", typeConverter=TypeConverters.toString)
    clean = Param(Params._dummy(), "clean", "apply clean_text before tokenising", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCol="text", outputCol="tokens", analyzer="word", clean=False):
        super().__init__()
        self._setDefault(analyzer="word", clean=False)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        c = F.col(self.getInputCol())
        if self.getOrDefault(self.clean):
            c = T.clean_text(c)
        fn = T.char_wb_ngrams if self.getOrDefault(self.analyzer) == "char_wb" else T.word_features
        return df.withColumn(self.getOutputCol(), fn(c))


def fit_variant_classifier(
    train: DataFrame,
    text_col: str = "text",
    label_col: str = "label",
    analyzer: str = "word",
    min_df: int = 1,
    max_iter: int = 500,
    balanced: bool = False,
    clean: bool = False,
    tol: float = TOLERANCE,
) -> PipelineModel | BlockModel:
    """Fit on ``train`` only; returns a model adding ``predicted`` (label string).

    ``tol`` bounds the largest component of the gradient at the end; a fit that stops at
    ``max_iter`` above it warns with :class:`NotConverged`.
    """
    spark = train.sparkSession
    tok = TextTokens(inputCol=text_col, outputCol="_tokens", analyzer=analyzer, clean=clean)
    path = scratch_path(spark, "classifier")
    rows = train.where(F.col(label_col).isNotNull())
    rows = rows.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    packed, packed_path = SH.pack(rows, F.col("text"), _analyzer(analyzer), ["label"], clean, SH.FIT_BYTES)
    sizes = {r["label"]: r["n"] for r in packed.select(F.explode("_k0").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(sizes)
    if len(labels) < 2:
        raise ValueError("need at least two classes to train a classifier")
    n = sum(sizes.values())
    weight = {c: n / (len(labels) * sizes[c]) if balanced else 1.0 for c in labels}
    held = packed.agg(F.sum("n_terms").alias("pairs"), F.count(F.lit(1)).alias("shards")).first()
    words = SH.vocabulary(packed, SH.count_buckets(held["pairs"], spark), min_df)
    words.write.partitionBy("kind").parquet(f"{path}/words")
    words = spark.read.schema(words.schema).parquet(f"{path}/words")
    vocab = words.where(F.col("kind") == "terms")
    n_terms = int(vocab.agg(F.sum("n")).first()[0] or 0)
    large = n_terms * (1 if len(labels) == 2 else len(labels)) > MAX_COEFFICIENTS
    if large and len(labels) > SS.CLASSES:
        return _fit_blocks(spark, rows.withColumn("text", T.clean_text("text")) if clean else rows, sizes, weight, analyzer, min_df, max_iter, tol, clean, text_col)
    matrix = SH.matrix(packed, words.where(F.col("kind") == "answers"), labels, [float(weight[c]) for c in labels], n)
    matrix.write.parquet(f"{path}/shards")
    SH.drop(spark, packed_path)
    SH.free(spark)
    shards = spark.read.schema(matrix.schema).parquet(f"{path}/shards")
    total = float(sum(sizes[c] * weight[c] for c in labels))
    if large:
        bias = SS.minimise(shards, vocab, len(labels), n, total, max_iter, tol, f"{path}/terms")
        SH.drop(spark, f"{path}/shards")
        return BlockModel(spark.read.parquet(f"{path}/terms"), labels, bias, n, analyzer, clean, text_col)
    terms, idf, data = _on_driver(vocab, shards, n)
    # a fixed layout, so that a repeated fit gives the same numbers; every partition sends a gradient
    data = data.repartitionByRange(max(1, min(int(held["shards"]), 2 * spark.sparkContext.defaultParallelism)), "_slice").sortWithinPartitions("_slice").persist()
    try:
        coef, bias = _minimise(data, n, n_terms, len(labels), max_iter, tol, idf)
    finally:
        data.unpersist()
    stages = [
        tok,
        CountVectorizerModel.from_vocabulary(terms or ["\u0000"], inputCol="_tokens", outputCol="_tf"),
        ElementwiseProduct(scalingVec=Vectors.dense(idf if len(idf) else [0.0]), inputCol="_tf", outputCol="_tfidf"),
        Normalizer(p=2.0, inputCol="_tfidf", outputCol="_features"),
        _lr_model(spark, coef if n_terms else np.zeros((len(labels), 1)), bias),
        IndexToString(inputCol="_pred", outputCol="predicted", labels=labels),
    ]
    return PipelineModel(stages=stages)


def _on_driver(vocab: DataFrame, shards: DataFrame, n_docs: int) -> tuple[list[str], np.ndarray, DataFrame]:
    """(terms in their order, their idf, the shards as :data:`lexiflow.operators.slices.FACTORED` rows with
    the terms' places in that order)."""
    table = vocab.orderBy("bucket").select("bucket", "lens", "terms", "df").toArrow()
    some = [SH.unpacked(a, b) for a, b in zip(table["lens"], table["terms"], strict=True)]
    flat = pa.concat_arrays([pa.array([], pa.string()), *some])
    df = np.concatenate([np.zeros(0, np.int64), *(SH.array(x, np.int64) for x in table["df"])])
    order = np.argsort(pa.compute.rank(flat, tiebreaker="first").to_numpy()) if len(flat) else np.zeros(0, np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = np.zeros(max(table["bucket"].to_pylist(), default=0) + 1, np.int64)
    first[table["bucket"].to_numpy()] = np.cumsum([0, *map(len, some)])[:-1] if some else []
    shared = shards.sparkSession.sparkContext.broadcast((place, first))
    names = [f.split()[0] for f in SL.FACTORED.split(", ")]

    def run(batches):
        place, first = shared.value
        for b in batches:
            for values in zip(*b.columns, strict=True):
                row = dict(zip(b.schema.names, values, strict=True))
                x = SH.Shard(row)
                tid = np.where(x.idx >= 0, place[np.where(x.idx >= 0, first[x.bucket] + x.idx, 0)] if len(place) else 0, -1)
                # the terms of a word, without those that were dropped
                cols, grams = (tid[x.cols], x.grams) if x.chars else (tid, np.ones(len(tid), np.int64))
                ends = np.concatenate([[0], np.cumsum(cols >= 0)])[np.concatenate([[0], np.cumsum(grams)])]
                kept = [*(row[c].as_py() for c in ("y", "w", "size")), x.words.tobytes(), SL._small(x.counts), row["scale"].as_py()]
                blobs = [*kept, np.diff(ends).astype(np.int64).tobytes(), cols[cols >= 0].astype(np.int32).tobytes()]
                yield SH.rows_of(names, [pa.array([row["number"].as_py()], pa.int32()), *(pa.array([v], pa.binary()) for v in blobs)])

    numbers = F.create_map(*[F.lit(v) for i, r in enumerate(shards.select("shard").orderBy("shard").collect()) for v in (r["shard"], i)])
    return flat.take(pa.array(order)).to_pylist(), SH.idf_of(df[order], n_docs), shards.withColumn("number", numbers[F.col("shard")]).mapInArrow(run, SL.FACTORED)


def _fit_blocks(spark, rows: DataFrame, sizes: dict, weight: dict, analyzer: str, min_df: int, max_iter: int, tol: float, clean: bool, text_col: str) -> BlockModel:
    """Many classes and terms: coefficients in blocks on Spark (:mod:`lexiflow.operators.blocked`)."""
    path = scratch_path(spark, "classifier-rows")
    rows.withColumn("id", F.monotonically_increasing_id()).write.parquet(f"{path}/docs")
    docs, labels, n = spark.read.parquet(f"{path}/docs"), sorted(sizes), sum(sizes.values())
    code = F.create_map(*[F.lit(x) for i, c in enumerate(labels) for x in (c, i)])
    weights = F.create_map(*[F.lit(x) for c in labels for x in (c, float(weight[c]))])
    docs = docs.withColumn("y", code[F.col("label")].cast("int")).withColumn("w", weights[F.col("label")])
    # whole slices: the fewer they are, the fewer words and terms they repeat
    total = int(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    slots = spark.sparkContext.defaultParallelism
    slices = max(1, -(-total // SL.SLICE_BYTES), min(2 * slots, -(-total // SL.LEAST_BYTES)))
    rows = SL.sliced(docs, slices, _analyzer(analyzer), "id", "text", keep=("y", "w"))
    SL.slice_terms(rows, _analyzer(analyzer)).write.parquet(f"{path}/needs")
    needs = spark.read.parquet(f"{path}/needs")
    df = needs.groupBy("term").agg(F.sum("n").alias("df")).where(F.col("df") >= min_df)
    vocab = FE.dense_ids(FE.with_idf(df, n), [F.asc("term")], "tid")
    data = SL.matrix(rows, needs, vocab, _analyzer(analyzer), packed=False)
    coefs, bias = BL.minimise(data, n, vocab.count(), len(labels), max_iter, tol)
    vocab.join(coefs, "tid").select("term", "df", "idf", "coef").write.parquet(f"{path}/terms")
    return BlockModel(spark.read.parquet(f"{path}/terms"), labels, bias, n, analyzer, clean, text_col)


def _analyzer(name: str):
    return T.char_wb_ngrams if name == "char_wb" else T.word_features


class BlockModel:
    """A fitted classifier as tables: ``terms`` (term, df, idf, coef), and one intercept per
    class.  Prediction joins the terms of the rows to the table and sums on Spark."""

    def __init__(self, terms: DataFrame, labels: list[str], bias, n_docs: int, analyzer: str = "word", clean: bool = False, text_col: str = "text"):
        self.terms, self.labels, self.bias = terms, list(labels), [float(b) for b in bias]
        self.n_docs, self.analyzer, self.clean, self.text_col = int(n_docs), analyzer, clean, text_col

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """The columns ``keep`` (all, if not given) and ``predicted``; equal margins go to the smaller
        label.  Rows are packed into shards once, which ask the table for their distinct terms."""
        keep = list(df.columns if keep is None else keep)
        packed, _ = SH.pack(df, F.col(self.text_col), _analyzer(self.analyzer), keep, self.clean)
        pairs = int(packed.agg(F.sum("n_terms")).first()[0] or 0)
        SH.free(df.sparkSession)
        return SH.classify(packed, self.terms, [df.schema[c] for c in keep], len(self.labels), self.bias, self.labels, pairs)

    def save(self, path: str) -> str:
        """The tables under ``path`` (:func:`lexiflow.sources.artefacts.load_model` reads them)."""
        spark = self.terms.sparkSession
        self.terms.write.mode("overwrite").parquet(f"{path}/block-terms")
        row = (self.labels, self.bias, self.n_docs, self.analyzer, self.clean, self.text_col)
        meta = spark.createDataFrame([row], "labels array<string>, bias array<double>, n_docs long, analyzer string, clean boolean, text_col string")
        meta.write.mode("overwrite").parquet(f"{path}/block-model")
        return path

    @classmethod
    def load(cls, spark, path: str) -> BlockModel:
        r = spark.read.parquet(f"{path}/block-model").first()
        return cls(spark.read.parquet(f"{path}/block-terms"), r["labels"], r["bias"], r["n_docs"], r["analyzer"], r["clean"], r["text_col"])


def _vectors(docs: DataFrame, counts: DataFrame, vocab: DataFrame, n_docs: int, labels: list[str], weight: dict[str, float]) -> DataFrame:
    """(id, y, w, cols, vals): one row per document, unit length TF-IDF."""
    joined = FE.join_idf(counts, vocab, n_docs, extra=["tid"])
    terms = joined.select("id", F.struct(F.col("tid").alias("c"), (F.col("tf") * F.col("idf")).alias("v")).alias("s"))
    rows = terms.groupBy("id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    code = F.create_map(*[F.lit(x) for i, c in enumerate(labels) for x in (c, i)])
    weights = F.create_map(*[F.lit(x) for c in labels for x in (c, float(weight[c]))])
    base = docs.select("id", code[F.col("label")].alias("y"), weights[F.col("label")].alias("w"))
    empty = F.array().cast("array<struct<c:long,v:double>>")
    out = base.join(rows, "id", "left").withColumn("s", F.coalesce("s", empty))
    # the norm is a column of its own across the exchange below; written inside the lambda
    # that divides by it, it would be summed again for every term
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["v"] * x["v"]))
    parts = max(1, -(-counts.count() // PARTITION_VALUES))
    out = out.withColumn("norm", norm).repartition(parts, "id").sortWithinPartitions("id")
    return out.select("id", "y", "w", F.transform("s", lambda x: x["c"]).alias("cols"), F.transform("s", lambda x: x["v"] / F.col("norm")).alias("vals"))


def _minimise(data: DataFrame, n: int, n_terms: int, k: int, max_iter: int, tol: float, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L-BFGS with backtracking over factored rows; returns (k x terms coefficients, intercepts).
    Two classes have opposite coefficients all along, so the second's are kept alone, and
    products of two vectors count twice."""
    rows, both = (1, 2.0) if k == 2 else (k, 1.0)
    size = rows * (n_terms + 1)

    def weight(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(np.frombuffer(x.as_buffer()).sum()) for x in b.column(0)], pa.float64())], names=["t"])

    total = float(data.select("w").mapInArrow(weight, "t double").agg(F.sum("t")).first()[0])
    factor = np.append(idf, 1.0)  # the values are counts: the idf belongs to the column
    # two softmax rows share the margin evenly: twice the penalty gives the margin the
    # penalty that a binary model puts on its one row
    l2 = 2.0 if k == 2 else 1.0
    parts = data.rdd.getNumPartitions()

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        loss, grad = _loss_and_gradient(data, x.reshape(rows, -1) * factor, parts)
        w = x.reshape(rows, -1)[:, :-1]
        grad = grad * factor / total
        grad[:, :-1] += l2 * w / total
        return loss / total + 0.5 * l2 * both * float((w * w).sum()) / total, grad.ravel()

    x = np.zeros(size)
    f, g = value(x)
    s_list: list[np.ndarray] = []
    y_list: list[np.ndarray] = []
    for _ in range(max_iter):
        if np.abs(g).max() <= tol:
            break
        d = -g
        alphas = []
        for s, y in zip(reversed(s_list), reversed(y_list), strict=True):
            a = (s @ d) / (y @ s)
            alphas.append(a)
            d = d - a * y
        if s_list:
            d = d * ((s_list[-1] @ y_list[-1]) / (y_list[-1] @ y_list[-1]))
        else:
            d = d / max(1.0, both**0.5 * np.linalg.norm(g))
        for (s, y), a in zip(zip(s_list, y_list, strict=True), reversed(alphas), strict=True):
            d = d + (a - (y @ d) / (y @ s)) * s
        slope = both * float(g @ d)
        step = 1.0
        while True:
            new, g_new = value(x + step * d)
            if new <= f + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = step * d, g_new - g
        if s @ y > 1e-12 * (y @ y):
            s_list, y_list = [*s_list[-9:], s], [*y_list[-9:], y]
        elif step < 1e-10:
            break
        x, f, g = x + step * d, new, g_new
    if np.abs(g).max() > tol:
        warnings.warn(f"stopped with a gradient of {np.abs(g).max():.2e} (objective {f:.6f})", NotConverged, stacklevel=3)
    w = x.reshape(rows, -1)
    if k == 2:
        w = np.concatenate([-w, w])
    return w[:, :-1], w[:, -1] - w[:, -1].mean()


def _loss_and_gradient(data: DataFrame, w: np.ndarray, parts: int) -> tuple[float, np.ndarray]:
    """Sums over all rows of the ``parts`` partitions; one row of ``w`` is that of the second of
    two classes with opposite coefficients."""
    shared = data.sparkSession.sparkContext.broadcast(w)
    out = np.zeros(w.size + 1)  # the loss comes last
    sums = _block_sums(data, shared, parts).toArrow()
    for block, vals in zip(sums["block"].to_pylist(), sums["vals"], strict=True):
        some = np.frombuffer(vals.as_buffer())
        out[block * BLOCK : block * BLOCK + len(some)] = some
    shared.destroy()
    return float(out[-1]), out[:-1].reshape(w.shape)


def _block_sums(data: DataFrame, shared, parts: int) -> DataFrame:
    """(seq, block, vals): one row per block of the gradient that is not zero.  Every
    partition sums its own rows; ``FAN`` neighbours are added at a time, in order, so a
    repeated fit gives the same numbers."""
    size = BLOCK

    def chunks(b):
        if b.schema.names[0] == "_slice":
            yield from (SL.factors(*x) for x in zip(*b.columns[1:], strict=True))
        elif b.num_rows:
            sizes = b.column(3).value_lengths().to_numpy().astype(np.int64)
            vals = b.column(4).flatten().to_numpy()
            yield b.column(1).to_numpy(), b.column(2).to_numpy(), sizes, b.column(3).flatten().to_numpy(), vals, np.ones(len(sizes)), None, None

    def run(batches):
        w = shared.value
        k, n_terms = len(w), w.shape[1] - 1
        grad, loss, some = np.zeros_like(w), 0.0, False
        for y, sw, sizes, words, vals, scale, grams, cols in (c for b in batches for c in chunks(b)):
            some = True
            z = []
            for c in range(k):
                per_word = w[c] if grams is None else _sums(w[c, cols], grams)
                z.append(_sums(per_word[words] * vals, sizes) * scale + w[c, -1])
            z = np.stack([-z[0], z[0]] if k == 1 else z, 1)
            top = z.max(1, keepdims=True)
            p = np.exp(z - top)
            sums = p.sum(1, keepdims=True)
            loss += float((sw * (np.log(sums[:, 0]) + top[:, 0] - z[np.arange(len(y)), y])).sum())
            p /= sums
            p[np.arange(len(y)), y] -= 1
            p *= sw[:, None]
            p = p[:, -k:]
            for c in range(k):
                back = np.repeat(p[:, c] * scale, sizes) * vals
                if grams is None:
                    grad[c, :-1] += np.bincount(words, back, n_terms)
                else:
                    back = np.bincount(words, back, len(grams))
                    grad[c, :-1] += np.bincount(cols, np.repeat(back, grams), n_terms)
            grad[:, -1] += p.sum(0)
        if some:
            yield from _blocks(TaskContext.get().partitionId(), np.append(grad.ravel(), loss), size)

    sums = data.mapInArrow(run, BLOCKS)
    while parts > 1:
        sums = sums.groupBy(F.expr(f"seq div {FAN}"), "block").applyInArrow(_adder(FAN), BLOCKS)
        parts = -(-parts // FAN)
    return sums


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; an empty run has none."""
    out, some = np.zeros(len(sizes)), np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


BLOCKS = "seq long, block long, vals binary"


def _blocks(seq: int, flat: np.ndarray, size: int):
    """The blocks that are not zero, a few MB at a time."""
    held = [i for i in range(-(-len(flat) // size)) if flat[i * size : (i + 1) * size].any()]
    for a in range(0, len(held), 32):
        some = held[a : a + 32]
        vals = pa.array([flat[i * size : (i + 1) * size].tobytes() for i in some], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([seq] * len(some), pa.int64()), pa.array(some, pa.int64()), vals], names=["seq", "block", "vals"])


def _adder(fan: int):
    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        total = sum(np.frombuffer(v.as_buffer()) for v in t["vals"])
        return pa.table({"seq": pa.array([t["seq"][0].as_py() // fan], pa.int64()), "block": t["block"].slice(0, 1), "vals": pa.array([total.tobytes()], pa.binary())})

    return add


def _lr_model(spark, coef: np.ndarray, bias: np.ndarray) -> LogisticRegressionModel:
    """A Spark ML model with the given coefficients."""
    sc = spark.sparkContext
    matrix = DenseMatrix(coef.shape[0], coef.shape[1], coef.ravel().tolist(), True)
    jvm = sc._jvm.org.apache.spark.ml
    java = jvm.classification.LogisticRegressionModel(
        jvm.util.Identifiable.randomUID("logreg"), _py2java(sc, matrix), _py2java(sc, Vectors.dense(bias)), coef.shape[0], True
    )
    model = LogisticRegressionModel(java)
    model._resetUid(java.uid())
    for name, col in (("featuresCol", "_features"), ("predictionCol", "_pred"), ("probabilityCol", "_prob"), ("rawPredictionCol", "_raw")):
        java.set(java.getParam(name), col)
        model._set(**{name: col})
    return model


def predict(model: PipelineModel | BlockModel, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``predicted`` beside the columns ``keep`` (all, if not given): others are not carried along."""
    if isinstance(model, BlockModel):
        return model.transform(df, keep)
    out = model.transform(df) if keep is None else model.transform(df).select(*keep, "predicted")
    return out.drop("_tokens", "_tf", "_tfidf", "_features", "_raw", "_prob", "_pred")


def with_predictions(model: PipelineModel | BlockModel, df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``predicted`` from a fitted model, keeping every input column."""
    return predict(model, df if text_col == "text" else df.withColumnRenamed(text_col, "text"))
