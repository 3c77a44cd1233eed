"""Translation memories: a table of (text -> standard) entries matched by cosine.

``TextMemory`` uses word (or char-gram) TF-IDF vectors fitted on the memory
entries (no sentence-encoder weights are available); ``VectorMemory`` uses a
precomputed embedding column.  Both return the best entry per query with its
score, through the exact top-1 operator in :mod:`lexiflow.operators.similarity`.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lexiflow.functions import text as T
from lexiflow.operators import features as FE
from lexiflow.operators import pruned as PR
from lexiflow.operators import similarity as SIM
from lexiflow.operators import threshold as TH
from lexiflow.session import scratch_path
from lexiflow.sources import artefacts as AR


class TextMemory:
    """Memory entries ``(mem_id, text, standard, pos[, label])``.

    The entries are written once with a row number of their own, which keys every table
    of the memory: equal or null ids stay rows of their own.  ``pos`` may be any orderable
    column (a file position struct is numbered first).  The result does not depend on the
    strategy that the memory's size selects.
    """

    def __init__(
        self,
        entries: DataFrame,
        analyzer: Callable[[Column], Column] = T.word_features,
        min_df: int = 1,
        with_label: bool = False,
        max_broadcast_bytes: int | None = None,
        force: str | None = None,
        stored_path: str | None = None,
    ):
        self.analyzer = analyzer
        self.with_label = with_label
        self.max_broadcast_bytes = max_broadcast_bytes
        self.force = force
        spark = entries.sparkSession
        self.path = stored_path or self._fit(entries, min_df)
        self.vocab = spark.read.parquet(f"{self.path}/vocab").select("term", "idf")
        self.vectors = spark.read.parquet(f"{self.path}/vectors")
        self._prepared = None
        self._idf = None

    def _fit(self, entries: DataFrame, min_df: int) -> str:
        """Write the entries, the vocabulary and the vectors; returns their folder."""
        spark = entries.sparkSession
        path = scratch_path(spark, "text-memory")
        cols = ["mem_id", "text", "standard", "pos"] + (["label"] if self.with_label else [])
        own = entries.select(*cols)
        if not isinstance(own.schema["pos"].dataType, IntegralType):
            own = FE.dense_ids(own, [F.asc_nulls_last("pos")], "_n").drop("pos").withColumnRenamed("_n", "pos")
        own.withColumn("_mk", F.monotonically_increasing_id()).write.parquet(f"{path}/entries")
        own = spark.read.parquet(f"{path}/entries")
        n_docs = own.count()
        counts = FE.term_counts(own, self.analyzer, "_mk")
        FE.with_idf(FE.term_df(own, self.analyzer, min_df, "_mk"), n_docs).write.parquet(f"{path}/vocab")
        idf = spark.read.parquet(f"{path}/vocab")
        vec = SIM.sparse_vectors(FE.tfidf(counts, idf, "_mk", n_docs), "_mk")
        vec.join(own.drop("text"), "_mk").drop("_mk").write.parquet(f"{path}/vectors")
        return path

    def save(self, path: str) -> str:
        """Keep the fitted memory under ``path``."""
        for part in ("vocab", "vectors"):
            AR.save_table(self.vectors.sparkSession.read.parquet(f"{self.path}/{part}"), f"{path.rstrip('/')}/{part}")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str, optional: bool = False, **options) -> TextMemory | None:
        """A saved memory; a missing one raises, or is None if ``optional``."""
        for part in ("vocab", "vectors"):
            if AR.load_table(spark, f"{path.rstrip('/')}/{part}", optional) is None:
                return None
        vectors = spark.read.parquet(f"{path.rstrip('/')}/vectors")
        return cls(vectors, with_label="label" in vectors.columns, stored_path=path.rstrip("/"), **options)

    def idf_broadcast(self):
        """The fitted vocabulary with its idf, shipped once per executor; it holds no
        more terms than the memory postings, so the memory size check bounds it."""
        if self._idf is None:
            self._idf = self.vocab.sparkSession.sparkContext.broadcast(SIM.idf_state(self.vocab.toPandas()))
        return self._idf

    def prepared(self):
        if self._prepared is None:
            self._prepared = SIM.prepare(
                self.vectors, "sparse", same_label=self.with_label,
                max_broadcast_bytes=self.max_broadcast_bytes, force=self.force, carry=("mem_id", "standard"),
            )
        return self._prepared

    def query_vectors(self, queries: DataFrame, qid_col: str = "qid", text_col: str = "text") -> DataFrame:
        counts = FE.term_counts(queries.select(F.col(qid_col).alias("qid"), F.col(text_col).alias("text")), self.analyzer, "qid")
        # raw tf*idf over the known terms; the scoring kernel divides by the norm of the
        # whole query, so no per-query window sort is needed here
        vocab = F.broadcast(self.vocab) if self.prepared().strategy == "broadcast" else self.vocab
        long_form = counts.join(vocab, "term").withColumn("tfidf", F.col("tf") * F.col("idf"))
        return SIM.sparse_vectors(long_form, "qid")

    def match(
        self,
        queries: DataFrame,
        qid_col: str = "id",
        text_col: str = "text",
        label_col: str | None = None,
    ) -> DataFrame:
        """Left-joins ``mem_id, mem_standard, mem_score`` (null when nothing is shared).

        With a broadcast memory every row is scored where it lies (terms from the
        JVM-side analyzer, weights and cosine in the scoring task): no shuffle of
        the queries.  For a sharded memory the rows are written once with a number of
        their own, scored in long form, and joined by that number.
        """
        label = label_col if label_col is not None and self.with_label else None
        if self.prepared().strategy == "broadcast":
            return self._match_rows(queries, text_col, label)
        spark = queries.sparkSession
        path = scratch_path(spark, "memory-rows")
        queries.withColumn("_qrow", F.monotonically_increasing_id()).write.parquet(path)
        rows = spark.read.parquet(path)
        qv = self.query_vectors(rows, "_qrow", text_col)
        if label is not None:
            qv = qv.join(rows.select(F.col("_qrow").alias("qid"), F.col(label).alias("label")), "qid")
        # block sizing from the raw token count (a bound on the distinct terms): a
        # narrow scan, instead of a second run of the query-vector pipeline
        tokens = F.coalesce(F.size(self.analyzer(F.col(text_col))), F.lit(0))
        nnz = rows.select(F.sum(F.greatest(tokens, F.lit(0))).alias("n")).first()["n"] or 0
        best = SIM.nearest(qv, self.prepared(), "sparse", same_label=label is not None, query_nnz=int(nnz))
        best = best.select(F.col("qid").cast("long").alias("_qrow"), F.col("mem_id"), F.col("standard").alias("mem_standard"), F.col("score").alias("mem_score"))
        best = best.withColumnsRenamed({c: f"_best_{c}" for c in best.columns if c != "_qrow"})
        out = rows.join(best, "_qrow", "left")
        return out.select(*[f"`{c}`" for c in queries.columns], *[F.col(f"_best_{c}").alias(c) for c in ("mem_id", "mem_standard", "mem_score")])

    def match_above(self, queries: DataFrame, threshold: float, id_col: str = "id", text_col: str = "text", label_col: str | None = None) -> DataFrame:
        """``match`` for matches of ``threshold`` or more only (null below), by prefix filtering:
        rows meet entries by their rare terms, however large the memory.  Adds ``mem_compared``,
        the number of entries that a row was compared with."""
        label = label_col if label_col is not None and self.with_label else None
        spark = queries.sparkSession
        path = scratch_path(spark, "memory-rows")
        queries.withColumn("_qrow", F.monotonically_increasing_id()).write.parquet(path)
        rows = spark.read.parquet(path)
        counts = FE.term_counts(rows.select(F.col("_qrow").alias("qid"), F.col(text_col).alias("text")), self.analyzer, "qid")
        # the memory's own document frequencies keep frequent terms out of a shuffle join
        order, n = TH.term_order(self.vectors)
        known = TH.numbered_terms(counts, order.drop("idf").join(self.vocab, "term"), n, "qid")
        entry = F.struct("tid", (F.col("tf") * F.col("idf")).alias("w"))
        qv = known.select("qid", entry.alias("s")).groupBy("qid").agg(F.sort_array(F.collect_list("s")).alias("s"))
        qv = qv.withColumn("nrm", F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"] * x["w"])))
        if label is not None:
            qv = qv.join(rows.select(F.col("_qrow").alias("qid"), F.col(label).cast("string").alias("label")), "qid")
        best = TH.nearest_numbered(qv.withColumnRenamed("qid", "k"), order, n, self.vectors, threshold, label is not None, ("mem_id", "standard"))
        best = best.select(F.col("k").alias("_qrow"), "mem_id", F.col("standard").alias("mem_standard"), F.col("score").alias("mem_score"), F.col("compared").alias("mem_compared"))
        names = [c for c in best.columns if c != "_qrow"]
        out = rows.join(best.withColumnsRenamed({c: f"_best_{c}" for c in names}), "_qrow", "left")
        zero = F.coalesce("_best_mem_compared", F.lit(0).cast("long")).alias("mem_compared")
        return out.select(*[f"`{c}`" for c in queries.columns], *[F.col(f"_best_{c}").alias(c) for c in names[:-1]], zero)

    def _match_rows(self, queries: DataFrame, text_col: str, label_col: str | None) -> DataFrame:
        rows = queries.withColumn("_terms", self.analyzer(F.col(text_col)))
        scored = SIM.nearest_rows(
            rows, self.prepared(), self.idf_broadcast(), "_terms", label_col, pos_col="_match_pos", score_col="_mem_score"
        )
        return scored.select(
            *[f"`{c}`" for c in queries.columns],
            F.col("_carry_mem_id").alias("mem_id"), F.col("_carry_standard").alias("mem_standard"), F.col("_mem_score").alias("mem_score"),
        )


class VectorMemory:
    """Memory entries ``(id, vec, pos[, label])`` with precomputed embeddings.

    A memory under the broadcast bound is shipped to the queries; a larger one is cut into
    rings, and a query visits those that can hold its match (``force``: ``broadcast``,
    ``sharded`` — every shard — or ``pruned``)."""

    def __init__(self, entries: DataFrame, max_broadcast_bytes: int | None = None, force: str | None = None):
        self.entries = entries
        self.max_broadcast_bytes = max_broadcast_bytes
        self.force = force
        self._prepared = {}

    def _rows(self, with_label: bool) -> DataFrame:
        return self.entries.select("pos", "vec", F.col("id").alias("match_id"), F.col("id").cast("string").alias("key"), *(["label"] if with_label else []))

    def prepared(self, with_label: bool = False):
        if with_label not in self._prepared:
            self._prepared[with_label] = SIM.prepare(
                self._rows(with_label), "dense", exclude_self=True, same_label=with_label,
                max_broadcast_bytes=self.max_broadcast_bytes, force=None if self.force == "pruned" else self.force, carry=("match_id",),
            )
        return self._prepared[with_label]

    def pruned(self, exclude_self: bool = False, with_label: bool = False) -> PR.PivotIndex:
        """The memory cut into rings."""
        which = (exclude_self, with_label)
        if which not in self._prepared:
            self._prepared[which] = PR.PivotIndex(self._rows(with_label), exclude_self, with_label, carry=("match_id",))
        return self._prepared[which]

    def match(self, queries: DataFrame, exclude_self: bool = False, same_label: bool = False) -> DataFrame:
        """queries: (id, vec[, label]) -> (qid, match_pos, score, match_id), a row per query row."""
        q = queries.select(F.col("id").alias("qid"), "vec", F.col("id").cast("string").alias("key"), *(["label"] if same_label else []))
        if self.force == "pruned" or (self.force is None and self.prepared(same_label).strategy == "sharded"):
            return self.pruned(exclude_self, same_label).nearest(q).drop("visited")
        return SIM.nearest(q, self.prepared(same_label), "dense", exclude_self=exclude_self, same_label=same_label)
