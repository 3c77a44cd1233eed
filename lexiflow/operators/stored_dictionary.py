"""Last-wins dictionaries kept on disk, bucketed by their join key.

Every version is a Parquet folder whose files are bucketed and sorted by the digest of the key
and the key itself.  A lookup joins on exactly these columns, so the dictionary side needs no
exchange, however large it is: only the queries are shuffled.  Query keys that fill more than
``HOT_SHARE`` of the queries (at most ``1 / HOT_SHARE`` of them) would pile up in the task of their
bucket; their entries are fetched first, by pushed-down filters, and broadcast.

``merge`` brings in the dictionary of a new part of the corpus with one full outer join, again
without an exchange of the stored side, and writes the next version.  Each entry carries the
position of its last occurrence, so the merged dictionary equals one built from all parts,
in whatever order they come.  Readers keep the version that they opened: a new one is
announced by a row in the ``versions`` table, after its files are complete.
"""

from __future__ import annotations

import hashlib
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.operators import dictionary as D
from lexiflow.session import path_exists

KEYS = ["_h1", "_h2", "key"]
HOT_SHARE = 0.01
HOT_LEAST = 1000  # rows of one key that a task takes without further ado


def entries(corpus: DataFrame, key_fn: Callable[[Column], Column] | None = T.normalize_text, **columns) -> DataFrame:
    """(key, standard, pos, last, _h1, _h2) of a corpus part; ``columns`` as for
    :func:`lexiflow.operators.dictionary.build_dictionary`."""
    last = {"last": F.col(columns.get("pos_col", "pos"))}
    return D.with_digest(D.build_dictionary(corpus, key_fn, extra=last, **columns))


class StoredDictionary:
    """One version of a dictionary under ``path``."""

    def __init__(self, spark: SparkSession, path: str, version: int, buckets: int, schema: str, key_fn=T.normalize_text):
        self.spark, self.path, self.version, self.buckets, self.schema, self.key_fn = spark, path.rstrip("/"), version, buckets, schema, key_fn
        self.table = f"lexiflow_dictionary_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_v{version}"

    @property
    def folder(self) -> str:
        return f"{self.path}/v{self.version}"

    @classmethod
    def create(cls, spark: SparkSession, path: str, corpus: DataFrame, buckets: int | None = None, key_fn=T.normalize_text, **columns) -> StoredDictionary:
        """Version 1, from a corpus with a text, its standard form and a position.

        ``buckets``: as many as a join of this size should have tasks, and no fewer than
        ``spark.sql.shuffle.partitions``, or Spark would rather shuffle both sides."""
        if path_exists(spark, f"{path.rstrip('/')}/versions"):
            raise ValueError(f"{path} holds a dictionary")
        rows = entries(corpus, key_fn, **columns)
        n = max(buckets or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))
        out = cls(spark, path, 1, n, rows._jdf.schema().toDDL(), key_fn)
        out._write(rows.repartition(n, *KEYS))
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None, key_fn=T.normalize_text) -> StoredDictionary:
        """The latest version, or a given one."""
        rows = spark.read.parquet(f"{path.rstrip('/')}/versions")  # a row per version
        if version is not None:
            rows = rows.where(F.col("version") == version)
        r = rows.orderBy(F.desc("version")).first()
        if r is None:
            raise FileNotFoundError(f"no version {version} under {path}")
        return cls(spark, path, r["version"], r["buckets"], r["schema"], key_fn)

    def _write(self, rows: DataFrame) -> None:
        named = [f"`{c}`" for c in KEYS]
        writer = rows.sortWithinPartitions(*named).write.mode("overwrite").option("path", self.folder)
        writer.bucketBy(self.buckets, *KEYS).sortBy(*KEYS).saveAsTable(self.table)
        done = self.spark.createDataFrame([(self.version, self.buckets, self.schema)], "version int, buckets int, schema string")
        done.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def rows(self) -> DataFrame:
        """(key, standard, pos, last, _h1, _h2), with the partitioning of its buckets."""
        if not self.spark.catalog.tableExists(self.table):
            by = ", ".join(KEYS)
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.table} ({self.schema}) USING parquet "
                f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'"
            )
        return self.spark.table(self.table)

    def dictionary(self) -> DataFrame:
        return self.rows().select("key", "standard", "pos")

    def merge(self, corpus: DataFrame, **columns) -> StoredDictionary:
        """The next version, with a new corpus part; this one stays as it is."""
        new = entries(corpus, self.key_fn, **columns).select(*[F.col(c).alias(f"n_{c}") for c in ("key", "standard", "pos", "last", "_h1", "_h2")])
        old = self.rows()
        on = (old["_h1"] == new["n__h1"]) & (old["_h2"] == new["n__h2"]) & (old["key"] == new["n_key"])
        both = old.join(new, on, "full_outer")
        later = F.coalesce(F.col("n_last") >= F.col("last"), F.col("n_key").isNotNull())
        pick = lambda c: F.coalesce(c, f"n_{c}").alias(c)
        out = both.select(
            pick("key"), F.when(later, F.col("n_standard")).otherwise(F.col("standard")).alias("standard"),
            F.least("pos", "n_pos").alias("pos"), F.greatest("last", "n_last").alias("last"), pick("_h1"), pick("_h2"),
        )
        merged = StoredDictionary(self.spark, self.path, self.version + 1, self.buckets, self.schema, self.key_fn)
        merged._write(out)
        return merged

    def hot_digests(self, keyed: DataFrame) -> list[int]:
        """First digests of the keys that hold ``HOT_SHARE`` of the queries or more."""
        asked = keyed.where("_key is not null").groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("n"))
        total = keyed.count()
        return [r["_h1"] for r in asked.where(F.col("n") >= max(HOT_LEAST, HOT_SHARE * total)).select("_h1").collect()]

    def lookup(self, queries: DataFrame, text_col: str = "text", out_col: str = "lookup", only: Column | None = None) -> DataFrame:
        """All query rows with ``out_col`` and ``out_col_pos``; null where the key is unknown."""
        q = D._keyed(queries, self.key_fn, text_col, only)
        hot = self.hot_digests(q)
        known = self.rows()
        if not hot:
            return self._joined(q, known, out_col)
        is_hot = F.col("_h1").isin(hot) & F.col("_key").isNotNull()
        few = F.broadcast(known.where(F.col("_h1").isin(hot)))  # an entry per hot key
        rest = self._joined(q.where(~is_hot), known, out_col)
        return self._joined(q.where(is_hot), few, out_col).unionByName(rest)

    @staticmethod
    def _joined(q: DataFrame, known: DataFrame, out_col: str) -> DataFrame:
        d = known.select(F.col("_h1").alias("_k1"), F.col("_h2").alias("_k2"), F.col("key").alias("_dkey"), F.col("standard").alias(out_col), F.col("pos").alias(f"{out_col}_pos"))
        return q.join(d, D._on(q, d), "left").drop("_key", "_h1", "_h2", "_k1", "_k2", "_dkey")

    def restrict(self, batch: DataFrame, text_col: str = "text") -> DataFrame:
        """The entries that a small batch may ask for (:func:`dictionary.restrict`)."""
        return D.restrict(self.rows().select("key", "standard", "pos", "_h1", "_h2"), batch, self.key_fn, text_col)
