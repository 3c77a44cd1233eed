"""Driver tables (parquet) and their role views.

Roles on the driver data (whole tables, no subsets):

* corpus ``(id, text, label, standard, pos)``: ``documents`` with ``lang`` as the
  label and ``source`` as the standard form, file order = ``doc_id``;
* translation memory: ``benchmark`` items (target = ``'item:' || item_id``);
* incoming texts: ``documents`` plus the user turns of ``conversations``;
* vector memory: ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


KEYS = {
    "documents": ["doc_id"],
    "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
    "embeddings": ["vec_id"],
    "benchmark": ["item_id"],
    "pages": ["page_id"],
}


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition a scan on its key when it has fewer splits than the cluster
    has task slots (e.g. one large row group).  Large inputs already scan as
    many splits and are left untouched, so no shuffle is added at scale."""
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # no RDD view (e.g. a remote session): leave the scan as is
        return df
    if splits >= slots:
        return df
    return df.repartition(slots, *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    keys = KEYS.get(name)
    return spread(df, keys) if keys else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel corpus view of ``documents``: (id, text, label, standard, pos)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        "text",
        F.col("lang").alias("label"),
        F.col("source").alias("standard"),
        F.col("doc_id").alias("pos"),
    )


def memory_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text translation memory from ``benchmark``: (mem_id, text, standard, pos)."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("mem_id"),
        "text",
        F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("standard"),
        F.col("item_id").alias("pos"),
    )


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.where(F.col("role") == "user").select("conv_id", "turn", "text")


def route_input(spark: SparkSession, sf_dir: str, requested_for_turns: str = "en") -> DataFrame:
    """Incoming texts: every document (requested label = its language) and every
    user turn (submitted with the default label).  Schema (id, text, requested_label)."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"),
        "text",
        F.col("lang").alias("requested_label"),
    )
    turns = user_turns(spark, sf_dir).select(
        F.concat(F.lit("conv:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"),
        "text",
        F.lit(requested_for_turns).alias("requested_label"),
    )
    return docs.unionByName(turns)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label", F.col("vec_id").alias("pos"))
