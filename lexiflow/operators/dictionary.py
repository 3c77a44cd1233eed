"""Last-wins dictionaries and exact lookups.

A dictionary is ``(key, standard, pos)``: one row per key, the value of the
*last* occurrence, the position of the *first* occurrence (Python ``dict``
insertion semantics).  Null keys are dropped: they never match.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.session import scratch_path


def build_dictionary(
    df: DataFrame,
    key_fn: Callable[[Column], Column] | None = T.normalize_text,
    text_col: str = "text",
    standard_col: str = "standard",
    pos_col: str = "pos",
    strip_standard: bool = True,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Fixed-width aggregation, then the values by position.

    The rows are written once with their key and its 128-bit digest, so no text is normalised
    twice.  The first and last position of every key are found by hash aggregation on the
    digest, read alone from that table (map-side combined, so a hot key costs nothing), and
    the row at the last position gives the key and its value.  Texts are neither sorted nor
    compared in the aggregation, and the join is on unique positions.  Rows at equal
    positions with one key leave one of them.
    """
    key = key_fn(F.col(text_col)) if key_fn is not None else F.col(text_col)
    # rows are filtered on a non-null text first and key_fn keeps non-null values
    # non-null, so the key is declared non-nullable: joins then infer no
    # ``isnotnull(key_fn(text))`` filter that would be pushed into the scan
    key = F.coalesce(key, F.lit(""))
    value = T.strip_ws(standard_col) if strip_standard else F.col(standard_col)
    more = [c.alias(name) for name, c in (extra or {}).items()]
    src = df.where(F.col(text_col).isNotNull())
    rows = src.select(key.alias("key"), value.alias("standard"), F.col(pos_col).alias("_pos"), *more)
    d1, d2 = digest(F.col("key"))
    rows = rows.withColumn("_d1", d1).withColumn("_d2", d2)
    path = scratch_path(df.sparkSession, "dictionary-rows")
    rows.write.option("compression", "zstd").parquet(path)
    rows = df.sparkSession.read.schema(rows.schema).parquet(path)
    ends = rows.groupBy(F.col("_d1").alias("_h1"), F.col("_d2").alias("_h2")).agg(F.max("_pos").alias("_last"), F.min("_pos").alias("pos"))
    on = (rows["_pos"] == ends["_last"]) & (rows["_d1"] == ends["_h1"]) & (rows["_d2"] == ends["_h2"])
    return rows.join(ends, on).select("key", "standard", "pos", *(extra or {}))


def digest(key: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a key: the join key in place of a whole text."""
    return F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(1), key).alias("_h2")


BATCH_KEYS = 1_000_000  # most rows of a micro-batch whose keys are broadcast (16 bytes each)


def with_digest(dictionary: DataFrame) -> DataFrame:
    """The dictionary with the digest of its keys, to be stored for :func:`restrict`."""
    return dictionary.select("*", *digest(F.col("key")))


def restrict(
    stored: DataFrame, batch: DataFrame, key_fn: Callable[[Column], Column] | None = T.normalize_text, text_col: str = "text"
) -> DataFrame:
    """The entries of a stored dictionary that a small batch may ask for.

    The digests of the batch's keys are broadcast (their number is checked) and the stored
    digests are filtered by them, so a micro-batch does not shuffle the whole dictionary.
    """
    key = key_fn(F.col(text_col)) if key_fn is not None else F.col(text_col)
    keys = batch.select(*digest(key)).distinct()
    path = scratch_path(batch.sparkSession, "batch-keys")  # counted and broadcast: the texts are normalised once
    keys.write.parquet(path)
    keys = batch.sparkSession.read.schema(keys.schema).parquet(path)
    if keys.limit(BATCH_KEYS + 1).count() > BATCH_KEYS:
        return stored.drop("_h1", "_h2")
    return stored.join(F.broadcast(keys), ["_h1", "_h2"], "left_semi").drop("_h1", "_h2")


def _keyed(queries: DataFrame, key_fn: Callable[[Column], Column] | None, text_col: str, only: Column | None = None) -> DataFrame:
    """Queries with their key and its digest; a null key, which never matches, is spread by
    the hash of its row instead of meeting all others in one task."""
    key = key_fn(F.col(text_col)) if key_fn is not None else F.col(text_col)
    row = F.xxhash64(*[F.col(f"`{c}`") for c in queries.columns])
    h1, h2 = digest(F.col("_key"))
    q = queries.withColumn("_key", key if only is None else F.when(only, key))
    return q.withColumn("_h1", F.when(F.col("_key").isNull(), row).otherwise(h1)).withColumn("_h2", h2)


def _on(q: DataFrame, d: DataFrame) -> Column:
    return (q["_h1"] == d["_k1"]) & (q["_h2"] == d["_k2"]) & (q["_key"] == d["_dkey"])


def _entries(dictionary: DataFrame, *cols: Column) -> DataFrame:
    h1, h2 = digest(F.col("key"))
    return dictionary.select(h1.alias("_k1"), h2.alias("_k2"), F.col("key").alias("_dkey"), *cols)


def lookup(
    queries: DataFrame,
    dictionary: DataFrame,
    key_fn: Callable[[Column], Column] | None = T.normalize_text,
    text_col: str = "text",
    out_col: str = "lookup",
    only: Column | None = None,
) -> DataFrame:
    """Left outer equi-join on the digest of the normalised key, and the key itself;
    ``only``: rows to look up, the others have no key.

    No broadcast hint: the dictionary grows with the corpus, so AQE picks broadcast
    only when the runtime size is under the threshold.  Otherwise both sides are plain
    shuffles on two long columns, which AQE can split where a query key is hot.
    """
    q = _keyed(queries, key_fn, text_col, only)
    d = _entries(dictionary, F.col("standard").alias(out_col), F.col("pos").alias(out_col + "_pos"))
    return q.join(d, _on(q, d), "left").drop("_key", "_h1", "_h2", "_k1", "_k2", "_dkey")


def lookup_split(
    queries: DataFrame,
    dictionary: DataFrame,
    key_fn: Callable[[Column], Column] | None = T.normalize_text,
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Membership split: (hits, misses) — a left join tagged by a match flag for the
    hits (dictionary keys are unique, so no row is repeated) and a left-anti join
    for the misses."""
    q = _keyed(queries, key_fn, text_col)
    d = _entries(dictionary, F.lit(True).alias("_hit"))
    hits = q.join(d, _on(q, d), "left").where(F.col("_hit")).select(*[f"`{c}`" for c in queries.columns])
    return hits, q.join(d, _on(q, d), "left_anti").select(*[f"`{c}`" for c in queries.columns])


def dictionary_size(dictionary: DataFrame) -> DataFrame:
    return dictionary.agg(F.count_distinct("key").alias("dict_size"))
