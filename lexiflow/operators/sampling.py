"""Deterministic ordering, sampling and stratified splits.

Row order for sampling is ``md5('<seed>:<id>')`` then ``id``: identical in any
engine and independent of partitioning.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow import constants as K

HASH_BITS_HEX = 4  # 16-bit buckets for the skew-safe split


def hash_key(id_col, seed: int = K.SEED) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def head_n(df: DataFrame, n: int, pos_col: str = "pos") -> DataFrame:
    """First ``n`` rows in file order (top-k: per-task top-n, then a merge)."""
    return df.orderBy(pos_col).limit(n)


def hash_sample(df: DataFrame, n: int, id_col: str = "id", seed: int = K.SEED) -> DataFrame:
    """Fixed-size sample: the ``n`` smallest hash keys (``min(n, rows)`` rows)."""
    return df.withColumn("_h", hash_key(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h")


def class_quotas(df: DataFrame, label_col: str, test_size: float) -> DataFrame:
    """Per class test quota: n_test = ceil(frac * N), shared by largest remainder.

    Integer arithmetic only; remainder ties go to the smaller label.  The result
    has one row per class (a closed label vocabulary), so it is tiny.
    """
    return quotas_of(df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c")), label_col, test_size)


def quotas_of(counts: DataFrame, label_col: str, test_size: float) -> DataFrame:
    """The same from a table of class sizes (label, n_c)."""
    frac = Fraction(test_size).limit_denominator(10_000)
    num, den = frac.numerator, frac.denominator
    w_all = Window.partitionBy()  # over the class table only (one row per class)
    c = counts.withColumn("n_all", F.sum("n_c").over(w_all))
    c = c.withColumn("n_test", F.expr(f"(n_all * {num} + {den} - 1) div {den}"))
    c = c.withColumn("base", F.expr("(n_test * n_c) div n_all")).withColumn("rem", F.expr("(n_test * n_c) % n_all"))
    c = c.withColumn("short", F.col("n_test") - F.sum("base").over(w_all))
    c = c.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("rem"), F.asc(label_col))))
    return c.select(label_col, "n_c", (F.col("base") + F.when(F.col("rk") <= F.col("short"), 1).otherwise(0)).alias("quota"))


def stratified_split(
    df: DataFrame,
    label_col: str = "label",
    id_col: str = "id",
    test_size: float = 0.2,
    seed: int = K.SEED,
    names: tuple[str, str] = ("train", "test"),
    split_col: str = "split",
) -> DataFrame:
    """Exact stratified split without a per-class window over whole classes.

    Rows are ranked inside their class by (hash, id) and the first ``quota``
    go to the test side.  Instead of sorting a whole class in one task (a class
    may hold a third of the data), rows are counted per (class, 16-bit hash
    bucket); only the single bucket per class that the quota cuts is ranked, which
    gives the (hash, id) of the last test row of each class.  These cut rows (one per
    class) are broadcast, and the rows themselves are tagged where they lie: no
    other column is shuffled.  Rows with one id stay on one side.
    """
    h = hash_key(id_col, seed)
    bucket = F.conv(F.substring(h, 1, HASH_BITS_HEX), 16, 10).cast("int")
    rows = df.where(F.col(label_col).isNotNull())
    keys = rows.select(F.col(label_col).alias("_label"), F.col(id_col).alias("_id"), h.alias("_h"), bucket.alias("_b"))
    buckets = keys.groupBy("_label", "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    sizes = buckets.groupBy("_label").agg(F.sum("_cnt").alias("n_c"))
    quotas = quotas_of(sizes, "_label", test_size).select("_label", "quota")
    wb = Window.partitionBy("_label").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_cnt").over(wb), F.lit(0)))
    edge = (
        buckets.join(F.broadcast(quotas), "_label")  # one row per class
        .where((F.col("_before") < F.col("quota")) & (F.col("quota") <= F.col("_before") + F.col("_cnt")))
        .select("_label", F.col("_b").alias("_bstar"), (F.col("quota") - F.col("_before")).alias("_need"))
    )
    inside = keys.join(F.broadcast(edge), "_label").where(F.col("_b") == F.col("_bstar"))
    wi = Window.partitionBy("_label").orderBy("_h", "_id")
    cut = inside.withColumn("_rn", F.row_number().over(wi)).where(F.col("_rn") == F.col("_need"))
    cut = cut.select(F.col("_label"), F.struct("_h", "_id").alias("_last"))
    tagged = rows.join(F.broadcast(cut), rows[label_col] == F.col("_label"), "left").drop("_label")
    is_test = F.coalesce(F.struct(h.alias("_h"), F.col(id_col).alias("_id")) <= F.col("_last"), F.lit(False))
    return tagged.withColumn(split_col, F.when(is_test, F.lit(names[1])).otherwise(F.lit(names[0]))).drop("_last")
