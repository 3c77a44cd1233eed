"""Token-id sequence columns: truncate, pad batches to a multiple of 8, mask padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow import constants as K


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def truncate(col, n: int) -> Column:
    return F.slice(_c(col), 1, n)


def mask_pad(col, pad_id: int = K.PAD_ID, ignore_id: int = K.LABEL_IGNORE_ID) -> Column:
    return F.transform(_c(col), lambda x: F.when(x == F.lit(pad_id), F.lit(ignore_id)).otherwise(x))


def pad_batches(
    df: DataFrame, id_col: str, batch_size: int, ids_col: str = "ids", multiple: int = 8, pad_id: int = K.PAD_ID
) -> DataFrame:
    """Group consecutive rows (by id) into batches and pad every sequence of a batch to the
    batch maximum rounded up to ``multiple``.  Rows are numbered by a distributed sort,
    so gaps in the ids leave no short batches; the window is bounded by the batch size."""
    from lexiflow.operators.features import dense_ids

    x = dense_ids(df, [F.asc(id_col)], "_no")
    x = x.withColumn("batch", F.floor(F.col("_no") / batch_size).cast("long")).drop("_no")
    longest = F.max(F.size(ids_col)).over(Window.partitionBy("batch"))
    x = x.withColumn("_target", F.ceil(longest / multiple).cast("int") * multiple)
    pad_n = F.col("_target") - F.size(ids_col)
    return x.withColumn(
        "input_ids", F.concat(F.col(ids_col), F.array_repeat(F.lit(pad_id).cast("long"), pad_n))
    ).withColumn(
        "attention_mask", F.concat(F.array_repeat(F.lit(1), F.size(ids_col)), F.array_repeat(F.lit(0), pad_n))
    ).drop("_target")
