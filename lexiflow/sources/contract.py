"""Schema contracts and multi-source loading with skip rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.session import path_exists
from lexiflow.sources import csv as CSV


class ContractError(ValueError):
    pass


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in required if c not in have]


def check_contract(df: DataFrame, required: list[str], policy: str = "raise") -> bool:
    """Required columns must be a subset of the frame's columns (no job runs).

    policy ``raise`` -> ContractError listing the missing set, ``assert`` ->
    AssertionError, ``skip`` -> return False.
    """
    missing = missing_columns(df, required)
    if not missing:
        return True
    if policy == "skip":
        return False
    if policy == "assert":
        raise AssertionError(f"missing columns: {missing}")
    raise ContractError(f"missing required columns: {sorted(missing)}")


csv_header = CSV.csv_header


def load_dataset(
    spark: SparkSession, path: str, clean: bool = True, required=("text", "label", "standard"), with_quarantine: bool = False
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """CSV read + contract + cleaning of ``text`` and ``standard`` (null stays null).

    Every column of the file is kept.  ``with_quarantine`` also returns the rows with too
    many fields, which are in no case part of the data.
    """
    cols = csv_header(spark, path)
    missing = [c for c in required if c not in cols]
    if missing:
        raise ContractError(f"missing required columns: {sorted(missing)}")
    rows, quarantine = CSV.read_csv(spark, path)
    if clean:
        for c in ("text", "standard"):
            if c in cols:
                rows = rows.withColumn(c, T.clean_text(c))
    return (rows, quarantine) if with_quarantine else rows


def load_sources(
    spark: SparkSession, sources: list[tuple[str, str]], required=("text", "label")
) -> tuple[DataFrame, DataFrame]:
    """Load several CSV sources; missing, empty or badly headed ones are skipped.

    Returns (union of the loaded sources, load report (source, status, rows, quarantined)).
    The union has every column of every source (null where a source lacks it).  Raises
    when no source is left.  Only file metadata and headers are read on the driver; rows
    are counted by distributed aggregates.
    """
    frames, report, bad = [], [], []
    for rank, (name, path) in enumerate(sources):
        if not path_exists(spark, path):
            report.append((name, "missing"))
            continue
        cols = csv_header(spark, path)
        if not cols:
            report.append((name, "empty"))
            continue
        if [c for c in required if c not in cols]:
            report.append((name, "bad header"))
            continue
        rows, quarantine = CSV.read_csv(spark, path, source_rank=rank)
        frames.append(rows.withColumn("source", F.lit(name)))
        bad.append(quarantine.select("_corrupt_record", "pos").withColumn("source", F.lit(name)))
        report.append((name, "loaded"))
    if not frames:
        raise ContractError("no usable source: every source is missing, empty or lacks the required columns")
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f, allowMissingColumns=True)
    broken = bad[0]
    for f in bad[1:]:
        broken = broken.unionByName(f)
    counts = union.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    lost = broken.groupBy("source").agg(F.count("_corrupt_record").alias("quarantined"))
    rep = spark.createDataFrame(report, "source string, status string")
    loaded = F.col("status") == "loaded"
    rep = rep.join(counts, "source", "left").join(lost, "source", "left")
    zero = lambda c: F.when(loaded, F.coalesce(F.col(c), F.lit(0).cast("long"))).alias(c)
    return union, rep.select("source", "status", zero("rows"), zero("quarantined"))
