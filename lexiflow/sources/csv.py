"""CSV corpora: strict headered read with quarantine, ragged read, and write.

* strict: columns bound by the names in the header, RFC-4180 quotes with doubled-quote
  escapes, multi-line fields.  A row with too few fields is padded with nulls; a row
  with too many goes to a quarantine frame (``mode='strict'`` fails fast on either).
  Files of one folder must agree on their header.
* ragged: no schema contract; rows are padded with ``''`` / cut to the column
  count, empty lines are skipped, and the header line is optionally kept as data.

A file larger than a split is read by many tasks even if quoted fields hold newlines
(:mod:`lexiflow.sources.csv_split`); a small one is left to Spark's reader, with the same rows.

Every row carries ``pos``, an orderable file position
``struct(source_rank, file_path, block_start, row_id)`` used for last-wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from lexiflow import constants as K
from lexiflow.functions import text as T
from lexiflow.sources import csv_split as SP

CORPUS_COLUMNS = ["text", "label", "standard"]


def string_schema(columns: list[str], corrupt: bool = True) -> Ty.StructType:
    fields = [Ty.StructField(c, Ty.StringType(), True) for c in columns]
    if corrupt:
        fields.append(Ty.StructField("_corrupt_record", Ty.StringType(), True))
    return Ty.StructType(fields)


def _position(df: DataFrame, source_rank: int = 0) -> DataFrame:
    return df.withColumn(
        "pos",
        F.struct(
            F.lit(source_rank).alias("source_rank"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("row_id"),
        ),
    )


def _split_rows(
    spark: SparkSession, path: str, schema: Ty.StructType, options: dict, names: list[str] | None, skip_header: bool, source_rank: int, keep: str | None = None
) -> DataFrame:
    """Parsed records and their position; ``names``: the header that every file must have;
    ``keep``: a column that rows must not have (``mode='dropmalformed'``)."""
    rec = SP.records(spark, path, options.get("ignoreLeadingWhiteSpace") == "true")
    at = F.struct("block_start", "row_id")
    if skip_header:
        first = rec.groupBy("file_path").agg(F.min(F.struct("block_start", "row_id", "record")).alias("f")).select("file_path", "f.*")
        if names is not None:
            parsed = first.select("file_path", F.from_csv("record", F.lit(string_schema([f"c{i}" for i in range(len(names))], corrupt=False).toDDL()), options).alias("h"))
            for r in parsed.collect():  # one row per file
                if list(r["h"]) != names:
                    raise ValueError(f"header of {r['file_path']} is {list(r['h'])}, not {names}")
        heads = first.select(F.col("file_path").alias("_f"), F.struct("block_start", "row_id").alias("_at"))
        rec = rec.join(F.broadcast(heads), (rec["file_path"] == F.col("_f")) & (at == F.col("_at")), "left_anti")
    text = F.when(F.col("crlf"), F.replace("record", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("record"))
    parsed = F.from_csv(text, F.lit(schema.toDDL()), {**options, "multiLine": "true"})
    pos = F.struct(F.lit(source_rank).alias("source_rank"), "file_path", "block_start", "row_id")
    out = rec.select(parsed.alias("_r"), pos.alias("pos"), "record").select("_r.*", "pos", F.col("record").alias("_raw"))
    corrupt = options.get("columnNameOfCorruptRecord")
    if corrupt in schema.fieldNames():  # as it stands in the file
        out = out.withColumn(corrupt, F.when(F.col(corrupt).isNotNull(), F.col("_raw")))
    out = out.drop("_raw")
    return out.where(F.col(keep).isNull()).drop(keep) if keep else out


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from a CSV header (reads the first line only)."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns


def read_csv(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    mode: str = "permissive",
    na_tokens: list[str] | None = K.NA_TOKENS,
    source_rank: int = 0,
    ignore_leading_ws: bool = True,
    multiline: bool = True,
    split: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Headered CSV -> (rows, quarantine).

    ``columns``: the columns to keep, by name (default: all, in file order); a name that
    the header lacks is an error.  ``mode``: ``permissive`` (pad short rows, quarantine
    long ones), ``dropmalformed`` or ``strict`` (fail fast).  NA tokens become null in
    every column.  ``split``: cut files at any byte and find the records by quote state
    (default: if a file is larger than a split); ``multiline=False`` promises that no field
    holds a newline, which spares that.
    """
    header = csv_header(spark, path)
    absent = [c for c in columns or [] if c not in header]
    if absent:
        raise ValueError(f"columns not in the header: {absent}")
    spark_mode = {"permissive": "PERMISSIVE", "dropmalformed": "DROPMALFORMED", "strict": "FAILFAST"}[mode]
    corrupt = "_corrupt_record"
    options = {
        "quote": '"', "escape": '"', "mode": spark_mode, "columnNameOfCorruptRecord": corrupt,
        "ignoreLeadingWhiteSpace": str(ignore_leading_ws).lower(),
    }
    if multiline and (SP.is_large(spark, path) if split is None else split):
        drop = spark_mode == "DROPMALFORMED"
        options = {**options, "mode": "PERMISSIVE"} if drop else options
        schema = string_schema(header, corrupt=spark_mode != "FAILFAST")
        raw = _split_rows(spark, path, schema, options, header, True, source_rank, corrupt if drop else None)
    else:
        # with enforceSchema off, a file with another header order raises
        reader = spark.read.schema(string_schema(header, corrupt=spark_mode == "PERMISSIVE")).options(header=True, enforceSchema=False, multiLine=multiline, **options)
        raw = _position(reader.csv(path), source_rank)
    if spark_mode != "PERMISSIVE":
        rows, quarantine = raw, spark.createDataFrame([], "_corrupt_record string").withColumn("pos", F.lit(None).cast(raw.schema["pos"].dataType))
    else:
        # a flagged record is parsed again with one more column: only a long row fills it.
        # An absent field is null there; an empty one is not.
        again = string_schema([*header, "_overflow"], corrupt=False)
        options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "\u0001", "emptyValue": "", "multiLine": "true"}
        long = F.from_csv(F.col(corrupt), F.lit(again.toDDL()), options)["_overflow"].isNotNull()
        # the reader refuses plans that need only the corrupt-record column
        flagged = F.col(corrupt).isNotNull() & long & (F.length(F.coalesce(F.col(f"`{header[0]}`"), F.lit(""))) >= 0)
        rows = raw.where(~F.coalesce(flagged, F.lit(False))).drop(corrupt)
        quarantine = raw.where(flagged).select(corrupt, "pos", F.col(f"`{header[0]}`").alias("_first")).drop("_first")
    keep = columns or header
    value = lambda c: T.na_to_null(c, na_tokens).alias(c) if na_tokens else F.col(c)
    return rows.select(*[value(c) for c in keep], "pos"), quarantine


def read_ragged_csv(
    spark: SparkSession,
    path: str,
    columns: list[str] = CORPUS_COLUMNS,
    header: bool = True,
    source_rank: int = 0,
    multiline: bool = True,
    split: bool | None = None,
) -> DataFrame:
    """Ragged CSV: pad short rows with '' and cut long ones to ``len(columns)``.

    ``header=False`` reproduces a reader that keeps the header line as a data row.  A
    quoted field may hold newlines; ``split`` and ``multiline`` are those of :func:`read_csv`.
    """
    n = len(columns)
    names = [f"_c{i}" for i in range(n)]
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    if multiline and (SP.is_large(spark, path) if split is None else split):
        raw = _split_rows(spark, path, string_schema(names, corrupt=False), options, None, header, source_rank)
    else:
        reader = spark.read.schema(string_schema(names, corrupt=False)).options(header=header, multiLine=multiline, **options)
        raw = _position(reader.csv(path), source_rank)
    return raw.select(*[F.coalesce(F.col(a), F.lit("")).alias(c) for a, c in zip(names, columns)], "pos")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headered CSV, every field quoted, doubled-quote escapes (round-trips newlines)."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
