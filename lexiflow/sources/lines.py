"""Plain line files: read, clean, write with a suffix, and report."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow import constants as K
from lexiflow.operators import corpus as C
from lexiflow.session import path_exists


def read_lines(spark: SparkSession, path: str | list[str], whole_folders: bool = False) -> DataFrame:
    """(file_path, line_no, before): one row per line, trailing newline removed.

    ``line_no`` counts the lines of a file from 0.  Lines of one split have consecutive
    row ids; a small table with the first row id and the number of lines of every split
    (as many rows as splits, so it is broadcast) turns them into line numbers.  No file
    has to fit one row or one task.  ``whole_folders``: the part files of a folder, by name, are
    one file, as :func:`write_line_files` writes it.
    """
    own = F.col("_metadata.file_path")
    raw = spark.read.text(path).select(
        F.col("value").alias("before"),
        (F.regexp_replace(own, "/[^/]*$", "") if whole_folders else own).alias("file_path"),
        own.alias("_part"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    splits = raw.groupBy("file_path", "_part", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file_path").orderBy("_part", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_gone", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = raw.join(F.broadcast(splits.drop("_n", "file_path")), ["_part", "_block"])
    return out.select("file_path", (F.col("_gone") + F.col("_row") - F.col("_first")).alias("line_no"), "before")


def preview(spark: SparkSession, path: str, first_lines: int = 10) -> DataFrame:
    """Changed lines among the first lines of each file: (file_path, line_no, before, after)."""
    cleaned = C.line_cleanup(read_lines(spark, path))
    return C.change_preview(cleaned, first_lines).select("file_path", "line_no", "before", "after")


def write_lines(df: DataFrame, path: str, col: str = "after", mode: str = "overwrite") -> None:
    df.select(F.col(col).alias("value")).write.mode(mode).text(path)


def suffixed(path: str, suffix: str = K.LINE_FILE_SUFFIX) -> str:
    base = path.rstrip("/")
    return base[:-4] + suffix + ".txt" if base.endswith(".txt") else base + suffix


def write_line_files(rows: DataFrame, out_dir: str, names: list[str], order: list[str], file_col: str = "file", col: str = "after") -> None:
    """One output per name under ``out_dir``: the values of ``col`` of the rows with that name, by
    ``order``.  Names without rows give an empty output.

    Rows are range-partitioned by (name, order), so a large file is written by many tasks and
    a task writes its files one after another; the part files of an output follow its lines.
    """
    spark = rows.sparkSession
    base = out_dir.rstrip("/")
    if path_exists(spark, base):
        raise FileExistsError(base)
    staged = f"{base}/_staged"
    keys = [file_col, *order]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select(F.col(file_col).alias("file"), F.col(col).alias("value")).write.partitionBy("file").text(staged)
    jvm = spark.sparkContext._jvm
    paths = jvm.org.apache.hadoop.fs.Path
    fs = paths(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for status in fs.listStatus(paths(staged)):  # one folder per output
        name = status.getPath().getName()
        if name.startswith("file="):
            fs.rename(status.getPath(), paths(f"{base}/{unescape(name[5:])}"))
    fs.delete(paths(staged), True)
    for name in names:
        if not path_exists(spark, f"{base}/{name}"):
            spark.createDataFrame([], "value string").write.text(f"{base}/{name}")


def file_names(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Names of the input files (no content is read); equal names in two folders are an error."""
    names = sorted(unquote(f.rsplit("/", 1)[1]) for f in spark.read.text(path).inputFiles())
    if len(set(names)) < len(names):
        raise ValueError("two input files have one name")
    return names


def _file_name(path: Column) -> Column:
    """The name in a file's URI, as the metadata column has it."""
    last = F.regexp_extract(path, "[^/]*$", 0)
    return F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))


def cleanup_files(spark: SparkSession, path: str | list[str], out_dir: str, suffix: str = K.LINE_FILE_SUFFIX) -> DataFrame:
    """Clean every file of a folder into an output of its own, named with the suffix, line by
    line in place; returns the report (file, n_lines, n_changed)."""
    names = file_names(spark, path)
    cleaned = C.line_cleanup(read_lines(spark, path)).withColumn("file", _file_name(F.col("file_path")))
    target = F.when(F.col("file").endswith(".txt"), F.regexp_replace("file", r"\.txt$", f"{suffix}.txt")).otherwise(F.concat("file", F.lit(suffix)))
    write_line_files(cleaned.withColumn("target", target), out_dir, [suffixed(n, suffix) for n in names], ["line_no"], "target")
    report = cleaned.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("changed").cast("int")).cast("long").alias("n_changed"))
    zero = F.lit(0).cast("long")
    every = spark.createDataFrame([(n,) for n in names], "file string").join(report, "file", "left")
    return every.select("file", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_changed", zero).alias("n_changed"))


def cleanup_job(spark: SparkSession, path: str, out_path: str | None = None) -> DataFrame:
    """Read lines -> remove dots -> collapse white space -> write next to the input
    with the suffix -> return the (lines, changed) report."""
    lines = spark.read.text(path).select(F.col("value").alias("before"))  # the report needs no line numbers
    cleaned = C.line_cleanup(lines)
    write_lines(cleaned, out_path or suffixed(path))
    return C.line_cleanup_report(cleaned)
