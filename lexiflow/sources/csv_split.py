"""Records of large quoted CSV files, read by many tasks.

A newline inside a quoted field does not end a record, so a task that begins in the middle of
a file cannot tell where its first record starts.  But a line maps the two states that it can
begin in (outside or inside a quoted field) to the state that it ends in, and these maps
compose.  So

1. every split of every file reports its composed map and whether a record ends in it for
   either state (one row per split);
2. the maps are composed along each file, which gives the state that each split begins in;
3. every split emits the records that begin and end in it; what continues a record of an
   earlier split, or is left open at the end, is joined with its record's other parts.

Lines are those of Spark's own text reader, which cuts files at any byte.  Quotes count as in
the library's CSV readers: ``"`` opens a quoted field at the start of a field only (after blanks,
if those are ignored), ``""`` is a quote, and a field that goes on after its closing quote is an
unquoted one up to the delimiter.  Line ends are ``\\n`` or ``\\r\\n``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAST = 1 << 40  # row number of a record that is left open at the end of its split


def ends_inside(line: str, inside: bool, skip_blanks: bool) -> bool:
    """Whether a quoted field is open at the end of the line; ``inside``: at its start."""
    i, n = 0, len(line)
    while True:
        if inside:
            while True:
                i = line.find('"', i)
                if i < 0:
                    return True
                if i + 1 < n and line[i + 1] == '"':
                    i += 2
                    continue
                break
            i = line.find(",", i + 1)
            if i < 0:
                return False
            i += 1
            inside = False
        if skip_blanks:
            while i < n and line[i] <= " " and line[i] != ",":
                i += 1
        if i < n and line[i] == '"':
            i += 1
            inside = True
            continue
        i = line.find(",", i)
        if i < 0:
            return False
        i += 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _maps(lines: DataFrame, skip_blanks: bool) -> DataFrame:
    """(file, block, to_out, to_in, ends_out, ends_in, crlf): the state that a split ends in
    from either state, whether a record ends inside it, and whether its first line ends in CR."""

    def run(batches):
        now = None
        for b in batches:
            files, blocks, values = (c.to_pylist() for c in b.columns)
            for f, k, line in zip(files, blocks, values, strict=True):
                if now is None or now[0] != f or now[1] != k:
                    if now is not None:
                        yield _rows([now])
                    now = [f, k, False, True, False, False, line.endswith("\r")]
                if '"' in line:
                    now[2], now[3] = ends_inside(line, now[2], skip_blanks), ends_inside(line, now[3], skip_blanks)
                now[4] = now[4] or not now[2]
                now[5] = now[5] or not now[3]
        if now is not None:
            yield _rows([now])

    names = ["file", "block", "to_out", "to_in", "ends_out", "ends_in", "crlf"]

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=names)

    return lines.mapInArrow(run, "file string, block long, to_out boolean, to_in boolean, ends_out boolean, ends_in boolean, crlf boolean")


def _starts(maps: list) -> dict[tuple[str, int], tuple[bool, int, bool]]:
    """(file, block) -> (begins inside a quoted field, block where that record began, CR LF)."""
    out: dict[tuple[str, int], tuple[bool, int, bool]] = {}
    now = None
    for r in sorted(maps, key=lambda r: (r["file"], r["block"])):
        if now is None or now[0] != r["file"]:
            now = (r["file"], False, r["block"], r["crlf"])
        _, inside, owner, crlf = now
        out[r["file"], r["block"]] = (inside, owner, crlf)
        after = r["to_in"] if inside else r["to_out"]
        # a record that is open at the end began here, unless this split only continues one
        if after and (not inside or r["ends_in"]):
            owner = r["block"]
        now = (r["file"], after, owner, crlf)
    return out


def records(spark: SparkSession, path: str, skip_blanks: bool = True) -> DataFrame:
    """(file_path, block_start, row_id, record, crlf): every record of the files, by
    (block_start, row_id) in file order; empty ones (``skip_blanks``: blank ones too) are left
    out.  ``crlf``: the lines of the file end in CR LF, also those inside the record."""
    lines = _lines(spark, path)
    starts = _starts(_maps(lines, skip_blanks).collect())  # one row per split
    shared = spark.sparkContext.broadcast(starts)
    names = ["file_path", "block_start", "row_id", "part", "record", "whole", "crlf"]

    def run(batches):
        table = shared.value
        key, held, row, part, owner, inside, crlf = None, [], 0, 0, 0, False, False
        out: list[tuple] = []

        def text(ended):
            if ended and crlf and held[-1].endswith("\r"):
                held[-1] = held[-1][:-1]
            return "\n".join(held)

        def close(whole):
            nonlocal held, row, part, owner
            if part:  # of a record that began in an earlier split
                out.append((key[0], owner, LAST, part, text(whole), False, crlf))
                part, owner = 0, key[1]
            elif whole:
                out.append((key[0], key[1], row, 0, text(True), True, crlf))
            else:
                out.append((key[0], key[1], LAST, 1, text(False), False, crlf))
            row += 1
            held = []

        def batch():
            cols = [pa.array(x) for x in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            files, blocks, values = (c.to_pylist() for c in b.columns)
            for f, k, line in zip(files, blocks, values, strict=True):
                if key != (f, k):
                    if held:
                        close(False)
                    key = (f, k)
                    inside, owner, crlf = table[key]
                    row, part = 0, 2 + k if inside else 0
                held.append(line)
                if '"' in line:
                    inside = ends_inside(line, inside, skip_blanks)
                if not inside:
                    close(True)
                if len(out) >= 4096:
                    yield batch()
        if held:
            close(False)
        if out:
            yield batch()

    rows = lines.mapInArrow(run, "file_path string, block_start long, row_id long, part long, record string, whole boolean, crlf boolean")
    done = rows.where("whole").select("file_path", "block_start", "row_id", "record", "crlf")
    # at most two rows per split take part in this shuffle
    parts = rows.where("not whole").groupBy("file_path", "block_start", "row_id", "crlf")
    parts = parts.agg(F.sort_array(F.collect_list(F.struct("part", "record"))).alias("s"))
    joined = parts.select("file_path", "block_start", "row_id", F.array_join(F.transform("s", lambda x: x["record"]), "\n").alias("record"), "crlf")
    blank = "record rlike '^[\\\\x00-\\\\x20]*$'" if skip_blanks else "record = ''"
    return done.unionByName(joined).where(f"not ({blank})")


def split_count(spark: SparkSession, path: str, skip_blanks: bool = True) -> int:
    """How many tasks' splits the files have."""
    return _lines(spark, path).select("file", "block").distinct().count()


def is_large(spark: SparkSession, path: str) -> bool:
    """Whether a file is larger than one split (sizes only; no content is read)."""
    most = spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728b")
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(most)
    size = spark.read.format("binaryFile").load(path).agg(F.max("length").alias("n")).first()["n"]
    return bool(size) and int(size) > int(limit)
