"""Helpers shared by the operators of this subpackage: Arrow kernels over text
columns, word boundaries on raw bytes, and tables written to the shared folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.session import ensure_checkpoint_dir, scratch_path, ship_package

#: bytes of text that a kernel handles at a time; one longer document is a slice of its own
SLICE_BYTES = 1 << 19

WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable by Python workers, know the shared folder, and bound
    the Arrow batches by bytes: they carry whole texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    ensure_checkpoint_dir(spark)
    return spark


def source_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, so that
    later jobs neither recompute it nor depend on an executor that may be lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that clashes with none of ``df`` (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}{k}"
    return name


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row; a column that holds a map anywhere, which Spark does not
    hash, is hashed as JSON."""

    def has_map(t) -> bool:
        if isinstance(t, T.MapType):
            return True
        if isinstance(t, T.ArrayType):
            return has_map(t.elementType)
        return isinstance(t, T.StructType) and any(has_map(f.dataType) for f in t)

    one = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if has_map(f.dataType) else F.col(f"`{f.name}`")
    return F.xxhash64(*[one(f) for f in df.schema.fields])


def fold(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null for a null id)."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(col.cast("string").cast("binary")) % n


# ------------------------------------------------------------------ Arrow kernels


def task(run: Callable) -> Callable:
    """A map over Arrow batches that hands freed memory back when the task ends: a Python
    worker serves many tasks and would otherwise keep the peak of each kind."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc only
        trim(0)


def bounds(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls; offsets start at 0."""
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    _, offs, data = text.buffers()
    if len(text) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    off = np.frombuffer(offs, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, col: int, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows holding about ``max_bytes`` of text, with their texts (null: empty)."""
    text = batch.column(col)
    if text.null_count:
        text = pc.fill_null(text, "")
    _, off = bounds(text)
    start = 0
    while start < len(text):
        end = max(start + 1, int(np.searchsorted(off, off[start] + max_bytes, "right")) - 1)
        yield batch.slice(start, end - start), text.slice(start, end - start)
        start = end


def annotate(
    df: DataFrame,
    text_col: str,
    make_kernel: Callable[[], Callable[[pa.Array], list]],
    fields: T.StructType,
    into: str,
    max_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """All columns of ``df`` and one struct column ``into``, computed from the text.

    ``make_kernel()`` is called once per task; the kernel maps the texts of a slice to
    one Arrow array (or NumPy array) per field.  Rows pass in place: nothing is shuffled.
    """
    at = df.columns.index(text_col)
    arrow = [pa.field(f.name, _arrow(f.dataType), f.nullable) for f in fields]
    schema = T.StructType([*df.schema.fields, T.StructField(into, fields, False)])

    def run(batches):
        kernel = make_kernel()
        for batch in batches:
            for part, text in slices(batch, at, max_bytes):
                cols = [c if isinstance(c, pa.Array) else pa.array(c) for c in kernel(text)]
                cols = [c if c.type == f.type else c.cast(f.type) for c, f in zip(cols, arrow, strict=True)]
                out = pa.StructArray.from_arrays(cols, fields=arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*part.schema.names, into])

    return df.mapInArrow(task(run), schema)


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(pa.field("element", _arrow(t.elementType), t.containsNull))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType), f.nullable) for f in t])
    return {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(),
        T.BooleanType: pa.bool_(), T.StringType: pa.string(), T.BinaryType: pa.binary(),
    }[type(t)]


# ------------------------------------------------------------------ words on raw bytes


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per document, the index of
    its first word (with one more entry for the end)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ws = WS[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = ~ws
    first[1:] &= ws[:-1] | edge[1:n]
    last = ~ws
    last[:-1] &= ws[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def pick(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings ``buf[starts:ends]`` (ordered, not overlapping) as an Arrow array."""
    mark = np.zeros(len(buf) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    data = buf[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    off = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Integer codes of the values and the distinct values they stand for."""
    if len(values) == 0:
        return np.zeros(0, np.int64), values
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of a per-byte (or per-word) array between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def sampled_ids(labels: DataFrame, column: str, per_class: int, id_col: str = "doc_id", keep: Column | None = None) -> DataFrame:
    """At most ``per_class`` labelled ids of each class 0 and 1 of ``column``, by hash order.

    Reads the narrow label table only; a repeated id counts once with its larger label;
    null ids and null labels are left out.
    """
    named = labels.select(F.col(id_col).alias("_id"), F.col(column).cast("int").alias("_y"))
    named = named.where("_id is not null and _y is not null")
    if keep is not None:
        named = named.where(keep)
    one = named.groupBy("_id").agg(F.max("_y").alias("_y"))
    parts = [
        one.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)
    ]
    return parts[0].unionByName(parts[1])
