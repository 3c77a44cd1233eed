"""Token-id shards as wavelet matrices: succinct bit-planes in one compressed file each.

A shard holds the ids of consecutive documents.  Its planes hold one bit of every id, from
the highest bit down; below each plane the ids with bit 0 come first, in order, then those
with bit 1.  Sampled rank counts make access, counting (rank) and occurrence lookup
(select) possible on the planes alone.  A shard file is one Parquet file of one row, whose
payload holds the document table and the planes, each plane compressed by itself; so any
store that Spark writes to will do, and a lost task's file is replaced by its retry.

Documents are laid out in ascending id order (null ids first, rows with one id by text
hash); every document ends with ``end_id``.

Defined results: a null text is empty and holds the end id only; an empty table gives no
file and reads back as no rows; a document longer than a shard has a shard of its own.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.llm import common as C
from lexiflow.llm import pieces as P
from lexiflow.llm.lexicon import default_file
from lexiflow.session import scratch_path

MAGIC = b"WVM1"
SHARD_IDS = 1 << 21
TEXT_SLICE = 4 << 20
RANK_BITS = 512  # bits between two sampled ranks
MEMO = 300_000  # pieces whose ids a Python worker remembers, and those of one slice
BLOCK = 1 << 16  # ids that a plane moves at a time: they stay in the cache
END_ID = 1


class WaveletMatrix:
    """Planes of a sequence of ids below ``2 ** n_planes``."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros  # planes: packed bits
        self._rank: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        x = ids.astype(np.uint16 if top < 1 << 16 else np.uint32, copy=False)
        planes, zeros = [], []
        for b in range(max(1, top.bit_length()) - 1, -1, -1):
            bit = x & x.dtype.type(1 << b) != 0
            planes.append(np.packbits(bit))
            zeros.append(len(x) - int(np.count_nonzero(bit)))
            y = np.empty_like(x)
            for part, low, one, high in cls._moves(bit, zeros[-1]):
                y[low], y[high] = x[part].take(np.flatnonzero(~one)), x[part].take(np.flatnonzero(one))
            x = y
        return cls(len(ids), planes, zeros)

    @staticmethod
    def _moves(bit: np.ndarray, zeros: int) -> Iterator[tuple[slice, slice, np.ndarray, slice]]:
        """Block by block: its places above a plane, where its ids with bit 0 go below, its
        bits, and where its ids with bit 1 go."""
        a, b = 0, zeros
        for start in range(0, len(bit), BLOCK):
            one = bit[start : start + BLOCK]
            n = int(np.count_nonzero(one))
            yield slice(start, start + len(one)), slice(a, a + len(one) - n), one, slice(b, b + n)
            a, b = a + len(one) - n, b + n

    def _bits(self, k: int) -> np.ndarray:
        return np.unpackbits(self.planes[k], count=self.n).view(bool)

    def decode(self) -> np.ndarray:
        """The whole sequence: planes are undone from the lowest bit up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for k in range(len(self.planes) - 1, -1, -1):
            x[self.zeros[k] :] |= kind(1 << (len(self.planes) - 1 - k))
            y = np.empty(self.n, kind)
            for part, low, one, high in self._moves(self._bits(k), self.zeros[k]):
                block = y[part]
                block[np.flatnonzero(~one)], block[np.flatnonzero(one)] = x[low], x[high]
            x = y
        return x

    def _ranks(self) -> list[np.ndarray]:
        if self._rank is None:
            self._rank = []
            for p in self.planes:
                step = RANK_BITS // 8
                ones = np.bitwise_count(np.pad(p, (0, -len(p) % step)).reshape(-1, step)).sum(1, dtype=np.int64)
                self._rank.append(np.concatenate([[0], np.cumsum(ones)]))
        return self._rank

    def _rank1(self, k: int, i: int) -> int:
        """Ones among the first ``i`` bits of plane ``k``."""
        block = i // RANK_BITS
        a = block * (RANK_BITS // 8)
        part = self.planes[k][a : a + (i - block * RANK_BITS + 7) // 8]
        ones = int(self._ranks()[k][block])
        if len(part):
            ones += int(np.bitwise_count(part[:-1]).sum())
            rest = i - (a + len(part) - 1) * 8
            ones += (int(part[-1]) >> (8 - rest)).bit_count()
        return ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k, z in enumerate(self.zeros):
            bit = (int(self.planes[k][i >> 3]) >> (7 - (i & 7))) & 1
            ones = self._rank1(k, i)
            i = z + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token < 0 or token.bit_length() > len(self.planes):
            return 0, 0
        for k, z in enumerate(self.zeros):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            lo, hi = (z + a, z + b) if token >> (len(self.planes) - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` among the first ``i`` ids."""
        lo, hi = self._range(token, 0, min(i, self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """Place of occurrence ``j`` (from 0) of ``token``."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        i = lo + j
        for k in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def _select(self, k: int, bit: int, j: int) -> int:
        """Place of the ``j``-th (from 0) ``bit`` of plane ``k``."""
        ones = self._ranks()[k]
        seen = ones if bit else np.arange(len(ones)) * RANK_BITS - ones
        block = int(np.searchsorted(seen, j, "right")) - 1
        a = block * (RANK_BITS // 8)
        bits = np.unpackbits(self.planes[k][a : a + RANK_BITS // 8])
        return block * RANK_BITS + int(np.flatnonzero(bits == bit)[j - int(seen[block])])

    def occurrences(self, token: int) -> np.ndarray:
        """All places of ``token``, ascending."""
        return np.array([self.select(token, j) for j in range(self.count(token))], np.int64)


def pack(doc_ids: list[int | None], lengths: np.ndarray, wm: WaveletMatrix) -> bytes:
    """File payload: magic, header length, header (JSON), compressed parts."""
    z = zstandard.ZstdCompressor(level=1)
    known = np.array([i is not None for i in doc_ids], bool)
    table = [
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.packbits(known).tobytes(), lengths.astype("<i8").tobytes(),
    ]
    parts = [z.compress(p) for p in [*table, *(x.tobytes() for x in wm.planes)]]
    head = json.dumps({"n": wm.n, "docs": len(doc_ids), "zeros": wm.zeros, "sizes": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


def unpack(payload: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    if payload[:4] != MAGIC:
        raise ValueError("not a wavelet matrix shard")
    (size,) = struct.unpack_from("<I", payload, 4)
    head = json.loads(payload[8 : 8 + size])
    z, at, parts = zstandard.ZstdDecompressor(), 8 + size, []
    for n in head["sizes"]:
        parts.append(np.frombuffer(z.decompress(payload[at : at + n]), np.uint8))
        at += n
    known = np.unpackbits(parts[1], count=head["docs"]).astype(bool).tolist()
    ids = [i if k else None for i, k in zip(parts[0].view("<i8").tolist(), known, strict=True)]
    return ids, parts[2].view("<i8"), WaveletMatrix(head["n"], parts[3:], head["zeros"])


def id_kind(tok) -> type:
    return np.uint16 if max(tok.get_vocab(with_added_tokens=True).values()) < 1 << 16 else np.uint32


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct piece that is not remembered.

    Pieces cut by the fast path are normalised and split already: they go to the library's
    model, many to a call, split at white space; the id that ends a piece carries the
    end-of-word suffix.  Chunks outside the fast path go through the whole tokenizer.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_str(file)
        self.plain = Tokenizer(self.tok.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.kind = id_kind(self.tok)
        self.sign = np.array([ord(c) for c in P.byte_alphabet()], "<u4")
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith(self.tok.model.end_of_word_suffix)]] = True
        self.memo: dict[bytes, int] = {}  # the first MEMO pieces met, by number
        self.pool, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _joined(self, pieces: pa.Array, many: int = 512) -> list[str]:
        """The pieces in printable characters, a space between two, ``many`` to a string."""
        buf, off = C.bounds(pieces)
        n = len(pieces)
        if n == 0:
            return []
        text = np.full(len(buf) + n, 0x20, "<u4")
        text[np.arange(len(buf)) + np.repeat(np.arange(n), np.diff(off))] = self.sign[buf]
        at = [*range(0, n, many), n]
        cuts = (off[at] + at).tolist()
        return [text[a : b - 1].tobytes().decode("utf-32-le") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _library(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece)."""
        strange = P.odd(pieces)
        plain = pieces.filter(pa.array(~strange))
        got = self.plain.encode_batch_fast(self._joined(plain), add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for e in got)])
        stop = np.flatnonzero(self.last[ids]) + 1
        if len(stop) != len(plain):
            raise RuntimeError("the model does not end every piece with its word suffix")
        odd = [self.tok.encode(p.decode(), add_special_tokens=False).ids for p in pieces.filter(pa.array(strange)).to_pylist()]
        size = np.zeros(len(pieces), np.int64)
        size[~strange] = np.diff(stop, prepend=0)
        size[strange] = [len(x) for x in odd]
        out = np.zeros(int(size.sum()), np.int32)
        fill = np.repeat(strange, size)
        out[~fill] = ids
        out[fill] = [i for x in odd for i in x]
        return out, size

    def resolve(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = distinct.to_numpy(zero_copy_only=False).tolist()  # bytes; to_pylist is slower by far
        at = np.fromiter(map(self.memo.get, raw, repeat(-1)), np.int64, len(raw))
        new = np.flatnonzero(at < 0)
        ids, size = self._library(distinct.take(pa.array(new)))
        ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        pool = np.concatenate([self.pool, ids])
        at[new] = np.arange(len(self.ends) - 1, len(ends) - 1)
        if len(self.memo) < MEMO:
            self.memo.update((raw[i], k) for i, k in zip(new.tolist(), at[new].tolist(), strict=True))
            self.pool, self.ends = pool, ends
        return ends[at], ends[at + 1] - ends[at], pool

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, first = P.cut(text)
        code, distinct = C.codes(pieces)
        return P.gather(code, first, *self.resolve(distinct))


@lru_cache(maxsize=1)
def worker_encoder(file: str) -> LibraryEncoder:
    """The encoder of this Python worker: it serves many tasks.  A task has one slot, so the
    library's own threads would only take those of other tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryEncoder(file)


SHARD_SCHEMA = "part long, shard long, part_start long, n_ids long, n_docs long, payload binary"


def encoded(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(id, h, n, ids): ids of every document with the end id, compressed; texts are encoded
    where they lie, and only these rows move.  ``h`` is a hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(file)

    def run(batches):
        enc, z = worker_encoder(shared.value), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for rows, text in C.slices(batch, 2, TEXT_SLICE):
                flat, off = enc(text)
                flat = flat.astype(enc.kind)
                end = np.array([end_id], enc.kind).tobytes()
                blobs = [z.compress(flat[a:b].tobytes() + end) for a, b in zip(off[:-1], off[1:], strict=True)]
                cols = [rows.column(0), rows.column(1), pa.array(np.diff(off) + 1), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "h", "n", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return src.mapInArrow(C.task(run), "id long, h long, n long, ids binary")


def write_shards(docs: DataFrame, path: str, file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode the documents and write them in ascending id order, one file per shard."""
    from tokenizers import Tokenizer

    rows = C.stored(encoded(docs, file, id_col, text_col, end_id), "wavelet-ids")
    laid = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").withColumn("part", F.spark_partition_id().cast("long"))
    kind = id_kind(Tokenizer.from_str(file))

    def run(batches):
        z = zstandard.ZstdDecompressor()
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = start = number = part = 0

        def flush():
            nonlocal ids, names, held, start, number
            wm = WaveletMatrix.build(np.concatenate(ids))
            row = [[part], [number], [start], [held], [len(names)], [pack(names, np.array([len(x) for x in ids]), wm)]]
            kinds = [pa.int64()] * 5 + [pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in SHARD_SCHEMA.split(", ")])
            start, number = start + held, number + 1
            ids, names, held = [], [], 0
            return out

        for batch in batches:
            for name, n, blob, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held + n > shard_ids:  # whole documents up to the size of a shard
                    yield flush()
                ids.append(np.frombuffer(z.decompress(blob), kind))
                names.append(name)
                held += n
        if held:
            yield flush()

    shards = laid.select("id", "n", "ids", "part").mapInArrow(C.task(run), SHARD_SCHEMA)
    shards.write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(path)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): ids before each written partition; as many rows as tasks that wrote."""
    n = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return n.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) from the shard files; ids as little-endian unsigned 32 bit."""
    rows = spark.read.parquet(path).join(F.broadcast(part_starts(spark, path)), "part")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                names, sizes, wm = unpack(batch.column(1)[i].as_py())
                ids = wm.decode().astype("<u4")
                ends = np.cumsum(sizes)
                first = batch.column(0)[i].as_py()
                a = 0
                while a < len(names):
                    done = int(ends[a - 1]) if a else 0
                    b = max(a + 1, int(np.searchsorted(ends, done + (1 << 20), "right")))
                    offs = np.concatenate([[0], ends[a:b] - done]) * 4
                    data = ids[done : int(ends[b - 1])]
                    raw = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[a:b], pa.int64()), pa.array(first + ends[a:b] - sizes[a:b]), raw], names=["doc_id", "start", "ids"]
                    )
                    a = b

    where = rows.select((F.col("base") + F.col("part_start")).alias("first"), "payload")
    return where.mapInArrow(C.task(run), "doc_id long, start long, ids binary")


def lookup(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(position) of every occurrence of ``token`` in the whole sequence, from the planes."""
    rows = spark.read.parquet(path).join(F.broadcast(part_starts(spark, path)), "part")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                at = unpack(batch.column(1)[i].as_py())[2].occurrences(token)
                yield pa.RecordBatch.from_arrays([pa.array(at + batch.column(0)[i].as_py())], names=["position"])

    return rows.select((F.col("base") + F.col("part_start")).alias("first"), "payload").mapInArrow(C.task(run), "position long")


def count(spark: SparkSession, path: str, token: int) -> int:
    """Occurrences of ``token`` in all shards, from the planes."""

    def run(batches):
        for batch in batches:
            n = [unpack(p.as_py())[2].count(token) for p in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])

    return int(spark.read.parquet(path).select("payload").mapInArrow(C.task(run), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def query(spark, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    path = scratch_path(spark, "wavelet-shards")
    write_shards(C.source_table(spark, sf_dir, "documents").select("doc_id", "text"), path, default_file())
    docs = read_documents(spark, path)
    return docs.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
