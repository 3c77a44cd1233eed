"""Packing by lexical retrieval: a sharded BM25 inverted index fills every window.

Documents are encoded (an end id closes each), and packed into windows of at most ``window``
ids.  The first unused document of a shard is the seed of a window; the index returns the
unused neighbours of the seed by BM25 over token ids, and they greedily fill what the seed
leaves free, best first.  The last one is cut where the window ends; its rest is the seed of
the next window, so no window inside a shard has padding.  A document that shares no scoring
term with the seed comes after all that do, in the order of the shard.  The last, partial
window of a shard is cut into sequences whose lengths are powers of two, which need no
padding either.

The index is sharded so that neighbours meet: documents are ordered by three min-hashes of
their token ids, weighted by inverse document frequency over the whole corpus (a table as
long as the vocabulary), and the order is cut into shards of about ``SHARD_TOKENS``.  The last
sort key is a hash of the row, so a group of copies of any size spreads over as many shards
as it needs; every document is in exactly one shard, is a seed or a neighbour once, and no
posting list is cut.  A document longer than a shard is a shard of its own.

Defined results: a null or empty text is one end id; repeated rows are documents of their
own; a null id is carried through; an empty table gives no pieces.  ``sequence_id`` is unique
and does not depend on names of other columns, which are not read.
"""

from __future__ import annotations

import json
import math
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm import common as C
from lexiflow.llm.lexicon import read_file

WINDOW = 1024
END_ID = 0
SHARD_TOKENS = 1 << 20
PARTITION_SHARDS = 4
K1, B = 1.2, 0.75
HASHES = 3
TEXT_SLICE = 4 << 20

#: pre-tokenisation of byte-level BPE files that name no pattern of their own (fixed value)
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PLAIN = np.zeros(256, bool)  # bytes of ASCII text and of the letters of Latin-1
_PLAIN[[0x09, 0x0A, 0x0D, *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3]] = True


class Encoder:
    """Ids as the ``tokenizers`` library gives them for a byte-level BPE file.

    Texts of plain bytes without a special token's string go to ``tiktoken`` with the same
    vocabulary (if the file's merges are its ids in order), each distinct chunk once; all
    others go to ``tokenizers`` whole.
    """

    def __init__(self, file: str):
        self.file = file
        spec = json.loads(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._fast(spec)
        if self.fast is not None:
            self.id_size = np.array([len(self.fast.decode_single_token_bytes(i)) for i in range(self.fast.n_vocab)])

    @cached_property
    def tok(self):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(self.file)
        tok.no_truncation()
        tok.no_padding()
        return tok

    @staticmethod
    def _fast(spec: dict):
        import tiktoken

        from lexiflow.llm.pieces import byte_alphabet

        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or spec.get("normalizer") or model["type"] != "BPE" or model.get("dropout"):
            return None
        byte_of = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        in_order = [vocab.get(a + b) for a, b in pairs]
        if in_order != list(range(256, 256 + len(pairs))) or any(c not in byte_of for t in vocab for c in t):
            return None
        ranks = {b"".join(byte_of[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by ``end_id``; where each text's ids begin, and the end)."""
        buf, off = C.bounds(text)
        whole = C.per_doc(~_PLAIN[buf], off) > 0
        if self.fast is None:
            whole[:] = True
        elif self.special:
            for x in self.special:
                whole |= pc.match_substring(text, x).to_numpy(zero_copy_only=False)
        # a chunk begins at each text, and at a space before a sign: no pre-token spans such a place
        begins = np.zeros(len(buf) + 1, bool)
        begins[:-2] = (buf[:-1] == 0x20) & ~C.WS[buf[1:]] if len(buf) > 1 else False
        begins[off] = True
        begins[-1] = False
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(buf))
        first = np.searchsorted(starts, off)
        plain = np.repeat(~whole, np.diff(first))
        chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(buf)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])
        code, distinct = C.codes(chunks.filter(pa.array(plain)))
        at, size, pool = self._resolved(distinct)
        # texts that the library takes whole, and the end id, follow in the pool
        odd = np.flatnonzero(whole)
        extra = [np.array(self.tok.encode(text[int(d)].as_py(), add_special_tokens=False).ids, np.uint32) for d in odd]
        extra.append(np.array([end_id], np.uint32))
        extra_size = np.array([len(x) for x in extra])
        extra_at = len(pool) + np.cumsum(extra_size) - extra_size
        pool = np.concatenate([pool, *extra])
        # parts of each text in order: its chunks (or its whole), then the end id
        n = len(text)
        many = np.where(whole, 1, np.diff(first))
        close = np.cumsum(many + 1) - 1
        part_at, part_size = np.empty(int(many.sum()) + n, np.int64), np.empty(int(many.sum()) + n, np.int64)
        part_at[close], part_size[close] = extra_at[-1], 1
        alone = close[odd] - 1
        part_at[alone], part_size[alone] = extra_at[:-1], extra_size[:-1]
        rest = np.ones(len(part_at), bool)
        rest[close] = rest[alone] = False
        part_at[rest], part_size[rest] = at[code], size[code]
        stop = np.cumsum(part_size)
        ids = pool[np.repeat(part_at - (stop - part_size), part_size) + np.arange(int(stop[-1]) if n else 0)]
        return ids, np.concatenate([[0], stop[close]]) if n else np.zeros(1, np.int64)

    def _resolved(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length) of the ids of each chunk in the pool, and the pool."""
        buf, off = C.bounds(chunks)
        size = np.diff(off)
        # chunks that begin with a space and a sign stay apart when they are joined
        apart = np.zeros(len(chunks), bool)
        two = np.flatnonzero(size > 1)
        apart[two] = (buf[off[two]] == 0x20) & ~C.WS[buf[off[two] + 1]]
        joined = chunks.filter(pa.array(apart))
        text, ends = C.bounds(joined)
        ids = self.fast.encode_to_numpy(text.tobytes().decode(), disallowed_special=()) if len(text) else np.zeros(0, np.uint32)
        stop = np.searchsorted(np.cumsum(self.id_size[ids]), ends[1:]) + 1
        rest = np.flatnonzero(~apart)
        others = [np.array(self.fast.encode_ordinary(chunks[int(i)].as_py().decode()), np.uint32) for i in rest]
        many = np.zeros(len(chunks), np.int64)
        many[apart] = np.diff(stop, prepend=0)
        at = np.zeros(len(chunks), np.int64)
        at[apart] = stop - many[apart]
        many[rest] = [len(x) for x in others]
        at[rest] = len(ids) + np.cumsum(many[rest]) - many[rest]
        return at, many, np.concatenate([ids, *others])


DOCUMENT, FREQUENCY = 0, 1


def encoded(docs: DataFrame, file: str, vocab: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(kind, row, id, n, ids): per document its ids with the end id, compressed; and per task and id that occurs (as ``row``) the number ``n`` of its documents that hold it."""
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(file)
    names = ["kind", "row", "id", "n", "ids"]
    width = id_bytes(vocab)

    def run(batches):
        enc, z = Encoder(shared.value), zstandard.ZstdCompressor(level=3)
        total, last = np.zeros(vocab, np.int64), np.zeros(vocab, np.int64)
        for batch in batches:
            for part, text in C.slices(batch, 2, TEXT_SLICE):
                ids, off = enc.encode(text, end_id)
                place = np.arange(len(ids))
                blobs = []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    own = ids[a:b]
                    last[own] = place[a:b]  # of equal ids one place stays
                    total[own[last[own] == place[a:b]]] += 1
                    blobs.append(z.compress(own.astype(f"<u{width}").tobytes()))
                cols = [pa.array(np.zeros(len(part), np.int32)), part.column(0), part.column(1), pa.array(np.diff(off)), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        some = np.flatnonzero(total)
        cols = [pa.array(np.full(len(some), FREQUENCY, np.int32)), pa.array(some), pa.nulls(len(some), pa.int64()), pa.array(total[some]), pa.nulls(len(some), pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(C.task(run), "kind int, row long, id long, n long, ids binary")


def id_bytes(vocab: int) -> int:
    return 2 if vocab <= 1 << 16 else 4


def _values(blob: bytes, width: int, z: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.frombuffer(z.decompress(blob), f"<u{width}")


def document_frequency(rows: DataFrame, vocab: int) -> np.ndarray:
    """In how many documents each id occurs; as long as the vocabulary, whatever the corpus."""
    counts = rows.where(F.col("kind") == FREQUENCY).groupBy("row").agg(F.sum("n").alias("df")).toArrow()
    out = np.zeros(vocab, np.int64)
    out[counts["row"].to_numpy()] = counts["df"].to_numpy()
    return out


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    """BM25's weight; 0 for an id in half of the documents or more, which tells nothing apart."""
    return np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0.0)


def hash_ranks(idf: np.ndarray) -> np.ndarray:
    """For each of ``HASHES`` min-hashes the rank of every id: exponential draws divided by the
    weight, so an id comes first with a chance in proportion to it."""
    ids = np.arange(len(idf), dtype=np.uint64)
    out = []
    for k in range(HASHES):
        u = (C.mix64(ids + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) >> np.uint64(11)).astype(np.float64) / 2**53
        draw = -np.log1p(-u) / np.maximum(idf, 1e-9)
        rank = np.empty(len(idf), np.int32)
        rank[np.lexsort((ids, draw))] = np.arange(len(idf), dtype=np.int32)
        out.append(rank)
    return np.stack(out)


def _signatures(rows: DataFrame, ranks, width: int) -> DataFrame:
    """(row, id, ids, h0, h1, h2): the compressed ids with their min-hashes."""
    names = [f"h{k}" for k in range(HASHES)]

    def run(batches):
        z = zstandard.ZstdDecompressor()
        table = ranks.value
        for batch in batches:
            best = np.zeros((len(batch), HASHES), np.int64)
            for i, blob in enumerate(batch.column(2)):
                best[i] = table[:, _values(blob.as_buffer(), width, z)].min(1)
            # equal hashes stay together, but long documents, whose ranks are low, do not
            mixed = [C.mix64(best[:, k].astype(np.uint64)).view(np.int64) for k in range(HASHES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, mixed)], names=["row", "id", "ids", *names])

    return rows.select("row", "id", "ids").mapInArrow(C.task(run), "row long, id long, ids binary, " + ", ".join(f"{n} long" for n in names))


class Index:
    """BM25 inverted index of one shard; ``terms[first[d]:first[d + 1]]`` are the postings'
    terms of document ``d``, ``post``/``weight`` the postings by term."""

    def __init__(self, ids: np.ndarray, off: np.ndarray, idf: np.ndarray, mean_length: float):
        n, size = len(off) - 1, np.diff(off)
        doc = np.repeat(np.arange(n), size)
        key = doc * len(idf) + ids
        key = key[idf[ids] > 0]
        key, tf = np.unique(key, return_counts=True)
        doc, term = key // len(idf), key % len(idf)
        w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean_length))
        used, local, df = np.unique(term, return_inverse=True, return_counts=True)
        order = np.argsort(local, kind="stable")
        self.n, self.post, self.weight = n, doc[order].astype(np.int32), w[order]
        self.ends = np.cumsum(df)
        self.begin, self.df = self.ends - df, df
        shared = df[local] > 1  # a term of one document finds no neighbour
        self.terms = local[shared]
        self.first = np.searchsorted(doc[shared], np.arange(n + 1))

    def drop_used(self, unused: np.ndarray) -> None:
        """Leave out the postings of used documents, which are never returned again."""
        keep = unused[self.post]
        before = np.concatenate([[0], np.cumsum(keep)])
        self.post, self.weight = self.post[keep], self.weight[keep]
        self.begin, ends = before[self.begin], before[self.ends]
        self.ends, self.df = ends, ends - self.begin

    def scores(self, d: int) -> np.ndarray:
        """BM25 of every document of the shard for the distinct terms of document ``d``."""
        t = self.terms[self.first[d] : self.first[d + 1]]
        if not len(t):
            return np.zeros(self.n)
        many = self.df[t]
        at = np.repeat(self.begin[t] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return np.bincount(self.post[at], self.weight[at], self.n)


def pack_shard(off: np.ndarray, index: Index, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces of a shard."""
    size = np.diff(off).tolist()
    n, unused = len(size), np.ones(len(size), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    seq, filled, nxt, left = 0, 0, 0, n
    seed, start = -1, 0  # the document that opens the window, and its ids already packed
    ranked: list[int] = []
    indexed = n
    while left or seed >= 0:
        if seed < 0:
            if ranked:
                seed = ranked.pop()
            else:
                while not unused[nxt]:
                    nxt += 1
                seed = nxt
            unused[seed] = False
            left -= 1
            start = 0
        take = min(window - filled, size[seed] - start)
        pieces.append((seed, start, take, seq, filled))
        opens, filled, start = filled == 0, filled + take, start + take
        done = seed
        if start == size[seed]:
            seed = -1
        if filled == window:
            seq, filled, ranked = seq + 1, 0, []
        elif opens and left:
            if 2 * left < indexed:
                index.drop_used(unused)
                indexed = left
            ranked = _neighbours(index, done, unused, window - filled, size)
    return pieces if not filled else _split_tail(pieces, seq, filled)


def _neighbours(index: Index, seed: int, unused: np.ndarray, free: int, size: list[int]) -> list[int]:
    """Unused documents that share a scoring term with the seed, the best last, enough to fill
    ``free`` ids (or all there are); equal scores by place in the shard."""
    score = index.scores(seed)
    score[~unused] = 0
    k = 8
    while True:
        least = score[np.argpartition(score, index.n - k)[index.n - k :]].min() if k < index.n else 0.0
        # all documents with the least score taken, so that ties are by place
        at = np.flatnonzero(score >= least) if least > 0 else np.flatnonzero(score)
        if least <= 0 or sum(size[i] for i in at) >= free:
            break
        k *= 4
    return at[np.lexsort((-at, score[at]))].tolist()


def _split_tail(pieces: list, seq: int, filled: int) -> list:
    """The last window as sequences of a power of two each."""
    tail = [p for p in pieces if p[3] == seq]
    out = pieces[: len(pieces) - len(tail)]
    bounds = [0]
    for bit in reversed(range(filled.bit_length())):
        if filled >> bit & 1:
            bounds.append(bounds[-1] + (1 << bit))
    for k in range(len(bounds) - 1):
        lo, hi = bounds[k], bounds[k + 1]
        for doc, start, n, _, at in tail:
            a, b = max(at, lo), min(at + n, hi)
            if a < b:
                out.append((doc, start + a - at, b - a, seq + k, a - lo))
    return out


PIECES = "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of sequences: (id, start, length, doc_tokens, sequence_id, offset, ids) with the
    ids of the piece as little-endian unsigned 32-bit integers.

    ``file``: content of a byte-level BPE file of the ``tokenizers`` library; ``window`` is a
    power of two.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    sc = docs.sparkSession.sparkContext
    spec = json.loads(file)
    vocab = 1 + max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    width = id_bytes(vocab)
    stored = C.stored(encoded(docs, file, vocab, id_col, text_col, end_id), "packing-ids")
    rows = stored.where(F.col("kind") == DOCUMENT)
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("tokens")).first()
    n, tokens = int(whole["n"]), int(whole["tokens"] or 0)
    idf = idf_of(document_frequency(stored, vocab), n)
    ranks, weights = sc.broadcast(hash_ranks(idf)), sc.broadcast(idf)
    mean = tokens / max(1, n)
    parts = max(1, math.ceil(tokens / (shard_tokens * PARTITION_SHARDS)))
    keys = [*[f"h{k}" for k in range(HASHES)], F.xxhash64("row"), "row"]
    # written, as a range partitioning first samples its input, which would run the step twice
    signed = C.stored(_signatures(rows, ranks, width), "packing-signatures")
    ordered = signed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered = ordered.select(F.spark_partition_id().cast("long").alias("part"), "id", "ids")

    def run(batches):
        z, idf = zstandard.ZstdDecompressor(), weights.value
        held: list[tuple] = []
        size, seq = 0, None
        for batch in batches:
            for part, i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                seq = part << 32 if seq is None else seq
                ids = _values(blob.as_buffer(), width, z)
                held.append((i, ids))
                size += len(ids)
                if size >= shard_tokens:
                    seq = yield from _shard_rows(held, seq, idf, mean, window)
                    held, size = [], 0
        if held:
            yield from _shard_rows(held, seq, idf, mean, window)

    return ordered.mapInArrow(C.task(run), PIECES)


def _shard_rows(held: list, seq: int, idf: np.ndarray, mean: float, window: int):
    """Arrow batches of a shard's pieces; returns the first unused sequence number."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    off = np.concatenate([[0], np.cumsum([len(x) for _, x in held])])
    ids = np.concatenate([x for _, x in held])
    pieces = pack_shard(off, Index(ids.astype(np.int64), off, idf, mean), window)
    for a in range(0, len(pieces), 512):
        doc, start, length, s, at = (list(x) for x in zip(*pieces[a : a + 512], strict=True))
        blobs = [held[d][1][i : i + m].astype("<u4").tobytes() for d, i, m in zip(doc, start, length, strict=True)]
        longs = [[held[d][0] for d in doc], start, length, [len(held[d][1]) for d in doc], [seq + x for x in s], at]
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in longs], pa.array(blobs, pa.binary())], names=names)
    return seq + pieces[-1][3] + 1


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    C.prepare(spark)
    file = read_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = pack(C.source_table(spark, sf_dir, "documents"), file)
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
