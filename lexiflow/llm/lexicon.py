"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The most frequent pieces of the corpus (counted over all documents) and their ids are
compiled into a minimal acyclic automaton: equal suffixes share states.  The words that
every transition skips are stored with it, so a walk yields the word's number, and the
number its ids.  The file is shipped to the executors and memory-mapped there.  Pieces
outside the lexicon are merged exactly by the vocabulary's ranks.

Defined results: a null text is empty and has no ids; its decoded text is empty.  Special
tokens written in a text are encoded as such, as the tokenizer file asks.  Repeated rows
get equal results each.  The lexicon holds at most ``LEXICON_WORDS`` words; this bound
changes the speed only.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm import common as C
from lexiflow.llm import pieces as P

LEXICON_WORDS = 1 << 16
LONGEST = 24  # bytes of a lexicon word
TEXT_SLICE = 2 << 20
FIELDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])


class Transducer:
    """Memory-mappable automaton over bytes; ``find`` numbers the words it holds."""

    NAMES = ("bits", "before", "first", "final", "target", "skip", "id_start", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for k in self.NAMES:
            setattr(self, k, arrays[k])

    @classmethod
    def compile(cls, words: list[bytes], ids: list[list[int]]) -> Transducer:
        """Incremental minimisation over the sorted words, then packed arrays."""
        order = sorted(range(len(words)), key=words.__getitem__)
        edges: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        stack: list[tuple[int, int]] = []  # (parent, byte) along the last word

        def minimise(depth: int) -> None:
            while len(stack) > depth:
                parent, byte = stack.pop()
                child = edges[parent][byte]
                sign = (final[child], tuple(edges[child].items()))
                known = register.get(sign)
                if known is None:
                    register[sign] = child
                else:
                    edges[parent][byte] = known

        last = b""
        for i in order:
            w = words[i]
            k = 0
            while k < min(len(w), len(last)) and w[k] == last[k]:
                k += 1
            minimise(k)
            state = edges[stack[-1][0]][stack[-1][1]] if stack else 0
            for byte in w[k:]:
                edges.append({})
                final.append(False)
                edges[state][byte] = len(edges) - 1
                stack.append((state, byte))
                state = len(edges) - 1
            final[state] = True
            last = w
        minimise(0)
        # live states in breadth-first order, words below each
        number, queue = {0: 0}, [0]
        for s in queue:
            for t in edges[s].values():
                if t not in number:
                    number[t] = len(queue)
                    queue.append(t)
        below: dict[int, int] = {}
        todo = [0]
        while todo:
            s = todo[-1]
            missing = [t for t in edges[s].values() if t not in below]
            if missing:
                todo.extend(missing)
            else:
                below[s] = int(final[s]) + sum(below[t] for t in edges[s].values())
                todo.pop()
        n = len(queue)
        bits = np.zeros((n, 4), np.uint64)
        first = np.zeros(n, np.int32)
        target, skip = [], []
        for i, s in enumerate(queue):
            first[i] = len(target)
            gone = int(final[s])
            for byte, t in sorted(edges[s].items()):
                bits[i, byte >> 6] |= np.uint64(1 << (byte & 63))
                target.append(number[t])
                skip.append(gone)
                gone += below[t]
        count = np.bitwise_count(bits).astype(np.int16)
        before = np.zeros((n, 4), np.int16)
        before[:, 1:] = np.cumsum(count, axis=1)[:, :3]
        lens = [len(ids[i]) for i in order]
        return cls({
            "bits": bits, "before": before, "first": first, "final": np.array([final[s] for s in queue], bool),
            "target": np.array(target, np.int32), "skip": np.array(skip, np.int32),
            "id_start": np.concatenate([[0], np.cumsum(lens)]).astype(np.int64),
            "ids": np.array([x for i in order for x in ids[i]], np.int32),
        })

    def save(self, path: str) -> None:
        """One file: a header line, then the arrays, each at a multiple of 64 bytes."""
        arrays = [np.ascontiguousarray(getattr(self, k)) for k in self.NAMES]
        head, at = [], 0
        for k, a in zip(self.NAMES, arrays, strict=True):
            head.append([k, a.dtype.str, list(a.shape), at])
            at += -(-a.nbytes // 64) * 64
        line = json.dumps(head).encode()
        start = -(-(len(line) + 1) // 64) * 64
        with open(path, "wb") as f:
            f.write(line.ljust(start - 1) + b"\n")
            for a in arrays:
                f.write(a.tobytes().ljust(-(-a.nbytes // 64) * 64, b"\0"))

    @classmethod
    def open(cls, path: str) -> Transducer:
        with open(path, "rb") as f:
            line = f.readline()
        out = {}
        for k, dtype, shape, at in json.loads(line):
            size = int(np.prod(shape))
            out[k] = np.memmap(path, np.dtype(dtype), "r", len(line) + at, tuple(shape)) if size else np.zeros(shape, np.dtype(dtype))
        return cls(out)

    def find(self, words: pa.Array) -> np.ndarray:
        """Number of each word, -1 if the lexicon does not hold it; all words step together."""
        buf, off = C.bounds(words)
        size = np.diff(off)
        out = np.full(len(size), -1, np.int64)
        at = np.flatnonzero(size <= LONGEST) if len(self.target) else np.zeros(0, np.int64)
        state, num = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        k = 0
        while len(at):
            done = size[at] == k
            hit = done & self.final[state]
            out[at[hit]] = num[hit]
            at, state, num = at[~done], state[~done], num[~done]
            byte = buf[off[at] + k]
            word, bit = byte >> 6, np.uint64(1) << (byte & 63).astype(np.uint64)
            mask = self.bits[state, word]
            go = (mask & bit) != 0
            at, state, num, word, bit, mask = at[go], state[go], num[go], word[go], bit[go], mask[go]
            edge = self.first[state] + self.before[state, word] + np.bitwise_count(mask & (bit - np.uint64(1)))
            num = num + self.skip[edge]
            state = self.target[edge]
            k += 1
        return out


class Encoder:
    """Ids of the texts of a slice: lexicon first, exact merges for the rest."""

    def __init__(self, file: str, lexicon: Transducer):
        self.vocab = P.Vocabulary(file)
        self.odd = P.OddChunks(file, self.vocab)
        self.lexicon = lexicon
        self.base = np.array(lexicon.ids, np.int32)

    def resolve(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, pool of ids) of distinct pieces."""
        number = self.lexicon.find(distinct)
        known = number >= 0
        start, length = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        start[known] = self.lexicon.id_start[number[known]]
        length[known] = self.lexicon.id_start[number[known] + 1] - start[known]
        rest = np.flatnonzero(~known)
        raw = distinct.take(pa.array(rest)).to_pylist()
        strange = np.array([P.is_odd(p) for p in raw], bool)
        plain = rest[~strange]
        ids, off = self.vocab.merge(distinct.take(pa.array(plain)))
        start[plain], length[plain] = len(self.base) + off[:-1], np.diff(off)
        pools, at = [self.base, ids], len(self.base) + len(ids)
        for i, p in zip(rest[strange].tolist(), (p for p, s in zip(raw, strange, strict=True) if s), strict=True):
            got = np.array(self.odd.ids(p), np.int32)
            start[i], length[i] = at, len(got)
            pools.append(got)
            at += len(got)
        return start, length, np.concatenate(pools)

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, first = P.cut(text)
        code, distinct = C.codes(pieces)
        return P.gather(code, first, *self.resolve(distinct))


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def piece_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(piece, n) over all documents; counted per slice before the shuffle."""

    def run(batches):
        for batch in batches:
            for _, text in C.slices(batch, 0, TEXT_SLICE):
                code, distinct = C.codes(P.cut(text)[0])
                n = np.bincount(code, minlength=len(distinct))
                yield pa.RecordBatch.from_arrays([distinct, pa.array(n.astype(np.int64))], names=["piece", "n"])

    return docs.select(text_col).mapInArrow(C.task(run), "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def build(docs: DataFrame, file: str, words: int = LEXICON_WORDS, text_col: str = "text") -> Transducer:
    """Lexicon of the ``words`` most frequent pieces (ties by piece), encoded exactly."""
    short = piece_counts(docs, text_col).where(F.length("piece") <= LONGEST)
    top = short.orderBy(F.desc("n"), "piece").limit(words).select("piece").toArrow()["piece"].combine_chunks()
    raw = [p for p in top.to_pylist() if not P.is_odd(p)]
    ids, off = P.Vocabulary(file).merge(pa.array(raw, pa.binary()))
    flat, cuts = ids.tolist(), off.tolist()
    return Transducer.compile(raw, [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def ship(spark: SparkSession, lexicon: Transducer) -> str:
    """Hand the compiled file to every executor; returns its name there."""
    name = f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="lexiflow-lexicon-"), name)
    lexicon.save(path)
    spark.sparkContext.addFile(path)
    return name


def encode(docs: DataFrame, file: str, lexicon: Transducer, text_col: str = "text", into: str = "_bpe") -> DataFrame:
    """All columns of ``docs`` and the struct ``into`` (ids).  ``file``: text of the
    tokenizer file, broadcast with the task code's other fixed data."""
    sc = docs.sparkSession.sparkContext
    name, shared = ship(docs.sparkSession, lexicon), sc.broadcast(file)

    def make():
        from pyspark import SparkFiles

        enc = Encoder(shared.value, Transducer.open(SparkFiles.get(name)))

        def kernel(text):
            ids, off = enc(text)
            field = pa.field("element", pa.int32(), False)
            return [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()), type=pa.list_(field))]

        return kernel

    return C.annotate(docs, text_col, make, FIELDS, into, TEXT_SLICE)


def decode(df: DataFrame, file: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the text ``into`` of its ids: token strings joined by one
    space (the file has no decoder).  A null list gives a null text; unknown ids are skipped."""
    shared = df.sparkSession.sparkContext.broadcast(file)
    at = df.columns.index(ids_col)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType(), True)])

    def run(batches):
        tokens = pa.array(P.Vocabulary(shared.value).tokens, pa.string())
        for batch in batches:
            col = batch.column(at)
            size = pc.fill_null(pc.list_value_length(col), 0).to_numpy()
            ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            a = 0
            while a < batch.num_rows:  # bounded by ids, not rows
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + (1 << 21), "right")) - 1)
                ids = col.slice(a, b - a)
                flat = pc.list_flatten(ids).to_numpy(zero_copy_only=False)
                off = ends[a : b + 1] - ends[a]
                good = (flat >= 0) & (flat < len(tokens))
                if not good.all():
                    off = np.concatenate([[0], np.cumsum(good)])[off]
                    flat = flat[good]
                words = pa.ListArray.from_arrays(pa.array(off, pa.int32()), tokens.take(pa.array(flat)))
                text = pc.if_else(pc.is_null(ids), pa.scalar(None, pa.string()), pc.binary_join(words, " "))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, text], names=[*batch.schema.names, into])
                a = b

    return df.mapInArrow(C.task(run), schema)


def default_file() -> str:
    import public_tokenizers

    return read_file(public_tokenizers.path("word_bpe_49k.json"))


def digests(docs: DataFrame, file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of documents (doc_id, text)."""
    coded = encode(docs, file, build(docs, file)).select("doc_id", F.col("_bpe.ids").alias("ids"))
    both = decode(coded, file)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return digests(docs.select("doc_id", "text"), default_file())


def query(spark, sf_dir: str) -> DataFrame:
    return stage(spark, C.source_table(spark, sf_dir, "documents"), sf_dir)
