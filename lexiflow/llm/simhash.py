"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 4 bits apart have a common variant at most 2 bits from either.
Every distinct fingerprint therefore emits all its variants within 2 bits, the variants
are shuffled, and fingerprints that meet on a variant are verified by their distance.

The variants are not shipped one by one.  Variants that share their leading ``p`` bits go
to one bucket, so a fingerprint is shipped once per bucket that holds variants of it
(``1 + p + p(p-1)/2`` copies of 8 bytes instead of 2,081), with the radius left for the
other bits; the bucket's task writes the variants out and sorts them.  A bucket with too
many variants for the memory is split on its next bit in the same way.  ``p`` follows the
number of distinct fingerprints; it changes the layout, never the pairs.

Fingerprints that meet on one variant are linked to the least of them and a bucket passes
on a spanning forest of its links: no pairs of a group are listed, and reachability is
kept.  Components come from repeated contraction of the link table in Spark.

Defined results: null and empty texts have fingerprint zero and link like any other;
equal texts share a fingerprint and a component; a null id takes part, and a component
of null ids only has a null id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm import common as C

SHINGLE = 4
SEED = 42
RADIUS = 2  # half of the largest linked distance
BUCKET = 256  # fingerprints whose own prefix is the bucket, on average
MAX_VARIANTS = 1 << 21  # variants a task holds at once

FIELDS = T.StructType([T.StructField("fp", T.LongType(), False)])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: lowers A-Z only, splits at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        parts = [joined]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]]).tolist()
        ends = (ends - 1).tolist()
        parts = [joined[a:b] for a, b in zip(starts, ends[shingle - 1 :])]  # noqa: B905
    h = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 8192):
        bits = np.unpackbits(h[a : a + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", into: str = "_simhash", shingle: int = SHINGLE) -> DataFrame:
    """All columns of ``docs`` and the struct ``into`` with the fingerprint as a signed long."""

    def make():
        def kernel(text):
            f = [fingerprint(t, shingle) for t in text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary()).to_pylist()]
            return [np.array(f, np.uint64).view(np.int64)]

        return kernel

    return C.annotate(docs, text_col, make, FIELDS, into)


# ------------------------------------------------------------------ links


def masks(bits: int, radius: int) -> np.ndarray:
    """All flips of at most ``radius`` of the low ``bits`` bits."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    out = [np.zeros(1, np.uint64)]
    if radius >= 1:
        out.append(one)
    if radius >= 2 and bits > 1:
        i, j = np.triu_indices(bits, 1)
        out.append(one[i] | one[j])
    return np.concatenate(out)


def flips(bits: int, radius: int) -> int:
    return 1 + (bits if radius >= 1 else 0) + (bits * (bits - 1) // 2 if radius >= 2 else 0)


def ship(fps: DataFrame, p: int) -> DataFrame:
    """(bucket, radius left, fingerprints): one row per bucket and Arrow batch."""

    def run(batches):
        flip = masks(p, RADIUS)
        left = (RADIUS - np.bitwise_count(flip)).astype(np.int8)
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for a in range(0, len(fp), 1 << 14):
                part = fp[a : a + (1 << 14)]
                prefix = part >> np.uint64(64 - p) if p else np.zeros(len(part), np.uint64)
                bucket = (prefix[:, None] ^ flip).ravel()
                own, r = np.repeat(part, len(flip)), np.tile(left, len(part))
                order = np.argsort(bucket, kind="stable")
                bucket, own, r = bucket[order], own[order], r[order]
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                end = np.append(cut[1:], len(bucket))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[cut].astype(np.int64)),
                        pa.array([own[x:y].tobytes() for x, y in zip(cut, end, strict=True)], pa.binary()),
                        pa.array([r[x:y].tobytes() for x, y in zip(cut, end, strict=True)], pa.binary()),
                    ],
                    names=["bucket", "fp", "left"],
                )

    return fps.mapInArrow(C.task(run), "bucket long, fp binary, left binary")


def meet(fp: np.ndarray, left: np.ndarray, bits: int, found: list) -> None:
    """Collect (least, other) of the fingerprints that meet on a variant over the low
    ``bits`` bits; splits on the next bit while the variants exceed the memory bound."""
    if len(fp) < 2:
        return
    n = np.bincount(left, minlength=RADIUS + 1)
    total = sum(int(n[r]) * flips(bits, r) for r in range(RADIUS + 1))
    if total > MAX_VARIANTS and bits > 0:
        bit = (fp >> np.uint64(bits - 1)) & np.uint64(1)
        for side in (0, 1):
            near = bit == side
            can = near | (left >= 1)
            meet(fp[can], np.where(near, left, left - 1)[can], bits - 1, found)
        return
    low = fp & np.uint64((1 << bits) - 1)
    var, own = [], []
    for r in range(RADIUS + 1):
        at = np.flatnonzero(left == r)
        m = masks(bits, r)
        var.append((low[at][:, None] ^ m).ravel())
        own.append(np.repeat(at, len(m)))
    var, own = np.concatenate(var), np.concatenate(own)
    s = np.sort(var)
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice) == 0:
        return
    # a table of hashed repeats first, then the exact values
    seen = np.zeros(1 << 20, bool)
    seen[C.mix64(twice) >> np.uint64(44)] = True
    at = np.flatnonzero(seen[C.mix64(var) >> np.uint64(44)])
    var, own = var[at], fp[own[at]]
    order = np.lexsort((own, var))
    var, own = var[order], own[order]
    head = np.concatenate([[True], var[1:] != var[:-1]])
    least = own[np.maximum.accumulate(np.where(head, np.arange(len(var)), 0))]
    a, b = least[~head], own[~head]
    near = (a != b) & (np.bitwise_count(a ^ b) <= 2 * RADIUS)
    if near.any():
        found.append(np.unique(np.column_stack([a[near], b[near]]), axis=0))


def forest(pairs: np.ndarray) -> np.ndarray:
    """(root, member) rows that connect what ``pairs`` connect."""
    nodes, flat = np.unique(pairs, return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    kids = np.flatnonzero(root != np.arange(len(nodes)))
    return np.column_stack([nodes[root[kids]], nodes[kids]])


def links(fps: DataFrame, p: int) -> DataFrame:
    """(a, b): links whose connectivity is that of all fingerprints within 4 bits."""

    def bucket_links(table: pa.Table) -> pa.Table:
        fp = np.frombuffer(b"".join(table["fp"].to_pylist()), np.uint64)
        left = np.frombuffer(b"".join(table["left"].to_pylist()), np.int8).astype(np.int64)
        found: list[np.ndarray] = []
        meet(fp, left, 64 - p, found)
        e = forest(np.concatenate(found)) if found else np.zeros((0, 2), np.uint64)
        return pa.table({"a": np.ascontiguousarray(e[:, 0]).view(np.int64), "b": np.ascontiguousarray(e[:, 1]).view(np.int64)})

    return ship(fps, p).groupBy("bucket").applyInArrow(bucket_links, "a long, b long").distinct()


def components(edges: DataFrame, name: str = "simhash") -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b).

    Each round every node moves to the least of itself and its neighbours under a fresh
    random order, which shrinks any graph by a constant factor; the least is found with
    map-side combining, so a node that touches a third of all links is no hot group.
    """
    steps: list[DataFrame] = []
    edges = C.stored(edges.where("a <> b"), f"{name}-edges")
    while edges.limit(1).count():
        rank = lambda c: F.xxhash64(F.col(c), F.lit(len(steps)))  # noqa: E731, B023
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("b"))).alias("m"))
        own = F.struct(rank("a").alias("r"), F.col("a").alias("b"))
        step = C.stored(best.select(F.col("a").alias("node"), F.least(F.col("m"), own)["b"].alias("to")), f"{name}-step")
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        moved = moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = C.stored(moved, f"{name}-edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    final = steps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        up = final.select(F.col("node").alias("to"), F.col("root"))
        final = step.join(up, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return final


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, row_hash, component): one row per document row; the component is the least id
    reachable.  ``row_hash`` tells rows with the same id apart."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), C.row_hash(docs).alias("row_hash"))
    marked = C.stored(fingerprints(src, "text", "s", shingle).select("id", "s.fp", "row_hash"), "simhash-docs")
    fps = C.stored(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-fps")
    n = fps.count()
    p = max(0, int(np.ceil(np.log2(max(n, 1) / BUCKET))))
    root = components(links(fps.select("fp"), p))
    joined = fps.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    top = joined.groupBy("root").agg(F.min("least").alias("component"))
    of = joined.select("fp", "root").join(top, "root").select("fp", "component")
    return marked.join(of, "fp").select("id", "fp", "row_hash", "component")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least id; of rows that repeat this id,
    the one with the least row hash, and one of wholly equal rows."""
    C.prepare(spark)
    found = near_duplicates(docs)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row_hash"))).alias("k"))
    first = first.select(F.col("k.id").alias("id"), F.col("k.row_hash").alias("row_hash"))
    count = found.groupBy("id", "row_hash").agg(F.count(F.lit(1)).alias("n"))
    keep = C.stored(
        first.join(count, first["id"].eqNullSafe(count["id"]) & (first["row_hash"] == count["row_hash"])).select(first["id"], first["row_hash"], "n"),
        "simhash-keep",
    )
    own, key, other, times = (C.fresh(docs, f"_simhash_{x}") for x in ("row", "id", "hash", "times"))
    marked = docs.withColumn(own, C.row_hash(docs))
    keep = keep.select(F.col("id").alias(key), F.col("row_hash").alias(other), F.col("n").alias(times))
    chosen = marked.join(keep, marked["doc_id"].eqNullSafe(F.col(key)) & (F.col(own) == F.col(other)))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    once = chosen.where(F.col(times) == 1).select(*cols)
    more = chosen.where(F.col(times) > 1).groupBy(key, own).agg(F.first(F.struct(*cols)).alias("r")).select("r.*")
    return once.unionByName(more)


def query(spark, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    found = near_duplicates(C.source_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
