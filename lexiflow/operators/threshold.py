"""Exact cosine top-1 at or above a threshold for sparse vectors: prefix filtering.

Terms are ordered from rare to frequent.  The *prefix* of a unit vector is its shortest run of
leading terms whose rest has a norm under the threshold.  Where two vectors reach the
threshold, their first common term lies in both prefixes: if it lay after one, all common
terms would, and that vector's rest alone bounds the cosine.  So the vectors meet by the
terms of their prefixes only, which are few and rare, and are compared exactly there.

Equal vectors (of one label) are compared once: of the memory's the lowest position can win, of
the queries' all get its match.  Prefix terms are hashed into groups whose memory rows fit a task
(a term that fills several is cut into shards), and their queries are cut into blocks.  Vectors
are shuffled once per group they belong to, and no pair of rows leaves a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexiflow.operators import features as FE
from lexiflow.operators import similarity as SIM
from lexiflow.session import scratch_path

GROUP_ROWS = 20_000  # vectors of one side in a group, on average
SLACK = 1e-9


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"threshold-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_TERMS = 1 << 19  # terms of a memory whose numbers are broadcast (counted first)


def term_order(memory: DataFrame) -> tuple[DataFrame, int]:
    """((term, df, idf, tid): terms of the memory from rare to frequent, rows of the memory);
    ``idf`` is there for :func:`lexiflow.operators.features.join_idf` only."""
    df = memory.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return FE.dense_ids(df, [F.asc("df"), F.asc("term")], "tid").withColumn("idf", F.lit(1.0)), memory.count()


def numbered_terms(each: DataFrame, order: DataFrame, n: int, id_col: str) -> DataFrame:
    """``each`` (id, term, ...) with the ``tid`` and ``idf`` of known terms.  A memory's terms are
    broadcast if they are few; else frequent terms are, and rare ones joined by shuffle."""
    if order.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        return each.join(F.broadcast(order), "term")
    return FE.join_idf(each, order, n, id_col, extra=["tid"])


def _numbered(rows: DataFrame, order: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """(k, s, nrm, *keep): vectors as sorted (tid, w), unknown terms in the norm only."""
    norm = F.sqrt(F.aggregate("ws", F.lit(0.0), lambda a, w: a + w * w))
    rows = _stored(rows.select("k", "terms", "ws", norm.alias("nrm"), *keep), "vectors")
    each = rows.select("k", F.explode(F.arrays_zip("terms", "ws")).alias("s")).select("k", F.col("s.terms").alias("term"), F.col("s.ws").alias("w"))
    known = numbered_terms(each, order, n, "k").select("k", F.struct("tid", "w").alias("s"))
    lists = known.groupBy("k").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return rows.drop("terms", "ws").join(lists, "k")


def _prefixed(out: DataFrame, threshold: float, among=None) -> DataFrame:
    """(k, tids, ws, prefix, ...): unit vectors and the length of their prefix; ``among``: a
    broadcast sorted array of term numbers, one of which the prefix must hold."""
    out = out.where("nrm > 0")
    at = out.columns.index("s")
    nrm = out.columns.index("nrm")
    rest = [f for f in out.schema.fields if f.name not in ("s", "nrm")]
    schema = StructType([*rest, *StructType.fromDDL("tids array<long>, ws array<double>, prefix int").fields])
    names = schema.fieldNames()
    held = [out.columns.index(f.name) for f in rest]

    def run(batches):
        for b in batches:
            s = b.column(at)
            off = np.concatenate([[0], np.cumsum(s.value_lengths().to_numpy())])
            flat = s.flatten()
            tid, w = flat.field("tid").to_numpy(), flat.field("w").to_numpy()
            w = w / np.repeat(b.column(nrm).to_numpy(), np.diff(off))
            # norm of what follows each place, within its vector
            square = np.concatenate([[0.0], np.cumsum((w * w)[::-1])])
            after = square[len(w) - 1 - np.arange(len(w))] - square[np.repeat(len(w) - off[1:], np.diff(off))]
            short = (np.sqrt(np.maximum(after, 0.0)) >= threshold - SLACK).astype(np.int64)
            prefix = np.minimum(np.add.reduceat(short, off[:-1]) + 1, np.diff(off)) if len(w) else np.zeros(len(b), np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x)) for x in (tid, w)]
            made = pa.RecordBatch.from_arrays([*[b.column(i) for i in held], *lists, pa.array(prefix, pa.int32())], names=names)
            if among is not None and len(w):
                place = np.arange(len(w)) - np.repeat(off[:-1], np.diff(off))
                met = np.isin(tid, among.value) & (place < np.repeat(prefix, np.diff(off)))
                made = made.filter(pa.array(np.logical_or.reduceat(met, off[:-1])))
            yield made

    return out.mapInArrow(run, schema)


def _postings(vectors: DataFrame) -> DataFrame:
    return vectors.select("k", F.explode(F.slice("tids", F.lit(1), F.col("prefix"))).alias("tid"))


def _groups(mem: DataFrame, q: DataFrame, group_rows: int) -> DataFrame:
    """(tid, grp, shards, blocks) of the prefix terms that both sides hold.

    The memory sets the number of groups, so a query goes to few; a group's queries are cut
    into blocks, each with a copy of the group's memory rows.  A term that fills groups of the
    memory by itself is a group of its own, cut into shards."""
    count = lambda x, name: _postings(x).groupBy("tid").agg(F.count(F.lit(1)).alias(name))
    terms = _stored(count(mem, "m").join(count(q, "q"), "tid"), "terms")
    light = int(terms.where(F.col("m") <= group_rows).agg(F.sum("m").alias("m")).first()["m"] or 0)
    groups = max(1, math.ceil(light / group_rows))
    parts = lambda c: F.greatest(F.ceil(F.col(c) / F.lit(group_rows)), F.lit(1)).cast("long")
    grp = F.when(F.col("m") > group_rows, -1 - F.col("tid")).otherwise(F.pmod(F.xxhash64("tid"), F.lit(groups)))
    terms = terms.withColumn("grp", grp).withColumn("shards", F.when(F.col("grp") < 0, parts("m")).otherwise(F.lit(1).cast("long")))
    blocks = terms.groupBy("grp").agg(F.sum("q").alias("q")).select("grp", parts("q").alias("blocks"))
    return terms.select("tid", "grp", "shards").join(blocks, "grp")


def _dealt(vectors: DataFrame, groups: DataFrame, own: str, other: str, cols: list[str]) -> DataFrame:
    """Vectors, once per group: with their prefix terms there, their part of the group's side
    ``own`` and a copy for each part of the other side."""
    each = _postings(vectors).join(groups, "tid")
    each = each.groupBy("k", "grp", "shards", "blocks").agg(F.collect_list("tid").alias("here"))
    mine = F.pmod(F.xxhash64("k"), F.col(own)).alias(own[:-1])
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other[:-1])
    each = each.select("k", "grp", "here", mine, copies)
    return each.join(vectors.select("k", "tids", "ws", *cols), "k")


def _compare(q: pa.Table, m: pa.Table, threshold: float, has_label: bool):
    """Rows of ``m`` that win for queries of one group: (query row, memory row, score, compared)."""
    m = m.sort_by([("pos", "ascending"), ("ord", "ascending")])
    lists = lambda t, c: t[c].combine_chunks()
    here, tids, ws = lists(m, "here"), lists(m, "tids"), lists(m, "ws")
    by = here.flatten().to_numpy()
    row = np.repeat(np.arange(len(m)), here.value_lengths().to_numpy())
    order = np.lexsort((row, by))
    by, row = by[order], row[order]
    size = tids.value_lengths().to_numpy().astype(np.int64)
    begin = np.cumsum(size) - size
    flat, weight = tids.flatten().to_numpy(), ws.flatten().to_numpy()
    vocab, local = np.unique(flat, return_inverse=True)
    scratch = np.zeros(len(vocab))
    label = SIM._named(m["label"].to_pylist(), "m") if has_label else None
    asked = SIM._named(q["label"].to_pylist(), "q") if has_label else None
    out = []
    columns = (lists(q, c) for c in ("here", "tids", "ws"))
    for i, (terms, own, w) in enumerate(zip(*columns, strict=True)):
        terms, own, w = terms.values.to_numpy(), own.values.to_numpy(), w.values.to_numpy()
        left, right = np.searchsorted(by, terms, "left"), np.searchsorted(by, terms, "right")
        near = np.unique(np.concatenate([row[a:b] for a, b in zip(left, right, strict=True)]))
        if has_label:
            near = near[label[near] == asked[i]]
        best, top = -1, None
        if len(near):
            at = np.minimum(np.searchsorted(vocab, own), len(vocab) - 1)
            known = vocab[at] == own
            scratch[at[known]] = w[known]
            many = size[near]
            place = np.repeat(begin[near] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            score = np.add.reduceat(scratch[local[place]] * weight[place], np.cumsum(many) - many)
            scratch[at[known]] = 0.0
            j = int(np.argmax(np.round(score, SIM.TIE_DECIMALS)))
            if score[j] >= threshold - SLACK:
                best, top = int(near[j]), float(score[j])
        out.append((i, best, top, len(near)))
    return m, out


def nearest_above(queries: DataFrame, memory: DataFrame, threshold: float, same_label: bool = False, carry: tuple[str, ...] = (), group_rows: int | None = None) -> DataFrame:
    """(qid, match_pos, score, carried columns, compared) per query row: the best memory row with
    a cosine of ``threshold`` or more, else nulls; ``compared`` counts the memory rows that the
    query's vector was compared with.

    ``queries``: qid, terms, ws[, label] with weights of any norm; ``memory``: pos, terms, ws of
    unit norm[, label] and the carried columns.
    """
    label = ["label"] if same_label else []
    q = queries.select(F.col("qid").cast("string").alias("qid"), "terms", "ws", *[F.col(c).cast("string").alias(c) for c in label])
    q = _stored(q.withColumn("k", F.monotonically_increasing_id()), "queries")
    order, n = term_order(memory)
    got = _search(_numbered(q.where("size(terms) > 0"), order, n, label), order, n, memory, threshold, same_label, carry, group_rows or GROUP_ROWS)
    out = q.select("k", "qid").join(got, "k", "left")
    return out.select("qid", "match_pos", "score", *carry, F.coalesce("compared", F.lit(0).cast("long")).alias("compared"))


def nearest_numbered(queries: DataFrame, order: DataFrame, n: int, memory: DataFrame, threshold: float, same_label: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(k, match_pos, score, carried columns, compared) of queries (k, s, nrm[, label]) whose terms
    are numbered by ``order`` already; only of those that share a prefix term with the memory."""
    return _search(queries, order, n, memory, threshold, same_label, carry, GROUP_ROWS)


def _digests(cols: list[str]) -> list:
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(1), *cols).alias("h2")]


def _search(q: DataFrame, order: DataFrame, n: int, memory: DataFrame, threshold: float, same_label: bool, carry: tuple[str, ...], group_rows: int) -> DataFrame:
    """``q``: (k, s, nrm[, label]), a row per query."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    label = ["label"] if same_label else []
    m = SIM.prepare(memory, "sparse", False, same_label, force="sharded", carry=carry).memory
    if not carry:
        m = m.withColumn("ord", F.lit(0).cast("long"))
    if same_label:
        m = m.where("label is not null")
    # one row per distinct vector: the memory's with the lowest position
    lowest = F.min(F.struct("pos", "ord", *carry)).alias("low")
    mem = m.select(*m.columns, *_digests(["terms", "ws", *label])).groupBy("h1", "h2")
    mem = mem.agg(F.first("terms").alias("terms"), F.first("ws").alias("ws"), lowest, *[F.first(c).alias(c) for c in label])
    mem = mem.select("terms", "ws", *label, "low.*").withColumn("k", F.monotonically_increasing_id())
    mem = _stored(_prefixed(_numbered(mem, order, n, [*label, "pos", "ord", *carry]), threshold), "memory")
    # queries that share no prefix term with the memory are left out before anything is shuffled
    met = _postings(mem).select("tid").distinct()
    few = met.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    among = mem.sparkSession.sparkContext.broadcast(np.sort(met.toArrow()["tid"].to_numpy())) if few else None
    q = q.where("label is not null") if same_label else q
    asked = _prefixed(q, threshold, among)
    asked = _stored(asked.select(*asked.columns, *_digests(["tids", "ws", *label])).withColumnRenamed("k", "own"), "asked")
    one = asked.groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in ("tids", "ws", "prefix", *label)])
    one = _stored(one.withColumn("k", F.monotonically_increasing_id()), "distinct")
    groups = _groups(mem, one, group_rows)
    left = _dealt(one, groups, "blocks", "shards", label)
    right = _dealt(mem, groups, "shards", "blocks", [*label, "pos", "ord", *carry])
    right = right.toDF(*right.columns)
    carried = [StructField(c, m.schema[c].dataType, True) for c in carry]
    schema = StructType([*StructType.fromDDL("k long, match_pos long, match_ord long, score double, compared long").fields, *carried])

    def run(qt: pa.Table, mt: pa.Table) -> pa.Table:
        mt, found = _compare(qt, mt, threshold, same_label) if len(qt) and len(mt) else (mt, [])
        i, j, score, compared = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
        take = pa.array([None if x < 0 else x for x in j], pa.int64())
        cols = [qt["k"].take(pa.array(i, pa.int64())), mt["pos"].take(take), mt["ord"].take(take), pa.array(score, pa.float64()), pa.array(compared, pa.int64())]
        return pa.table([*cols, *[mt[c].take(take) for c in carry]], names=schema.fieldNames())

    keys = ["grp", "shard", "block"]
    got = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)
    own = Window.partitionBy("k")  # at most a row per prefix term
    best = own.orderBy(F.desc_nulls_last(F.round("score", SIM.TIE_DECIMALS)), F.asc_nulls_last("match_pos"), F.asc_nulls_last("match_ord"))
    got = got.withColumn("rn", F.row_number().over(best)).withColumn("compared", F.sum("compared").over(own)).where("rn = 1").drop("rn", "match_ord")
    got = one.select("k", F.col("h1").alias("d1"), F.col("h2").alias("d2")).join(got, "k").drop("k")
    out = asked.select("own", "h1", "h2").join(got, (F.col("h1") == F.col("d1")) & (F.col("h2") == F.col("d2")))
    reached = F.col("score") >= threshold
    found = lambda c: F.when(reached, F.col(c)).alias(c)
    return out.select(F.col("own").alias("k"), found("match_pos"), found("score"), *[found(c) for c in carry], "compared")
