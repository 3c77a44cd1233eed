"""Exact cosine top-1 against a translation memory.

Two physical strategies, same answer:

* **broadcast** (memory under ``max_broadcast_bytes``, checked with a count
  before anything is collected): the memory is shipped once per executor and
  every query partition is scored with NumPy inside ``mapInPandas``; queries are
  never shuffled.
* **sharded** (larger memories): memory rows are hashed into shards that each fit
  a task, queries into blocks; ``cogroup`` on (shard, block) scores each pair of
  groups, and a per-query reduce picks the best of the shard winners.  No cross
  join and no pair rows are ever materialised.  Dense shards and blocks are cut alike, into
  pairs enough for all task slots, and none is larger than ``TILE_BYTES``.

Tie rule: the highest score wins, equal scores go to the lowest memory
position, rows at one position are ordered by a hash of what they carry.  Zero vectors
never match; a null label matches no label, and a null key excludes nothing.  Queries and
memory rows are never told apart by the caller's ids: equal or null ids are rows of their own.

``carry`` columns of the memory (its id, its target text) travel with the scoring state and
come back with the match, so they are part of the size check and need no join.
Scores are compared after rounding to 12 places, so summation order cannot
change the winner.

Dense memories carry ``vec array<float|double>``; sparse (TF-IDF) memories
carry ``terms array<string>, ws array<double>`` already L2-normalised.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

# bound of a broadcast memory; ``spark.lexiflow.memoryBroadcastBytes`` of the session overrides it
DEFAULT_MAX_BROADCAST = 128 << 20
MAX_BROADCAST_CONF = "spark.lexiflow.memoryBroadcastBytes"
TIE_DECIMALS = 12
# a scored block is (queries x memory rows) doubles: keep it near this size
SCORE_BLOCK_BYTES = 32 << 20
TILE_BYTES = 32 << 20  # vectors of a dense shard or block
TILE_LEAST = 1 << 12  # rows; smaller ones are not cut to fill the task slots
RESULT_FIELDS = [("qid", StringType()), ("match_pos", LongType()), ("score", DoubleType())]


# ----------------------------------------------------------------------------- scoring kernels


def _named(values, null: str) -> np.ndarray:
    """Labels or keys for comparison: a null becomes ``null``, which no value equals."""
    out = np.empty(len(values), dtype=object)
    out[:] = [null if v is None or v is pd.NA or v != v else f"={v}" for v in values]
    return out


def _in_order(mem: pd.DataFrame) -> pd.DataFrame:
    by = ["pos", "ord"] if "ord" in mem else ["pos"]
    return mem.sort_values(by, kind="stable").reset_index(drop=True)


def _own_columns(mem: pd.DataFrame) -> dict:
    known = ("pos", "ord", "vec", "terms", "ws", "key", "label")
    return {
        "pos": mem["pos"].to_numpy(np.int64),
        "ord": mem["ord"].to_numpy(np.int64) if "ord" in mem else None,
        "key": _named(mem["key"], "m") if "key" in mem else None,
        "label": _named(mem["label"], "m") if "label" in mem else None,
        "carry": {c: mem[c].astype(object).to_numpy() for c in mem.columns if c not in known and not c.startswith("_")},
    }


def _result(state: dict, qid, row: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    """Winning memory row of each query (-1: none) -> result columns."""
    found = row >= 0
    at = np.maximum(row, 0)
    out = {"qid": pd.Series(np.asarray(qid, dtype=object), dtype=object)}
    for name in ("pos", "ord"):
        if state.get(name) is not None:
            v = pd.array(np.where(found, state[name][at] if len(state[name]) else 0, 0), dtype="Int64")
            v[~found] = pd.NA
            out["match_pos" if name == "pos" else "match_ord"] = v
    out["score"] = np.where(found, score, np.nan)
    for name, values in state.get("carry", {}).items():
        v = np.empty(len(row), dtype=object)
        if len(values):
            v[found] = values[at[found]]
        out[name] = pd.Series(v, dtype=object)
    return pd.DataFrame(out)


def _dense_state(mem: pd.DataFrame) -> dict:
    mem = _in_order(mem)
    m = np.stack([np.asarray(v, dtype=np.float64) for v in mem["vec"]]) if len(mem) else np.zeros((0, 0))
    norms = np.linalg.norm(m, axis=1) if len(mem) else np.zeros(0)
    valid = norms > 0
    safe = np.where(valid, norms, 1.0)
    if len(mem):
        m /= safe[:, None]
    own = _own_columns(mem)
    return {"kind": "dense", "m": m, "valid": valid, **own, "key_index": _index(own["key"]), "label_index": _index(own["label"])}


def _index(values: np.ndarray | None) -> tuple | None:
    """(distinct values, code of each row, rows by code, their bounds): rows are compared by numbers."""
    if values is None:
        return None
    codes, distinct = pd.factorize(values)
    by = np.argsort(codes, kind="stable")
    return pd.Index(distinct, dtype=object), codes, by, np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(distinct)))])


def _same(index: tuple, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, memory row) of all equal values."""
    distinct, _, by, bounds = index
    code = distinct.get_indexer(asked)
    q = np.flatnonzero(code >= 0)
    n = bounds[code[q] + 1] - bounds[code[q]]
    at = np.repeat(bounds[code[q]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(q, n), by[at]


def _sparse_state(mem: pd.DataFrame) -> dict:
    """Postings by term: the memory vocabulary sorted, then (row, weight) runs."""
    mem = _in_order(mem)
    lens = mem["terms"].map(len).to_numpy(np.int64)
    rows = np.repeat(np.arange(len(mem), dtype=np.int64), lens)
    terms = np.concatenate([np.asarray(t, dtype=object) for t in mem["terms"]]) if lens.sum() else np.zeros(0, dtype=object)
    ws = np.concatenate([np.asarray(w, dtype=np.float64) for w in mem["ws"]]) if lens.sum() else np.zeros(0)
    # object arrays of str throughout: a fixed-width unicode array would be as wide as the
    # longest term (one junk token of 10^4 characters) for every entry
    vocab, tids = np.unique(terms, return_inverse=True) if len(terms) else (np.zeros(0, dtype=object), np.zeros(0, np.int64))
    order = np.argsort(tids, kind="stable")
    tids, rows, ws = tids[order], rows[order], ws[order]
    indptr = np.zeros(len(vocab) + 1, dtype=np.int64)
    np.add.at(indptr, tids + 1, 1)
    indptr = np.cumsum(indptr)
    return {
        "kind": "sparse",
        "vocab": vocab,
        "indptr": indptr,
        "rows": rows,
        "ws": ws,
        "n": len(mem),
        "valid": lens > 0,
        **_own_columns(mem),
    }


def _dense_scores(state: dict, q: pd.DataFrame) -> np.ndarray:
    qm = np.stack([np.asarray(v, dtype=np.float64) for v in q["vec"]])
    qn = np.linalg.norm(qm, axis=1)
    s = (qm / np.where(qn > 0, qn, 1.0)[:, None]) @ state["m"].T
    s[qn == 0, :] = -np.inf
    return s


def _best_sparse(state: dict, q: pd.DataFrame) -> pd.DataFrame:
    """Top-1 over the candidates only: memory rows sharing a term with the query.

    Work per query is the postings it touches, not the memory size.  Scores are
    summed in posting order as in the dense-row form, so results are identical.
    Memory rows are in position order, so the first maximum is the lowest position.
    """
    n = len(q)
    vocab, indptr, rows, mws = state["vocab"], state["indptr"], state["rows"], state["ws"]
    qkey = _named(q["key"], "q") if "key" in q and state["key"] is not None else None
    qlab = _named(q["label"], "q") if "label" in q and state["label"] is not None else None
    norms = q["nrm"].to_numpy(np.float64) if "nrm" in q else None  # of whole queries, where terms are a part
    best_row = np.full(n, -1, dtype=np.int64)
    best_score = np.full(n, np.nan)
    tids = q["tids"] if "tids" in q else None  # terms already resolved to memory-vocabulary rows
    for i, (terms, ws) in enumerate(zip(q["terms"], q["ws"])):
        if terms is None or not len(terms) or not len(vocab):
            continue
        w = np.asarray(ws, dtype=np.float64)
        nrm = np.sqrt(np.dot(w, w)) if norms is None else norms[i]
        if nrm > 0:
            w = w / nrm  # cosine: query weights are L2-normalised here
        if tids is not None:
            t = np.asarray(tids.iloc[i], dtype=np.int64)
            keep = t >= 0
        else:
            qt = np.asarray(terms, dtype=object)
            t = np.minimum(np.searchsorted(vocab, qt), len(vocab) - 1)
            keep = vocab[t] == qt
        t, w = t[keep], w[keep]
        if not len(t):
            continue
        starts, lens = indptr[t], indptr[t + 1] - indptr[t]
        total = int(lens.sum())
        if not total:
            continue
        idx = np.repeat(starts - np.cumsum(lens) + lens, lens) + np.arange(total)
        cand, inv = np.unique(rows[idx], return_inverse=True)
        sc = np.bincount(inv, weights=np.repeat(w, lens) * mws[idx], minlength=len(cand))
        ok = (sc > 0) & state["valid"][cand]  # no shared weight: no candidate
        if qkey is not None:
            ok &= state["key"][cand] != qkey[i]
        if qlab is not None:
            ok &= state["label"][cand] == qlab[i]
        if not ok.any():
            continue
        cand, sc = cand[ok], sc[ok]
        j = int(np.argmax(np.round(sc, TIE_DECIMALS)))
        best_row[i], best_score[i] = cand[j], sc[j]
    return _result(state, q["qid"], best_row, best_score)


def _best(state: dict, q: pd.DataFrame) -> pd.DataFrame:
    if len(state["pos"]) == 0 or len(q) == 0:
        return _result(state, q["qid"] if "qid" in q else [], np.full(len(q), -1), np.full(len(q), np.nan))
    if state["kind"] == "sparse":
        return _best_sparse(state, q)
    s = _dense_scores(state, q)
    if not state["valid"].all():
        s[:, ~state["valid"]] = -np.inf
    if "key" in q and state["key"] is not None:
        s[_same(state["key_index"], _named(q["key"], "q"))] = -np.inf
    if "label" in q and state["label"] is not None:
        distinct, codes, *_ = state["label_index"]
        s[distinct.get_indexer(_named(q["label"], "q"))[:, None] != codes[None, :]] = -np.inf
    best = _first_best(s)
    top = s[np.arange(len(q)), best]
    return _result(state, q["qid"], np.where(np.isfinite(top), best, -1), top)


def _first_best(s: np.ndarray) -> np.ndarray:
    """The first column of each row that holds its largest score, as rounded to ``TIE_DECIMALS``.
    Only scores next to the largest can round to the same, so the others are not rounded."""
    row = np.arange(len(s))
    top = s.max(1)
    best = (s >= (top - 2 * 10.0**-TIE_DECIMALS)[:, None]).argmax(1)
    unlike = np.flatnonzero(~(np.round(s[row, best], TIE_DECIMALS) == np.round(top, TIE_DECIMALS)))  # NaN too
    if len(unlike):
        best[unlike] = np.round(s[unlike], TIE_DECIMALS).argmax(1)
    return best


def _block_rows(state: dict, batch_rows: int) -> int:
    """Queries per scored block, so that a dense score matrix stays bounded however
    large the memory (a memory near the broadcast bound has ~10^6 rows).  The
    sparse kernel keeps candidates only and needs no bound."""
    if state["kind"] == "sparse":
        return batch_rows
    return max(1, min(batch_rows, SCORE_BLOCK_BYTES // (8 * max(1, len(state["pos"])))))


def _score_batches(state: dict, batches, batch_rows: int):
    step = _block_rows(state, batch_rows)
    for pdf in batches:
        for lo in range(0, len(pdf), step):
            yield _best(state, pdf.iloc[lo : lo + step])


# ----------------------------------------------------------------------------- planning


def _memory_bytes(memory: DataFrame, kind: str, carry: tuple[str, ...] = ()) -> int:
    """Size of the scoring state: vectors or terms, and all that travels with them."""
    extra = F.lit(0)
    for c in carry:
        extra = extra + F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) * 2 + 56
    if kind == "dense":
        stats = memory.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d"), F.sum(extra).alias("x")).first()
        return int(stats["n"] or 0) * int(stats["d"] or 0) * 8 + int(stats["x"] or 0)
    stats = memory.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.size("terms")).alias("nnz"),
        F.sum(F.aggregate("terms", F.lit(0), lambda acc, t: acc + F.length(t))).alias("chars"),
        F.sum(extra).alias("x"),
    ).first()
    return int(stats["nnz"] or 0) * 72 + int(stats["chars"] or 0) * 4 + int(stats["n"] or 0) * 16 + int(stats["x"] or 0)


def max_broadcast(spark, given: int | None = None) -> int:
    """The bound of a broadcast memory: as given, else of the session, else the default."""
    return given if given is not None else int(spark.conf.get(MAX_BROADCAST_CONF, str(DEFAULT_MAX_BROADCAST)))


class Prepared:
    """A memory side planned once: strategy chosen from its checked size, and for
    the broadcast strategy the scoring state shipped to executors once."""

    def __init__(self, memory: DataFrame, kind: str, strategy: str, n_shards: int = 1, state=None, carry: tuple[str, ...] = ()):
        self.memory, self.kind, self.strategy, self.n_shards, self.state = memory, kind, strategy, n_shards, state
        self.carry = carry
        self.fields = [StructField(c, memory.schema[c].dataType, True) for c in carry]


def prepare(
    memory: DataFrame,
    kind: str = "dense",
    exclude_self: bool = False,
    same_label: bool = False,
    max_broadcast_bytes: int | None = None,
    shard_bytes: int = 64 << 20,
    force: str | None = None,
    carry: tuple[str, ...] = (),
) -> Prepared:
    vcols = ["vec"] if kind == "dense" else ["terms", "ws"]
    text = lambda c: F.col(c).cast("string").alias(c)
    named = ([text("key")] if exclude_self else []) + ([text("label")] if same_label else [])
    last = F.coalesce(F.col("pos"), F.lit((1 << 63) - 1)).alias("pos")  # a row without position comes last
    own = [F.xxhash64(*[F.col(c).cast("string") for c in carry]).alias("ord"), *[F.col(c) for c in carry]] if carry else []
    m = memory.select(last, *vcols, *named, *own)
    size = _memory_bytes(m, kind, carry)
    strategy = force or ("broadcast" if size <= max_broadcast(m.sparkSession, max_broadcast_bytes) else "sharded")
    if strategy == "broadcast":
        mem_pdf = _pandas(m)  # size checked above
        state = _dense_state(mem_pdf) if kind == "dense" else _sparse_state(mem_pdf)
        return Prepared(m, kind, strategy, state=m.sparkSession.sparkContext.broadcast(state), carry=carry)
    most = min(shard_bytes, TILE_BYTES) if kind == "dense" else shard_bytes
    return Prepared(m, kind, strategy, n_shards=max(1, math.ceil(size / most)), carry=carry)


def _pandas(m: DataFrame) -> pd.DataFrame:
    """Rows on the driver with nulls kept as None (a nullable long must not turn float)."""
    t = m.toArrow()
    return pd.DataFrame({c: pd.Series(t[c].to_pylist() if c not in ("pos", "ord") else t[c].to_numpy(), dtype=object if c not in ("pos", "ord") else None) for c in t.column_names})


def nearest(
    queries: DataFrame,
    memory: DataFrame | Prepared,
    kind: str = "dense",
    exclude_self: bool = False,
    same_label: bool = False,
    max_broadcast_bytes: int | None = None,
    shard_bytes: int = 64 << 20,
    batch_rows: int = 512,
    force: str | None = None,
    query_nnz: int | None = None,
) -> DataFrame:
    """Top-1 memory position per query row: (qid, match_pos, score) and what the memory carries.

    ``queries``: qid + vec (dense) or terms/ws (sparse), optional ``key`` (with
    ``exclude_self``) and ``label`` (with ``same_label``).
    ``memory``: pos + vec or terms/ws, optional ``key`` and ``label`` — or a
    :class:`Prepared` memory.  Queries with no candidate get a null match and score.
    """
    prep = memory if isinstance(memory, Prepared) else prepare(
        memory, kind, exclude_self, same_label, max_broadcast_bytes, shard_bytes, force
    )
    vcols = ["vec"] if prep.kind == "dense" else ["terms", "ws"]
    named = (["key"] if exclude_self else []) + (["label"] if same_label else [])
    q = queries.select(F.col("qid").cast("string").alias("qid"), *vcols, *[F.col(c).cast("string").alias(c) for c in named])
    fields = [StructField(n, t, True) for n, t in RESULT_FIELDS]
    names = [f.name for f in [*fields, *prep.fields]]
    if prep.strategy == "broadcast":
        bstate = prep.state

        def run(batches):
            for part in _score_batches(bstate.value, batches, batch_rows):
                yield part[names]

        return q.mapInPandas(run, StructType([*fields, *prep.fields]))
    # ``query_nnz``: a caller's bound on the queries' stored terms (e.g. their token
    # count), which spares a sizing pass over the query vectors themselves
    if prep.kind == "dense":
        n_shards, n_blocks = _tiles(q, prep)
        return _nearest_sharded(q, prep, batch_rows, n_blocks, n_shards).select(*names)
    n_blocks = _query_blocks(q, prep.kind) if query_nnz is None else _blocks_for(query_nnz * 72)
    return _nearest_sharded(q, prep, batch_rows, n_blocks).select(*names)


def _tiles(q: DataFrame, prep: Prepared) -> tuple[int, int]:
    """(shards, blocks) of a dense search: none larger than ``TILE_BYTES``, and four pairs for every
    task slot.  Each side is copied once per part of the other, so both are cut alike."""
    n_q, n_m = q.count(), prep.memory.count()
    rows = max(TILE_LEAST, math.isqrt(n_q * n_m // (4 * q.sparkSession.sparkContext.defaultParallelism)))
    return max(prep.n_shards, -(-n_m // rows)), max(_query_blocks(q, "dense", TILE_BYTES), -(-n_q // rows))


def idf_state(idf_pdf: pd.DataFrame) -> dict:
    """Sorted vocabulary with its idf weights (the fitted side of a text memory)."""
    idf_pdf = idf_pdf.sort_values("term", kind="stable")
    return {"terms": idf_pdf["term"].astype(str).to_numpy(), "idf": idf_pdf["idf"].to_numpy(np.float64)}


def _weigh_batch(term_lists, vocab: pd.Index, idf: np.ndarray, to_state: np.ndarray):
    """Raw term lists of a chunk -> per row (known terms, tf * idf, memory-vocabulary
    rows) in vocabulary order, computed for the whole chunk at once: one hash lookup
    of all terms in the (sorted) vocabulary index, one count over integer (row, term) keys.  Unknown terms are dropped
    before the kernel normalises (transform semantics of a fitted vectoriser)."""
    n, v = len(term_lists), len(vocab)
    lens = np.fromiter((0 if t is None else len(t) for t in term_lists), np.int64, n)
    empty = [np.zeros(0, dtype=object)] * n, [np.zeros(0)] * n, [np.zeros(0, np.int64)] * n
    if not v or not lens.sum():
        return empty
    flat = np.concatenate([np.asarray(t, dtype=object) for t, k in zip(term_lists, lens) if k])
    tid = vocab.get_indexer(flat)
    known = tid >= 0
    row = np.repeat(np.arange(n, dtype=np.int64), lens)[known]
    keys, counts = np.unique(row * v + tid[known], return_counts=True)
    r, t = keys // v, keys % v
    w = counts * idf[t]
    b = np.searchsorted(r, np.arange(n + 1))
    terms = vocab.to_numpy()
    return (
        [terms[t[b[i] : b[i + 1]]] for i in range(n)],
        [w[b[i] : b[i + 1]] for i in range(n)],
        [to_state[t[b[i] : b[i + 1]]] for i in range(n)],
    )


def _vocab_rows(vocab: pd.Index, state_vocab: np.ndarray) -> np.ndarray:
    """Row of each fitted-vocabulary term in the memory postings (-1 when absent)."""
    return pd.Index(state_vocab, dtype=object).get_indexer(vocab.to_numpy()).astype(np.int64)


def nearest_rows(
    rows: DataFrame,
    prep: Prepared,
    idf_bcast,
    terms_col: str,
    label_col: str | None = None,
    batch_rows: int = 512,
    pos_col: str = "match_pos",
    score_col: str = "score",
) -> DataFrame:
    """Row-wise top-1 for a broadcast sparse memory: every input column is carried
    through and ``pos_col``/``score_col`` and the carried memory columns are appended
    (as ``_carry_<name>``).

    ``terms_col`` holds each row's raw term list (tokenised JVM-side); tf, idf
    and the cosine are computed inside the scoring task, so the query stream is
    never exploded, grouped or shuffled, and no join back to the input is needed.
    """
    if prep.strategy != "broadcast" or prep.kind != "sparse":
        raise ValueError("row-wise scoring needs a broadcast sparse memory")
    bstate = prep.state
    keep_cols = [f for f in rows.schema.fields if f.name != terms_col]
    carried = [StructField(f"_carry_{f.name}", f.dataType, True) for f in prep.fields]
    schema = StructType([*keep_cols, StructField(pos_col, LongType()), StructField(score_col, DoubleType()), *carried])
    names, carry = [f.name for f in keep_cols], prep.carry

    def run(batches):
        state, iv = bstate.value, idf_bcast.value
        vocab = pd.Index(iv["terms"], dtype=object)  # hash index, built once per task
        to_state = _vocab_rows(vocab, state["vocab"])
        step = _block_rows(state, batch_rows)
        for pdf in batches:
            for lo in range(0, len(pdf), step):
                chunk = pdf.iloc[lo : lo + step]
                terms, ws, tids = _weigh_batch(list(chunk[terms_col]), vocab, iv["idf"], to_state)
                q = pd.DataFrame({"qid": np.arange(len(chunk)).astype(str), "terms": terms, "ws": ws, "tids": tids})
                if label_col is not None:
                    q["label"] = chunk[label_col].to_numpy()
                best = _best(state, q)
                out = chunk[names].reset_index(drop=True)
                out[pos_col] = best["match_pos"].to_numpy()
                out[score_col] = best["score"].to_numpy()
                for c in carry:
                    out[f"_carry_{c}"] = best[c]
                yield out

    return rows.mapInPandas(run, schema)


def _blocks_for(size: int, block_bytes: int = 64 << 20) -> int:
    return max(1, math.ceil(size / block_bytes))


def _query_blocks(q: DataFrame, kind: str, block_bytes: int = 64 << 20) -> int:
    """Query blocks sized by query volume: every memory shard is replicated once per
    block, so the block count follows the queries, not the cluster's partition count."""
    if kind == "dense":
        st = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
        size = int(st["n"] or 0) * int(st["d"] or 0) * 8
    else:
        st = q.agg(F.sum(F.size("terms")).alias("nnz")).first()
        size = int(st["nnz"] or 0) * 72
    return max(1, math.ceil(size / block_bytes))


def _nearest_sharded(q: DataFrame, prep: Prepared, batch_rows: int, n_blocks: int = 1, n_shards: int | None = None) -> DataFrame:
    """Memory shards against query blocks; the best of the shard winners per query row.

    The queries are written once with a row number of their own, which groups, reduces
    and joins them whatever their ids are.  A sparse query is sent only to the shards
    that share a term with it, with the shared terms and its whole norm.
    """
    from lexiflow.session import scratch_path

    kind, n_shards, m = prep.kind, n_shards or prep.n_shards, prep.memory
    path = scratch_path(q.sparkSession, "memory-queries")
    q.withColumn("_rk", F.monotonically_increasing_id()).write.parquet(path)
    q = q.sparkSession.read.parquet(path)
    shard = F.pmod(F.xxhash64("pos"), F.lit(n_shards)).cast("int")
    ms = m.withColumn("_shard", shard)
    block = F.pmod(F.xxhash64("_rk"), F.lit(n_blocks)).cast("int")
    if kind == "dense":
        qx = q.withColumn("_blk", block).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    else:
        qx = _shared_terms(q, ms).withColumn("_blk", block)
    mx = ms.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    fields = [StructField("_rk", LongType()), StructField("match_pos", LongType()), StructField("match_ord", LongType()), StructField("score", DoubleType())]
    names = ["qid", "match_pos", "match_ord", "score", *prep.carry]

    def run(qpdf: pd.DataFrame, mpdf: pd.DataFrame) -> pd.DataFrame:
        state = _dense_state(mpdf) if kind == "dense" else _sparse_state(mpdf)
        step = _block_rows(state, batch_rows)
        qpdf = qpdf.assign(qid=qpdf["_rk"])
        parts = [_best(state, qpdf.iloc[lo : lo + step]) for lo in range(0, len(qpdf), step)]
        out = pd.concat(parts, ignore_index=True) if parts else _best(state, qpdf)
        if "match_ord" not in out:
            out["match_ord"] = out["match_pos"]
        out = out[names].rename(columns={"qid": "_rk"})
        return out[out["match_pos"].notna()]

    # both sides come from the memory: fresh column ids keep the grouping keys apart
    mx = mx.toDF(*mx.columns)
    cand = (
        qx.groupBy("_shard", "_blk")
        .cogroup(mx.groupBy("_shard", "_blk"))
        .applyInPandas(run, StructType([*fields, *prep.fields]))
    )
    order = Window.partitionBy("_rk").orderBy(F.desc(F.round("score", TIE_DECIMALS)), F.asc("match_pos"), F.asc("match_ord"))
    best = cand.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
    return q.select("_rk", "qid").join(best, "_rk", "left")


def _shared_terms(q: DataFrame, ms: DataFrame) -> DataFrame:
    """One row per query and memory shard that share a term: the shared terms, their raw
    weights and the norm of the whole query."""
    nrm = F.sqrt(F.aggregate("ws", F.lit(0.0), lambda a, w: a + w * w))
    terms = q.withColumn("nrm", nrm).withColumn("_tw", F.explode(F.arrays_zip("terms", "ws")))
    terms = terms.select(*[c for c in q.columns if c not in ("terms", "ws")], "nrm", F.col("_tw.terms").alias("term"), F.col("_tw.ws").alias("w"))
    # a table of its own: the join below must not share columns with the memory side
    where = ms.select(F.col("_shard").alias("_s"), F.explode("terms").alias("_t")).distinct().select(F.col("_t").alias("term"), F.col("_s").alias("_to"))
    rest = [c for c in q.columns if c not in ("terms", "ws", "_rk")]
    sent = terms.join(where, "term").groupBy("_rk", "_to").agg(
        F.sort_array(F.collect_list(F.struct("term", "w"))).alias("_tw"), F.first("nrm").alias("nrm"), *[F.first(c).alias(c) for c in rest]
    )
    return sent.select(
        "_rk", F.col("_to").alias("_shard"), "nrm", *rest, F.transform("_tw", lambda s: s["term"]).alias("terms"), F.transform("_tw", lambda s: s["w"]).alias("ws")
    )


# ----------------------------------------------------------------------------- helpers


def cosine(a, b):
    """Cosine of two array columns in double precision (JVM-side)."""
    from pyspark.sql import Column

    ca = F.col(a) if isinstance(a, str) else a
    cb = F.col(b) if isinstance(b, str) else b
    ca = ca.cast("array<double>")
    cb = cb.cast("array<double>")
    dot = F.aggregate(F.zip_with(ca, cb, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(F.transform(ca, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))
    nb = F.sqrt(F.aggregate(F.transform(cb, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))
    res: Column = F.when((na > 0) & (nb > 0), dot / (na * nb))
    return res


def sparse_vectors(long_form: DataFrame, id_col: str, weight_col: str = "tfidf") -> DataFrame:
    """Long form (id, term, weight) -> (id, terms, ws); one group per document
    (bounded by its distinct terms)."""
    g = long_form.groupBy(id_col).agg(F.collect_list(F.struct("term", weight_col)).alias("_tw"))
    return g.select(
        id_col,
        F.transform("_tw", lambda s: s["term"]).alias("terms"),
        F.transform("_tw", lambda s: s[weight_col]).alias("ws"),
    )
