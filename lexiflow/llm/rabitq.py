"""Nearest neighbours by cosine from randomly rotated one-bit codes.

Every vector is scaled to length one, centred, rotated by a seeded random orthogonal
matrix and kept as the signs of its coordinates with three correction scalars: its inner
product with the centre, its distance from the centre and the inner product of its
direction with its code.  A query's rotated direction is cut into bit-planes, and the inner
product with a code is a weighted sum of popcounts.  The estimate's error bound decides
which vectors are compared exactly, on the original vectors in double precision: all whose
estimate plus bound reaches the fifth best score found so far.

Rows and queries meet in blocks: a task holds one block of rows and one of queries, and
passes on the best ``k`` of each query; the best of all blocks are then taken per query.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part, neither as query nor as candidate; a query's own row is no candidate, another row
with its id is; fewer than ``k`` candidates give fewer rows; ties go to the smaller id, null
ids last.  Vectors of different lengths in one table are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm import common as C

ROW_BLOCK = 4096
QUERY_BLOCK = 4096
PLANES = 6  # bits a query coordinate is cut into
BOUND = 3.0  # standard deviations of the estimate
K = 5
EVERY = 50
SEED = 42


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float64)


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    return pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first, against overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Codec:
    """Rotation and centre, and the codes they give."""

    def __init__(self, centre: np.ndarray, seed: int = SEED):
        self.dim = len(centre)
        self.wide = max(64, -(-self.dim // 64) * 64)
        self.centre, self.turn = centre, rotation(self.wide, seed)

    def _turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = unit(x)
        d = u - self.centre
        r = np.sqrt((d * d).sum(1))
        y = np.zeros((len(x), self.wide))
        y[:, : self.dim] = d / np.maximum(r, 1e-300)[:, None]
        return u @ self.centre, r, y @ self.turn

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(packed signs as 64-bit words, scalars: with centre, distance, with code)."""
        c, r, y = self._turned(x)
        plus = y > 0
        fit = np.abs(y).sum(1) / np.sqrt(self.wide)
        return np.packbits(plus, axis=1).view(np.uint64), np.column_stack([c, r, np.maximum(fit, 1e-9)])

    def estimate(self, x: np.ndarray, bits: np.ndarray, scalars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated cosine, bound) of every query in ``x`` with every code."""
        c, r, y = self._turned(x)
        low = y.min(1, keepdims=True)
        step = np.maximum((y.max(1, keepdims=True) - low) / (2**PLANES - 1), 1e-12)
        cut = np.rint((y - low) / step).astype(np.uint8)
        dots = np.zeros((len(x), len(bits)))
        for b in range(PLANES):
            plane = np.packbits((cut >> b) & 1, axis=1).view(np.uint64)
            for w in range(plane.shape[1]):
                dots += np.bitwise_count(plane[:, w, None] & bits[None, :, w]) * float(1 << b)
        ones = np.bitwise_count(bits).sum(1)
        # sum over coordinates of sign * value = 2 * (sum over set signs) - sum over all
        total = low[:, 0] * self.wide + step[:, 0] * cut.sum(1)
        inner = (2 * (step * dots + low * ones) - total[:, None]) / np.sqrt(self.wide)
        oc, orr, fit = scalars.T
        spread = r[:, None] * orr
        guess = oc + c[:, None] - self.centre @ self.centre + spread * inner / fit
        sigma = np.sqrt(np.maximum(1 - fit**2, 0) / max(self.wide - 1, 1)) / fit + step / np.sqrt(12) / fit
        return guess, BOUND * spread * sigma + 1e-9


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of paired rows in double precision."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def best(score: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, null, -score))[:k]


def search_block(codec: Codec, rows: dict, queries: dict, k: int) -> dict[str, list]:
    """Best ``k`` rows of the block for each query of the block."""
    out: dict[str, list] = {"qrow": [], "query_id": [], "vec_id": [], "score": []}
    for a in range(0, len(queries["row"]), 128):
        x = queries["x"][a : a + 128]
        guess, bound = codec.estimate(x, rows["bits"], rows["scalars"])
        for i in range(len(x)):
            g, top = guess[i], guess[i] + bound[i]
            g[rows["row"] == queries["row"][a + i]] = -np.inf
            # exact scores of the likeliest rows set the bar for all others
            first = np.argpartition(-g, min(4 * k, len(g) - 1))[: 4 * k] if len(g) > 4 * k else np.arange(len(g))
            first = first[np.isfinite(g[first])]
            if len(first) == 0:
                continue
            s = exact(np.broadcast_to(x[i], (len(first), len(x[i]))), rows["x"][first])
            bar = np.sort(s)[-k] if len(s) >= k else -np.inf
            rest = (top >= bar) & np.isfinite(g)
            rest[first] = False
            more = np.flatnonzero(rest)
            if len(more):
                s = np.concatenate([s, exact(np.broadcast_to(x[i], (len(more), len(x[i]))), rows["x"][more])])
                first = np.concatenate([first, more])
            pick = best(s, rows["id"][first], rows["null"][first], k)
            out["qrow"].extend([int(queries["row"][a + i])] * len(pick))
            out["query_id"].extend([int(queries["id"][a + i])] * len(pick))
            out["vec_id"].extend(None if n else int(v) for n, v in zip(rows["null"][first][pick], rows["id"][first][pick], strict=True))
            out["score"].extend(s[pick].tolist())
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, id, vec) of the rows that take part, with a row number of its own each."""
    v = F.col(vec_col).cast("array<double>")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec"))
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    some = F.exists("vec", lambda c: c != 0)
    return src.where("vec is not null").where(~bad).where(some).withColumn("row", F.monotonically_increasing_id())


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, Codec | None]:
    """(index table, codec): codes of every row that takes part, stored once."""
    rows = C.stored(usable(vectors, id_col, vec_col).select("row", "id", "vec"), "ann-rows")
    dims = [r[0] for r in rows.select(F.size("vec")).distinct().limit(2).collect()]
    if len(dims) > 1:
        raise ValueError("vectors of different lengths")
    if not dims:
        return rows.withColumn("bits", F.lit(b"")).withColumn("scalars", F.lit(b"")), None
    dim = int(dims[0])

    def sums(batches):
        for batch in batches:
            if batch.num_rows:
                u = unit(matrix(batch.column(0), dim))
                yield pa.RecordBatch.from_arrays([pa.array([u.sum(0).tolist()]), pa.array([len(u)])], names=["s", "n"])

    parts = rows.select("vec").mapInArrow(C.task(sums), "s array<double>, n long")
    s = parts.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    n = parts.agg(F.sum("n")).first()[0]
    centre = np.array([r["x"] for r in sorted(s, key=lambda r: r["i"])]) / n
    centre = np.round(centre, 9)  # the sum's order must not change the codes
    codec = Codec(centre)

    def codes(batches):
        own = Codec(centre)
        for batch in batches:
            if batch.num_rows:
                bits, scalars = own.codes(matrix(batch.column(2), dim))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([b.tobytes() for b in bits], pa.binary()), pa.array([x.tobytes() for x in scalars], pa.binary())],
                    names=["row", "id", "vec", "bits", "scalars"],
                )

    schema = "row long, id long, vec array<double>, bits binary, scalars binary"
    return C.stored(rows.mapInArrow(C.task(codes), schema), "ann-index"), codec


def nearest(index: DataFrame, codec: Codec | None, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): ``queries`` are rows of the index."""
    spark = index.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if codec is None:
        return spark.createDataFrame([], schema)
    n, q = index.count(), queries.count()
    n_rows, n_queries = max(1, -(-n // ROW_BLOCK)), max(1, -(-q // QUERY_BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    mod = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    left = index.withColumn("rb", mod("row", n_rows)).withColumn("qb", every(n_queries))
    right = queries.select("row", "id", "vec").withColumn("qb", mod("row", n_queries)).withColumn("rb", every(n_rows))
    centre, dim = codec.centre, codec.dim

    def meet(rows: pa.Table, asks: pa.Table) -> pa.Table:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        found: dict[str, list] = {"qrow": [], "query_id": [], "vec_id": [], "score": []}
        if rows.num_rows and asks.num_rows:
            rows, asks = rows.combine_chunks(), asks.combine_chunks()
            col = lambda t, c: t[c].chunk(0) if t[c].num_chunks == 1 else pa.concat_arrays(t[c].chunks)
            ids = col(rows, "id")
            block = {
                "row": col(rows, "row").to_numpy(zero_copy_only=False), "null": ids.is_null().to_numpy(zero_copy_only=False),
                "id": ids.fill_null(0).to_numpy(zero_copy_only=False), "x": matrix(col(rows, "vec"), dim),
                "bits": np.frombuffer(b"".join(col(rows, "bits").to_pylist()), np.uint64).reshape(rows.num_rows, -1),
                "scalars": np.frombuffer(b"".join(col(rows, "scalars").to_pylist())).reshape(rows.num_rows, 3),
            }
            ask = {c: col(asks, c).to_numpy(zero_copy_only=False) for c in ("row", "id")} | {"x": matrix(col(asks, "vec"), dim)}
            found = search_block(Codec(centre), block, ask, k)
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(found.items(), kinds, strict=True)})

    near = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(meet, "qrow long, query_id long, vec_id long, score double")
    w = Window.partitionBy("qrow").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    index, codec = build_index(C.source_table(spark, sf_dir, "embeddings"))
    return nearest(index, codec, index.where(F.col("id") % EVERY == 0))


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, o.vec_id, list_cosine_similarity(q.e, o.e) AS score
  FROM v q JOIN v o ON q.vec_id <> o.vec_id WHERE q.vec_id % {EVERY} = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
