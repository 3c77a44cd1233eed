"""Logistic regression whose coefficients never meet on one machine, in few passes over the matrix.

The penalised optimum is a sum of training rows, so a point is kept as factors of documents, in
their shards (:mod:`lexiflow.operators.shards`), not as coefficients of terms.  A pass makes the gradient there: shards
send the sums of their terms to buckets, buckets add them up and answer, and a shard keeps the factors of the gradient
and its margins.  A term that one shard alone holds never leaves it.

The objective is then minimised over all combinations of the gradients found so far, each class of
each gradient a vector of its own, by Newton steps: margins are linear, so a step needs the kept
margins only, and no pass.  The next gradient is orthogonal to all of these, so passes are few (5 instead of
73 on 41,054 documents of four classes).  Beyond ``MOST`` vectors, the point and the latest ones are kept.

The driver holds the coordinates of the vectors: at most ``(classes * (MOST + 1))^2`` numbers.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.operators import shards as SH
from lexiflow.operators.blocked import NotConverged
from lexiflow.session import scratch_path

CLASSES = 8  # classes at most: the Newton system has (classes * vectors)^2 numbers
MOST = 60  # vectors kept
NEWTON = 20  # steps between two passes
TOGETHER = 2  # shards of a partition, as every step runs a task for each
BATCH = 1 << 20  # bytes of a batch to Python: it goes through buffers outside the heap, which are kept


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = z.max(0)
    p = np.exp(z - top)
    s = p.sum(0)
    return p / s, np.log(s) + top


def _kept(row: dict, prefix: str, n: int) -> np.ndarray:
    """The vectors of a shard, one below the other."""
    parts = [SH.array(row[f"{prefix}{i}"]) for i in range(sum(c.startswith(prefix) and c[1:].isdigit() for c in row))]
    return np.concatenate([np.zeros((0, n)), *(p.reshape(-1, n) for p in parts)])


def _residuals(row: dict, y: np.ndarray, w: np.ndarray, point: np.ndarray, bias: np.ndarray, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """(sums over documents of the residuals, factors of the gradient of all classes but the last)."""
    n = len(y)
    p = _softmax(point @ _kept(row, "k", n) + bias[:, None])[0]
    p[y, np.arange(n)] -= 1
    p *= w
    return p.sum(1), (p + l2 * (point @ _kept(row, "g", n)))[:-1]


class Solver:
    """Minimises the sum of weighted log losses + ``l2 / 2 |W|^2``; intercepts are free."""

    def __init__(self, data: DataFrame, k: int, l2: float, tol: float, max_iter: int):
        self.spark, self.k, self.l2, self.tol, self.max_iter = data.sparkSession, k, l2, tol, max_iter
        parts = max(2 * self.spark.sparkContext.defaultParallelism, -(-data.count() // TOGETHER))
        self.shards = data.repartition(parts, "shard").persist(StorageLevel.MEMORY_AND_DISK)
        self.rows = data.select("shard", F.col("y").alias("ry"), F.col("w").alias("rw")).repartition(parts, "shard").persist(StorageLevel.MEMORY_AND_DISK)
        self.parts, self.tables = parts, 0
        self.point, self.bias = np.zeros((k, 0)), np.zeros(k)  # coordinates of the kept vectors
        self.gram = np.zeros((0, 0))

    def close(self) -> None:
        self.shards.unpersist()
        self.rows.unpersist()

    def _sums(self, point: np.ndarray, bias: np.ndarray, l2: float, all_terms: bool) -> tuple[DataFrame, DataFrame]:
        """(matrix and vectors of every shard, its sums per term by bucket): of the factors of the gradient, or with
        ``all_terms`` of the point's own and also of the terms that no other shard holds."""
        joined = self.shards.join(self.rows.drop("ry", "rw").hint("shuffle_hash"), "shard")  # both lie by shard: nothing is moved or sorted
        names = joined.columns

        def run(batches):
            for b in batches:
                for values in zip(*b.columns, strict=True):
                    row = dict(zip(names, values, strict=True))
                    x = SH.Shard(row)
                    if all_terms:
                        e, which = (point @ _kept(row, "g", len(x.y)))[:-1], np.flatnonzero(x.idx >= 0)
                    else:
                        e, which = _residuals(row, x.y, x.w, point, bias, l2)[1], np.flatnonzero(x.shared)
                    g, idx, parts = x.back(e)[:, which], x.idx[which], x.parts(which)
                    yield SH.rows_of(
                        ["bucket", "shard", "idx", "v"],
                        [pa.array([p[0] for p in parts], pa.int32()), pa.array([row["shard"].as_py()] * len(parts), pa.int64()), pa.array([_blob(idx[a:e]) for _, a, e in parts], pa.binary()), pa.array([_blob(g[:, a:e]) for _, a, e in parts], pa.binary())],
                    )

        return joined, joined.mapInArrow(run, "bucket int, shard long, idx binary, v binary")

    def gradient(self) -> tuple[DataFrame, str]:
        """(shard, g, k, info) written: factors of the gradient and its margins; ``info`` has the sums of
        residuals, the largest component of the gradient, and products with the vectors kept."""
        point, bias, l2, r = self.point, self.bias, self.l2, self.k - 1
        joined, sums = self._sums(point, bias, l2, False)

        def add(t: pa.Table) -> pa.Table:
            t = t.sort_by("shard")
            idx = [SH.array(i, np.int32) for i in t["idx"]]
            total = np.zeros((r, max((int(i.max()) + 1 for i in idx if len(i)), default=0)))
            for i, v in zip(idx, t["v"], strict=True):
                total[:, i] += SH.array(v).reshape(r, -1)
            return pa.table({"shard": t["shard"], "bucket": t["bucket"], "v": pa.array([_blob(total[:, i]) for i in idx], pa.binary())})

        def back(batches):
            for b in batches:
                for values in zip(*b.columns, strict=True):
                    row = dict(zip(b.schema.names, values, strict=True))
                    x = SH.Shard(row)
                    residual, e = _residuals(row, x.y, x.w, point, bias, l2)
                    g = x.back(e)
                    if row["answers"].is_valid:
                        got = row["answers"].values
                        order = np.argsort(got.field("bucket").to_numpy())
                        g[:, np.flatnonzero(x.shared)] = np.concatenate([SH.array(got.field("v")[i]).reshape(r, -1) for i in order.tolist()], 1)
                    top = max(np.abs(g).max(initial=0), np.abs(g.sum(0)).max(initial=0))
                    m = x.forth(g)
                    products = m @ np.concatenate([_kept(row, "g", len(x.y)), e]).T
                    info = np.concatenate([residual, [top], products.ravel()])
                    yield SH.rows_of(["shard", "g", "k", "info"], [pa.array([row["shard"].as_py()], pa.int64()), *(pa.array([_blob(v)], pa.binary()) for v in (e, m, info))])

        answers = sums.groupBy("bucket").applyInArrow(add, "shard long, bucket int, v binary")
        answers = answers.repartition(self.parts, "shard").groupBy("shard").agg(F.collect_list(F.struct("bucket", "v")).alias("answers"))
        out = joined.join(answers.hint("shuffle_hash"), "shard", "left").mapInArrow(back, "shard long, g binary, k binary, info binary")
        path = scratch_path(self.spark, "gradient")
        out.write.parquet(path)
        return self.spark.read.schema(out.schema).parquet(path), path

    def _keep(self, table: DataFrame) -> None:
        """Put the vectors of a table (shard, g, k) beside the others."""
        new = table.select("shard", F.col("g").alias(f"g{self.tables}"), F.col("k").alias(f"k{self.tables}"))
        before, self.tables = self.rows, self.tables + 1
        self.rows = before.join(new.repartition(self.parts, "shard").hint("shuffle_hash"), "shard").persist(StorageLevel.MEMORY_AND_DISK)
        self.rows.select(F.sum(F.length("ry"))).collect()
        before.unpersist()

    def _shrink(self) -> None:
        """Replace the vectors by the point and the latest half."""
        r, m, some = self.k - 1, self.point.shape[1], MOST // 2
        change = np.concatenate([self.point[:r], np.eye(m)[m - some :]])

        def run(batches):
            names = None
            for b in batches:
                names = b.schema.names
                for values in zip(*b.columns, strict=True):
                    row = dict(zip(names, values, strict=True))
                    n = len(row["ry"].as_buffer()) // 4
                    out = [_blob(change @ _kept(row, p, n)) for p in "gk"]
                    yield SH.rows_of(["shard", "ry", "rw", "g", "k"], [pa.array([v.as_py()]) for v in values[:3]] + [pa.array([v], pa.binary()) for v in out])

        path, before = scratch_path(self.spark, "vectors"), self.rows
        cols = ["shard", "ry", "rw", *[f"{p}{i}" for i in range(self.tables) for p in "gk"]]
        before.select(*cols).mapInArrow(run, "shard long, ry binary, rw binary, g binary, k binary").write.parquet(path)
        table = self.spark.read.schema("shard long, ry binary, rw binary, g binary, k binary").parquet(path)
        self.rows, self.tables = table.select("shard", "ry", "rw").repartition(self.parts, "shard").persist(StorageLevel.MEMORY_AND_DISK), 0
        self._keep(table)
        before.unpersist()
        self.gram = change @ self.gram @ change.T
        self.point = np.concatenate([np.eye(r), -np.ones((1, r))]) @ np.eye(r, r + some)

    def loss(self, point: np.ndarray, bias: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Sum of the losses, and its first and second derivatives by the coordinates (and an intercept) per class."""
        k, m = point.shape[0], point.shape[1] + 1

        def run(batches):
            f, first, second = 0.0, np.zeros((k, m)), np.zeros((k, m, k, m))
            for b in batches:
                for values in zip(*b.columns, strict=True):
                    row = dict(zip(b.schema.names, values, strict=True))
                    y, w = SH.array(row["ry"], np.int32), SH.array(row["rw"])
                    v = np.concatenate([_kept(row, "k", len(y)), np.ones((1, len(y)))])
                    z = np.column_stack([point, bias]) @ v
                    p, top = _softmax(z)
                    f += float((w * (top - z[y, np.arange(len(y))])).sum())
                    for c in range(k):
                        for d in range(c, k):
                            part = (v * (w * p[c] * ((c == d) - p[d]))) @ v.T
                            second[c, :, d] += part
                            if c != d:
                                second[d, :, c] += part
                    p[y, np.arange(len(y))] -= 1
                    first += (p * w) @ v.T
            yield SH.rows_of(["f", "a", "b"], [pa.array([f]), pa.array([_blob(first)], pa.binary()), pa.array([_blob(second)], pa.binary())])

        cols = ["ry", "rw", *[f"k{i}" for i in range(self.tables)]]
        got = self.rows.select(*cols).mapInArrow(run, "f double, a binary, b binary").toArrow()
        total = [sum(SH.array(x) for x in got[c]) for c in "ab"]
        return sum(got["f"].to_pylist()), total[0].reshape(k, m), total[1].reshape(k, m, k, m)

    def minimise(self, total: float) -> None:
        k, r = self.k, self.k - 1
        for step in range(self.max_iter + 1):
            table, path = self.gradient()
            info = [SH.array(x) for x in table.select("shard", "info").orderBy("shard").select("info").toArrow()["info"]]
            SH.free(self.spark)
            top = max(max(i[k] for i in info), np.abs(sum(i[:k] for i in info)).max()) / total
            if top <= self.tol:
                return
            if step == self.max_iter:
                break
            products = sum(i[k + 1 :] for i in info).reshape(r, -1)
            self._keep(table)
            old, gram = len(self.gram), products[:, : len(self.gram)]
            self.gram = np.block([[self.gram, gram.T], [gram, (products[:, old:] + products[:, old:].T) / 2]])
            self.point = np.concatenate([self.point, np.zeros((k, r))], 1)
            if len(self.gram) > MOST:
                self._shrink()
            self._newton(total)
        warnings.warn(f"stopped with a gradient of {top:.2e}", NotConverged, stacklevel=4)

    def _newton(self, total: float) -> None:
        """Minimise over the kept vectors and the intercepts."""
        k, l2 = self.k, self.l2
        # an orthonormal basis of the vectors; directions that are not there but for rounding go
        unit = 1 / np.sqrt(np.maximum(np.diag(self.gram), 1e-300))
        size, axes = np.linalg.eigh(self.gram * unit * unit[:, None])
        good = size > 1e-12 * size.max()
        basis = (axes[:, good] / np.sqrt(size[good])).T * unit
        at, m = self.point @ self.gram @ basis.T, int(good.sum())
        bias = self.bias

        def value(at, bias):
            f, first, second = self.loss(at @ basis, bias)
            wide = np.zeros((m + 1, basis.shape[1] + 1))
            wide[:m, :-1], wide[m, -1] = basis, 1
            first = first @ wide.T
            first[:, :m] += l2 * at
            second = np.einsum("ia,cadb,jb->cidj", wide, second, wide, optimize=True)
            for c in range(k):
                second[c, range(m), c, range(m)] += l2
                # one intercept of all classes has no effect on the loss
                second[c, m, :, m] += total / k**2
            return f + 0.5 * l2 * float((at * at).sum()), first, second

        f, first, second = value(at, bias)
        start = np.linalg.norm(first[:, :m])
        for _ in range(NEWTON):
            if np.linalg.norm(first[:, :m]) <= max(0.3 * self.tol * total, 0.01 * start) and np.abs(first[:, m]).max() <= 0.3 * self.tol * total:
                break
            flat = second.reshape(k * (m + 1), -1)
            d = -np.linalg.solve(flat + 1e-12 * np.trace(flat) / len(flat) * np.eye(len(flat)), first.ravel()).reshape(k, m + 1)
            slope, s = float((first * d).sum()), 1.0
            while True:
                new = value(at + s * d[:, :m], bias + s * d[:, m])
                if new[0] <= f + 1e-4 * s * slope or s < 1e-8:
                    break
                s /= 2
            if not new[0] <= f + 1e-12 * abs(f):
                break
            at, bias = at + s * d[:, :m], bias + s * d[:, m]
            f, first, second = new
        self.point, self.bias = at @ basis, bias

    def coefficients(self, terms: DataFrame, n_docs: int) -> DataFrame:
        """(term, df, idf, coef): one array of class coefficients per term of the vocabulary ``terms``."""
        r, k = self.k - 1, self.k

        def run(t: pa.Table, known: pa.Table) -> pa.Table:
            t = t.sort_by("shard")
            total = np.zeros((r, known["n"][0].as_py()))
            for i, v in zip(t["idx"], t["v"], strict=True):
                total[:, SH.array(i, np.int32)] += SH.array(v).reshape(r, -1)
            w = np.concatenate([total, -total.sum(0, keepdims=True)])
            df = SH.array(known["df"][0], np.int64)
            coef = pa.ListArray.from_arrays(pa.array(np.arange(len(df) + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(w.T).ravel()))
            return pa.table({"term": SH.unpacked(known["lens"][0], known["terms"][0]), "df": df, "idf": SH.idf_of(df, n_docs), "coef": coef})

        sums = self._sums(self.point, self.bias, self.l2, True)[1]
        return sums.groupBy("bucket").cogroup(terms.select("bucket", "n", "lens", "terms", "df").groupBy("bucket")).applyInArrow(run, "term string, df long, idf double, coef array<double>")


def minimise(data: DataFrame, terms: DataFrame, k: int, n_docs: int, total: float, max_iter: int, tol: float, path: str) -> np.ndarray:
    """Fit on the rows of :func:`lexiflow.operators.shards.matrix`; writes (term, df, idf, coef) to ``path``, returns the intercepts."""
    # two softmax rows share the margin evenly: twice the penalty gives the margin the
    # penalty that a binary model puts on its one row
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = data.sparkSession.conf.get(name)
    data.sparkSession.conf.set(name, str(BATCH))
    solver = Solver(data, k, 2.0 if k == 2 else 1.0, tol, max_iter)
    try:
        solver.minimise(total)
        solver.coefficients(terms, n_docs).write.parquet(path)
        return solver.bias - solver.bias.mean()
    finally:
        solver.spark.conf.set(name, before)
        solver.close()
        SH.free(solver.spark)
