"""Logistic regression whose coefficients never meet on one machine.

The feature matrix is cut into cells of ``ROWS`` x ``COLS``; coefficients, gradients and the
solver's history are tables of column blocks, margins and residuals tables of row blocks.
A pass joins coefficient blocks to cells by column block and adds partial margins by row
block; residual blocks are joined to cells by row block and partial gradients added by
column block.  The cells are kept in both partitionings (spilled to disk, recomputed from the
written rows if an executor is lost), so a pass shuffles blocks, never the matrix.

The solver is vector-free L-BFGS: all dot products of its basis (past steps, past gradient
changes, the gradient and the point itself) are summed in one Spark pass, the two-loop
recursion runs on these few numbers, and its result is a linear combination of blocks.
Margins are linear, so a line search needs the margins of the direction once and then only
row blocks.  Every iteration writes its state: nothing depends on a lost executor.

The driver holds one row per class and at most ``(2 MEMORY + 2)^2`` dot products.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.operators import features as FE
from lexiflow.session import scratch_path

ROWS = 1 << 15
COLS = 1 << 15
MEMORY = 8
CELL_VALUES = 1 << 20  # stored values that a piece of a cell holds at most
STEPS = [0.5**i for i in range(12)]  # of a line search, evaluated together


class NotConverged(UserWarning):
    pass


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"blocked-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _batch(names: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _array(scalar, kind=np.float64) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), kind)


def _total(t: pa.Table, col: str, by: str) -> np.ndarray:
    """Sum of the blocks of a group, in a fixed order."""
    t = t.sort_by(by)
    out = np.zeros(0)
    for v in t[col]:
        part = _array(v)
        out = part.copy() if not len(out) else out + part
    return out


class Cells:
    """The training matrix: ``rows`` (rb, y, w), and the cells partitioned by either side."""

    def __init__(self, data: DataFrame, k: int, n_terms: int, n_rows: int, rows: int = 0, cols: int = 0):
        self.rows_per, self.cols_per = rows or ROWS, cols or COLS
        self.spark, self.k, self.n_terms, self.n_rows = data.sparkSession, k, n_terms, n_rows
        numbered = FE.dense_ids(data, [F.asc("id")], "r")
        self.rows = _stored(self._row_blocks(numbered), "rows")
        cells = _stored(self._cut(numbered), "cells")
        self.col_blocks = -(-n_terms // self.cols_per)
        self.row_blocks = max(1, -(-n_rows // self.rows_per))
        level = StorageLevel.MEMORY_AND_DISK
        slots = self.spark.sparkContext.defaultParallelism
        self.by_col = cells.repartition(max(1, min(self.col_blocks, 4 * slots)), "cb").persist(level)
        self.by_row = cells.repartition(max(1, min(self.row_blocks, 4 * slots)), "rb").persist(level)

    def close(self) -> None:
        self.by_col.unpersist()
        self.by_row.unpersist()

    def _row_blocks(self, numbered: DataFrame) -> DataFrame:
        size = self.rows_per

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by("r")
            y, w = t["y"].to_numpy().astype(np.int32), t["w"].to_numpy()
            return pa.table({"rb": t["rb"].slice(0, 1), "y": [_blob(y)], "w": [_blob(w)]})

        narrow = numbered.select(F.expr(f"r div {size}").alias("rb"), "r", "y", "w")
        return narrow.groupBy("rb").applyInArrow(run, "rb long, y binary, w binary")

    def _cut(self, numbered: DataFrame) -> DataFrame:
        rows, cols, most = self.rows_per, self.cols_per, CELL_VALUES
        names = ["rb", "cb", "ro", "co", "v"]

        def run(batches):
            for b in batches:
                size = b.column(1).value_lengths().to_numpy()
                r = np.repeat(b.column(0).to_numpy(), size)
                c, v = b.column(1).flatten().to_numpy().astype(np.int64), b.column(2).flatten().to_numpy()
                order = np.lexsort((c // cols, r // rows))
                r, c, v = r[order], c[order], v[order]
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] // rows != r[:-1] // rows) | (c[1:] // cols != c[:-1] // cols)
                cut = np.flatnonzero(new)
                for a, e in zip(cut.tolist(), [*cut[1:].tolist(), len(r)], strict=True):
                    for i in range(a, e, most):
                        j = min(e, i + most)
                        yield _batch(
                            names, [int(r[a] // rows)], [int(c[a] // cols)],
                            [_blob((r[i:j] % rows).astype(np.int32))], [_blob((c[i:j] % cols).astype(np.int32))], [_blob(v[i:j])],
                        )

        return numbered.select("r", "cols", "vals").mapInArrow(run, "rb long, cb long, ro binary, co binary, v binary")

    def margins(self, blocks: DataFrame) -> DataFrame:
        """(rb, z): margins, without intercepts, of coefficient blocks (cb, x)."""
        k, rows, cols = self.k, self.rows_per, self.cols_per

        def part(batches):
            for b in batches:
                for rb, cb, ro, co, v, x in zip(*b.columns, strict=True):
                    ro, co, v = _array(ro, np.int32), _array(co, np.int32), _array(v)
                    w = _array(x).reshape(k, cols)
                    z = np.stack([np.bincount(ro, w[c, co] * v, rows) for c in range(k)])
                    yield _batch(["rb", "cb", "z"], [rb.as_py()], [cb.as_py()], [_blob(z)])

        def add(t: pa.Table) -> pa.Table:
            return pa.table({"rb": t["rb"].slice(0, 1), "z": [_blob(_total(t, "z", "cb"))]})

        joined = self.by_col.join(blocks, "cb").select("rb", "cb", "ro", "co", "v", "x")
        return joined.mapInArrow(part, "rb long, cb long, z binary").groupBy("rb").applyInArrow(add, "rb long, z binary")

    def gradient(self, residuals: DataFrame) -> DataFrame:
        """(cb, g): sums over rows of residual times feature, from (rb, e)."""
        k, rows, cols = self.k, self.rows_per, self.cols_per

        def part(batches):
            for b in batches:
                for rb, cb, ro, co, v, e in zip(*b.columns, strict=True):
                    ro, co, v = _array(ro, np.int32), _array(co, np.int32), _array(v)
                    r = _array(e).reshape(k, rows)
                    g = np.stack([np.bincount(co, r[c, ro] * v, cols) for c in range(k)])
                    yield _batch(["cb", "rb", "g"], [cb.as_py()], [rb.as_py()], [_blob(g)])

        def add(t: pa.Table) -> pa.Table:
            return pa.table({"cb": t["cb"].slice(0, 1), "g": [_blob(_total(t, "g", "rb"))]})

        joined = self.by_row.join(residuals, "rb").select("rb", "cb", "ro", "co", "v", "e")
        return joined.mapInArrow(part, "cb long, rb long, g binary").groupBy("cb").applyInArrow(add, "cb long, g binary")


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = z.max(0)
    p = np.exp(z - top)
    s = p.sum(0)
    return p / s, np.log(s) + top


def _margins_of(z, d, rows: int, k: int, n: int, bias: np.ndarray, step_bias: np.ndarray, step: float) -> np.ndarray:
    """Margins of a row block at ``step`` along the direction; blocks without features are null."""
    out = np.repeat((bias + step * step_bias)[:, None], n, 1)
    for blob, f in ((z, 1.0), (d, step)):
        if blob.is_valid and f:
            out += f * _array(blob).reshape(k, rows)[:, :n]
    return out


class Solver:
    """Minimises mean log loss + ``l2 / (2 total) |W|^2`` over blocks; intercepts are free."""

    def __init__(self, cells: Cells, l2: float, tol: float, max_iter: int):
        self.cells, self.l2, self.tol, self.max_iter = cells, l2, tol, max_iter
        self.k = cells.k
        spark = cells.spark

        def weight(batches):
            for b in batches:
                for w in b.column(0):
                    yield _batch(["t"], [float(_array(w).sum())])

        self.total = float(cells.rows.select("w").mapInArrow(weight, "t double").agg(F.sum("t")).first()[0])
        size, k = cells.cols_per, self.k

        def zeros(batches):
            for b in batches:
                for i in b.column(0).to_pylist():
                    yield _batch(["cb", "v"], [i], pa.array([[_blob(np.zeros(k * size))]], pa.list_(pa.binary())))

        # vectors of a block: x, g, then steps and gradient changes, the latest last
        self.state = spark.range(cells.col_blocks).mapInArrow(zeros, "cb long, v array<binary>")
        self.bias, self.bias_grad = np.zeros(k), np.zeros(k)
        self.past: list[tuple[np.ndarray, np.ndarray]] = []
        self.z = cells.rows.select("rb", F.lit(None).cast("binary").alias("z"))
        self.dir = cells.rows.select("rb", F.lit(None).cast("binary").alias("d"))

    def _rows(self) -> DataFrame:
        return self.cells.rows.join(self.z, "rb", "left").join(self.dir, "rb", "left").select("rb", "y", "w", "z", "d")

    def losses(self, steps: list[float], step_bias: np.ndarray) -> list[float]:
        """Sums of the weighted log losses at steps along the direction."""
        rows, k, bias = self.cells.rows_per, self.k, self.bias

        def run(batches):
            for b in batches:
                for y, w, z, d in zip(*b.columns, strict=True):
                    y, w = _array(y, np.int32), _array(w)
                    out = []
                    for s in steps:
                        m = _margins_of(z, d, rows, k, len(y), bias, step_bias, s)
                        out.append(float((w * (_softmax(m)[1] - m[y, np.arange(len(y))])).sum()))
                    yield _batch(["i", "f"], list(range(len(steps))), out)

        got = self._rows().select("y", "w", "z", "d").mapInArrow(run, "i long, f double").groupBy("i").agg(F.sum("f").alias("f")).collect()
        out = dict(got)
        return [out[i] for i in range(len(steps))]

    def move(self, step: float, step_bias: np.ndarray) -> tuple[DataFrame, DataFrame]:
        """((rb, z) at the step, (rb, e, b): residuals there and their sums), written."""
        rows, k, bias = self.cells.rows_per, self.k, self.bias

        def run(batches):
            for b in batches:
                for rb, y, w, z, d in zip(*b.columns, strict=True):
                    y, w = _array(y, np.int32), _array(w)
                    m = _margins_of(z, d, rows, k, len(y), bias, step_bias, step)
                    e = _softmax(m)[0]
                    e[y, np.arange(len(y))] -= 1
                    e *= w
                    at = m - (bias + step * step_bias)[:, None]
                    wide = lambda x: _blob(np.pad(x, ((0, 0), (0, rows - x.shape[1]))))
                    yield _batch(["rb", "z", "e", "b"], [rb.as_py()], [wide(at)], [wide(e)], pa.array([e.sum(1).tolist()], pa.list_(pa.float64())))

        out = _stored(self._rows().mapInArrow(run, "rb long, z binary, e binary, b array<double>"), "margins")
        return out.select("rb", "z"), out.select("rb", "e", "b")

    def advance(self, direction: list[float], step: float, step_bias: np.ndarray, first: bool = False) -> None:
        """Move by ``step`` along the combination ``direction`` of the state's vectors; the
        state then has the new point, gradient, step and gradient change."""
        self.z, residuals = self.move(step, step_bias)
        grad = self.cells.gradient(residuals.select("rb", "e"))
        sums = np.array([r["b"] for r in residuals.select(F.posexplode("b").alias("c", "b")).groupBy("c").agg(F.sum("b").alias("b")).orderBy("c").collect()])
        k, l2, total, size = self.k, self.l2, self.total, self.cells.cols_per

        def run(batches):
            for b in batches:
                for cb, v, g in zip(*b.columns, strict=True):
                    old = [_array(x) for x in v]
                    d = np.zeros(k * size)
                    for f, x in zip(direction, old, strict=False):
                        d = d + f * x
                    x = old[0] + step * d
                    new = (_array(g) if g.is_valid else np.zeros(k * size)) / total + l2 * x / total
                    keep = [x, new] if first else [x, new, *(old[2:][2 * (len(old) >= 2 + 2 * MEMORY) :]), step * d, new - old[1]]
                    yield _batch(["cb", "v"], [cb.as_py()], pa.array([[_blob(x) for x in keep]], pa.list_(pa.binary())))

        joined = self.state.join(grad, "cb", "left").select("cb", "v", "g")
        self.state = _stored(joined.mapInArrow(run, "cb long, v array<binary>"), "state")
        before, self.bias_grad = self.bias_grad, sums / total
        if not first:
            self.past = [*self.past[-(MEMORY - 1) :], (step * step_bias, self.bias_grad - before)]
        self.bias = self.bias + step * step_bias

    def gram(self) -> tuple[np.ndarray, float]:
        """Dot products of the state's vectors, intercepts included but for the point's own;
        and the largest component of the gradient."""

        def run(batches):
            for b in batches:
                for v in b.column(0):
                    m = np.stack([_array(x) for x in v])
                    g = m @ m.T
                    n = len(m)
                    yield _batch(["i", "f", "top"], list(range(n * n)), g.ravel(), np.full(n * n, np.abs(m[1]).max()))

        got = self.state.select("v").mapInArrow(run, "i long, f double, top double").groupBy("i").agg(F.sum("f").alias("f"), F.max("top").alias("top")).collect()
        n = int(round(len(got) ** 0.5))
        out = np.zeros(n * n)
        for r in got:
            out[r["i"]] = r["f"]
        return out.reshape(n, n), max(got[0]["top"], float(np.abs(self.bias_grad).max()))

    def _bias_vectors(self) -> list[np.ndarray]:
        return [np.zeros(self.k), self.bias_grad, *(x for pair in self.past for x in pair)]

    def minimise(self) -> None:
        self.advance([], 0.0, np.zeros(self.k), first=True)
        self.value = self.losses([0.0], np.zeros(self.k))[0] / self.total
        top = np.inf
        for _ in range(self.max_iter):
            dots, top = self.gram()
            if top <= self.tol:
                return
            own = self._bias_vectors()
            full = dots + np.array([[a @ b for b in own] for a in own])
            d = self._direction(full)
            step_bias = sum(f * b for f, b in zip(d, own, strict=True))
            slope = float(d @ full[:, 1])
            x2, xd, d2 = dots[0, 0], float(d @ dots[:, 0]), float(d @ dots @ d)
            self.dir = _stored(self.cells.margins(self._combined(d)), "direction").withColumnRenamed("z", "d")
            found = 0.0
            for scale in (1.0, 2.0 ** -len(STEPS)):
                steps = [s * scale for s in STEPS]
                sums = self.losses(steps, step_bias)
                values = [f / self.total + 0.5 * self.l2 / self.total * (x2 + 2 * s * xd + s * s * d2) for f, s in zip(sums, steps, strict=True)]
                good = [i for i, s in enumerate(steps) if values[i] <= self.value + 1e-4 * s * slope]
                if good:
                    found, value = steps[good[0]], values[good[0]]
                    break
            if not found:
                break
            self.advance(d.tolist(), found, step_bias)
            self.value = value
        warnings.warn(f"stopped with a gradient of {top:.2e} (objective {self.value:.6f})", NotConverged, stacklevel=3)

    def _direction(self, dots: np.ndarray) -> np.ndarray:
        """Two-loop recursion on coefficients of the state's vectors (x, g, s, y, s, y, ...)."""
        n = len(dots)
        d = np.zeros(n)
        d[1] = -1.0
        pairs = [(i, i + 1) for i in range(2, n, 2) if dots[i, i + 1] > 1e-12 * dots[i + 1, i + 1]]
        alphas = []
        for s, y in reversed(pairs):
            a = (dots[s] @ d) / dots[s, y]
            alphas.append(a)
            d[y] -= a
        if pairs:
            s, y = pairs[-1]
            d *= dots[s, y] / dots[y, y]
        else:
            d /= max(1.0, dots[1, 1] ** 0.5)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            d[s] += a - (dots[y] @ d) / dots[s, y]
        return d

    def _combined(self, direction: np.ndarray) -> DataFrame:
        f = direction.tolist()

        def run(batches):
            for b in batches:
                for cb, v in zip(*b.columns, strict=True):
                    d = sum(c * _array(x) for c, x in zip(f, v, strict=True))
                    yield _batch(["cb", "x"], [cb.as_py()], [_blob(d)])

        return self.state.mapInArrow(run, "cb long, x binary")

    def coefficients(self) -> DataFrame:
        """(tid, coef): one array of class coefficients per term."""
        k, size, n = self.k, self.cells.cols_per, self.cells.n_terms

        def run(batches):
            for b in batches:
                for cb, v in zip(*b.columns, strict=True):
                    w = _array(v[0]).reshape(k, size)
                    first = cb.as_py() * size
                    for a in range(0, min(size, n - first), 4096):
                        part = w[:, a : a + 4096][:, : n - first - a]
                        flat = pa.array(np.ascontiguousarray(part.T).ravel())
                        off = pa.array(np.arange(part.shape[1] + 1, dtype=np.int32) * k)
                        yield _batch(["tid", "coef"], first + a + np.arange(part.shape[1]), pa.ListArray.from_arrays(off, flat))

        return self.state.mapInArrow(run, "tid long, coef array<double>")


def minimise(data: DataFrame, n_rows: int, n_terms: int, k: int, max_iter: int, tol: float, rows: int = 0, cols: int = 0) -> tuple[DataFrame, np.ndarray]:
    """((tid, coef) table, intercepts) of rows ``(id, y, w, cols, vals)``."""
    cells = Cells(data, k, n_terms, n_rows, rows, cols)
    try:
        # two softmax rows share the margin evenly: twice the penalty gives the margin the
        # penalty that a binary model puts on its one row
        solver = Solver(cells, 2.0 if k == 2 else 1.0, tol, max_iter)
        solver.minimise()
        return _stored(solver.coefficients(), "coefficients"), solver.bias - solver.bias.mean()
    finally:
        cells.close()
