"""Exact cosine top-1 against a large dense memory, visiting only shards that can win.

The unit vectors of the memory are assigned to their nearest *pivot* (a bounded sample of
the memory by hash order), and a pivot's rows are cut into rings by their angle to it.  By the
triangle inequality on the sphere, no row of a ring lies nearer to a query than

    max(0, angle(query, pivot) - largest angle, smallest angle - angle(query, pivot))

so a query first visits the ring with the least bound, which gives it a score to beat, and then
only rings whose bound can beat or equal that.  Rings of neighbouring pivots are packed into
shards that fit a task; a ring that is larger (copies) is cut by hash.  A query is sent once to
each shard with a ring that it must visit, so never to more shards than there are, and a
shard is copied once per block of the queries that visit it.  The result is that of :func:`lexiflow.operators.similarity.nearest`,
ties included; bounds are loosened by ``SLACK`` against rounding.

How much is pruned depends on the vectors: clustered ones visit few rings, vectors spread
evenly in many dimensions visit most.  ``visited`` reports it per query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lexiflow.operators import similarity as SIM
from lexiflow.session import scratch_path

MAX_PIVOTS = 1024
PIVOT_BYTES = 32 << 20
BINS = 256  # of the angle to a pivot
PIVOTS_PER_SHARD = 8
SLACK = 1e-7  # radians
TASK_PAIRS = 1 << 29  # comparisons of a task
BOUND_CELLS = 1 << 20  # bounds that a task computes at a time, some six arrays of doubles
SHARD_BYTES = 16 << 20  # vectors of a shard; a task holds them several times over


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"pruned-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _units(vec: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows, norms) of a list column; a zero row stays zero."""
    if not len(vec):
        return np.zeros((0, 0)), np.zeros(0)
    m = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), -1)
    n = np.linalg.norm(m, axis=1)
    return m / np.where(n > 0, n, 1.0)[:, None], n


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _chained(units: np.ndarray) -> np.ndarray:
    """The pivots in an order in which each is followed by its nearest of the rest."""
    if len(units) < 3:
        return units
    near = units @ units.T
    order, left = [0], np.ones(len(units), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, near[order[-1]], -2.0).argmax()))
        left[order[-1]] = False
    return units[order]


class Rings:
    """What a task needs to bound a query: pivots, and per ring its pivot, angles and first
    shard; ``groups`` counts the groups of shards that rings share or fill."""

    def __init__(self, pivots: np.ndarray, pivot: np.ndarray, least: np.ndarray, most: np.ndarray, group: np.ndarray):
        self.pivots, self.pivot, self.least, self.most, self.group = pivots, pivot, least, most, group
        self.groups = int(group.max()) + 1 if len(group) else 0

    def bounds(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least angle to any row of each ring, angle to the ring's pivot) per query."""
        to = _angles(units, self.pivots)[:, self.pivot]
        return np.maximum(np.maximum(to - self.most, self.least - to) - SLACK, 0.0), to


class PivotIndex:
    """Memory rows ``pos, vec[, key][, label]`` and carried columns, cut into rings."""

    def __init__(
        self,
        memory: DataFrame,
        exclude_self: bool = False,
        same_label: bool = False,
        carry: tuple[str, ...] = (),
        shard_bytes: int = SHARD_BYTES,
        n_pivots: int | None = None,
    ):
        self.exclude_self, self.same_label, self.carry, self.shard_bytes = exclude_self, same_label, carry, shard_bytes
        m = SIM.prepare(memory, "dense", exclude_self, same_label, force="sharded", carry=carry).memory
        if not carry:
            m = m.withColumn("ord", F.lit(0).cast("long"))
        m = m.withColumn("vec", F.col("vec").cast("array<double>")).where("size(vec) > 0 and exists(vec, x -> x <> 0)")
        self.carried = [StructField(c, m.schema[c].dataType, True) for c in carry]
        stats = m.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
        self.n, self.dim = int(stats["n"]), int(stats["d"] or 1)
        most = min(MAX_PIVOTS, max(1, PIVOT_BYTES // (8 * self.dim)))
        wanted = PIVOTS_PER_SHARD * math.ceil(self.n * self.dim * 8 / shard_bytes)
        self.n_pivots = max(1, min(most, n_pivots or wanted))
        first = m.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(self.n_pivots).toArrow()  # bounded by PIVOT_BYTES
        self.pivots = _chained(_units(first["vec"].combine_chunks())[0])
        self.memory = _stored(self._assigned(m), "assigned") if self.n else m
        self._cut()

    def _assigned(self, m: DataFrame) -> DataFrame:
        at = m.columns.index("vec")
        pivots = m.sparkSession.sparkContext.broadcast(self.pivots)
        schema = StructType([*m.schema.fields, StructField("_pivot", LongType()), StructField("_bin", LongType()), StructField("_angle", DoubleType())])
        names = schema.fieldNames()

        def run(batches):
            for b in batches:
                angle = _angles(_units(b.column(at))[0], pivots.value)
                best = angle.argmin(1)
                a = angle[np.arange(len(best)), best]
                ring = np.minimum((a * (BINS / math.pi)).astype(np.int64), BINS - 1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best), pa.array(ring), pa.array(a)], names=names)

        return m.mapInArrow(run, schema)

    def _cut(self) -> None:
        """Rings of neighbouring bins, from at most ``pivots x BINS`` counts."""
        rows = max(1, self.shard_bytes // (8 * self.dim))
        bins = []
        if self.n:
            counts = self.memory.groupBy("_pivot", "_bin").agg(F.count(F.lit(1)).alias("n"), F.min("_angle").alias("lo"), F.max("_angle").alias("hi"))
            bins = sorted(tuple(r) for r in counts.collect())
        rings: list[list] = []  # pivot, rows, least, most
        ring_of = []  # (pivot, bin, ring)
        for pivot, b, n, lo, hi in bins:
            if rings and rings[-1][0] == pivot and rings[-1][1] + n <= max(1, rows // PIVOTS_PER_SHARD):
                rings[-1][1] += n
                rings[-1][3] = hi
            else:
                rings.append([pivot, n, lo, hi])
            ring_of.append((pivot, b, len(rings) - 1))
        groups: list[int] = []  # rows of a group: several rings of one shard, or one of several
        group = []
        for i, r in enumerate(rings):
            # a new pivot begins a new group if the last one is half full
            if not groups or groups[-1] + r[1] > rows or (r[0] != rings[i - 1][0] and 2 * groups[-1] >= rows):
                groups.append(0)
            groups[-1] += r[1]
            group.append(len(groups) - 1)
        self.group_of = [(p, b, group[g]) for p, b, g in ring_of]
        self.parts = [-(-n // rows) for n in groups]  # shards of a group
        self.first = np.concatenate([[0], np.cumsum(self.parts)[:-1]]).astype(int).tolist() if groups else []
        self.n_shards = sum(self.parts)
        col = lambda i, kind: np.array([r[i] for r in rings], kind)
        self.rings = Rings(self.pivots, col(0, np.int64), col(2, float), col(3, float), np.array(group, np.int64))

    def _table(self, rows: list, schema: str) -> DataFrame:
        return F.broadcast(self.memory.sparkSession.createDataFrame(rows, schema))  # a row per bin or ring

    def _score(self, asked: DataFrame, more: bool, block_bytes: int, batch_rows: int) -> DataFrame:
        """Scores of queries against all rows of the shards that they visit: (_rk, match_pos,
        match_ord, score, carried), a row per query and shard; null where nothing matches."""
        per_group = dict(self._visits(asked, more, True).groupBy("_group").agg(F.sum("n").alias("n")).collect())  # a row per group
        rows = min(self.n, max(1, self.shard_bytes // (8 * self.dim)))
        blocks = {g: max(1, math.ceil(n * self.dim * 8 / block_bytes), math.ceil(n * rows / TASK_PAIRS)) for g, n in per_group.items()}
        self.copies += sum(self.parts[g] * n for g, n in blocks.items())
        sizes = self._table([(g, self.first[g], self.parts[g], n) for g, n in blocks.items()] or [(-1, 0, 1, 1)], "_group long, _first long, _parts long, _blocks long")
        visits = self._visits(asked, more)
        q = visits.join(sizes, "_group").withColumn("_blk", F.pmod(F.xxhash64("_rk"), F.col("_blocks")))
        q = q.withColumn("_shard", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_parts") - 1)))
        q = q.drop("_group", "_first", "_parts", "_blocks")
        place = self._table(self.group_of, "_pivot long, _bin long, _group long")
        m = self.memory.join(place, ["_pivot", "_bin"]).join(sizes, "_group")
        m = m.withColumn("_shard", F.col("_first") + F.pmod(F.xxhash64("pos", "ord"), F.col("_parts")))
        m = m.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        m = m.drop("_pivot", "_bin", "_angle", "_group", "_first", "_parts", "_blocks")
        m = m.toDF(*m.columns)
        names = ["_rk", "match_pos", "match_ord", "score", *self.carry]
        fields = [StructField("_rk", LongType()), StructField("match_pos", LongType()), StructField("match_ord", LongType()), StructField("score", DoubleType())]

        def run(qpdf: pd.DataFrame, mpdf: pd.DataFrame) -> pd.DataFrame:
            state = SIM._dense_state(mpdf)
            step = SIM._block_rows(state, batch_rows)
            qpdf = qpdf.assign(qid=qpdf["_rk"])
            parts = [SIM._best(state, qpdf.iloc[lo : lo + step]) for lo in range(0, len(qpdf), step)]
            return pd.concat(parts, ignore_index=True).rename(columns={"qid": "_rk"})[names] if parts else pd.DataFrame(columns=names)

        return q.groupBy("_shard", "_blk").cogroup(m.groupBy("_shard", "_blk")).applyInPandas(run, StructType([*fields, *self.carried]))

    def _visits(self, q: DataFrame, more: bool, count: bool = False) -> DataFrame:
        """The queries with the group of shards (``_group``) that they visit first, or all others
        that can win (``more``: ``_have`` is the score to beat); ``count``: (_group, n) only."""
        at, have = q.columns.index("vec"), q.columns.index("_have") if more else 0
        rings = q.sparkSession.sparkContext.broadcast(self.rings)
        fields = [f for f in q.schema.fields if f.name != "_have"]
        schema = StructType([*fields, StructField("_group", LongType())])
        keep = [q.columns.index(f.name) for f in fields]
        names = schema.fieldNames()

        def run(batches):
            r = rings.value
            total = np.zeros(r.groups, np.int64)
            step = max(1, BOUND_CELLS // max(1, len(r.pivot), len(r.pivots)))
            start = np.flatnonzero(np.diff(r.group, prepend=-1))  # rings of a group follow one another
            for whole in batches:
                for a in range(0, len(whole), step):
                    b = whole.slice(a, step)
                    units, norm = _units(b.column(at))
                    low, to = r.bounds(units)
                    first = r.group[(low + 1e-3 * to).argmin(1)]
                    can = np.zeros((len(b), r.groups), bool)
                    if more:
                        best = b.column(have).to_numpy(zero_copy_only=False).astype(np.float64)  # NaN: nothing yet
                        can = np.logical_or.reduceat(~(np.cos(low) < best[:, None] - 1e-9), start, axis=1)
                    can[np.arange(len(b)), first] = not more
                    can[norm == 0] = False
                    if count:
                        total += can.sum(0)
                        continue
                    row, group = np.nonzero(can)
                    for i in range(0, len(row), 4096):
                        take = pa.array(row[i : i + 4096])
                        yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in keep], pa.array(group[i : i + 4096])], names=names)
            if count:
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["_group", "n"])

        return q.mapInArrow(run, "_group long, n long" if count else schema)

    def nearest(self, queries: DataFrame, block_bytes: int = SHARD_BYTES, batch_rows: int = 512) -> DataFrame:
        """(qid, match_pos, score, carried columns, visited): the best memory row of every query
        row, and how many shards it was compared with.  ``copies`` counts the shard copies."""
        self.copies = 0
        named = (["key"] if self.exclude_self else []) + (["label"] if self.same_label else [])
        q = queries.select(F.col("qid").cast("string").alias("qid"), F.col("vec").cast("array<double>").alias("vec"), *[F.col(c).cast("string").alias(c) for c in named])
        q = _stored(q.withColumn("_rk", F.monotonically_increasing_id()), "queries")
        if not self.n_shards:
            none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.carried]
            return q.select("qid", F.lit(None).cast("long").alias("match_pos"), F.lit(None).cast("double").alias("score"), *none, F.lit(0).cast("long").alias("visited"))
        asked = q.where("size(vec) > 0").drop("qid")
        one = _stored(self._score(asked, False, block_bytes, batch_rows), "scores")
        if self.rings.groups > 1:
            have = one.groupBy("_rk").agg(F.max(F.round("score", SIM.TIE_DECIMALS)).alias("_have"))
            rest = _stored(asked.join(have, "_rk", "left"), "rest")
            two = self._score(rest, True, block_bytes, batch_rows)
        else:
            two = one.where(F.lit(False))
        both = one.unionByName(two)
        own = Window.partitionBy("_rk")  # at most one row per shard
        order = own.orderBy(F.desc_nulls_last(F.round("score", SIM.TIE_DECIMALS)), F.asc_nulls_last("match_pos"), F.asc_nulls_last("match_ord"))
        best = both.withColumn("_rn", F.row_number().over(order)).withColumn("visited", F.count(F.lit(1)).over(own)).where("_rn = 1")
        best = best.select("_rk", "match_pos", "score", *self.carry, "visited")
        out = q.select("_rk", "qid").join(best, "_rk", "left")
        return out.select("qid", "match_pos", "score", *self.carry, F.coalesce("visited", F.lit(0).cast("long")).alias("visited"))
