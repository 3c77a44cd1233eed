"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source is cut into blocks of ``BLOCK`` words (the documents of a shard, in seeded
order, form one stream per source, cut into equal blocks).  The blocks of the mix are
allotted to the sources by highest quotients ``votes / (2 k + 1)``; the seats of a source
are then spread over its shards: the whole part of each shard's share, and the rest by
highest quotient.  Within a shard a seeded choice says which blocks are taken once more.

Targets: source i (by code point, null last) weighs 3, 1, 2, repeating; the mix has 150 %
of all words; a target stops at twice its source's size and the excess is shared again by
weight.  Since a shard gets at most twice its blocks, no document exceeds twice its size.

Defined results: null and empty texts have size 0 and take 0; a null source is a source
of its own, after all others; sources without a word have target 0; repeated rows are
rows of their own.  Shards hold about ``SHARD_WORDS`` words of all sources by hash, so a
source with a third of all rows is spread like the others.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm import common as C

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2
BLOCK = 16
SHARD_WORDS = 1 << 20
MAX_SOURCES = 1_000_000
SEED = 42


def with_size(docs: DataFrame, text_col: str, into: str) -> DataFrame:
    """All columns and the struct ``into`` (size): words ``[^\\x20\\x09-\\x0D]+``."""

    def make():
        def kernel(text):
            return [np.diff(C.word_bounds(*C.bounds(text))[2])]

        return kernel

    return C.annotate(docs, text_col, make, T.StructType([T.StructField("size", T.LongType(), False)]), into)


def targets(sizes: list[int], weights: list[int], total: float) -> list[float]:
    """Shares of ``total`` by weight, none above MAX_REPEAT times its size."""
    out = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > MAX_REPEAT * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = float(MAX_REPEAT * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients ``votes / (2 k + 1)``, at most ``most`` each; ties to the first.

    A divisor whose quotients fill no more than the seats is found by bisection: these
    quotients are the highest, so their seats are given at once, and a heap allots the few
    that are left.  The work follows the number of sources, not of seats.
    """
    v, m = np.array(votes, float), np.array(most, np.int64)
    if v.sum() <= 0 or seats <= 0:
        return [0] * len(votes)
    seats = min(seats, int(m[v > 0].sum()))

    def given(least: float) -> np.ndarray:
        """Seats whose quotient is ``least`` or more."""
        n = np.minimum(np.floor((v / least + 1) / 2), m).astype(np.int64)
        return n - ((n > 0) & (v < least * (2 * n - 1)))  # rounding never gives a seat too many

    low, high = 0.0, float(v.max()) * 2
    for _ in range(100):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if int(given(mid).sum()) > seats:
            low = mid
        else:
            high = mid
    got = given(high).tolist()
    heap = [(-x / (2 * k + 1), i) for i, (x, k, n) in enumerate(zip(votes, got, most, strict=True)) if x > 0 and k < n]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def plan(per_source: list[tuple[str | None, int, int]]) -> list[dict]:
    """Targets and seats of the sources (source, words, blocks), in their order."""
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(per_source))]
    sizes = [s for _, s, _ in per_source]
    goal = targets(sizes, weights, TOTAL_SHARE * sum(sizes))
    votes = [t / s * b if s else 0.0 for t, (_, s, b) in zip(goal, per_source, strict=True)]
    seats = sainte_lague(votes, round(sum(votes)), [MAX_REPEAT * b for _, _, b in per_source])
    return [
        {"source": src, "source_size": size, "target": t, "seats": q, "blocks": b}
        for (src, size, b), t, q in zip(per_source, goal, seats, strict=True)
    ]


def choose(pdf: pd.DataFrame, seed: int = SEED) -> pd.DataFrame:
    """Words taken of the documents of one shard; ``quota`` blocks of each source."""
    pdf = pdf.sort_values(["place", "pos", "key", "size"], kind="stable", ignore_index=True)
    out = np.zeros(len(pdf), np.int64)
    for place, at in pdf.groupby("place", sort=True).indices.items():
        size = pdf["size"].to_numpy()[at]
        total, n, quota = int(size.sum()), int(pdf["blocks"].iat[at[0]]), int(pdf["quota"].iat[at[0]])
        if total == 0 or quota == 0:
            continue
        times, more = divmod(quota, n)
        copies = np.full(n, times, np.int64)
        rng = np.random.Generator(np.random.Philox(key=[seed, (int(pdf["shard"].iat[0]) << 24) + int(place)]))
        copies[rng.permutation(n)[:more]] += 1
        edge = np.arange(n + 1, dtype=np.int64) * total // n
        gone = np.concatenate([[0], np.cumsum(copies * np.diff(edge))])
        stop = np.cumsum(size)

        def upto(x, edge=edge, gone=gone, copies=copies, n=n):
            k = np.minimum(np.searchsorted(edge, x, "right") - 1, n - 1)
            return gone[k] + copies[k] * (x - edge[k])

        out[at] = upto(stop) - upto(stop - size)
    return pd.DataFrame({"id": pdf["id"], "key": pdf["key"], "size": pdf["size"], "place": pdf["place"], "taken": out})


def n_blocks(words: Column) -> Column:
    return F.when(words > 0, F.greatest(F.lit(1), F.round(words / BLOCK))).otherwise(0).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key: Column | None = None) -> DataFrame:
    """(id, key, size, source_size, target, taken), a row per document row.

    Only ids, hashes and counts are shuffled.  ``key`` is a hash that tells rows with the
    same id apart (default: of id, source and text).
    """
    spark = docs.sparkSession
    row = F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)) if key is None else key
    src = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), row.alias("key"), F.col(text_col).alias("text")
    )
    sized = with_size(src, "text", "s").select("id", "source", "key", F.col("s")["size"].alias("size"))
    sized = C.stored(sized, "mix-sizes")
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // SHARD_WORDS))
    pos = F.xxhash64(F.lit(SEED), F.col("id"), F.col("key"))
    # documents without a word are set aside: a shard holds words, so it would not bound them
    dealt = sized.where("size > 0").withColumn("pos", pos).withColumn("shard", F.pmod(pos, F.lit(shards)))
    streams = C.stored(
        dealt.groupBy("source", "shard").agg(F.sum("size").alias("words")).withColumn("blocks", n_blocks(F.col("words"))), "mix-streams"
    )
    named = sized.groupBy("source").agg(F.sum("size").alias("words"))  # all sources, those without words too
    filled = streams.groupBy("source").agg(F.sum("blocks").alias("blocks")).withColumnRenamed("source", "s")
    per = named.join(filled, named["source"].eqNullSafe(filled["s"]), "left").select("source", "words", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    if per.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: their table must fit the driver")
    rows = per.orderBy(F.col("source").isNull(), "source").collect()
    planned = plan([(r["source"], int(r["words"]), int(r["blocks"])) for r in rows])
    schema = "place long, source string, source_size long, target double, seats long, all_blocks long"
    table = spark.createDataFrame(
        [(i, x["source"], x["source_size"], x["target"], x["seats"], x["blocks"]) for i, x in enumerate(planned)], schema
    )
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    # seats of a source over its shards: whole shares, the rest by highest quotient
    s = streams.join(F.broadcast(table), same(streams, table)).drop("source")
    share = F.when(F.col("all_blocks") > 0, F.col("seats") * F.col("blocks") / F.col("all_blocks")).otherwise(0.0)
    s = s.withColumn("share", share).withColumn("base", F.floor("share"))
    s = s.withColumn("quotient", F.when(F.col("share") > F.col("base"), F.col("share") / (2 * F.col("base") + 1)).otherwise(0.0))
    by = Window.partitionBy("place")
    s = s.withColumn("rest", F.col("seats") - F.sum("base").over(by))
    s = s.withColumn("nth", F.row_number().over(by.orderBy(F.desc("quotient"), F.xxhash64(F.lit(SEED), "place", "shard"), "shard")))
    s = s.withColumn("quota", F.least(F.col("base") + F.when(F.col("nth") <= F.col("rest"), 1).otherwise(0), MAX_REPEAT * F.col("blocks")))
    quotas = C.stored(s.select("shard", "place", "blocks", "quota"), "mix-quotas")
    rows = dealt.join(F.broadcast(table), same(dealt, table)).select("id", "key", "size", "pos", "shard", "place")
    rows = rows.join(quotas, ["shard", "place"])
    seed = SEED
    chosen = rows.groupBy("shard").applyInArrow(
        lambda t: pa.Table.from_pandas(choose(nullable_ids(t), seed), preserve_index=False).select(["id", "key", "size", "place", "taken"]),
        "id long, key long, size long, place long, taken long",
    )
    out = chosen.join(F.broadcast(table), "place")
    empty = sized.where("size = 0")
    empty = empty.join(F.broadcast(table), same(empty, table)).withColumn("taken", F.lit(0).cast("long"))
    cols = ["id", "key", "size", "source_size", "target", "taken"]
    return out.select(*cols).unionByName(empty.select(*cols))


def nullable_ids(t: pa.Table) -> pd.DataFrame:
    pdf = t.drop_columns(["id"]).to_pandas()
    pdf["id"] = pd.array(t["id"].to_pylist(), "Int64")
    return pdf


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in whole documents: a document stays as often as the mix takes its words, the
    part of a copy rounded up or down by a seeded hash, so that the sources' words come
    near their targets.  Documents without a word go."""
    C.prepare(spark)
    own, key, ident, many, nth = (C.fresh(docs, f"_mix_{x}") for x in ("row", "key", "id", "times", "nth"))
    marked = docs.withColumn(own, C.row_hash(docs))
    taken = mix(marked, key=F.col(own))
    # wholly equal rows have one key and interchangeable amounts: shared evenly
    chance = F.pmod(F.xxhash64(F.lit(SEED + 1), "key", "id"), F.lit(1 << 20)) / (1 << 20)
    times = taken.groupBy("key", "id").agg(F.sum("taken").alias("t"), F.sum("size").alias("s")).where("s > 0")
    times = times.withColumn("n", F.floor(F.col("t") / F.col("s") + chance).cast("int")).where("n > 0")
    times = times.select(F.col("key").alias(key), F.col("id").alias(ident), F.col("n").alias(many))
    out = marked.join(times, (F.col(own) == F.col(key)) & marked["doc_id"].eqNullSafe(F.col(ident)))
    out = out.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(many))))
    return out.select(*[f"`{c}`" for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return mix(C.source_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
