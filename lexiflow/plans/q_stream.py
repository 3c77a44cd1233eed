"""Streaming router query: the batch cascade run continuously over arriving files."""

from __future__ import annotations


from pyspark.sql import functions as F

from lexiflow import constants as K
from lexiflow.functions import text as T
from lexiflow.operators import dictionary as D
from lexiflow.plans.q_route import ROUTE_COLS, _RT2_SQL, _dictionary, _memory, route_idiom_lookup_df
from lexiflow.plans.registry import register
from lexiflow.session import scratch_path
from lexiflow.sources import tables as TB
from lexiflow.streaming import router as SR


FILE_ROWS = 1 << 12  # of an arriving file, some 10 MB of text; a task reads one or a few


def arriving_files(n: int) -> int:
    """How many files ``n`` rows arrive in."""
    return max(4, -(-n // FILE_ROWS))


@register("stream_route", _RT2_SQL)
def q_stream_route(spark, sf):
    """Incoming texts land as several files, among them stop-marker rows; the stream drops
    these, routes every micro-batch (memory -> classifier -> lookup -> placeholder) and
    appends to a parquet sink.  The sink equals the batch route of the same input.  Larger input
    arrives in more files of one size, so a micro-batch has tasks for all slots; there are two
    micro-batches whatever the size, as each reads the dictionary's digests."""
    src = scratch_path(spark, "stream-in")
    sink = scratch_path(spark, "stream-out")
    ckpt = scratch_path(spark, "stream-ckpt")
    rows = TB.route_input(spark, sf)
    stops = TB.user_turns(spark, sf).select(
        F.concat(F.lit("stop:"), F.col("conv_id").cast("string")).alias("id"),
        F.concat(F.lit(" "), F.upper(F.lit(K.STOP_MARKER)), F.lit(" ")).alias("text"),
        F.lit("en").alias("requested_label"),
    )
    incoming = rows.unionByName(stops)
    files = arriving_files(incoming.count())
    incoming.repartition(files).write.mode("overwrite").parquet(src)

    # static sides built once and shared by every micro-batch; a batch takes from the
    # stored dictionary only the entries it may ask for
    memory = _memory(spark, sf)
    memory.prepared()
    path = scratch_path(spark, "stream-dictionary")
    D.with_digest(_dictionary(spark, sf, T.normalize_text)).write.parquet(path)
    stored = spark.read.parquet(path)

    def route_batch(batch):
        lookup = D.restrict(stored, batch)
        return route_idiom_lookup_df(spark, sf, batch, memory, lookup).select(*ROUTE_COLS)

    query = SR.start_router(spark, src, sink, ckpt, route_batch, max_files_per_trigger=-(-files // 2))
    SR.run_to_completion(query)
    return spark.read.parquet(sink).select(*ROUTE_COLS)
