"""Continuous router: texts arriving as files are routed and appended to a sink.

``readStream`` (file source, explicit schema) -> control rows (the stop marker)
dropped -> each micro-batch routed with the batch cascade (memory, lookup,
classifier, generator) inside ``foreachBatch`` -> parquet sink.  The static
sides (memory, dictionary) are built once and reused by every micro-batch; the
router keeps no state between batches.  A micro-batch is written to its own
``batch_id=N`` folder with overwrite, so a retried batch replaces its earlier
attempt (exactly-once output with the checkpointed source offsets).

A stored dictionary may be replaced while the stream runs.  Each micro-batch takes the latest
version when it first runs and notes it beside the checkpoint, so a batch that is repeated
after a failure or a restart is routed with the version of its first attempt, and the batches
after it with the new one.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from lexiflow import constants as K
from lexiflow.functions import text as T
from lexiflow.operators.stored_dictionary import StoredDictionary
from lexiflow.session import path_exists

INPUT_SCHEMA = Ty.StructType(
    [
        Ty.StructField("id", Ty.StringType(), True),
        Ty.StructField("text", Ty.StringType(), True),
        Ty.StructField("requested_label", Ty.StringType(), True),
    ]
)


def drop_control_rows(df: DataFrame, marker: str = K.STOP_MARKER) -> DataFrame:
    """The interactive loop's stop marker is a control row, not data."""
    return df.where(~(T.lookup_key("text") == F.lit(marker)) | F.col("text").isNull())


def start_router(
    spark: SparkSession,
    source_dir: str,
    sink_dir: str,
    checkpoint_dir: str,
    route_batch: Callable[[DataFrame], DataFrame],
    fmt: str = "parquet",
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    dictionary_path: str | None = None,
    after_batch: Callable[[int], None] | None = None,
):
    """Start the streaming query; returns the ``StreamingQuery``.

    ``dictionary_path``: a stored dictionary, whose pinned version is then the second argument
    of ``route_batch``; ``after_batch`` is told the id of each batch whose output is written,
    before the stream commits it (so it may hear of a batch again).
    """
    reader = spark.readStream.schema(INPUT_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = drop_control_rows(reader.load(source_dir))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if dictionary_path is None:
            routed = route_batch(batch)
        else:
            routed = route_batch(batch, pinned_dictionary(spark, checkpoint_dir, dictionary_path, batch_id))
        routed.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch_id={batch_id}")
        if after_batch is not None:
            after_batch(batch_id)

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def pinned_dictionary(spark: SparkSession, checkpoint_dir: str, path: str, batch_id: int) -> StoredDictionary:
    """The version that a micro-batch uses: the latest at its first attempt."""
    note = f"{checkpoint_dir.rstrip('/')}/dictionary/batch_id={batch_id}"
    if path_exists(spark, f"{note}/_SUCCESS"):
        return StoredDictionary.open(spark, path, spark.read.parquet(note).first()["version"])
    out = StoredDictionary.open(spark, path)
    spark.createDataFrame([(out.version,)], "version int").coalesce(1).write.mode("overwrite").parquet(note)
    return out


def run_to_completion(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
