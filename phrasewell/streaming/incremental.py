"""Incremental results by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupStateTimeout


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    form: str = "parquet",
    pattern: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Rows of files as they appear in a folder."""
    reader = spark.readStream.schema(schema).format(form)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def append_results(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    name: str | None = None,
) -> None:
    """Process what has arrived since the last run, append it to ``path`` and stop.

    The checkpoint remembers finished files, so a broken run continues where it was and a finished
    row is written once. ``transform`` works row by row.
    """
    writer = (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    if name:
        writer = writer.queryName(name)
    writer.start().awaitTermination()


def append_batches(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
) -> None:
    """Like ``append_results`` for work that is more than row by row: ``handle`` gets each batch.

    A batch may be handed over again after a failure, so ``handle`` has to replace what is stored
    under the number of the batch, or to write by a key as ``resume_stage`` does.
    """
    (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def with_first_batch(stream: DataFrame, key: str, out: str = "first_batch", expiry_ms: int | None = None) -> DataFrame:
    """Add the number of the batch in which the key of a row came first; equal to its own batch's if it is new.

    The state store keeps two numbers per key. With ``expiry_ms`` a key that has not come for that long is new again, and
    the store forgets it once later batches tell that the time is over. A batch that is handed over again sees the
    state and the time that it saw before. Rows of a key go through one task, piece by piece; columns are texts or
    arrays of texts.
    """
    kinds = T.StructType([*stream.schema.fields, T.StructField(out, T.LongType())])
    names = stream.columns

    def mark(_: tuple, parts: Iterator[Any], state: Any) -> Iterator[Any]:
        if state.hasTimedOut:
            state.remove()
            return
        first = None
        for part in parts:
            if first is None:
                now = int(part["_at"].iloc[0])
                known = state.exists and (expiry_ms is None or now - state.get[1] <= expiry_ms)
                first = state.get[0] if known else int(TaskContext.get().getLocalProperty("streaming.sql.batchId"))
                state.update((first, now))
                if expiry_ms is not None:
                    state.setTimeoutTimestamp(max(now, state.getCurrentWatermarkMs()) + expiry_ms + 1)
            yield part[names].assign(**{out: first})

    timed = stream.withColumn("_time", F.current_timestamp()).withColumn("_at", F.unix_millis("_time"))
    # Times of arrival are those of the batches, so the watermark follows them, and a store never waits for the clock.
    waiting = timed.drop("_time") if expiry_ms is None else timed.withWatermark("_time", "0 seconds")
    timeout = GroupStateTimeout.NoTimeout if expiry_ms is None else GroupStateTimeout.EventTimeTimeout
    return waiting.groupBy(key).applyInPandasWithState(mark, kinds, "first long, last long", "append", timeout)
