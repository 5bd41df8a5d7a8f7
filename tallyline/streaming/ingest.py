"""Incremental ingest: files arriving in a folder are merged into a keyed table.

A re-delivered day is idempotent: the merge keeps one row per key. Offsets live in the
checkpoint folder, so a restarted query continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

from tallyline.sources.sinks import upsert_table


def stream_upserts(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    keys: Sequence[str],
    version: Sequence[str],
    partition: str | None = None,
    pattern: str | None = None,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    files_per_batch: int = 1000,
):
    """Start the query; it stops by itself after the files present have been merged."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.parquet(source)
    if transform is not None:
        rows = transform(rows)

    def merge(batch: DataFrame, _: int) -> None:
        upsert_table(batch, target, keys, version, partition)

    return (
        rows.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
