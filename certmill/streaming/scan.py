"""Incremental scans: new dump files only, progress kept in a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from certmill.functions.names import strip_wildcard
from certmill.operators.entries import decode_entries
from certmill.schemas import DUMP
from certmill.sources.dump import is_entry


def entry_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A dump folder as a stream of entries."""
    reader = spark.readStream.schema(DUMP).option("mode", "PERMISSIVE")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).where(is_entry()).select("index", "entry")


def run_to_parquet(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Process what is new and stop; a second run on the same checkpoint reads only later files."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_scan(
    spark: SparkSession, path: str, output: str, checkpoint: str, files_per_batch: int | None = None
) -> StreamingQuery:
    """Decode new entries of a dump folder into a Parquet table."""
    decoded = decode_entries(entry_stream(spark, path, files_per_batch)).drop("entry")
    return run_to_parquet(decoded, output, checkpoint)


def stream_names(stream: DataFrame, name: str = "domain") -> DataFrame:
    """Unique stripped names across micro-batches; the state holds every name seen."""
    return stream.select(strip_wildcard(F.col(name)).alias("clean")).dropDuplicates(["clean"])


def stream_names_within(stream: DataFrame, time: str, delay: str, name: str = "domain") -> DataFrame:
    """Unique stripped names with bounded state: a name may return after ``delay`` of event time."""
    return (
        stream.select(strip_wildcard(F.col(name)).alias("clean"), F.col(time).cast("timestamp").alias(time))
        .withWatermark(time, delay)
        .dropDuplicatesWithinWatermark(["clean"])
    )
