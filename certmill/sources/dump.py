"""Dumps of raw log entries, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from certmill.schemas import DUMP


def _is_metadata() -> Column:
    """A line that describes the run: it has a type and no entry."""
    return F.col("type").isNotNull() & F.col("entry").isNull()


def is_entry() -> Column:
    return (
        F.col("index").isNotNull() & F.col("entry.leaf_input").isNotNull() & ~_is_metadata()
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(DUMP)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """``index`` and ``entry`` of every entry line; metadata, blank and broken lines are left out."""
    return _lines(spark, path).where(is_entry()).select("index", "entry")


def dump_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata lines of a dump."""
    return _lines(spark, path).where(_is_metadata()).select(
        "type", "log_uri", "tree_size", "start", "end", "batch_size"
    )


def dump_audit(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines that hold an entry, metadata, or neither."""
    bad = ~is_entry() & ~_is_metadata()
    return _lines(spark, path).select(
        is_entry().alias("e"), _is_metadata().alias("m"), bad.alias("b")
    ).agg(
        F.count_if("e").alias("entries"), F.count_if("m").alias("metadata"), F.count_if("b").alias("bad_lines")
    )
