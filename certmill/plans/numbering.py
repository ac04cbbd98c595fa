"""Row numbers over a whole table or within groups, without one big sort task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from certmill.plans.joins import lookup_join
from certmill.session import stored


def number_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``index``, the 1-based number of a row in the order of ``keys``.

    Rows are range partitioned, sorted and stored once, a file for each range. A
    row's number is its place in its file behind the rows of the files before it;
    the sizes of the files come from their footers, so the rows are read once.
    """
    ranges = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys), "numbered")
    meta = ranges.metadataColumn("_metadata")
    placed = ranges.select("*", meta["file_name"].alias("_file"), meta["row_index"].alias("_row"))
    # One row for each file, as many as the shuffle has partitions: safe to broadcast.
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    # Fixed value: how Spark names the files of a task, ``part-<task>-<id>-c<number>``.
    task, number = (F.regexp_extract("_file", "^part-([0-9]+)-.*-c([0-9]+)", i).cast("int") for i in (1, 2))
    before = W.orderBy(task, number).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (
        placed.join(F.broadcast(starts), "_file")
        .withColumn("index", F.col("_base") + F.col("_row") + 1)
        .drop("_file", "_row", "_base")
    )


def number_within(rows: DataFrame, group: str, keys: list[str], name: str) -> DataFrame:
    """Add ``name``, the 1-based number of a row within its group; a huge group is many ranges."""
    numbered = number_rows(rows, [group, *keys])
    first = stored(numbered.groupBy(group).agg(F.min("index").alias("_first")), "first-in-group")
    return (
        lookup_join(numbered, first, group, "inner")
        .withColumn(name, F.col("index") - F.col("_first") + 1)
        .drop("index", "_first")
    )
