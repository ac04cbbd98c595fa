"""Unique names of an endless stream: state that expires, and a table of old names behind it.

The state store holds the names of the last ``delay`` and forgets them; it drops the many
repeats that come close together. Its clock is the time of the batch, so no row is late and
none is lost. What passes it is compared with the table
of all names kept so far, so a name never returns, however late it is repeated, and state
stays bounded however many names there are.

Folders under ``path``: ``new/batch=N`` has the names first seen in batch N, the result;
``old/upto=N`` is all of them before batch N in one sorted table, written every ``every``
batches, so that a batch reads one table and fewer than ``every`` small ones. Each folder follows
from the batch's number and the folders before it, so a batch that is run again after a failure
overwrites what it had written with the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from certmill.plans.joins import fits_broadcast
from certmill.streaming.scan import stream_names_within

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def kept_names(spark: SparkSession, path: str) -> DataFrame:
    """All names kept so far (``clean``), each once."""
    return spark.read.schema("clean STRING, batch BIGINT").parquet(f"{path}/new").select("clean")


def _before(spark: SparkSession, path: str, batch: int, every: int) -> DataFrame | None:
    """The names kept before a batch: the last compacted table and the batches after it."""
    base = batch - batch % every
    paths = [f"{path}/old/upto={base}"] if base else []
    paths += [f"{path}/new/batch={n}" for n in range(base, batch)]
    return spark.read.schema("clean STRING").parquet(*paths) if paths else None


def _compact(spark: SparkSession, path: str, batch: int, every: int) -> None:
    """All names before ``batch`` as one table, sorted so that files have narrow ranges."""
    last = batch - every
    paths = [f"{path}/old/upto={last}"] if last else []
    paths += [f"{path}/new/batch={n}" for n in range(last, batch)]
    names = spark.read.schema("clean STRING").parquet(*paths)
    names.repartitionByRange("clean").sortWithinPartitions("clean").write.mode("overwrite").parquet(f"{path}/old/upto={batch}")


def _unseen(names: DataFrame, old: DataFrame) -> DataFrame:
    """``names`` that ``old`` lacks. The table of old names stays in place where the batch is small."""
    if fits_broadcast(names):
        known = old.join(F.broadcast(names), "clean", "left_semi").distinct()
        return names.join(F.broadcast(known), "clean", "left_anti")
    return names.join(old, "clean", "left_anti")


def keep_names(stream: DataFrame, path: str, checkpoint: str, delay: str, name: str = "domain", every: int = 16) -> StreamingQuery:
    """Add the names of ``stream`` that were never seen to the table at ``path``; stops when all is read.

    Names are compared without wildcard; a null is no name. The state store is RocksDB, on the
    executors' disks. One writer for each ``path``.
    """
    if every < 1:
        raise ValueError("every is at least 1")
    spark = stream.sparkSession
    timed = stream.where(F.col(name).isNotNull()).select(name, F.current_timestamp().alias("_seen"))

    def add(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        if number and number % every == 0:
            _compact(own, path, number, every)
        names = batch.select("clean").distinct().persist()
        try:
            old = _before(own, path, number, every)
            fresh = names if old is None else _unseen(names, old)
            fresh.write.mode("overwrite").parquet(f"{path}/new/batch={number}")
        finally:
            names.unpersist()

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        return (
            stream_names_within(timed, "_seen", delay, name)
            .writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(_PROVIDER, before)
