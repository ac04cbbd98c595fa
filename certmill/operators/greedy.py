"""Exact scan assignment: every certificate takes its first passing name that no earlier one holds.

Walking certificates one by one cannot be spread over a cluster. But a walk over
any part of them, in scan order, never puts a certificate behind its place in the
whole walk: the others can only take more names. So each task walks its part first,
and what is left are names that certificates of several parts took. Those are settled in
rounds: of all that took a name the earliest keeps it, the others go on to their next
name, and so does a holder that an earlier certificate displaces. When no name has
two takers, the places are those of the whole walk.

Cost. Certificates meet those that want the same first name, so the walks settle most
of them, equal lists at once and however many; a name that a third of all want is one bid
for each part. After that a round reads only what moves: the movers carry
the names that they have left, and holders lie in buckets by name, with the names they have left
too, of which those are opened that movers ask for. Movers' names are broadcast, many of them as a
bit filter, so that of the holders only those asked for are shuffled. A holder only ever gives way to
an earlier one, so holders are an append-only table and a round rewrites nothing.
Each round is one job and one table in the shared checkpoint folder: plans stay short and
lost executors recompute at most one round. The number of rounds is the longest chain of
displacements between parts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window as W, functions as F

from certmill.operators import known as kn
from certmill.plans.joins import MAX_BYTES
from certmill.session import new_table_path, stored

# Certificates of one walk, and names it holds at most: what a task's memory allows.
WALK_CERTS = 500_000
# What one bitmap holds.
MAX_BUCKETS = 32_768
# Movers whose names are broadcast as they are; the names of more become a bit filter.
MAX_ASKED = 100_000
# Rounds that are read as tables of their own before they become one.
MERGE_ROUNDS = 8

_BIDS = "name string, ord bigint, step int, rest array<string>"


def _walk(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (ord, names) in scan order to the first name that no earlier row of the walk took."""
    taken: set[str] = set()
    for batch in batches:
        lists = batch.column(1)
        values, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
        names, ends = values.to_pylist(), np.cumsum(sizes, dtype=np.int64)
        rows, places, start = [], [], 0
        for row, end in enumerate(ends.tolist()):
            for place in range(start, end):
                if names[place] not in taken:
                    taken.add(names[place])
                    rows.append(row)
                    places.append(place)
                    break
            start = end
            if len(taken) >= most:
                taken = set()
        row, at = np.array(rows, np.int64), np.array(places, np.int64)
        left = ends[row] - at - 1
        offsets = np.concatenate([[0], np.cumsum(left)])
        behind = np.arange(offsets[-1]) + np.repeat(at + 1 - offsets[:-1], left)
        yield pa.RecordBatch.from_arrays([
            values.take(pa.array(at)), batch.column(0).take(pa.array(row)),
            pa.array((at - (ends - sizes)[row]).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values.take(pa.array(behind))),
        ], names=["name", "ord", "step", "rest"])


def walked(options: DataFrame, most: int = WALK_CERTS) -> DataFrame:
    """``name, ord, step, rest``: where walks over parts of ``options`` put its certificates.

    Parts are ranges of the first name, within one name of the scan order, of about
    ``most`` certificates. A walk that runs longer forgets its names and starts anew.
    """
    wanted = options.where(F.size("names") > 0).select("ord", "names")
    count = -(-wanted.count() // most) or 1
    parts = wanted.repartitionByRange(count, F.get("names", F.lit(0)), "ord").sortWithinPartitions("ord")
    return parts.mapInArrow(lambda batches: _walk(batches, most), _BIDS)


class Assignment:
    """Rounds of bids; :attr:`moved` and :attr:`opened` tell what each round moved and which buckets it read."""

    def __init__(self, options: DataFrame, walk_certs: int = WALK_CERTS):
        self.spark = options.sparkSession
        self.base = new_table_path(self.spark, "assign")
        self.buckets = min(MAX_BUCKETS, max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        self.moved: list[int] = []
        self.opened: list[int] = []
        self._won: list[DataFrame] = []
        movers = walked(options, walk_certs)
        while True:
            wanted = self._round(movers)
            last = len(self.moved) - 1
            rows = self._read([last])
            self._won.append(rows.where("part = 'won'"))
            if len(self._won) > MERGE_ROUNDS:
                # The first round, by far the largest, is not listed again.
                self._won[1:] = [self._read(range(1, last + 1)).where("part = 'won'")]
            if not wanted:
                return
            movers = rows.where("part = 'lost'").select("name", "ord", "step", "rest")
            self.opened.append(len(wanted))
            # A mover's new name is held by none, or by a row of one of these buckets.
            self.held = self._log().where(F.col("bucket").isin(wanted))

    held: DataFrame | None = None

    def _path(self, number: int) -> str:
        return f"{self.base}/round={number}"

    def _read(self, numbers: Iterable[int]) -> DataFrame:
        # With its schema given, opening a table needs no job; a round may leave no row of a part.
        paths = [self._path(i) for i in numbers]
        return self.spark.read.schema(f"{_BIDS}, round int, part string, bucket int").option("basePath", self.base).parquet(*paths)

    def _log(self) -> DataFrame:
        """All that ever won a name. Each round's files are listed when it ends, not by every round after it."""
        return reduce(DataFrame.unionByName, self._won)

    def _asked(self, movers: DataFrame) -> DataFrame:
        """The holders of the movers' names, and beyond ``MAX_ASKED`` movers some others; holders are not shuffled."""
        held, moved = self.held.select("name", "ord", "step", "rest"), self.moved[-1]
        if moved <= MAX_ASKED:
            asked = F.broadcast(movers.select(F.col("name").alias("_asked")))
            return held.join(asked, F.col("name").eqNullSafe(F.col("_asked")), "left_semi")
        names = movers.select(F.col("name").alias("_clean"))
        width = min(kn.filter_width(moved), 8 * MAX_BYTES)
        marked = kn.may_be_known(
            held.withColumnRenamed("name", "_clean"),
            kn.KnownNames(names, kn.name_bits(names.where("_clean IS NOT NULL"), width), width, moved),
        )
        return marked.where("_maybe OR _clean IS NULL").select(F.col("_clean").alias("name"), "ord", "step", "rest")

    def _bucket(self):
        # The partition to which a shuffle by name sends the row, so a task writes few files.
        return F.pmod(F.hash("name"), F.lit(self.buckets)).cast("int")

    def _round(self, movers: DataFrame) -> list[int]:
        """Settle the movers' names; the buckets of the names that the losers take next."""
        bids = movers.withColumn("fresh", F.lit(True))
        if self.held is not None:
            # Holders of names that none asks for are first of their names and not fresh, so they leave below.
            bids = bids.unionByName(self._asked(movers).withColumn("fresh", F.lit(False)))
        by_name = W.partitionBy("name").orderBy("ord")
        everyone = by_name.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        judged = bids.select(
            "*", F.row_number().over(by_name).alias("place"),
            F.min(F.when(~F.col("fresh"), F.col("ord"))).over(everyone).alias("owner"),
        )
        # Earlier owners of a name have moved on long ago.
        first, present = F.col("place") == 1, F.col("fresh") | (F.col("ord") == F.col("owner"))
        judged = judged.where((first & F.col("fresh")) | (~first & present & (F.size("rest") > 0)))
        after = judged.select(
            F.when(first, F.col("name")).otherwise(F.get("rest", F.lit(0))).alias("name"), "ord",
            F.when(first, F.col("step")).otherwise(F.col("step") + 1).alias("step"),
            F.when(first, F.col("rest")).otherwise(F.slice("rest", F.lit(2), F.greatest(F.size("rest"), F.lit(1)))).alias("rest"),
            F.when(first, "won").otherwise("lost").alias("part"),
        )
        seen, lost = Observation(), F.col("part") == "lost"
        bit = F.when(lost, self._bucket().cast("bigint"))
        after = after.observe(seen, F.count_if(lost).alias("n"), F.bitmap_construct_agg(bit).alias("bits"))
        self.moved.append(0)
        # The next round reads all losers at once, so they need no buckets.
        bucket = F.when(lost, F.lit(0)).otherwise(self._bucket())
        after.withColumn("bucket", bucket).write.partitionBy("part", "bucket").parquet(self._path(len(self.moved) - 1))
        self.moved[-1] = seen.get["n"]
        if not seen.get["n"]:
            return []
        return [i * 8 + j for i, byte in enumerate(bytes(seen.get["bits"])) if byte for j in range(8) if byte >> j & 1]

    def owners(self) -> DataFrame:
        """``name, ord, step``: the earliest that ever won each name."""
        return self._log().groupBy("name").agg(F.min("ord").alias("ord"), F.min_by("step", "ord").alias("step"))


def assign(options: DataFrame) -> DataFrame:
    """``name``, ``ord``, ``step``: the option each certificate ends with; losers have no row.

    ``options`` has one row per certificate: ``ord`` (unique, the scan order)
    and ``names`` (its passing names, most wanted first; repeats are harmless).
    It is read three times and should be a stored table.
    """
    return Assignment(options).owners()


def greedy_hits(certs: DataFrame) -> DataFrame:
    """Certificates with ``ord`` and ``options`` to hits with ``domain``, ``clean`` and ``rule_name``."""
    table = stored(certs, "candidates")
    owners = assign(table.select("ord", F.col("options.clean").alias("names")))
    got = table.join(owners.select("ord", "step"), "ord").withColumn(
        "_o", F.get("options", F.col("step"))
    )
    return got.select(
        *[c for c in certs.columns if c != "options"],
        F.col("_o.domain").alias("domain"),
        F.col("_o.clean").alias("clean"),
        F.col("_o.rule_name").alias("rule_name"),
    )
