"""Known names kept as a table with a filter of their bits in front of it.

A session's known names grow with everything that it found. Up to the broadcast
bound they are broadcast as they are. Beyond it a bit table, made when the names are
stored, is broadcast in their place: a name whose bit is not set is new for certain and
stays where it is; only the others, the known names and about one new name in nine, go
into a shuffle join with the names themselves. Results are exact either way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from certmill.functions.names import strip_wildcard
from certmill.plans.joins import MAX_BYTES, MAX_ROWS, fits_broadcast, spread_join
from certmill.session import new_table_path, stored

BITS_PER_NAME = 8
WORDS = 64  # words of 64 bits in one row of the filter


@dataclass(frozen=True)
class KnownNames:
    """``names`` (``_clean``, each once) and ``bits`` (``_piece, _words``), of ``width`` bits in all."""

    names: DataFrame
    bits: DataFrame
    width: int
    rows: int


def _place(name: Column, width: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(width).cast("bigint"))


def filter_width(rows: int) -> int:
    """Bits of a filter for ``rows`` names."""
    return max(64 * WORDS, 1 << max(0, BITS_PER_NAME * rows - 1).bit_length())


def name_bits(names: DataFrame, width: int) -> DataFrame:
    """``_piece, _words``: the bits that the names ``_clean`` set in a filter of ``width`` bits."""
    at = _place(F.col("_clean"), width)
    set_bits = names.select(at.alias("_at")).selectExpr("_at >> 6 AS _word", "shiftleft(1L, cast(_at & 63 AS INT)) AS _bits")
    words = set_bits.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    pieces = words.groupBy(F.expr(f"_word div {WORDS}").alias("_piece")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("_word") % WORDS).alias("k"), F.col("_bits").alias("v")))).alias("_m")
    )
    full = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(WORDS - 1).cast("bigint")), lambda i: F.coalesce(F.col("_m")[i], F.lit(0).cast("bigint")))
    return pieces.select("_piece", full.alias("_words"))


def store_known(known: DataFrame, path: str | None = None) -> KnownNames:
    """Store the names of ``known.domain`` without wildcard, and their bits; nulls are no names."""
    spark = known.sparkSession
    base = path or new_table_path(spark, "known")
    clean = known.select(strip_wildcard(F.col("domain")).alias("_clean"))
    clean.where(F.col("_clean").isNotNull()).distinct().write.parquet(f"{base}/names")
    names = spark.read.parquet(f"{base}/names")
    rows = names.count()
    width = filter_width(rows)
    name_bits(names, width).write.parquet(f"{base}/bits")
    return open_known(spark, base, rows, width)


def open_known(spark: SparkSession, path: str, rows: int, width: int) -> KnownNames:
    """Names stored by :func:`store_known`."""
    return KnownNames(spark.read.parquet(f"{path}/names"), spark.read.parquet(f"{path}/bits"), width, rows)


def may_be_known(rows: DataFrame, known: KnownNames, flag: str = "_maybe") -> DataFrame:
    """``rows`` with ``flag``: false for a ``_clean`` that is surely not known. No exchange of the rows."""
    at = _place(F.col("_clean"), known.width)
    placed = rows.withColumn("_at", at).withColumn("_piece", F.expr(f"_at div {64 * WORDS}"))
    joined = placed.join(F.broadcast(known.bits), "_piece", "left")
    word = F.element_at("_words", F.expr(f"cast((_at >> 6) % {WORDS} AS INT)") + 1)
    is_set = F.expr("shiftleft(1L, cast(_at & 63 AS INT))").bitwiseAND(word) != 0
    found = F.coalesce(is_set, F.lit(False)) & F.col("_clean").isNotNull()
    return joined.withColumn(flag, found).drop("_piece", "_words", "_at")


def _broadcast_names(known: KnownNames, max_rows: int) -> bool:
    return known.rows <= max_rows and fits_broadcast(known.names, max_rows=max_rows)


def without_known(rows: DataFrame, known: KnownNames, max_rows: int = MAX_ROWS) -> DataFrame:
    """``rows`` whose ``_clean`` is not known; null is never known.

    Beyond both bounds (``max_rows`` names, and a filter of ``MAX_BYTES``) all rows are joined.
    """
    if _broadcast_names(known, max_rows):
        return rows.join(F.broadcast(known.names), "_clean", "left_anti")
    if known.width // 8 > MAX_BYTES:
        return spread_join(rows, known.names, ["_clean"], "left_anti")
    # Stored once, so that the source is read once for both halves.
    marked = stored(may_be_known(rows, known), "marked")
    suspects = marked.where("_maybe").drop("_maybe")
    new = spread_join(suspects, known.names, ["_clean"], "left_anti")
    return marked.where("NOT _maybe").drop("_maybe").unionByName(new)


def only_known(rows: DataFrame, known: KnownNames, max_rows: int = MAX_ROWS) -> DataFrame:
    """``rows`` whose ``_clean`` is known; of the others only those with a set bit reach the join."""
    if _broadcast_names(known, max_rows):
        return rows.join(F.broadcast(known.names), "_clean", "left_semi")
    if known.width // 8 > MAX_BYTES:
        return spread_join(rows, known.names, ["_clean"], "left_semi")
    suspects = stored(may_be_known(rows, known).where("_maybe").drop("_maybe"), "suspects")
    return spread_join(suspects, known.names, ["_clean"], "left_semi")
