"""Embedded timestamps matched to the logs that issued them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from certmill.functions import framing as fr
from certmill.functions.fields import format_utc
from certmill.operators.loglist import contact, log_id_index
from certmill.plans.joins import lookup_join, with_kept
from certmill.schemas import DASH


def explode_scts(lists: DataFrame, blob: str = "sct_list", tag: str = "extension") -> DataFrame:
    """One row per timestamp of a serialized list, with its 1-based ``ordinal`` in the list.

    Parts too short for a timestamp have no row but keep their ordinal; :func:`broken_lists` names their lists.
    ``timestamp`` is empty for instants after the year 9999.
    """
    sct = F.col("_part.sct")
    ms = fr.sct_millis(sct)
    keep = [c for c in lists.columns if c not in (blob, tag)]
    return lists.select(
        *keep, tag, F.explode(fr.numbered_scts(F.col(blob))).alias("_part")
    ).select(
        *keep,
        F.col("_part.no").alias("ordinal"),
        fr.sct_log_id(sct).alias("log_id_b64"),
        ms.alias("timestamp_ms"),
        format_utc(F.timestamp_millis(F.when(ms.between(0, fr.MAX_MILLIS), ms))).alias("timestamp"),
        fr.sct_version(sct).alias("version"),
        fr.sct_hash(sct).alias("hash_algorithm"),
        F.col(tag).alias("extension"),
    )


# Columns that a lookup adds, each a dash for unknown logs.
LOOKUP_COLUMNS = [
    "operator", "operator_contact", "description", "url", "state", "state_timestamp",
    "period_start", "period_end", "mmd", "log_kind", "log_type",
]


def lookup_scts(scts: DataFrame, entries: DataFrame) -> DataFrame:
    """Each timestamp with its log's metadata, ``matched`` and the ``period`` text.

    Timestamps are many and logs few, and one log may have issued a third of
    them: the checked broadcast leaves the timestamps where they are.
    """
    def dashed(name: str):
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(DASH))

    known = log_id_index(entries).select(
        F.col("log_id").alias("log_id_b64"),
        "operator",
        contact(F.col("operator_emails")).alias("operator_contact"),
        "description",
        dashed("url").alias("url"),
        "state",
        dashed("state_timestamp").alias("state_timestamp"),
        F.col("start").alias("period_start"),
        F.col("end").alias("period_end"),
        F.coalesce(F.col("mmd").cast("string"), F.lit(DASH)).alias("mmd"),
        "log_kind",
        dashed("log_type").alias("log_type"),
        F.lit(True).alias("matched"),
    )
    joined = lookup_join(scts, known, "log_id_b64")
    start, end = F.col("period_start"), F.col("period_end")
    period = F.when((start == DASH) & (end == DASH), F.lit(DASH)).otherwise(
        F.concat(start, F.lit(" ~ "), end)
    )
    return (
        joined.withColumn("matched", F.coalesce("matched", F.lit(False)))
        .withColumns({c: F.coalesce(c, F.lit(DASH)) for c in LOOKUP_COLUMNS})
        .withColumn("period", period)
        .select(*scts.columns, "matched", *LOOKUP_COLUMNS, "period")
    )


def broken_lists(lists: DataFrame, blob: str = "sct_list") -> DataFrame:
    """The lists that are not whole, with ``error``; their whole timestamps are still in :func:`explode_scts`."""
    return with_kept(lists, "error", fr.sct_list_error(F.col(blob)), lambda e: e.isNotNull()).drop(blob)


def sct_summary(looked_up: DataFrame, certs: DataFrame | None = None) -> DataFrame:
    """Per certificate: timestamps in all, matched, unknown.

    ``certs`` has the ``cert_id`` of every certificate; those without timestamps get zeros.
    """
    if certs is not None:
        counts = sct_summary(looked_up)
        zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "matched", "unknown")}
        return certs.select("cert_id").distinct().join(counts, "cert_id", "left").select("cert_id", *zero.values())
    return looked_up.groupBy("cert_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("matched").alias("matched"),
        F.count_if(~F.col("matched")).alias("unknown"),
    )
