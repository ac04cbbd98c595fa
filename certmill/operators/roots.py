"""Accepted roots of logs: coverage of a target root, missing logs, listings."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from certmill.functions import framing as fr
from certmill.operators.loglist import contact_map, slash_url
from certmill.plans.joins import lookup_join
from certmill.plans.numbering import number_within
from certmill.schemas import DASH


def target_fingerprint(text: str | None = None, der: bytes | None = None) -> str:
    """The SHA-256 digest to look for, from hexadecimal text or from certificate bytes."""
    if (text is None) == (der is None):
        raise ValueError("give either a fingerprint or certificate bytes")
    if der is not None:
        return hashlib.sha256(der).hexdigest()
    digits = "".join(c for c in text if c in "0123456789abcdefABCDEF").lower()
    if len(digits) != 64:
        raise ValueError("a SHA-256 fingerprint has 64 hexadecimal digits")
    return digits


def root_coverage(logs: DataFrame, log_roots: DataFrame, target: str) -> DataFrame:
    """Logs with ``has_root`` (``yes``, ``no``, ``error``) and ``roots``, the number of roots as text.

    ``log_roots`` has a row per root and log (``log_url``, ``der``); a log that
    answered with no root has one row with null bytes, and a log without any
    row gave no answer. Roots are counted per log before the join, with partial
    sums on the map side, so a log with many roots is no hot key.
    """
    per_log = log_roots.groupBy(slash_url(F.col("log_url")).alias("_url")).agg(
        F.coalesce(F.bool_or(fr.fingerprint("der") == target), F.lit(False)).alias("_has"),
        F.count("der").alias("_n"),
    )
    joined = logs.withColumn("_url", slash_url(F.col("url"))).join(per_log, "_url", "left")
    return joined.select(
        *logs.columns,
        F.when(F.col("_n").isNull(), F.lit("error"))
        .when(F.col("_has"), F.lit("yes"))
        .otherwise(F.lit("no"))
        .alias("has_root"),
        F.coalesce(F.col("_n").cast("string"), F.lit(DASH)).alias("roots"),
    )


def root_missing(coverage: DataFrame) -> DataFrame:
    """Logs that answered and lack the root."""
    return coverage.where(F.col("has_root") == "no")


def hide_present(coverage: DataFrame) -> DataFrame:
    """The coverage table without logs that have the root; logs in error stay."""
    return coverage.where(F.col("has_root") != "yes")


def root_summary(coverage: DataFrame) -> DataFrame:
    return coverage.agg(
        F.count_if(F.col("has_root") == "yes").alias("present"),
        F.count_if(F.col("has_root") == "no").alias("missing"),
        F.count_if(F.col("has_root") == "error").alias("errors"),
        F.count(F.lit(1)).alias("total"),
    )


def coverage_report(coverage: DataFrame, operators: DataFrame, failures: DataFrame) -> DataFrame:
    """The coverage table with ``contact``, the operator's addresses, and ``note``, why a log gave no answer.

    ``failures`` has ``log_url`` and ``note`` of requests that failed; of several for a log
    the greatest is shown, its first 80 characters. Logs that answered have an empty note.
    """
    told = failures.groupBy(slash_url(F.col("log_url")).alias("_url")).agg(F.max("note").alias("note"))
    noted = lookup_join(contact_map(coverage, operators).withColumn("_url", slash_url(F.col("url"))), told, "_url")
    note = F.when(F.col("has_root") == "error", F.substring("note", 1, 80))
    return noted.select(*coverage.columns, "contact", F.coalesce(note, F.lit("")).alias("note"))


def roots_by_log(logs: DataFrame, log_roots: DataFrame, subjects: DataFrame) -> DataFrame:
    """Every root of every listed log with its subject, numbered within the log.

    Roots are numbered by their place ``pos`` in the log's answer when the
    table has it, else by fingerprint. ``subjects`` has one row per
    ``fingerprint``; ``?`` stands for a root that is not among them.
    """
    listed = logs.where(F.trim("url") != "").select(
        slash_url(F.col("url")).alias("url"), "description", "operator"
    )
    found = lookup_join(
        log_roots.where(F.col("der").isNotNull()).withColumn("url", slash_url(F.col("log_url"))),
        listed, "url", "inner",
    ).withColumn("fingerprint_sha256", fr.fingerprint("der"))
    named = _number_in_log(found)
    known = subjects.select(
        F.col("fingerprint").alias("fingerprint_sha256"), "subject_cn", "subject_org"
    )
    return lookup_join(named, known, "fingerprint_sha256").select(
        "operator", "description", "url", "root_no", "fingerprint_sha256",
        F.coalesce("subject_cn", F.lit("?")).alias("subject_cn"),
        F.coalesce("subject_org", F.lit("?")).alias("subject_org"),
    )


def _number_in_log(roots: DataFrame) -> DataFrame:
    """Add ``root_no``, 1-based in each log."""
    if "pos" in roots.columns:
        return roots.withColumn("root_no", F.col("pos").cast("bigint") + 1)
    return number_within(roots, "url", ["fingerprint_sha256"], "root_no")
