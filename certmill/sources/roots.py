"""Answers of logs to the question for their accepted roots, as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from certmill.functions.framing import from_base64
from certmill.schemas import ROOTS


def read_roots(
    spark: SparkSession, path: str, log_url: str | None = None, json_lines: bool = False
) -> DataFrame:
    """``log_url``, ``pos`` and ``der``, one row per root; an empty answer keeps a null row.

    A file is one answer, or with ``json_lines`` one answer per line. Without
    ``log_url`` each answer names its log, in a ``log_url`` field or by its
    partition folder.
    """
    raw = spark.read.schema(ROOTS + ("" if log_url else ", log_url STRING")).option(
        "multiLine", not json_lines
    ).json(path)
    if log_url:
        raw = raw.withColumn("log_url", F.lit(log_url))
    return raw.select("log_url", F.posexplode_outer("certificates").alias("pos", "_c")).select(
        "log_url", "pos", from_base64(F.col("_c")).alias("der")
    )
