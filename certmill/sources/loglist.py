"""The JSON list of logs, version 3: operators with their classic and tiled logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from certmill.schemas import LOG_LIST, NOT_AVAILABLE, UNKNOWN


def _operators(spark: SparkSession, path: str) -> DataFrame:
    """One row per operator, with its place in the documents (documents in file name order)."""
    docs = (
        spark.read.schema(LOG_LIST)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .json(path)
        .select("operators", F.col("_metadata.file_path").alias("_doc"))
    )
    return docs.select("_doc", F.posexplode("operators").alias("_op", "o")).select(
        "_doc", "_op", F.coalesce("o.name", F.lit("Unknown")).alias("operator"), "o"
    )


def _emails(email: Column) -> Column:
    """Addresses given as one text, as a list, or not at all; empty ones are dropped."""
    shape = F.schema_of_variant(email)
    listed = F.when(
        F.startswith(shape, F.lit("ARRAY")), F.try_variant_get(email, "$", "array<string>")
    ).when(shape == "STRING", F.array(F.try_variant_get(email, "$", "string")))
    return F.filter(
        F.coalesce(listed, F.array().cast("array<string>")), lambda e: e.isNotNull() & (e != "")
    )


def _day(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(NOT_AVAILABLE)).otherwise(
        F.substring(text, 1, 10)
    )


def _state(log: Column) -> Column:
    return F.coalesce(F.get(F.map_keys(log["state"]), F.lit(0)), F.lit(UNKNOWN))


def _exploded(ops: DataFrame, field: str, kind: str) -> DataFrame:
    return ops.select(
        "_doc", "_op", "operator", F.col("o.email").alias("email"),
        F.posexplode(f"o.{field}").alias("_i", "log"), F.lit(kind).alias("log_kind"),
    )


def _position() -> Column:
    """Sorts as the logs stand in the documents: operator, classic before tiled, place."""
    return F.struct("_doc", "_op", "log_kind", "_i").alias("pos")


def read_operators(spark: SparkSession, path: str) -> DataFrame:
    """``name`` and ``emails`` of every operator."""
    return _operators(spark, path).select(
        F.col("operator").alias("name"), _emails(F.col("o.email")).alias("emails")
    )


def read_log_list(spark: SparkSession, path: str) -> DataFrame:
    """Classic logs: description, url, year, start, end, state, operator, and ``pos``."""
    log = F.col("log")
    start, end = log["temporal_interval"]["start_inclusive"], log["temporal_interval"]["end_exclusive"]
    year = F.when(F.coalesce(start, F.lit("")) == "", F.lit("Unknown")).otherwise(F.substring(start, 1, 4))
    return _exploded(_operators(spark, path), "logs", "classic").select(
        F.coalesce(log["description"], F.lit(NOT_AVAILABLE)).alias("description"),
        F.coalesce(log["url"], F.lit("")).alias("url"),
        year.alias("year"),
        _day(start).alias("start"),
        _day(end).alias("end"),
        _state(log).alias("state"),
        "operator",
        _position(),
    )


def read_log_entries(spark: SparkSession, path: str) -> DataFrame:
    """Classic and tiled logs that have a ``log_id``, with the fields a lookup shows."""
    ops = _operators(spark, path)
    both = _exploded(ops, "logs", "classic").unionByName(_exploded(ops, "tiled_logs", "tiled"))
    log = F.col("log")
    url = F.coalesce(
        *[F.nullif(log[c], F.lit("")) for c in ("url", "submission_url", "monitoring_url")], F.lit("")
    )
    # "url" ends with one slash; an empty one stays empty.
    slashed = F.when(url == "", url).otherwise(F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/")))
    since = F.get(F.map_values(log["state"]), F.lit(0))["timestamp"]
    interval = log["temporal_interval"]
    return both.where(F.coalesce(log["log_id"], F.lit("")) != "").select(
        "operator",
        _emails(F.col("email")).alias("operator_emails"),
        F.coalesce(log["description"], F.lit(NOT_AVAILABLE)).alias("description"),
        log["log_id"].alias("log_id"),
        slashed.alias("url"),
        _state(log).alias("state"),
        F.coalesce(F.replace(F.substring(since, 1, 19), F.lit("T"), F.lit(" ")), F.lit("")).alias("state_timestamp"),
        _day(interval["start_inclusive"]).alias("start"),
        _day(interval["end_exclusive"]).alias("end"),
        log["mmd"].alias("mmd"),
        "log_kind",
        log["log_type"].alias("log_type"),
        _position(),
    )
