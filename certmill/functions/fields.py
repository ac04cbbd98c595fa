"""Column expressions over certificate fields."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

from certmill.schemas import NOT_AVAILABLE


def missing(col: Column) -> Column:
    """``N/A`` in place of null."""
    return F.coalesce(col, F.lit(NOT_AVAILABLE))


def format_utc(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS UTC``, empty for null."""
    text = F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    return F.coalesce(text, F.lit(""))


def utc_text(when: datetime | str) -> str:
    """An instant in the text form the tables use."""
    if isinstance(when, str):
        return when
    if when.tzinfo is not None:
        when = when.astimezone(timezone.utc)
    return when.strftime("%Y-%m-%d %H:%M:%S UTC")


def is_expired(not_after: Column, as_of: datetime | str) -> Column:
    """``not_after`` before ``as_of``.

    The text form sorts as the instants do, so the test stays a string
    comparison that a Parquet scan can prune on.
    """
    return (not_after != "") & (not_after < F.lit(utc_text(as_of)))


def placeholder(log_index: Column) -> Column:
    """The name of a certificate without names."""
    return F.concat(F.lit("__cert:"), log_index.cast("string"), F.lit("__"))


def san_or_fallback(san: Column, subject_cn: Column, log_index: Column) -> Column:
    """SAN names; else the subject name; else the placeholder."""
    return (
        F.when(F.size(F.coalesce(san, F.array().cast("array<string>"))) > 0, san)
        .when(missing(subject_cn) != NOT_AVAILABLE, F.array(subject_cn))
        .otherwise(F.array(placeholder(log_index)))
    )
