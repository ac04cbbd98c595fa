"""Certificate tables in their standard form."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from certmill.functions import fields

_TEXT = ["issuer_cn", "issuer_org", "issuer_country", "subject_cn", "subject_org", "subject_country"]


def fill_missing(certs: DataFrame) -> DataFrame:
    """``N/A`` for every absent attribute."""
    return certs.withColumns({c: fields.missing(F.col(c)) for c in _TEXT if c in certs.columns})


def fill_names(certs: DataFrame) -> DataFrame:
    """SAN names, or the subject name, or the placeholder."""
    return certs.withColumn(
        "san", fields.san_or_fallback(F.col("san"), F.col("subject_cn"), F.col("log_index"))
    )


def mark_expired(certs: DataFrame, as_of: datetime | str) -> DataFrame:
    return certs.withColumn("is_expired", fields.is_expired(F.col("not_after"), as_of))


def standard_certs(raw: DataFrame, as_of: datetime | str) -> DataFrame:
    """All three steps."""
    return mark_expired(fill_names(fill_missing(raw)), as_of)


def first_domain(certs: DataFrame) -> DataFrame:
    return certs.withColumn("domain", F.coalesce(F.get("san", F.lit(0)), F.lit("")))
