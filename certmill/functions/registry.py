"""Functions for predicate and rule text, registered as SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

# ``endswith``, ``contains`` and ``startswith`` are built in; ``matches`` is read as ``regexp_like``.
_SQL_FUNCTIONS = [
    ("dns_has_flag(flags ARRAY<STRING>, flag STRING)", "BOOLEAN",
     "array_contains(split(lower(array_join(flags, ' ')), ' '), lower(flag))"),
    ("strip_wildcard(name STRING)", "STRING",
     "CASE WHEN startswith(name, '*.') THEN substring(name, 3) ELSE name END"),
]


def register_functions(spark: SparkSession) -> None:
    for head, kind, body in _SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
