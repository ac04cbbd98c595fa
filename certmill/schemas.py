"""Explicit schemas of every table the library reads or writes."""

from __future__ import annotations

# Texts that stand for "missing" in results.
NOT_AVAILABLE = "N/A"
DASH = "—"
UNKNOWN = "unknown"

CERTS = (
    "log_uri STRING, log_index BIGINT, issuer_cn STRING, issuer_org STRING, "
    "issuer_country STRING, subject_cn STRING, subject_org STRING, subject_country STRING, "
    "not_before STRING, not_after STRING, is_expired BOOLEAN, san ARRAY<STRING>, der BINARY"
)

# A dump line: either an entry (index, entry) or run metadata (type, ...).
DUMP = (
    "index BIGINT, entry STRUCT<leaf_input: STRING, extra_data: STRING>, type STRING, "
    "log_uri STRING, tree_size BIGINT, start BIGINT, end BIGINT, batch_size BIGINT, "
    "_corrupt_record STRING"
)

_LOG = (
    "STRUCT<description: STRING, log_id: STRING, mmd: INT, url: STRING, submission_url: STRING, "
    "monitoring_url: STRING, log_type: STRING, state: MAP<STRING, STRUCT<timestamp: STRING>>, "
    "temporal_interval: STRUCT<start_inclusive: STRING, end_exclusive: STRING>>"
)
LOG_LIST = (
    "operators ARRAY<STRUCT<name: STRING, email: VARIANT, "
    f"logs: ARRAY<{_LOG}>, tiled_logs: ARRAY<{_LOG}>>>"
)

RULE_FILE = "name STRING, filter STRING, rules ARRAY<STRUCT<name: STRING, filter: STRING>>"

ROOTS = "certificates ARRAY<STRING>"

DNS_OBS = (
    "domain STRING, rdtype STRING, rcode STRING, flags ARRAY<STRING>, "
    "has_ad BOOLEAN, has_rrsig BOOLEAN"
)

SESSIONS = (
    "id BIGINT, interval_from STRING, interval_to STRING, target_count BIGINT, query STRING, "
    "nxdomain_mode BOOLEAN, status STRING, created_at STRING, updated_at STRING"
)
JOBS = (
    "id BIGINT, log_uri STRING, tree_size_at_start BIGINT, next_end_index BIGINT, "
    "target_count BIGINT, matched_count BIGINT, status STRING, query STRING, "
    "nxdomain_mode BOOLEAN, session_id BIGINT, created_at STRING, updated_at STRING"
)
MATCHES = (
    "id BIGINT, job_id BIGINT, log_index BIGINT, domain STRING, issuer_cn STRING, "
    "issuer_org STRING, not_before STRING, not_after STRING, rule_name STRING, matched_at STRING"
)

# Column order of the two CSV exports.
PARSED_COLUMNS = [
    "index", "timestamp_ms", "timestamp_utc", "issuer_cn", "issuer_org", "subject_cn",
    "subject_org", "not_before", "not_after", "domain", "san", "cert_der_b64",
]
EXPORT_COLUMNS = [
    "index", "job_id", "log_index", "domain", "issuer_cn", "issuer_org",
    "not_before", "not_after", "matched_rule",
]
