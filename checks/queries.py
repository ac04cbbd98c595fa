"""Every operator as a query over the given tables, beside the SQL that DuckDB runs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from certmill.functions import dns, fields, framing as fr, names as nm
from certmill.functions.registry import register_functions
from certmill.operators import (
    certs as ct, dnsobs, entries as en, jobs as jb, known as kn, loglist as ll, psl, roots as rt,
    rules as rl, scan, scts as sc,
)
from certmill.plans import audits as pl, state as ss
from certmill.session import new_table_path, stored
from certmill.sinks import files as sk
from certmill.sources import certfiles, dump, loglist as sll, psl as spsl, roots as srt, rules as srl
from certmill.streaming import names as sn, scan as st
from checks.fixtures import AS_OF, BATCH, Fixtures
from checks.fixtures_sql import with_

Query = Callable[[Fixtures], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NOW = "2026-02-01 00:00:00"
TARGET_ROOT = rt.target_fingerprint(der=b"root-7")


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def text(col: str):
    return F.col(col).cast("string").alias(col)


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        register_functions(spark)
        return QUERIES[name](Fixtures(spark, sf_dir))

    return call


def _stored_json(x: Fixtures, df: DataFrame, label: str) -> str:
    path = new_table_path(x.spark, label)
    df.write.json(path)
    return path


def _dump_path(x: Fixtures) -> str:
    """The entries as a dump: metadata, blank and broken lines beside the entry lines."""
    rows = x.entries().select(F.to_json(F.struct("index", "entry")).alias("value"))
    noise = x.table("supplier").selectExpr(
        "CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '{\"index\": 1, \"entry\": {' "
        "ELSE concat('{\"type\": \"log_dump_entries\", \"log_uri\": \"https://log0.example/\", \"tree_size\": ', "
        "s_suppkey, '}') END AS value"
    )
    path = new_table_path(x.spark, "dump")
    rows.unionByName(noise).write.text(path)
    return path


def _documents_path(x: Fixtures) -> str:
    """The log list, one document per operator folder."""
    path = new_table_path(x.spark, "log-list")
    x.log_list_documents().repartition("operator").write.partitionBy("operator").text(path)
    return path


# --- 2.1 sources, scans, sinks -----------------------------------------------------------

@query("src_dump_jsonl", with_("entries") + """
SELECT index, CASE WHEN k = 48 THEN 3 WHEN k = 49 THEN 8
  ELSE 4 * ((12 + (CASE WHEN t = 0 THEN 3 + octet_length(encode(body)) ELSE 0 END) + 2) // 3) END AS leaf_chars,
  CASE WHEN t = 1 AND k <> 45 THEN 4 * ((3 + octet_length(encode(body)) + 2) // 3) ELSE 0 END AS extra_chars
FROM entries""")
def _(x):
    return dump.read_dump(x.spark, _dump_path(x)).select(
        "index",
        F.length("entry.leaf_input").cast("bigint").alias("leaf_chars"),
        F.length("entry.extra_data").cast("bigint").alias("extra_chars"),
    )


@query("src_log_list", with_("logs") + """
SELECT description, url, year, "start", "end", state, operator FROM logs WHERE log_kind = 'classic'""")
def _(x):
    return sll.read_log_list(x.spark, _documents_path(x)).drop("pos")


@query("src_log_entries", with_("logs") + """
SELECT operator, array_to_string(operator_emails, ', ') AS emails, description, log_id, slash_url AS url, state,
  state_timestamp, "start", "end", CAST(mmd AS VARCHAR) AS mmd, log_kind, log_type FROM logs""")
def _(x):
    return sll.read_log_entries(x.spark, _documents_path(x)).select(
        "operator", F.array_join("operator_emails", ", ").alias("emails"), "description", "log_id", "url",
        "state", "state_timestamp", "start", "end", text("mmd"), "log_kind", "log_type",
    )


@query("src_operators", with_("ops") + """
SELECT name, array_to_string(emails, ', ') AS emails, len(emails) AS n FROM ops""")
def _(x):
    return sll.read_operators(x.spark, _documents_path(x)).select(
        "name", F.array_join("emails", ", ").alias("emails"), F.size("emails").cast("bigint").alias("n")
    )


@query("src_psl_rules", """
WITH lines AS (
  SELECT * FROM (VALUES ('arpa', 'unknown', 'plain', 1), ('com', 'icann', 'plain', 3), ('co.uk', 'icann', 'plain', 4),
    ('cn', 'icann', 'plain', 6), ('*.ck', 'icann', 'wildcard', 7), ('www.ck', 'icann', 'exception', 8),
    ('s0.hosting', 'icann', 'plain', 9)) t(rule, section, kind, pos)
  UNION ALL
  SELECT (CASE s_suppkey % 3 WHEN 1 THEN '*.' WHEN 2 THEN 'x.' ELSE '' END) || 's' || s_suppkey || '.hosting',
    'private', CASE s_suppkey % 3 WHEN 1 THEN 'wildcard' WHEN 2 THEN 'exception' ELSE 'plain' END, 12 + s_suppkey
  FROM supplier)
SELECT rule, arg_max(section, pos) AS section, arg_max(kind, pos) AS kind FROM lines GROUP BY rule""")
def _(x):
    path = new_table_path(x.spark, "psl")
    # A list is one file with its lines in order.
    x.psl_text().repartition(1).sortWithinPartitions("pos").select("line").write.text(path)
    return spsl.read_psl_rules(x.spark, path)


@query("src_rules_json", """
SELECT CASE WHEN s_suppkey % 5 = 4 THEN 'unnamed' ELSE s_name END AS name,
  CASE WHEN s_suppkey % 7 = 6 THEN 'true' ELSE 'log_index % ' || (s_suppkey + 2) || ' = 0' END AS filter
FROM supplier""")
def _(x):
    rules = x.table("supplier").selectExpr(
        "s_suppkey % 2 AS shape",
        "to_json(named_struct('name', CASE WHEN s_suppkey % 5 <> 4 THEN s_name END, 'filter', "
        "CASE WHEN s_suppkey % 7 <> 6 THEN concat('log_index % ', s_suppkey + 2, ' = 0') END)) AS rule",
    )
    files = rules.groupBy("shape").agg(F.array_join(F.collect_list("rule"), ",").alias("r")).selectExpr(
        "shape", "CASE WHEN shape = 0 THEN concat('[', r, ']') ELSE concat('{\"rules\": [', r, ']}') END AS value"
    )
    path = new_table_path(x.spark, "rules")
    files.repartition("shape").write.partitionBy("shape").text(path)
    return srl.read_rules(x.spark, path).select("name", "filter")


@query("src_roots_json", with_("log_roots") + """
SELECT slash_url AS log_url, der_text AS der FROM log_roots""")
def _(x):
    answers = x.log_roots().groupBy(ll.slash_url(F.col("log_url")).alias("log_url")).agg(
        F.collect_list(fr.to_base64(F.col("der"))).alias("certificates")
    )
    # One answer per log; the log is named in the answer, as a collector stores it.
    path = _stored_json(x, answers.select("certificates", "log_url"), "roots")
    return srt.read_roots(x.spark, path, json_lines=True).select("log_url", F.col("der").cast("string").alias("der"))


@query("src_cert_files", "SELECT 'part-' || p_partkey || ': ' || p_name AS der FROM part")
def _(x):
    rows = x.table("part").selectExpr(
        "p_partkey AS log_index", "p_size > 25 AS large",
        "cast(concat('part-', p_partkey, ': ', p_name) AS binary) AS der",
    )
    folder = new_table_path(x.spark, "cert-files")
    # Every part is a file: the large ones as PEM, the others as DER.
    sk.write_cert_files(rows.where("large"), f"{folder}/pem", "pem")
    sk.write_cert_files(rows.where("NOT coalesce(large, false)"), f"{folder}/der", "der")
    return certfiles.read_cert_files(x.spark, folder, "*.[pd]e[mr]").select(F.col("der").cast("string").alias("der"))


@query("scan_ranges", with_("certs") + """
SELECT log_uri, unnest(generate_series(CAST(0 AS BIGINT), n, 50)) AS batch_start,
  least(n, unnest(generate_series(CAST(0 AS BIGINT), n, 50)) + 49) AS batch_end
FROM (SELECT log_uri, max(log_index) AS n FROM certs GROUP BY log_uri)""")
def _(x):
    bounds = x.certs().groupBy("log_uri").agg(F.max("log_index").alias("range_end"))
    return scan.entry_ranges(bounds.withColumn("range_start", F.lit(0).cast("bigint")), BATCH)


@query("scan_index_slice", with_("entries") + """
SELECT index, t AS entry_type_asked FROM entries WHERE index BETWEEN 100 AND 100 + 5000""")
def _(x):
    return en.index_slice(x.entries(), 100, 5100).selectExpr("index", "index % 3 AS entry_type_asked")


@query("scan_tail_order", with_("placed") + """
SELECT log_uri, log_index, scan_batch, scan_pos FROM placed ORDER BY log_uri, scan_batch, log_index""")
def _(x):
    certs = x.certs().select("log_uri", "log_index")
    return scan.with_scan_position(certs, scan.tree_sizes(certs), BATCH).orderBy(*scan.scan_order()).select(
        "log_uri", "log_index", "scan_batch", "scan_pos"
    )


@query("sink_dump_jsonl", with_("entries") + "SELECT index, error AS error FROM entries")
def _(x):
    path = new_table_path(x.spark, "dump-out")
    sk.write_dump(x.entries(), path, "https://log0.example/", 10, 0, 9, 200)
    return en.decode_entries(dump.read_dump(x.spark, f"{path}/*")).select("index", "error")


_PARSED_SQL = with_("entries") + """
SELECT index, timestamp_ms, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S')
    || (CASE WHEN ms % 1000 = 0 THEN '' ELSE '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || '000' END)
    || '+00:00' AS timestamp_utc,
  'CA ' || body AS issuer_cn, 'Issuer' AS issuer_org, body AS subject_cn, 'N/A' AS subject_org,
  '2024-01-01 00:00:00 UTC' AS not_before, '2025-01-01 00:00:00 UTC' AS not_after,
  'n' || length(body) || '.example' AS domain, 'n' || length(body) || '.example;x.example' AS san,
  to_base64(encode(body)) AS cert_der_b64
FROM entries WHERE error IS NULL"""


def _parsed(x: Fixtures) -> DataFrame:
    return pl.parse_dump(x.spark, _dump_path(x), x.cert_fields())


@query("sink_parsed_jsonl", _PARSED_SQL)
def _(x):
    path = new_table_path(x.spark, "parsed")
    sk.write_parsed_jsonl(_parsed(x), path)
    schema = "index BIGINT, timestamp_ms BIGINT, san ARRAY<STRING>, " + ", ".join(
        f"{c} STRING" for c in sk.PARSED_COLUMNS if c not in ("index", "timestamp_ms", "san")
    )
    return sk.parsed_csv_frame(x.spark.read.schema(schema).json(path))


@query("sink_parsed_csv", _PARSED_SQL)
def _(x):
    path = new_table_path(x.spark, "parsed-csv")
    sk.write_parsed_csv(_parsed(x), path)
    schema = ", ".join(
        f"{c} {'BIGINT' if c in ('index', 'timestamp_ms') else 'STRING'}" for c in sk.PARSED_COLUMNS
    )
    return x.spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


_EXPORT_SQL = with_("matches", "jobs") + """
SELECT row_number() OVER (ORDER BY m.id) AS index, m.job_id, m.log_index, m.domain, m.issuer_cn, m.issuer_org,
  m.not_before, m.not_after, m.rule_name AS matched_rule FROM matches m JOIN jobs j ON j.id = m.job_id"""


@query("sink_matches_csv", _EXPORT_SQL)
def _(x):
    path = new_table_path(x.spark, "export")
    sk.write_matches_csv(jb.export_rows(x.matches(), x.jobs()), path)
    schema = ", ".join(
        f"{c} {'BIGINT' if c in ('index', 'job_id', 'log_index') else 'STRING'}" for c in sk.EXPORT_COLUMNS
    )
    return x.spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


@query("sink_cert_files", with_("raw_certs") + """
SELECT file_name, outcome FROM (
  SELECT 'log' || (o_orderkey % 4) || '-' || log_index || '.pem' AS file_name,
    CASE WHEN der_text IS NULL THEN 'failed' ELSE 'written' END AS outcome FROM raw_certs)
UNION ALL SELECT 'again', 'skipped ' || count(der_text) || ' failed ' || (count(*) - count(der_text)) FROM raw_certs""")
def _(x):
    folder = new_table_path(x.spark, "pem")
    hits = x.raw_certs().select(
        F.concat(F.regexp_extract("log_uri", "//(log[0-9]+)", 1), F.lit("-"), F.col("log_index"), F.lit(".pem")).alias("file_name"),
        "log_index", "der",
    )
    first = sk.write_cert_files(hits, folder)
    again = sk.outcome_counts(sk.write_cert_files(hits, folder)).selectExpr(
        "'again' AS file_name", "concat('skipped ', skipped, ' failed ', failed) AS outcome"
    )
    return first.unionByName(again)


# --- 2.2 framing decode and projections ----------------------------------------------------

def _leaf():
    return fr.from_base64(F.col("entry.leaf_input"))


def _extra():
    return fr.from_base64(F.coalesce(F.col("entry.extra_data"), F.lit("")))


@query("leaf_timestamp", with_("entries") + """
SELECT index, CAST(timestamp_ms AS VARCHAR) AS timestamp_ms FROM entries""")
def _(x):
    return x.entries().select("index", fr.leaf_timestamp(_leaf()).cast("string").alias("timestamp_ms"))


@query("leaf_timestamp_iso", with_("entries") + """
SELECT index, CASE WHEN timestamp_ms IS NOT NULL THEN strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S')
  || (CASE WHEN ms % 1000 = 0 THEN '' ELSE '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || '000' END)
  || '+00:00' END AS timestamp_utc FROM entries""")
def _(x):
    return x.entries().select("index", fr.millis_to_iso(fr.leaf_timestamp(_leaf())).alias("timestamp_utc"))


@query("leaf_header", with_("entries") + """
SELECT index, CASE WHEN k IN (48, 49) THEN NULL WHEN k = 47 THEN '1' ELSE '0' END AS version,
  CASE WHEN k IN (48, 49) THEN NULL ELSE '0' END AS leaf_type,
  CASE WHEN k IN (48, 49) THEN NULL ELSE CAST(t AS VARCHAR) END AS entry_type,
  CASE WHEN error IN ('bad_base64', 'leaf_too_short', 'unsupported_header', 'unknown_entry_type') THEN error END AS error
FROM entries""")
def _(x):
    leaf = _leaf()
    return x.entries().select(
        "index", fr.leaf_version(leaf).cast("string").alias("version"),
        fr.leaf_type(leaf).cast("string").alias("leaf_type"),
        fr.entry_type(leaf).cast("string").alias("entry_type"), fr.header_error(leaf).alias("error"),
    )


@query("leaf_der_x509", with_("entries") + """
SELECT index, CASE WHEN error IS NULL AND t = 0 THEN body END AS der,
  CASE WHEN k NOT IN (47, 48, 49) AND t = 1 THEN 'not_x509_entry' ELSE error END AS error FROM entries""")
def _(x):
    return x.entries().select(
        "index", fr.x509_der(_leaf()).cast("string").alias("der"), fr.x509_error(_leaf()).alias("error")
    )


@query("leaf_der_precert", with_("entries") + """
SELECT index, CASE WHEN error IS NULL AND t = 1 THEN body END AS der,
  CASE WHEN k NOT IN (47, 48, 49) AND t = 0 THEN 'not_precert_entry' ELSE error END AS error FROM entries""")
def _(x):
    return x.entries().select(
        "index", fr.precert_der(_leaf(), _extra()).cast("string").alias("der"),
        fr.precert_error(_leaf(), _extra()).alias("error"),
    )


@query("decode_entries", with_("entries") + """
SELECT index, CAST(timestamp_ms AS VARCHAR) AS timestamp_ms,
  CASE WHEN k NOT IN (48, 49) THEN CAST(t AS VARCHAR) END AS entry_type,
  CASE WHEN error IS NULL THEN body END AS der, error FROM entries""")
def _(x):
    return en.decode_entries(x.entries()).select(
        "index", text("timestamp_ms"), text("entry_type"), F.col("der").cast("string").alias("der"), "error"
    )


@query("decode_audit", with_("entries") + """
, b AS (SELECT (n - 1 - index) // 50 AS scan_batch, n, count(*) AS received, count(*) FILTER (error IS NULL) AS parsed,
    count(*) FILTER (error IS NOT NULL) AS unparsed
  FROM entries, (SELECT max(index) + 1 AS n FROM entries) GROUP BY 1, 2)
SELECT 'https://log0.example/' AS log_uri, scan_batch, received, parsed, unparsed,
  CAST(sum(parsed) OVER (ORDER BY scan_batch) AS BIGINT) AS total_parsed,
  greatest(0, n - (scan_batch + 1) * 50) / n * 100.0 AS position_pct FROM b""")
def _(x):
    entries = dump.read_dump(x.spark, _dump_path(x)).withColumn("log_uri", F.lit("https://log0.example/"))
    return en.decode_audit(en.decode_entries(entries), scan.tree_sizes(entries, "index"), BATCH)


@query("cert_fingerprint", with_("log_roots") + """
SELECT slash_url AS log_url, sha256(der_text) AS fingerprint FROM log_roots""")
def _(x):
    return x.log_roots().select(ll.slash_url(F.col("log_url")).alias("log_url"), fr.fingerprint(F.col("der")).alias("fingerprint"))


@query("normalize_fingerprint", with_("log_roots") + """
SELECT slash_url AS log_url, CASE WHEN der_text LIKE 'alt%' THEN left(sha256(der_text), 40) ELSE sha256(der_text) END AS fingerprint,
  der_text NOT LIKE 'alt%' AS valid FROM log_roots""")
def _(x):
    # Each step is a projection of its own, so that what the next one uses several times is computed once.
    rows = x.log_roots().select("log_url", "der", F.upper(fr.fingerprint(F.col("der"))).alias("digits"))
    pairs = [F.concat(F.substring("digits", i, 2), F.lit(":")) for i in range(1, 65, 2)]
    shown = rows.select("log_url", "der", F.concat(*pairs).alias("shown"))
    alt = F.startswith(F.col("der").cast("string"), F.lit("alt"))
    cut = shown.select("log_url", F.when(alt, F.substring("shown", 1, 60)).otherwise(F.col("shown")).alias("cut"))
    return cut.select(
        ll.slash_url(F.col("log_url")).alias("log_url"),
        fr.normalize_fingerprint(F.col("cut")).alias("fingerprint"), fr.is_sha256_hex(F.col("cut")).alias("valid"),
    )


@query("pem_encode", """
SELECT doc_id, '-----BEGIN CERTIFICATE-----' || chr(10) || regexp_replace(to_base64(encode(text)), '(.{1,64})', '\\1' || chr(10), 'g')
  || '-----END CERTIFICATE-----' || chr(10) AS pem FROM documents""")
def _(x):
    return x.table("documents").select("doc_id", fr.pem(F.col("text").cast("binary")).alias("pem"))


@query("sct_list_explode", with_("scts") + """
SELECT cert_id, ordinal, log_id_b64, ms AS timestamp_ms, "timestamp", 'Version.v1' AS version,
  CASE WHEN l_suppkey % 2 = 0 THEN 'sha256' ELSE 'sha384' END AS hash_algorithm,
  CASE WHEN cert_id % 2 = 0 THEN 'precert_scts' ELSE 'embedded_scts' END AS extension FROM scts""")
def _(x):
    return sc.explode_scts(x.sct_lists()).withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query("sct_list_errors", with_("scts") + """
SELECT DISTINCT cert_id, CASE WHEN cert_id % 2 = 0 THEN 'precert_scts' ELSE 'embedded_scts' END AS extension,
  CASE WHEN cert_id % 5 = 2 THEN 'bad_length' ELSE 'length_mismatch' END AS error
FROM scts WHERE cert_id % 5 IN (1, 2, 3)""")
def _(x):
    return sc.broken_lists(x.torn_sct_lists())


@query("sct_list_torn", with_("torn_scts") + """
SELECT cert_id, ordinal, log_id_b64, ms AS timestamp_ms FROM torn_scts""")
def _(x):
    return sc.explode_scts(x.torn_sct_lists()).select(
        "cert_id", F.col("ordinal").cast("bigint").alias("ordinal"), "log_id_b64", "timestamp_ms"
    )


@query("san_fallback", with_("certs") + """
SELECT log_uri, log_index, array_to_string(san, ';') AS san FROM certs""")
def _(x):
    return ct.fill_names(x.raw_certs()).select("log_uri", "log_index", F.array_join("san", ";").alias("san"))


@query("expand_names", with_("expanded") + """
SELECT log_uri, log_index, issuer_cn, issuer_org, issuer_country, subject_cn, subject_org, subject_country,
  not_before, not_after, is_expired, array_to_string(san, ';') AS san, array_to_string(san, ';') AS domains, domain,
  CAST(pos AS BIGINT) AS pos FROM expanded""")
def _(x):
    return rl.expand_names(x.certs()).select(
        "log_uri", "log_index", "issuer_cn", "issuer_org", "issuer_country", "subject_cn", "subject_org",
        "subject_country", "not_before", "not_after", "is_expired", F.array_join("san", ";").alias("san"),
        F.array_join("domains", ";").alias("domains"), "domain", F.col("pos").cast("bigint").alias("pos"),
    )


@query("cert_projection", _PARSED_SQL)
def _(x):
    return sk.parsed_csv_frame(_parsed(x))


@query("is_expired", with_("certs") + "SELECT log_uri, log_index, is_expired FROM certs")
def _(x):
    return ct.mark_expired(x.raw_certs(), AS_OF).select("log_uri", "log_index", "is_expired")


@query("missing_sentinel", with_("certs") + """
SELECT log_uri, log_index, subject_cn, subject_org, subject_country, issuer_cn FROM certs""")
def _(x):
    return ct.fill_missing(x.raw_certs()).select(
        "log_uri", "log_index", "subject_cn", "subject_org", "subject_country", "issuer_cn"
    )


@query("format_utc", """
SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' END AS seen FROM events""")
def _(x):
    seen = F.when(F.col("event_type") != "error", F.col("ts"))
    return x.table("events").select("event_id", fields.format_utc(seen).alias("seen"))


# --- 2.3 predicates and rules ------------------------------------------------------------

def _named(x: Fixtures) -> DataFrame:
    return rl.expand_names(x.certs())


def _predicate(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    sql = with_("expanded") + (
        "SELECT log_uri, log_index, CAST(pos AS BIGINT) AS pos, domain FROM expanded WHERE " + (duck_sql or spark_sql)
    )

    @query(name, sql)
    def _(x):
        return rl.where_certs(_named(x), spark_sql).select(
            "log_uri", "log_index", F.col("pos").cast("bigint").alias("pos"), "domain"
        )


_predicate("pred_compare", "issuer_org = 'BUILDING' AND issuer_cn != '5-LOW' AND not_before >= '1996-01-01' "
           "AND not_after < '2001-01-01' AND log_index > 10 AND log_index <= 1000000")
_predicate("pred_like", "domain LIKE 'p_%.co%' AND issuer_country LIKE 'NATION_1%'")
_predicate("pred_not_like", "domain NOT LIKE '%.com' AND domain NOT LIKE '*.%'")
_predicate("pred_in", "issuer_country IN ('NATION_1', 'NATION_2') OR issuer_org IN ('BUILDING')")
_predicate("pred_not_in", "issuer_org NOT IN ('BUILDING', 'MACHINERY')")
_predicate("pred_null", "subject_org IS NOT NULL AND NOT (domain IS NULL) AND subject_org = 'N/A'")
_predicate("pred_logic", "(is_expired = TRUE OR issuer_org = 'BUILDING') AND NOT (domain LIKE '%.cn') AND is_expired <> False")
_predicate("pred_quoted", "WHERE issuer_org <> 'Let''s Encrypt' AND subject_cn <> 'a=b AND true'",
           "issuer_org <> 'Let''s Encrypt' AND subject_cn <> 'a=b AND true'")
_predicate("fn_matches", "matches(domain, '^p[0-9]+[.]co') OR matches(issuer_cn, 'URG')",
           "regexp_matches(domain, '^p[0-9]+[.]co') OR regexp_matches(issuer_cn, 'URG')")
_predicate("fn_endswith", "endswith(domain, '.co.uk')", "ends_with(domain, '.co.uk')")
_predicate("fn_contains", "contains(domain, 'blogspot') OR contains(subject_cn, '00000000')")

_RULES = [
    ("old building", "issuer_org = 'BUILDING' AND is_expired"),
    ("dot com", "domain LIKE '%.com' AND NOT matches(domain, '^[*]')"),
    ("it's ck", "endswith(domain, '.ck')"),
]
_RULE_CASE = """CASE WHEN issuer_country = 'NATION_3' THEN 'query' WHEN issuer_org = 'BUILDING' AND is_expired THEN 'old building'
  WHEN domain LIKE '%.com' AND domain NOT LIKE '*%' THEN 'dot com' WHEN domain LIKE '%.ck' THEN 'it''s ck' END"""


@query("rule_first_match", with_("expanded") + f"""
SELECT * FROM (SELECT log_uri, log_index, CAST(pos AS BIGINT) AS pos, domain, {_RULE_CASE} AS rule_name FROM expanded)
WHERE rule_name IS NOT NULL""")
def _(x):
    rules = rl.combine("issuer_country = 'NATION_3'", _RULES)
    return rl.first_rule(_named(x), rules).select(
        "log_uri", "log_index", F.col("pos").cast("bigint").alias("pos"), "domain", "rule_name"
    )


@query("after_date", with_("certs") + "SELECT log_uri, log_index, not_before FROM certs WHERE not_before >= '1998-03'")
def _(x):
    return scan.after_date(x.certs(), "1998-03").select("log_uri", "log_index", "not_before")


@query("usable_only", with_("logs") + "SELECT description, url, state FROM logs WHERE state = 'usable'")
def _(x):
    return ll.usable_only(x.ct_logs()).select("description", "url", "state")


@query("url_present", with_("logs") + "SELECT description, slash_url AS url FROM logs WHERE url <> ''")
def _(x):
    return ll.url_present(x.ct_logs()).select("description", "url")


@query("require_icann", with_("cert_ok") + "SELECT log_uri, log_index FROM cert_ok WHERE dns_failed = 0")
def _(x):
    return psl.require_icann(x.certs(), x.psl_rules()).select("log_uri", "log_index")


@query("nxdomain_filter", with_("enriched") + """
SELECT log_uri, log_index, CAST(pos AS BIGINT) AS pos, clean AS domain FROM enriched WHERE rcode = 'NXDOMAIN'""")
def _(x):
    return dnsobs.nxdomain_only(_named(x), x.dns_obs()).select(
        "log_uri", "log_index", F.col("pos").cast("bigint").alias("pos"), "domain"
    )


# --- 2.4 names -----------------------------------------------------------------------------

_KEY = ["log_uri", "log_index"]


def _pos():
    return F.col("pos").cast("bigint").alias("pos")


@query("normalize_domain", with_("clean") + "SELECT log_uri, log_index, CAST(pos AS BIGINT) AS pos, clean FROM clean")
def _(x):
    return _named(x).select(*_KEY, _pos(), nm.strip_wildcard(F.col("domain")).alias("clean"))


@query("canonical_host", with_("clean") + """
SELECT log_uri, log_index, CAST(pos AS BIGINT) AS pos, rtrim(lower(clean), '.') AS host FROM clean""")
def _(x):
    padded = F.concat(F.lit("  "), F.col("domain"), F.lit(". "))
    return _named(x).select(*_KEY, _pos(), nm.canonical_host(padded).alias("host"))


@query("name_kind", with_("expanded", "hosts") + """
SELECT log_uri, log_index, CAST(pos AS BIGINT) AS pos, kind FROM expanded JOIN hosts USING (domain)""")
def _(x):
    return _named(x).select(*_KEY, _pos(), nm.name_kind(F.col("domain")).alias("kind"))


@query("public_suffix", with_("expanded", "suffixes") + """
SELECT log_uri, log_index, CAST(pos AS BIGINT) AS pos, host, public_suffix FROM expanded JOIN suffixes USING (domain)
WHERE kind = 'dns_name'""")
def _(x):
    found = psl.with_public_suffix(_named(x).select(*_KEY, "pos", "domain"), x.psl_rules())
    return found.where("kind = 'dns_name'").select(*_KEY, _pos(), "host", "public_suffix")


@query("psl_wildcards", with_("suffixes") + """
SELECT DISTINCT host, public_suffix, psl_section, public_suffix LIKE '%.ck' AS by_wildcard,
  host LIKE '%.www.ck' AS by_exception FROM suffixes WHERE kind = 'dns_name'""")
def _(x):
    found = psl.with_public_suffix(_named(x).select("domain"), x.psl_rules()).where("kind = 'dns_name'")
    return found.select(
        "host", "public_suffix", "psl_section", F.endswith(F.col("public_suffix"), F.lit(".ck")).alias("by_wildcard"),
        F.endswith(F.col("host"), F.lit(".www.ck")).alias("by_exception"),
    ).distinct()


@query("psl_public_suffix", with_("expanded", "suffixes") + """
SELECT log_uri, log_index, CAST(pos AS BIGINT) AS pos, coalesce(public_suffix, '') AS psl_public_suffix
FROM expanded JOIN suffixes USING (domain)""")
def _(x):
    named = _named(x).select(*_KEY, "pos", "domain")
    return psl.with_psl_columns(named, x.psl_rules()).select(*_KEY, _pos(), "psl_public_suffix")


@query("psl_section", with_("expanded", "suffixes") + """
SELECT log_uri, log_index, CAST(pos AS BIGINT) AS pos, coalesce(psl_section, '') AS psl_section
FROM expanded JOIN suffixes USING (domain)""")
def _(x):
    named = _named(x).select(*_KEY, "pos", "domain")
    return psl.with_psl_columns(named, x.psl_rules()).select(*_KEY, _pos(), "psl_section")


@query("is_icann_domain", with_("expanded", "suffixes") + """
SELECT log_uri, log_index, CAST(pos AS BIGINT) AS pos, coalesce(psl_section = 'icann', false) AS is_icann_domain
FROM expanded JOIN suffixes USING (domain)""")
def _(x):
    named = _named(x).select(*_KEY, "pos", "domain")
    return psl.with_psl_columns(named, x.psl_rules()).select(*_KEY, _pos(), "is_icann_domain")


@query("name_verdict", with_("expanded", "verdicts") + """
SELECT log_uri, log_index, CAST(pos AS BIGINT) AS pos, domain AS name, kind, public_suffix, psl_section,
  CAST(ok AS VARCHAR) AS ok, reason FROM expanded JOIN verdicts USING (domain)""")
def _(x):
    named = _named(x).select(*_KEY, "pos", "domain")
    return psl.with_verdict(named, x.psl_rules()).select(
        *_KEY, _pos(), "name", "kind", "public_suffix", "psl_section", text("ok"), "reason"
    )


@query("cert_verdict", with_("expanded", "verdicts") + """
SELECT log_uri, log_index, count(*) FILTER (kind = 'dns_name') AS dns_checked,
  count(*) FILTER (kind = 'dns_name' AND NOT ok) AS dns_failed,
  count(*) FILTER (kind = 'dns_name' AND NOT ok) = 0 AS all_ok,
  string_agg(domain || '=' || coalesce(psl_section, '-'), ' ' ORDER BY pos) AS names
FROM expanded JOIN verdicts USING (domain) GROUP BY ALL""")
def _(x):
    shown = F.transform("domains", lambda d: F.concat(d["name"], F.lit("="), F.coalesce(d["psl_section"], F.lit("-"))))
    return psl.cert_verdict(x.certs(), x.psl_rules()).select(
        *_KEY, "dns_checked", "dns_failed", "all_ok", F.array_join(shown, " ").alias("names")
    )


@query("dns_lookup_keys", with_("clean") + """
SELECT DISTINCT clean AS domain, unnest(['A', 'AAAA']) AS rdtype FROM clean""")
def _(x):
    return dnsobs.lookup_keys(_named(x), ["A", "AAAA"])


@query("dns_enrich", with_("enriched") + """
SELECT log_uri, log_index, CAST(pos AS BIGINT) AS pos, domain, rcode, flags, has_ad, has_rrsig FROM enriched""")
def _(x):
    named = _named(x).select(*_KEY, "pos", "domain")
    return dnsobs.enrich(named, x.dns_obs()).select(
        *_KEY, _pos(), "domain", "rcode", F.array_join("flags", ",").alias("flags"), "has_ad", "has_rrsig"
    )


@query("dns_status_rcode", with_("dns_obs") + """
SELECT domain, rcode AS status, CASE rcode WHEN 'NOERROR' THEN 0 WHEN 'SERVFAIL' THEN 2 WHEN 'NXDOMAIN' THEN 3
  WHEN 'REFUSED' THEN 5 ELSE -1 END AS rcode_number FROM dns_obs""")
def _(x):
    return x.dns_obs().select("domain", F.col("rcode").alias("status"), dns.rcode_number(F.col("rcode")).alias("rcode_number"))


@query("dns_flags", with_("dns_obs") + """
SELECT domain, flags, flags LIKE '%AD%' AS has_ad_flag, true AS has_qr_flag FROM dns_obs""")
def _(x):
    return x.dns_obs().select(
        "domain", F.array_join("flags", ",").alias("flags"), dns.has_flag(F.col("flags"), "ad").alias("has_ad_flag"),
        F.expr("dns_has_flag(flags, 'qr')").alias("has_qr_flag"),
    )


@query("dns_exists_nx", with_("dns_obs") + """
SELECT domain, rcode = 'NOERROR' AS dns_exists, rcode = 'NXDOMAIN' AS is_nxdomain FROM dns_obs""")
def _(x):
    r = F.col("rcode")
    return x.dns_obs().select("domain", dns.exists(r).alias("dns_exists"), dns.is_nxdomain(r).alias("is_nxdomain"))


@query("dnssec_secure", with_("dns_obs") + """
SELECT domain, rcode = 'NOERROR' AND (has_ad OR has_rrsig) AS secure,
  rcode = 'NOERROR' AND NOT has_ad AND NOT has_rrsig AS insecure FROM dns_obs""")
def _(x):
    args = (F.col("rcode"), F.col("has_ad"), F.col("has_rrsig"))
    return x.dns_obs().select(
        "domain", dns.is_dnssec_secure(*args).alias("secure"), dns.is_dnssec_insecure(*args).alias("insecure")
    )


# --- 2.5 joins -----------------------------------------------------------------------------

@query("sct_lookup", with_("scts", "log_index_") + """
SELECT cert_id, ordinal, log_id_b64, l.log_id IS NOT NULL AS matched, coalesce(operator, '—') AS operator,
  CASE WHEN len(operator_emails) > 0 THEN array_to_string(operator_emails, ', ') ELSE '—' END AS operator_contact,
  coalesce(description, '—') AS description, coalesce(nullif(url, ''), '—') AS url, coalesce(state, '—') AS state,
  coalesce(nullif(state_timestamp, ''), '—') AS state_timestamp,
  coalesce(CAST(mmd AS VARCHAR), '—') AS mmd, coalesce(log_kind, '—') AS log_kind, coalesce(log_type, '—') AS log_type,
  coalesce("start" || ' ~ ' || "end", '—') AS period
FROM scts s LEFT JOIN log_index_ l ON l.log_id = s.log_id_b64""")
def _(x):
    found = sc.lookup_scts(sc.explode_scts(x.sct_lists()), x.log_entries())
    return found.select(
        "cert_id", F.col("ordinal").cast("bigint").alias("ordinal"), "log_id_b64", "matched", "operator",
        "operator_contact", "description", "url", "state", "state_timestamp", "mmd", "log_kind", "log_type", "period",
    )


@query("log_id_index", with_("log_index_") + "SELECT log_id, description, operator, pos FROM log_index_")
def _(x):
    return ll.log_id_index(x.log_entries()).select("log_id", "description", "operator", "pos")


@query("interval_overlap", with_("logs", "sessions") + """
SELECT s.id AS session_id, l.description FROM logs l JOIN (SELECT id, DATE '2021-06-15' + CAST(id % 40 AS INTEGER) * 30 AS lo,
  DATE '2021-06-15' + CAST(id % 40 AS INTEGER) * 30 + 180 AS hi FROM sessions) s
ON l.start_day <= s.hi AND (l.end_day IS NULL OR l.end_day > s.lo)""")
def _(x):
    intervals = x.sessions().selectExpr(
        "id AS session_id", "date_add(date'2021-06-15', cast(id % 40 AS int) * 30) AS interval_from",
        "date_add(date'2021-06-15', cast(id % 40 AS int) * 30 + 180) AS interval_to",
    )
    return ll.overlap_join(intervals, x.ct_logs()).select("session_id", "description")


@query("select_logs", with_("logs") + """
SELECT description, slash_url AS url, "start", operator FROM logs WHERE state = 'usable' AND url <> ''
  AND start_day <= DATE '2026-06-30' AND (end_day IS NULL OR end_day > DATE '2023-02-01')
ORDER BY start_day DESC, description DESC""")
def _(x):
    return ll.select_logs(x.ct_logs(), today=date(2026, 6, 30), lo=date(2023, 2, 1)).select(
        "description", "url", "start", "operator"
    )


@query("contact_map", with_("logs", "ops") + """
SELECT description, operator, CASE WHEN len(emails) > 0 THEN array_to_string(emails, ', ') ELSE '—' END AS contact
FROM logs LEFT JOIN ops ON name = operator""")
def _(x):
    return ll.contact_map(x.ct_logs(), x.operators()).select("description", "operator", "contact")


@query("log_operator", with_("logs", "jobs") + """
SELECT id, log_uri, coalesce(operator, 'manual') AS operator FROM (SELECT id, CASE WHEN id % 4 = 3 THEN 'https://other.example/'
  ELSE log_uri END AS log_uri FROM jobs) LEFT JOIN logs ON slash_url = log_uri""")
def _(x):
    rows = x.jobs().selectExpr("id", "CASE WHEN id % 4 = 3 THEN 'https://other.example/' ELSE log_uri END AS log_uri")
    return ll.log_operator(rows, x.ct_logs()).select("id", "log_uri", "operator")


@query("root_coverage", with_("coverage") + "SELECT operator, description, state, has_root, roots FROM coverage")
def _(x):
    return rt.root_coverage(x.ct_logs(), x.log_roots(), TARGET_ROOT).select(
        "operator", "description", "state", "has_root", "roots"
    )


@query("root_report", with_("logs", "log_roots", "ops") + """
, answers AS (SELECT slash_url, count(*) AS n, bool_or(der_text = 'root-7') AS has FROM log_roots
  WHERE CAST(regexp_extract(slash_url, 'log([0-9]+)', 1) AS BIGINT) % 3 <> 1 GROUP BY slash_url),
told AS (SELECT CASE WHEN s_suppkey % 13 = 12 THEN '' ELSE 'https://log' || s_suppkey || '.example/' END AS slash_url,
    max('timed out after ' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || ' ' || repeat('.', 90)) AS note
  FROM supplier WHERE s_suppkey % 4 <> 3 GROUP BY ALL)
SELECT l.operator, CASE WHEN len(o.emails) > 0 THEN array_to_string(o.emails, ', ') ELSE '—' END AS contact,
  l.description, l.state, CASE WHEN r.n IS NULL THEN 'error' WHEN r.has THEN 'yes' ELSE 'no' END AS has_root,
  coalesce(CAST(r.n AS VARCHAR), '—') AS roots, CASE WHEN r.n IS NULL THEN coalesce(left(t.note, 80), '') ELSE '' END AS note
FROM logs l LEFT JOIN answers r ON r.slash_url = l.slash_url LEFT JOIN told t ON t.slash_url = l.slash_url
  LEFT JOIN ops o ON o.name = l.operator""")
def _(x):
    coverage = rt.root_coverage(x.ct_logs(), x.some_log_roots(), TARGET_ROOT)
    return rt.coverage_report(coverage, x.operators(), x.root_failures()).select(
        "operator", "contact", "description", "state", "has_root", "roots", "note"
    )


@query("root_missing", with_("coverage") + "SELECT operator, description FROM coverage WHERE has_root = 'no'")
def _(x):
    return rt.root_missing(rt.root_coverage(x.ct_logs(), x.log_roots(), TARGET_ROOT)).select("operator", "description")


@query("roots_by_log", with_("logs", "log_roots") + """
SELECT operator, description, slash_url AS url,
  row_number() OVER (PARTITION BY slash_url ORDER BY sha256(der_text)) AS root_no,
  sha256(der_text) AS fingerprint_sha256, coalesce(p_name, '?') AS subject_cn, coalesce(p_brand, '?') AS subject_org
FROM logs JOIN log_roots USING (slash_url) LEFT JOIN part ON 'root-' || p_partkey = der_text""")
def _(x):
    return rt.roots_by_log(x.ct_logs(), x.log_roots(), x.subjects())


@query("session_known", with_("matches", "jobs") + """
SELECT DISTINCT session_id, domain FROM matches m JOIN jobs j ON j.id = m.job_id WHERE session_id IS NOT NULL""")
def _(x):
    return jb.session_known(x.matches(), x.jobs())


@query("job_known", with_("matches") + "SELECT job_id, domain FROM matches")
def _(x):
    return jb.job_known(x.matches())


@query("skip_completed_logs", with_("logs", "jobs", "sessions") + """
SELECT s.id AS session_id, slash_url AS url FROM sessions s JOIN logs l ON l.pos // 4 = s.id AND l.url <> ''
WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.status = 'completed' AND j.session_id = s.id AND j.log_uri = slash_url)""")
def _(x):
    planned = ll.url_present(x.ct_logs()).selectExpr("pos div 4 AS session_id", "url")
    return jb.skip_completed_logs(planned, x.jobs())


@query("skip_known", with_("clean", "matches") + """
SELECT log_uri, log_index, CAST(pos AS BIGINT) AS pos, domain FROM clean WHERE clean NOT IN (
  SELECT CASE WHEN domain LIKE '*.%' THEN substr(domain, 3) ELSE domain END FROM matches)""")
def _(x):
    return jb.skip_known(_named(x), jb.job_known(x.matches())).select(*_KEY, _pos(), "domain")


@query("skip_known_stored", with_("clean", "matches") + """
SELECT log_uri, log_index, CAST(pos AS BIGINT) AS pos, domain FROM clean WHERE clean NOT IN (
  SELECT CASE WHEN domain LIKE '*.%' THEN substr(domain, 3) ELSE domain END FROM matches)""")
def _(x):
    # The bound is set low so that the filter works at every size.
    marked = _named(x).withColumn("_clean", nm.strip_wildcard(F.col("domain")))
    known = kn.store_known(jb.job_known(x.matches()))
    return kn.without_known(marked, known, max_rows=0).select(*_KEY, _pos(), "domain")


# --- 2.6 aggregations ------------------------------------------------------------------------

@query("logs_per_operator", with_("logs", "ops") + """
SELECT name AS operator, CASE WHEN len(emails) > 0 THEN array_to_string(emails, ', ') ELSE '—' END AS contact,
  (SELECT count(*) FROM logs WHERE operator = name) AS logs FROM ops ORDER BY lower(name)""")
def _(x):
    return ll.logs_per_operator(x.operators(), x.ct_logs())


@query("usable_by_year", with_("logs") + """
SELECT year, count(*) FILTER (state = 'usable') AS usable, count(*) AS total FROM logs GROUP BY year ORDER BY year DESC""")
def _(x):
    return ll.usable_by_year(x.ct_logs())


@query("usable_by_operator", with_("logs") + """
SELECT year, operator, count(*) FILTER (state = 'usable') AS usable, count(*) AS total FROM logs GROUP BY ALL""")
def _(x):
    return ll.usable_by_operator(x.ct_logs())


@query("group_targets", with_("logs") + """
SELECT operator, string_agg(slash_url || '|' || description, ' ' ORDER BY slash_url, description) AS targets, count(*) AS n
FROM logs WHERE url <> '' GROUP BY operator""")
def _(x):
    targets = ll.url_present(x.ct_logs()).selectExpr("operator", "url AS uri", "description AS label")
    shown = F.transform("targets", lambda t: F.concat(t["uri"], F.lit("|"), t["label"]))
    return ll.group_targets(targets).select(
        "operator", F.array_join(shown, " ").alias("targets"), F.size("targets").cast("bigint").alias("n")
    )


@query("session_unique_count", with_("matches", "jobs") + """
SELECT session_id, count(DISTINCT domain) AS unique_domains FROM matches m JOIN jobs j ON j.id = m.job_id
WHERE session_id IS NOT NULL GROUP BY session_id""")
def _(x):
    return jb.session_unique_count(x.matches(), x.jobs())


@query("job_hit_counts", with_("matches", "jobs") + """
SELECT j.id, j.log_uri, j.status, (SELECT count(*) FROM matches m WHERE m.job_id = j.id) AS hit_count FROM jobs j
ORDER BY j.id DESC LIMIT 100""")
def _(x):
    return jb.job_hit_counts(x.matches(), x.jobs(), 100).select("id", "log_uri", "status", "hit_count")


@query("count_matches", with_("matches") + """
SELECT 'all' AS scope, count(*) AS matches FROM matches UNION ALL
SELECT CAST(job_id AS VARCHAR), count(*) FROM matches GROUP BY job_id""")
def _(x):
    m = x.matches()
    total = jb.count_matches(m).select(F.lit("all").alias("scope"), "matches")
    return total.unionByName(jb.count_matches(m, per_job=True).select(F.col("job_id").cast("string").alias("scope"), "matches"))


@query("job_log_indices", with_("matches") + "SELECT DISTINCT job_id, log_index FROM matches")
def _(x):
    return jb.job_log_indices(x.matches())


@query("scan_status", with_("matches", "jobs") + """
SELECT (SELECT count(*) FROM matches) AS total_hits, '#' || id AS active_job, log_uri,
  matched_count || '/' || target_count AS progress, next_end_index, status
FROM jobs WHERE status = 'running' ORDER BY id DESC LIMIT 1""")
def _(x):
    return jb.scan_status(x.matches(), x.jobs())


@query("sct_summary", with_("scts", "logs") + """
SELECT cert_id, count(*) AS total, count(*) FILTER (log_id_b64 IN (SELECT log_id FROM logs)) AS matched,
  count(*) FILTER (log_id_b64 NOT IN (SELECT log_id FROM logs)) AS unknown FROM scts GROUP BY cert_id""")
def _(x):
    return sc.sct_summary(sc.lookup_scts(sc.explode_scts(x.sct_lists()), x.log_entries()))


@query("sct_summary_all", with_("torn_scts", "logs") + """
SELECT c.cert_id, count(t.cert_id) AS total, count(*) FILTER (t.log_id_b64 IN (SELECT log_id FROM logs)) AS matched,
  count(*) FILTER (t.log_id_b64 NOT IN (SELECT log_id FROM logs)) AS unknown
FROM (SELECT DISTINCT cert_id FROM scts) c LEFT JOIN torn_scts t ON t.cert_id = c.cert_id GROUP BY c.cert_id""")
def _(x):
    lists = x.torn_sct_lists()
    return sc.sct_summary(sc.lookup_scts(sc.explode_scts(lists), x.log_entries()), lists)


@query("root_summary", with_("coverage") + """
SELECT count(*) FILTER (has_root = 'yes') AS present, count(*) FILTER (has_root = 'no') AS missing,
  count(*) FILTER (has_root = 'error') AS errors, count(*) AS total FROM coverage""")
def _(x):
    return pl.check_root(x.ct_logs(), x.log_roots(), TARGET_ROOT)[1]


@query("known_union", with_("matches", "jobs") + """
SELECT DISTINCT domain FROM (SELECT domain FROM matches UNION ALL
  SELECT domain FROM matches m JOIN jobs j ON j.id = m.job_id WHERE session_id IS NOT NULL)""")
def _(x):
    m = x.matches()
    return jb.known_union(jb.job_known(m), jb.session_known(m, x.jobs()))


# --- 2.7 windows, sorts, limits --------------------------------------------------------------

@query("active_job", with_("jobs") + """
SELECT id, log_uri, next_end_index, status FROM jobs WHERE status = 'running' ORDER BY id DESC LIMIT 1""")
def _(x):
    return jb.active_job(x.jobs()).select("id", "log_uri", "next_end_index", "status")


@query("latest_completed_job", with_("jobs") + "SELECT max(id) AS id FROM jobs WHERE status = 'completed'")
def _(x):
    return jb.latest_completed_job(x.jobs())


@query("find_session", with_("sessions") + """
SELECT id, target_count, status FROM sessions WHERE status = 'running' AND interval_from = '2026-01-01'
  AND interval_to = '2026-06-30' AND coalesce(query, '') = '' AND nxdomain_mode ORDER BY id DESC LIMIT 1""")
def _(x):
    return jb.find_session(x.sessions(), "2026-01-01", "2026-06-30", None, True).select("id", "target_count", "status")


@query("running_job_for_log", with_("jobs") + """
SELECT log_uri, CAST(session_id AS VARCHAR) AS session_id, max(id) AS id FROM jobs WHERE status = 'running'
GROUP BY log_uri, session_id""")
def _(x):
    return jb.running_job_for_log(x.jobs()).select("log_uri", text("session_id"), "id")


@query("export_row_index", _EXPORT_SQL)
def _(x):
    return jb.export_rows(x.matches(), x.jobs())


@query("sct_ordinal", with_("scts") + "SELECT cert_id, ordinal, log_id_b64, ms AS timestamp_ms FROM scts")
def _(x):
    return sc.explode_scts(x.sct_lists()).select(
        "cert_id", F.col("ordinal").cast("bigint").alias("ordinal"), "log_id_b64", "timestamp_ms"
    )


_FIRST_SQL = f"""
SELECT log_uri, log_index, domain, rule_name FROM (
  SELECT *, row_number() OVER (PARTITION BY log_uri, log_index ORDER BY pos) AS rn FROM (
    SELECT log_uri, log_index, pos, domain, {_RULE_CASE} AS rule_name FROM expanded) WHERE rule_name IS NOT NULL)
WHERE rn = 1"""


@query("first_match_per_cert", with_("expanded") + _FIRST_SQL)
def _(x):
    return scan.first_match(x.certs(), rl.combine("issuer_country = 'NATION_3'", _RULES)).select(
        *_KEY, "domain", "rule_name"
    )


_SLICE = "issuer_org = 'BUILDING' AND domain LIKE '%.com'"


@query("target_limit", with_("expanded", "placed") + f"""
SELECT f.log_uri, f.log_index, f.domain, p.scan_batch FROM (
  SELECT *, row_number() OVER (PARTITION BY log_uri, log_index ORDER BY pos) AS rn FROM expanded WHERE {_SLICE}) f
JOIN placed p USING (log_uri, log_index) WHERE rn = 1
ORDER BY f.log_uri, p.scan_batch, f.log_index LIMIT 100""")
def _(x):
    return flagship(x)


@query("save_hits", with_("expanded", "placed", "raw_certs") + f"""
SELECT 'log' || (o_orderkey % 4) || '.example-' || h.log_index || '.pem' AS file_name,
  CASE WHEN der_text IS NULL THEN 'failed' ELSE 'written' END AS outcome FROM (
  SELECT f.log_uri, f.log_index FROM (
    SELECT *, row_number() OVER (PARTITION BY log_uri, log_index ORDER BY pos) AS rn FROM expanded WHERE {_SLICE}) f
  JOIN placed p USING (log_uri, log_index) WHERE rn = 1
  ORDER BY f.log_uri, p.scan_batch, f.log_index LIMIT 100) h
JOIN raw_certs c ON c.log_index = h.log_index AND h.log_uri = 'https://log' || (o_orderkey % 4) || '.example/'""")
def _(x):
    return sk.write_cert_files(pl.hit_certificates(flagship(x), x.certs()), new_table_path(x.spark, "hit-certs"))


def flagship(x: Fixtures) -> DataFrame:
    """Scan for a predicate with a target: first passing name per certificate, in scan order."""
    opts = pl.ScanOptions(query=_SLICE, batch_size=BATCH, target=100)
    heads = stored(x.tree_heads(), "heads")
    return pl.first_hits(x.certs(), heads, opts).select("log_uri", "log_index", "domain", "scan_batch")


@query("parse_limit", _PARSED_SQL + " ORDER BY index LIMIT 500")
def _(x):
    decoded = en.decode_entries(dump.read_dump(x.spark, _dump_path(x)))
    return sk.parsed_csv_frame(en.parsed_first(decoded, x.cert_fields(), 500))


# --- 2.8 stateful and incremental ------------------------------------------------------------

@query("dedupe_matches", with_("matches") + "SELECT id, job_id, log_index, domain, rule_name FROM matches")
def _(x):
    return jb.dedupe_matches(x.arrivals()).select("id", "job_id", "log_index", "domain", "rule_name")


def _assign_sql(source: str) -> str:
    """Rounds of proposals over (ord, step, name): the last round's accepted pairs."""
    return f"""
, start_ AS (SELECT ord, name, step, false AS refused, 0 AS round_no, true AS moved FROM ({source})),
rounds AS (
  SELECT * FROM start_
  UNION ALL
  SELECT ord, name, step, refused OR lost, round_no + 1, bool_or(lost) OVER () AS moved FROM (
    SELECT *, bid AND ord > min(CASE WHEN bid THEN ord END) OVER (PARTITION BY name) AS lost FROM (
      SELECT *, NOT refused AND step = min(CASE WHEN NOT refused THEN step END) OVER (PARTITION BY ord) AS bid
      FROM rounds WHERE moved)))
, final_ AS (
  SELECT ord, name, step FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY step) AS rn FROM rounds
    WHERE NOT moved AND NOT refused) WHERE rn = 1)
"""


_ALL_ORD = """SELECT ord, clean AS name, min(pos) AS step FROM (
  SELECT c.clean, c.pos, dense_rank() OVER (ORDER BY c.log_uri) * 1000000000 + p.scan_pos AS ord
  FROM clean c JOIN placed p USING (log_uri, log_index)) GROUP BY ALL"""


@query("greedy_hits", with_("clean", "placed", recursive=True) + _assign_sql(_ALL_ORD) + """
SELECT p.log_uri, p.log_index, f.name AS clean FROM final_ f JOIN (
  SELECT *, dense_rank() OVER (ORDER BY log_uri) * 1000000000 + scan_pos AS ord FROM placed) p USING (ord)""")
def _(x):
    certs = x.certs()
    sizes = stored(x.tree_heads(), "heads")
    ranks = sizes.select("log_uri", F.regexp_extract("log_uri", "//log([0-9]+)", 1).cast("bigint").alias("log_rank"))
    opts = pl.ScanOptions(batch_size=BATCH, target=None)
    return pl.scan_logs(certs, sizes, opts, ranks=ranks).select("log_uri", "log_index", "clean")


_SESSION_RANK = """(SELECT slash_url AS log_uri, row_number() OVER (ORDER BY operator, start_day DESC NULLS LAST, description DESC) AS log_rank
  FROM logs WHERE url <> '')"""


@query("session_hits", with_("clean", "placed", "logs", recursive=True) + _assign_sql(f"""
SELECT ord, clean AS name, min(pos) AS step FROM (
  SELECT c.clean, c.pos, r.log_rank * 1000000000 + p.scan_pos AS ord FROM clean c JOIN placed p USING (log_uri, log_index)
  JOIN {_SESSION_RANK} r USING (log_uri) WHERE c.issuer_org = 'BUILDING' AND c.domain LIKE '%.com') GROUP BY ALL""") + f"""
SELECT p.log_uri, p.log_index, f.name AS clean FROM final_ f JOIN (
  SELECT p.*, r.log_rank * 1000000000 + p.scan_pos AS ord FROM placed p JOIN {_SESSION_RANK} r USING (log_uri)) p USING (ord)
ORDER BY ord LIMIT 300""")
def _(x):
    certs = x.certs()
    opts = pl.ScanOptions(query=_SLICE, batch_size=BATCH, target=300)
    return pl.scan_session(certs, stored(x.tree_heads(), "heads"), ll.url_present(x.ct_logs()), opts).select(
        "log_uri", "log_index", "clean"
    )


_PARTIAL_SQL = """
WITH e0 AS (SELECT 'https://log' || (event_id % 4) || '.example/' AS log_uri, event_id // 4 AS i FROM events),
kept AS (SELECT * FROM e0 WHERE i % 7 <> 3 AND i % 100 >= 5),
e AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE i % 11 = 5),
s AS (SELECT CASE WHEN k = 3 THEN 'https://log9.example/' ELSE 'https://log' || k || '.example/' END AS log_uri, max(i) - 20 * k AS tree_size
  FROM (SELECT event_id % 4 AS k, event_id // 4 AS i FROM events) GROUP BY k)
"""


@query("entry_coverage", _PARTIAL_SQL + """
, c AS (SELECT log_uri, count(*) AS received, count(DISTINCT CASE WHEN i < tree_size THEN i END) AS distinct_indices,
    count(*) FILTER (i < tree_size) AS below, count(*) FILTER (i >= tree_size) AS beyond_tree, count(*) FILTER (tree_size IS NULL) AS no_size
  FROM e LEFT JOIN s USING (log_uri) GROUP BY log_uri)
SELECT log_uri, coalesce(received, 0) AS received, coalesce(distinct_indices, 0) AS distinct_indices,
  coalesce(below - distinct_indices, 0) AS repeated, coalesce(beyond_tree, 0) AS beyond_tree, coalesce(no_size, 0) AS no_size,
  coalesce(tree_size - coalesce(distinct_indices, 0), 0) AS missing FROM c FULL JOIN s USING (log_uri)""")
def _(x):
    found = en.entry_coverage(x.partial_entries(), stored(x.partial_sizes(), "heads"))
    return found.drop("tree_size")


@query("missing_ranges", _PARTIAL_SQL + """
, gone AS (SELECT log_uri, i FROM (SELECT log_uri, unnest(range(tree_size)) AS i FROM s) ANTI JOIN e USING (log_uri, i))
SELECT log_uri, min(i) AS first_missing, max(i) AS last_missing FROM (
  SELECT log_uri, i, i - row_number() OVER (PARTITION BY log_uri ORDER BY i) AS part FROM gone) GROUP BY log_uri, part""")
def _(x):
    return en.missing_ranges(x.partial_entries(), stored(x.partial_sizes(), "heads"), block=1000)


@query("session_state", with_("clean", "placed", "logs", recursive=True) + _assign_sql(f"""
SELECT ord, clean AS name, min(pos) AS step FROM (
  SELECT c.clean, c.pos, r.log_rank * 1000000000 + p.scan_pos AS ord FROM clean c JOIN placed p USING (log_uri, log_index)
  JOIN {_SESSION_RANK} r USING (log_uri) WHERE c.issuer_org = 'BUILDING' AND c.domain LIKE '%.com') GROUP BY ALL""") + f"""
SELECT row_number() OVER (ORDER BY f.ord) AS id, p.log_uri, p.log_index, f.name AS clean FROM final_ f JOIN (
  SELECT p.*, r.log_rank * 1000000000 + p.scan_pos AS ord FROM placed p JOIN {_SESSION_RANK} r USING (log_uri)) p USING (ord)
ORDER BY id LIMIT 500""")
def _(x):
    store = ss.StateStore.create(x.spark, new_table_path(x.spark, "session-state"))
    state = store.load()
    sessions = jb.start_session(state.sessions, "2026-01-01", "2026-06-30", 500, _SLICE, False, NOW)
    store.commit(state, "start", sessions, state.jobs, state.matches.limit(0))
    # A third of the first log, then the rest: each step finds the state that the one before committed.
    certs, heads = x.certs(), stored(x.tree_heads(), "heads")
    step = heads.agg(F.max("tree_size")).first()[0] // 3 + 1
    opts = pl.ScanOptions(query=_SLICE, batch_size=BATCH)
    logs = ll.url_present(x.ct_logs())
    if not ss.advance_session(store, 1, certs, heads, logs, opts, NOW, entries=step):
        ss.advance_session(store, 1, certs, heads, logs, opts, NOW)
    state = store.load()
    logs_of = state.jobs.select(F.col("id").alias("job_id"), "log_uri")
    return state.matches.join(F.broadcast(logs_of), "job_id").select(  # one job for each of the session's logs
        "id", "log_uri", "log_index", nm.strip_wildcard(F.col("domain")).alias("clean")
    )


@query("resume_scan", with_("clean", "jobs", "matches", recursive=True) + """
, job AS (SELECT * FROM jobs WHERE status = 'running' ORDER BY id DESC LIMIT 1),
known AS (SELECT CASE WHEN domain LIKE '*.%' THEN substr(domain, 3) ELSE domain END AS name
  FROM matches WHERE job_id = (SELECT id FROM job)),
rest AS (SELECT c.*, (next_end_index - c.log_index) // 50 AS b FROM clean c JOIN job j ON j.log_uri = c.log_uri
  AND c.log_index <= j.next_end_index),
cand AS (SELECT b * 1000000 + log_index AS ord, clean AS name, min(pos) AS step FROM rest
  WHERE domain LIKE '%.com' AND clean NOT IN (SELECT name FROM known) GROUP BY ALL)
""" + _assign_sql("SELECT * FROM cand") + """
SELECT f.ord % 1000000 AS log_index, f.name AS clean, (SELECT id FROM job) AS job_id FROM final_ f
ORDER BY f.ord LIMIT (SELECT target_count - matched_count FROM job)""")
def _(x):
    job = jb.active_job(x.jobs())
    opts = pl.ScanOptions(query="domain LIKE '%.com'", batch_size=BATCH)
    return pl.resume_scan(x.certs(), job, x.matches(), opts).select("log_index", "clean", "job_id")


@query("upsert_checkpoint", with_("jobs", "arrivals") + """
, p AS (SELECT job_id, arg_max(log_index, id) AS next_end_index, arg_max(log_index % 90, id) AS matched_count,
    '2026-02-' || lpad(CAST(max(id) AS VARCHAR), 20, '0') AS updated_at FROM arrivals GROUP BY job_id)
SELECT j.id, coalesce(p.next_end_index, j.next_end_index) AS next_end_index,
  coalesce(p.matched_count, j.matched_count) AS matched_count, coalesce(p.updated_at, j.updated_at) AS updated_at
FROM jobs j LEFT JOIN p ON p.job_id = j.id""")
def _(x):
    progress = x.arrivals().selectExpr(
        "job_id", "log_index AS next_end_index", "log_index % 90 AS matched_count",
        "concat('2026-02-', lpad(cast(id AS string), 20, '0')) AS updated_at",
    )
    return jb.apply_checkpoints(x.jobs(), progress).select("id", "next_end_index", "matched_count", "updated_at")


@query("complete_status", with_("jobs", "sessions") + f"""
SELECT 'job' AS kind, id, CASE WHEN session_id = 3 OR id = 7 THEN 'completed' ELSE status END AS status,
  CASE WHEN (session_id = 3 AND status = 'running') OR id = 7 THEN '{NOW}' ELSE updated_at END AS updated_at FROM jobs
UNION ALL SELECT 'session', id, CASE WHEN id = 3 THEN 'completed' ELSE status END,
  CASE WHEN id = 3 THEN '{NOW}' ELSE updated_at END FROM sessions""")
def _(x):
    jobs = jb.complete_job(jb.complete_session_jobs(x.jobs(), 3, NOW), 7, NOW)
    sessions = jb.complete_session(x.sessions(), 3, NOW)
    return jobs.selectExpr("'job' AS kind", "id", "status", "updated_at").unionByName(
        sessions.selectExpr("'session' AS kind", "id", "status", "updated_at")
    )


@query("purge_job", with_("jobs", "matches") + """
SELECT 'job' AS kind, id FROM jobs WHERE id <> 5 UNION ALL SELECT 'match', id FROM matches WHERE job_id <> 5""")
def _(x):
    matches, jobs = jb.purge_job(x.matches(), x.jobs(), 5)
    return jobs.selectExpr("'job' AS kind", "id").unionByName(matches.selectExpr("'match' AS kind", "id"))


@query("purge_completed", with_("jobs", "matches", "sessions") + """
SELECT 'job' AS kind, id FROM jobs WHERE status <> 'completed'
UNION ALL SELECT 'match', id FROM matches WHERE job_id NOT IN (SELECT id FROM jobs WHERE status = 'completed')
UNION ALL SELECT 'session', id FROM sessions WHERE status <> 'completed'
UNION ALL SELECT 'matches deleted', count(*) FROM matches WHERE job_id IN (SELECT id FROM jobs WHERE status = 'completed')
UNION ALL SELECT 'jobs deleted', count(*) FROM jobs WHERE status = 'completed'""")
def _(x):
    m, j = x.matches(), x.jobs()
    matches, jobs, sessions = jb.purge_completed(m, j, x.sessions())
    counts = jb.purge_counts(m, j)
    return (
        jobs.selectExpr("'job' AS kind", "id")
        .unionByName(matches.selectExpr("'match' AS kind", "id"))
        .unionByName(sessions.selectExpr("'session' AS kind", "id"))
        .unionByName(counts.selectExpr("'matches deleted' AS kind", "matches_deleted AS id"))
        .unionByName(counts.selectExpr("'jobs deleted' AS kind", "jobs_deleted AS id"))
    )


@query("purge_all", with_("jobs", "matches", "sessions") + """
SELECT 'matches' AS kind, 0 AS rows_left, count(*) AS rows_before FROM matches
UNION ALL SELECT 'jobs', 0, count(*) FROM jobs UNION ALL SELECT 'sessions', 0, count(*) FROM sessions""")
def _(x):
    left = jb.purge_all(x.spark)
    out = None
    for kind, old, new in zip(("matches", "jobs", "sessions"), (x.matches(), x.jobs(), x.sessions()), left):
        path = new_table_path(x.spark, f"purge-{kind}")
        old.write.parquet(path)
        before = x.spark.read.parquet(path).count()
        new.write.mode("overwrite").parquet(path)
        row = x.spark.read.parquet(path).agg(F.count(F.lit(1)).cast("int").alias("rows_left")).select(
            F.lit(kind).alias("kind"), "rows_left", F.lit(before).cast("bigint").alias("rows_before")
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("add_missing_column", with_("jobs") + """
SELECT id, log_uri, CAST(NULL AS VARCHAR) AS session_id FROM jobs""")
def _(x):
    return jb.add_missing_column(x.jobs().drop("session_id")).select("id", "log_uri", text("session_id"))


@query("stream_scan", with_("entries") + """
SELECT index, CAST(timestamp_ms AS VARCHAR) AS timestamp_ms, CASE WHEN error IS NULL THEN body END AS der, error FROM entries""")
def _(x):
    base = new_table_path(x.spark, "stream-scan")
    source = _dump_path(x)
    for _ in range(2):
        # The second run finds nothing new and adds no row.
        st.stream_scan(x.spark, source, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return x.spark.read.parquet(f"{base}/out").select(
        "index", text("timestamp_ms"), F.col("der").cast("string").alias("der"), "error"
    )


@query("stream_dedupe", with_("clean") + "SELECT DISTINCT clean FROM clean")
def _(x):
    base = new_table_path(x.spark, "stream-names")
    _named(x).select("domain").write.parquet(f"{base}/in")
    stream = x.spark.readStream.schema("domain STRING").option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    st.run_to_parquet(st.stream_names(stream), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return x.spark.read.schema("clean STRING").parquet(f"{base}/out")


@query("stream_names_kept", with_("clean") + "SELECT DISTINCT clean FROM clean")
def _(x):
    base = new_table_path(x.spark, "stream-kept")
    _named(x).select("domain").write.parquet(f"{base}/in")
    stream = x.spark.readStream.schema("domain STRING").option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    sn.keep_names(stream, f"{base}/out", f"{base}/checkpoint", "10 minutes").awaitTermination()
    return sn.kept_names(x.spark, f"{base}/out")


@query("start_job", with_("jobs") + f"""
SELECT id, log_uri, next_end_index, matched_count, status, created_at FROM jobs UNION ALL
SELECT max(id) + 1, 'https://log9.example/', 4999, 0, 'running', '{NOW}' FROM jobs""")
def _(x):
    more = jb.start_job(x.jobs(), "https://log9.example/", 5000, 100, None, False, NOW, session_id=1)
    return more.select("id", "log_uri", "next_end_index", "matched_count", "status", "created_at")
