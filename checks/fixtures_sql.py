"""The fixture tables again, as DuckDB common table expressions.

``with_(names)`` gives the WITH clause of the named tables and of those they need.
"""

from __future__ import annotations

# A small rule list that covers all kinds of rules.
PSL_RULES = [
    ("com", "icann", "plain"), ("co.uk", "icann", "plain"), ("org", "icann", "plain"),
    ("cn", "icann", "plain"), ("uk", "icann", "plain"), ("*.ck", "icann", "wildcard"),
    ("www.ck", "icann", "exception"), ("blogspot.com", "private", "plain"),
    ("github.io", "private", "plain"),
]
_SUFFIX = (
    "CASE l_suppkey % 9 WHEN 0 THEN 'com' WHEN 1 THEN 'co.uk' WHEN 2 THEN 'blogspot.com' "
    "WHEN 3 THEN 'github.io' WHEN 4 THEN 'org' WHEN 5 THEN 'test' WHEN 6 THEN 'cn' "
    "ELSE CASE WHEN l_linenumber = 3 THEN 'www.ck' ELSE 'b.ck' END END"
)

_MAIL = "lower(n_name) || '.example'"
_EMAILS = (
    f"CASE n_nationkey % 3 WHEN 0 THEN ['ops@' || {_MAIL}, 'ct@' || {_MAIL}] "
    f"WHEN 1 THEN ['ops@' || {_MAIL}] ELSE [] END"
)
_DAY = "make_date(2022 + k % 4, 1 + 6 * (k % 2), 1)"

TABLES: dict[str, tuple[list[str], str]] = {
    "names0": ([], f"""
        SELECT DISTINCT l_orderkey, l_linenumber,
          CASE WHEN l_linenumber = 6 THEN upper(name) || '.' ELSE name END AS name
        FROM (SELECT l_orderkey, l_linenumber,
          CASE WHEN l_suppkey % 9 = 8 THEN '192.0.2.' || (l_partkey % 256)
          ELSE (CASE WHEN l_linenumber % 5 = 0 THEN '*.' ELSE '' END)
            || 'p' || l_partkey || '.' || ({_SUFFIX}) END AS name FROM lineitem)"""),
    "raw_certs": (["names0"], """
        SELECT 'https://log' || (o_orderkey % 4) || '.example/' AS log_uri,
          o_orderkey // 4 AS log_index, o_orderkey,
          o_orderpriority AS issuer_cn, c_mktsegment AS issuer_org, n_name AS issuer_country,
          CASE WHEN o_orderkey % 7 <> 0 THEN lower(replace(c_name, '#', '-')) || '.example.com' END AS subject_cn,
          CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS subject_org,
          CASE WHEN c_custkey % 3 <> 0 THEN n_name END AS subject_country,
          strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' UTC' AS not_before,
          strftime(o_orderdate + to_days(CAST(30 + o_custkey % 400 AS INTEGER)), '%Y-%m-%d %H:%M:%S') || ' UTC' AS not_after,
          s.san, CASE WHEN o_orderkey % 11 <> 0 THEN 'cert-' || o_orderkey END AS der_text
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT l_orderkey, list(name ORDER BY l_linenumber, name) AS san
                   FROM names0 GROUP BY l_orderkey) s ON s.l_orderkey = o_orderkey"""),
    "certs": (["raw_certs"], """
        SELECT log_uri, log_index, issuer_cn, issuer_org, issuer_country,
          coalesce(subject_cn, 'N/A') AS subject_cn, coalesce(subject_org, 'N/A') AS subject_org,
          coalesce(subject_country, 'N/A') AS subject_country, not_before, not_after,
          strptime(left(not_after, 19), '%Y-%m-%d %H:%M:%S') < TIMESTAMP '1998-06-15 00:00:00' AS is_expired,
          CASE WHEN len(san) > 0 THEN san WHEN subject_cn IS NOT NULL THEN [subject_cn]
            ELSE ['__cert:' || log_index || '__'] END AS san, der_text
        FROM raw_certs"""),
    "expanded": (["certs"], """
        SELECT *, unnest(san) AS domain, generate_subscripts(san, 1) - 1 AS pos FROM certs"""),
    "placed": (["certs"], """
        SELECT *, (tree_size - 1 - log_index) // 50 AS scan_batch,
          row_number() OVER (PARTITION BY log_uri ORDER BY (tree_size - 1 - log_index) // 50, log_index) - 1 AS scan_pos
        FROM (SELECT *, max(log_index) OVER (PARTITION BY log_uri) + 1 AS tree_size FROM certs)"""),
    "clean": (["expanded"], """
        SELECT *, CASE WHEN domain LIKE '*.%' THEN substr(domain, 3) ELSE domain END AS clean FROM expanded"""),
    "entries": ([], """
        SELECT *, CASE WHEN k = 48 THEN 'bad_base64' WHEN k = 49 THEN 'leaf_too_short'
            WHEN k = 47 THEN 'unsupported_header' WHEN t = 2 THEN 'unknown_entry_type'
            WHEN k = 46 THEN 'length_exceeds_buffer' WHEN t = 1 AND k = 45 THEN 'missing_extra_data' END AS error,
          CASE WHEN k NOT IN (48, 49) THEN ms END AS timestamp_ms
        FROM (SELECT event_id AS index, event_id % 50 AS k, event_id % 3 AS t, coalesce(props, '') AS body,
              epoch_us(ts) // 1000 AS ms, ts FROM events)"""),
    "logs": ([], f"""
        SELECT n_name AS operator, {_EMAILS} AS operator_emails, s_name || ' log' AS description,
          to_base64(unhex(sha256('log-' || (CASE WHEN k % 10 = 9 THEN k - 1 ELSE k END)))) AS log_id,
          CASE WHEN k % 13 = 12 THEN '' ELSE 'https://log' || k || '.example' ||
            (CASE WHEN k % 2 = 0 THEN '/' ELSE '' END) END AS url,
          state, CASE WHEN state = 'unknown' THEN '' ELSE '2024-01-02 03:04:05' END AS state_timestamp,
          CASE WHEN k % 17 = 16 THEN 'N/A' ELSE CAST({_DAY} AS VARCHAR) END AS "start",
          CASE WHEN k % 6 = 5 THEN 'N/A' ELSE CAST(CAST({_DAY} + INTERVAL 1 YEAR AS DATE) AS VARCHAR) END AS "end",
          CASE WHEN k % 17 <> 16 THEN {_DAY} END AS start_day,
          CASE WHEN k % 6 <> 5 THEN CAST({_DAY} + INTERVAL 1 YEAR AS DATE) END AS end_day,
          CASE WHEN k % 17 = 16 THEN 'Unknown' ELSE CAST(2022 + k % 4 AS VARCHAR) END AS year,
          CASE WHEN k % 7 <> 6 THEN 86400 END AS mmd,
          CASE WHEN k % 5 = 4 THEN 'tiled' ELSE 'classic' END AS log_kind,
          CASE WHEN k % 3 = 0 THEN 'prod' END AS log_type, k AS pos,
          CASE WHEN k % 13 = 12 THEN '' ELSE 'https://log' || k || '.example/' END AS slash_url
        FROM (SELECT *, s_suppkey AS k, CASE s_suppkey % 4 WHEN 1 THEN 'retired' WHEN 2 THEN 'unknown'
                ELSE 'usable' END AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""),
    "ops": ([], f"SELECT n_name AS name, {_EMAILS} AS emails FROM nation"),
    "scts": ([], """
        SELECT *, row_number() OVER (PARTITION BY cert_id ORDER BY log_key, ms) AS ordinal,
          to_base64(unhex(sha256(log_key))) AS log_id_b64,
          strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S') || ' UTC' AS "timestamp"
        FROM (SELECT DISTINCT l_orderkey AS cert_id,
          (CASE WHEN l_linenumber = 7 THEN 'other-' ELSE 'log-' END) || l_suppkey AS log_key, l_suppkey,
          epoch_us(l_shipdate) // 1000 AS ms FROM lineitem)"""),
    "torn_scts": (["scts"], """
        SELECT * REPLACE (ordinal + CASE WHEN cert_id % 5 = 2 THEN 1 ELSE 0 END AS ordinal) FROM (
          SELECT *, max(ordinal) OVER (PARTITION BY cert_id) AS parts FROM scts)
        WHERE cert_id % 5 <> 4 AND NOT (cert_id % 5 = 3 AND ordinal = parts)"""),
    "log_index_": (["logs"], """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY pos DESC) AS rn FROM logs) WHERE rn = 1"""),
    "log_roots": ([], """
        SELECT DISTINCT 'https://log' || l_suppkey || '.example/' AS slash_url,
          (CASE WHEN l_linenumber = 7 THEN 'alt-root-' ELSE 'root-' END) || l_partkey AS der_text FROM lineitem"""),
    "coverage": (["logs", "log_roots"], """
        SELECT l.operator, l.description, l.state, l.slash_url,
          CASE WHEN r.n IS NULL THEN 'error' WHEN r.has THEN 'yes' ELSE 'no' END AS has_root,
          coalesce(CAST(r.n AS VARCHAR), '—') AS roots
        FROM logs l LEFT JOIN (SELECT slash_url, count(*) AS n, bool_or(der_text = 'root-7') AS has
          FROM log_roots GROUP BY slash_url) r ON r.slash_url = l.slash_url"""),
    "rules": ([], "SELECT * FROM (VALUES "
              + ", ".join(f"('{r}', '{s}', '{k}')" for r, s, k in PSL_RULES) + ") t(rule, section, kind)"),
    "hosts": (["clean"], r"""
        SELECT domain, CASE WHEN domain LIKE '\_\_cert:%' ESCAPE '\' OR instr(host, '.') = 0 THEN 'invalid'
            WHEN regexp_full_match(host, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') THEN 'ip' ELSE 'dns_name' END AS kind, host
        FROM (SELECT DISTINCT domain, rtrim(lower(clean), '.') AS host FROM clean)"""),
    "suffixes": (["hosts", "rules"], """
        SELECT domain, kind, host,
          CASE WHEN kind = 'dns_name' THEN array_to_string(list_slice(string_split(host, '.'),
            len(string_split(host, '.')) - coalesce(labels, 1) + 1, len(string_split(host, '.'))), '.') END AS public_suffix,
          CASE WHEN kind = 'dns_name' THEN coalesce(section, 'unknown') END AS psl_section
        FROM hosts LEFT JOIN (
          SELECT host, arg_max(labels, prio) AS labels, arg_max(section, prio) AS section FROM (
            SELECT h.host, r.section,
              len(string_split(r.rule, '.')) - (CASE WHEN kind2 = 'exception' THEN 1 ELSE 0 END) AS labels,
              (CASE WHEN kind2 = 'exception' THEN 1000 ELSE 0 END) + len(string_split(r.rule, '.')) AS prio
            FROM (SELECT DISTINCT host FROM hosts WHERE kind = 'dns_name') h
            JOIN (SELECT *, kind AS kind2 FROM rules) r
              ON (kind2 <> 'wildcard' AND (h.host = r.rule OR ends_with(h.host, '.' || r.rule)))
              OR (kind2 = 'wildcard' AND ends_with(h.host, substr(r.rule, 2))))
          GROUP BY host) m USING (host)"""),
    "verdicts": (["suffixes"], """
        SELECT domain, kind, public_suffix, psl_section,
          CASE WHEN kind = 'dns_name' THEN psl_section = 'icann' END AS ok,
          CASE WHEN domain LIKE '__cert:%' THEN 'not a DNS name' WHEN kind = 'invalid' THEN 'not a FQDN'
            WHEN kind = 'ip' THEN 'IP address (BR DNS-name PSL rule does not apply)'
            WHEN psl_section = 'icann' THEN 'public suffix is in PSL ICANN DOMAINS'
            WHEN psl_section = 'private' THEN
              'public suffix is in PSL PRIVATE DOMAINS (not an ICANN registry suffix; BR audit risk)'
            ELSE 'public suffix section unknown in cached PSL (unknown)' END AS reason
        FROM suffixes"""),
    "cert_ok": (["expanded", "verdicts"], """
        SELECT log_uri, log_index, count(*) FILTER (kind = 'dns_name') AS dns_checked,
          count(*) FILTER (kind = 'dns_name' AND NOT ok) AS dns_failed
        FROM expanded JOIN verdicts USING (domain) GROUP BY ALL"""),
    "dns_obs": ([], """
        SELECT 'p' || p_partkey || '.com' AS domain, 'A' AS rdtype,
          CASE p_partkey % 4 WHEN 0 THEN 'NOERROR' WHEN 1 THEN 'NXDOMAIN' WHEN 2 THEN 'SERVFAIL' ELSE 'REFUSED' END AS rcode,
          CASE WHEN p_partkey % 8 = 0 THEN 'QR,AD' ELSE 'QR' END AS flags,
          p_partkey % 8 = 0 AS has_ad, p_partkey % 12 = 0 AS has_rrsig FROM part"""),
    "enriched": (["clean", "dns_obs"], """
        SELECT c.log_uri, c.log_index, c.pos, c.domain, c.clean, coalesce(d.rcode, 'UNKNOWN') AS rcode,
          coalesce(d.flags, '') AS flags, coalesce(d.has_ad, false) AS has_ad,
          coalesce(d.has_rrsig, false) AS has_rrsig
        FROM clean c LEFT JOIN dns_obs d ON d.domain = c.clean"""),
    "sessions": ([], """
        SELECT id, '2026-01-01' AS interval_from, '2026-06-30' AS interval_to, 100 + id AS target_count,
          CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'q' END AS query, id % 2 = 0 AS nxdomain_mode,
          CASE WHEN id % 2 = 0 THEN 'running' ELSE 'completed' END AS status,
          '2026-01-01 00:00:00' AS created_at, '2026-01-01 00:00:00' AS updated_at
        FROM (SELECT DISTINCT s_suppkey // 4 AS id FROM supplier)"""),
    "jobs": ([], """
        SELECT s + 1 AS id, 'https://log' || (s % 4) || '.example/' AS log_uri, 1000 + s AS tree_size_at_start,
          900 + s AS next_end_index, CAST(100 AS BIGINT) AS target_count, s % 50 AS matched_count,
          CASE WHEN s % 3 = 0 THEN 'running' ELSE 'completed' END AS status,
          CASE s % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'q2' ELSE 'q3' END AS query,
          s % 2 = 0 AS nxdomain_mode, CASE WHEN s % 5 <> 4 THEN s // 4 END AS session_id,
          '2026-01-01 00:00:00' AS created_at, '2026-01-02 00:00:00' AS updated_at
        FROM (SELECT s_suppkey AS s FROM supplier)"""),
    "arrivals": ([], """
        SELECT DISTINCT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey AS id,
          l_suppkey + 1 AS job_id, l_orderkey AS log_index,
          (CASE WHEN l_linenumber % 5 = 0 THEN '*.' ELSE '' END) || 'p' || l_partkey || '.com' AS domain,
          'CA ' || (l_suppkey % 7) AS issuer_cn, 'Org ' || (l_suppkey % 5) AS issuer_org,
          '2026-01-01 00:00:00 UTC' AS not_before, '2026-12-31 00:00:00 UTC' AS not_after,
          'r' || (l_partkey % 3) AS rule_name, '2026-01-03 00:00:00' AS matched_at FROM lineitem"""),
    "matches": (["arrivals"], """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY job_id, domain ORDER BY id) AS rn
          FROM arrivals) WHERE rn = 1"""),
}


def with_(*names: str, recursive: bool = False) -> str:
    done: list[str] = []

    def need(name: str) -> None:
        if name in done:
            return
        for n in TABLES[name][0]:
            need(n)
        done.append(name)

    for n in names:
        need(n)
    # Materialized, so a table used several times is computed once.
    body = ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n][1]})" for n in done)
    return ("WITH RECURSIVE " if recursive else "WITH ") + body + "\n"
