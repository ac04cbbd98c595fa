"""Certificate-shaped tables that Spark derives from the given test tables.

The given tables hold no certificates; each builder maps whole tables to the
shape an operator needs, by plain arithmetic that DuckDB repeats in
``fixtures_sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from certmill.operators import certs as ct

AS_OF = "1998-06-15 00:00:00 UTC"
BATCH = 50

SUFFIX = (
    "CASE l_suppkey % 9 WHEN 0 THEN 'com' WHEN 1 THEN 'co.uk' WHEN 2 THEN 'blogspot.com' "
    "WHEN 3 THEN 'github.io' WHEN 4 THEN 'org' WHEN 5 THEN 'test' WHEN 6 THEN 'cn' "
    "ELSE CASE WHEN l_linenumber = 3 THEN 'www.ck' ELSE 'b.ck' END END"
)


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # --- certificates ------------------------------------------------------------------

    def names(self) -> DataFrame:
        """Distinct (order, line, name)."""
        # Lines of an order meet before their names are made; one shuffle serves all that follows by order.
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").repartition("l_orderkey")
        base = lines.selectExpr(
            "l_orderkey", "l_linenumber",
            "CASE WHEN l_suppkey % 9 = 8 THEN concat('192.0.2.', l_partkey % 256) "
            "ELSE concat(CASE WHEN l_linenumber % 5 = 0 THEN '*.' ELSE '' END, "
            f"'p', l_partkey, '.', {SUFFIX}) END AS name",
        )
        return base.selectExpr(
            "l_orderkey", "l_linenumber",
            "CASE WHEN l_linenumber = 6 THEN concat(upper(name), '.') ELSE name END AS name",
        ).distinct()

    def raw_certs(self) -> DataFrame:
        """Certificates with nulls where attributes are absent."""
        san = self.names().groupBy("l_orderkey").agg(
            F.sort_array(F.collect_list(F.struct("l_linenumber", "name")))["name"].alias("san")
        )
        orders, customer, nation = self.table("orders"), self.table("customer"), self.table("nation")
        return (
            orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(nation, customer.c_nationkey == nation.n_nationkey)
            .join(san, orders.o_orderkey == san.l_orderkey, "left")
            .selectExpr(
                "concat('https://log', o_orderkey % 4, '.example/') AS log_uri",
                "o_orderkey div 4 AS log_index",
                "o_orderpriority AS issuer_cn", "c_mktsegment AS issuer_org",
                "n_name AS issuer_country",
                "CASE WHEN o_orderkey % 7 <> 0 THEN "
                "concat(lower(replace(c_name, '#', '-')), '.example.com') END AS subject_cn",
                "CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS subject_org",
                "CASE WHEN c_custkey % 3 <> 0 THEN n_name END AS subject_country",
                "concat(date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss'), ' UTC') AS not_before",
                "concat(date_format(dateadd(DAY, cast(30 + o_custkey % 400 AS int), o_orderdate), "
                "'yyyy-MM-dd HH:mm:ss'), ' UTC') AS not_after",
                "san",
                "CASE WHEN o_orderkey % 11 <> 0 THEN "
                "cast(concat('cert-', o_orderkey) AS binary) END AS der",
            )
        )

    def certs(self) -> DataFrame:
        return ct.standard_certs(self.raw_certs(), AS_OF)

    def tree_heads(self) -> DataFrame:
        """``log_uri`` and ``tree_size`` of each log, as its head tells them; no certificate is read."""
        return self.table("orders").selectExpr(
            "concat('https://log', o_orderkey % 4, '.example/') AS log_uri", "o_orderkey div 4 AS log_index"
        ).groupBy("log_uri").agg((F.max("log_index") + 1).alias("tree_size"))

    # --- log entries -------------------------------------------------------------------

    def entries(self) -> DataFrame:
        """One log entry per event, some of them broken in different ways."""
        size = "lpad(hex(length(body) + CASE WHEN k = 46 THEN 5 ELSE 0 END), 6, '0')"
        return (
            self.table("events")
            .selectExpr(
                "event_id", "event_id % 50 AS k", "event_id % 3 AS t",
                "cast(coalesce(props, '') AS binary) AS body",
                "lpad(hex(unix_millis(cast(ts AS timestamp))), 16, '0') AS ms",
            )
            .selectExpr(
                "event_id", "k", "t",
                "concat(CASE WHEN k = 47 THEN '01' ELSE '00' END, '00', ms, lpad(hex(t), 4, '0'), "
                f"CASE WHEN t = 0 THEN concat({size}, hex(body)) ELSE '' END) AS leaf",
                f"CASE WHEN t = 1 AND k <> 45 THEN concat({size}, hex(body)) ELSE '' END AS extra",
            )
            .selectExpr(
                "event_id AS index",
                "'https://log0.example/' AS log_uri",
                "named_struct('leaf_input', CASE WHEN k = 48 THEN '@@@' ELSE regexp_replace("
                "base64(unhex(CASE WHEN k = 49 THEN substring(leaf, 1, 12) ELSE leaf END)), '[\r\n]', '') END, "
                "'extra_data', regexp_replace(base64(unhex(extra)), '[\r\n]', '')) AS entry",
            )
        )

    def partial_entries(self) -> DataFrame:
        """Indices of four logs with gaps and repeats; see :meth:`partial_sizes`."""
        rows = self.table("events").selectExpr("concat('https://log', event_id % 4, '.example/') AS log_uri", "event_id div 4 AS index")
        kept = rows.where("index % 7 <> 3 AND index % 100 >= 5")
        return kept.unionByName(kept.where("index % 11 = 5"))

    def partial_sizes(self) -> DataFrame:
        """Heads of logs 0 to 2 that are behind some entries, and of a log without entries; log 3 has none."""
        return self.table("events").selectExpr("event_id % 4 AS k", "event_id div 4 AS i").groupBy("k").agg(F.max("i").alias("m")).selectExpr(
            "CASE WHEN k = 3 THEN 'https://log9.example/' ELSE concat('https://log', k, '.example/') END AS log_uri", "m - 20 * k AS tree_size"
        )

    def cert_fields(self) -> DataFrame:
        """Certificate fields by fingerprint, for the bytes that the entries carry."""
        return self.table("events").selectExpr(
            "sha2(cast(coalesce(props, '') AS binary), 256) AS fingerprint",
            "concat('CA ', coalesce(props, '')) AS issuer_cn", "'Issuer' AS issuer_org",
            "coalesce(props, '') AS subject_cn", "'N/A' AS subject_org",
            "'2024-01-01 00:00:00 UTC' AS not_before", "'2025-01-01 00:00:00 UTC' AS not_after",
            "array(concat('n', length(props), '.example'), 'x.example') AS san",
        )

    # --- logs --------------------------------------------------------------------------

    def operators(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "n_name AS name",
            "CASE n_nationkey % 3 WHEN 0 THEN array(concat('ops@', lower(n_name), '.example'), "
            "concat('ct@', lower(n_name), '.example')) WHEN 1 THEN "
            "array(concat('ops@', lower(n_name), '.example')) ELSE cast(array() AS array<string>) END AS emails",
        )

    def log_entries(self) -> DataFrame:
        """One log per supplier; its nation is the operator."""
        supplier, ops = self.table("supplier"), self.operators()
        nation = self.table("nation")
        return (
            supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
            .join(ops, nation.n_name == ops.name)
            .selectExpr("*", "s_suppkey AS k")
            .selectExpr(
                "*",
                "make_date(cast(2022 + k % 4 AS int), cast(1 + 6 * (k % 2) AS int), 1) AS first_day",
                "CASE k % 4 WHEN 1 THEN 'retired' WHEN 2 THEN 'unknown' ELSE 'usable' END AS state",
            )
            .selectExpr(
                "n_name AS operator", "emails AS operator_emails",
                "concat(s_name, ' log') AS description",
                "regexp_replace(base64(unhex(sha2(cast(concat('log-', CASE WHEN k % 10 = 9 THEN k - 1 ELSE k END) "
                "AS binary), 256))), '[\r\n]', '') AS log_id",
                "CASE WHEN k % 13 = 12 THEN '' ELSE concat('https://log', k, '.example', "
                "CASE WHEN k % 2 = 0 THEN '/' ELSE '' END) END AS url",
                "state",
                "CASE WHEN state = 'unknown' THEN '' ELSE '2024-01-02 03:04:05' END AS state_timestamp",
                "CASE WHEN k % 17 = 16 THEN 'N/A' ELSE cast(first_day AS string) END AS start",
                "CASE WHEN k % 6 = 5 THEN 'N/A' ELSE cast(add_months(first_day, 12) AS string) END AS end",
                "CASE WHEN k % 7 <> 6 THEN 86400 END AS mmd",
                "CASE WHEN k % 5 = 4 THEN 'tiled' ELSE 'classic' END AS log_kind",
                "CASE WHEN k % 3 = 0 THEN 'prod' END AS log_type",
                "k AS pos",
            )
        )

    def ct_logs(self) -> DataFrame:
        return self.log_entries().selectExpr(
            "description", "url",
            "CASE WHEN start = 'N/A' THEN 'Unknown' ELSE substring(start, 1, 4) END AS year",
            "start", "end", "state", "operator", "pos",
        )

    def log_list_documents(self) -> DataFrame:
        """``operator`` and ``value``: one JSON document per operator, with its logs."""
        log = (
            "to_json(named_struct('description', description, 'log_id', log_id, 'mmd', mmd, "
            "'url', CASE WHEN log_kind = 'classic' OR pos % 3 = 0 THEN url WHEN pos % 3 = 1 THEN '' END, "
            "'submission_url', CASE WHEN log_kind = 'tiled' AND pos % 3 = 1 THEN url END, "
            "'monitoring_url', CASE WHEN log_kind = 'tiled' AND pos % 3 = 2 THEN url END, "
            "'log_type', log_type, "
            "'state', CASE WHEN state <> 'unknown' THEN "
            "map(state, named_struct('timestamp', '2024-01-02T03:04:05Z')) END, "
            "'temporal_interval', named_struct("
            "'start_inclusive', CASE WHEN start <> 'N/A' THEN concat(start, 'T00:00:00Z') END, "
            "'end_exclusive', CASE WHEN end <> 'N/A' THEN concat(end, 'T00:00:00Z') END)))"
        )
        rows = self.log_entries().selectExpr("operator", "log_kind", "pos", f"{log} AS log")

        def listing(kind: str):
            inside = F.collect_list(F.when(F.col("log_kind") == kind, F.struct("pos", "log")))
            return F.array_join(F.array_sort(inside)["log"], ",").alias(kind)

        logs = rows.groupBy("operator").agg(listing("classic"), listing("tiled"))
        nation = self.table("nation").selectExpr("n_name AS operator", "n_nationkey")
        email = (
            "CASE n_nationkey % 3 WHEN 0 THEN concat('\"email\": [\"ops@', lower(operator), "
            "'.example\", \"\", \"ct@', lower(operator), '.example\"],') "
            "WHEN 1 THEN concat('\"email\": \"ops@', lower(operator), '.example\",') ELSE '' END"
        )
        return nation.join(logs, "operator", "left").selectExpr(
            "operator",
            f"concat('{{\"operators\": [{{\"name\": \"', operator, '\", ', {email}, "
            "' \"logs\": [', coalesce(classic, ''), '], \"tiled_logs\": [', coalesce(tiled, ''), ']}]}') AS value",
        )

    # --- embedded timestamps -------------------------------------------------------------

    def scts(self) -> DataFrame:
        """Distinct timestamps of a certificate."""
        return self.table("lineitem").selectExpr(
            "l_orderkey AS cert_id",
            "concat(CASE WHEN l_linenumber = 7 THEN 'other-' ELSE 'log-' END, l_suppkey) AS log_key",
            "l_suppkey",
            "unix_millis(cast(l_shipdate AS timestamp)) AS ms",
        ).distinct()

    def sct_lists(self) -> DataFrame:
        """``cert_id``, ``sct_list`` (serialized, in order of log key and time) and ``extension``."""
        one = self.scts().selectExpr(
            "cert_id", "log_key", "ms",
            "concat('00', sha2(cast(log_key AS binary), 256), lpad(hex(ms), 16, '0'), "
            "CASE WHEN l_suppkey % 3 = 0 THEN '0002abcd' ELSE '0000' END, "
            "CASE WHEN l_suppkey % 2 = 0 THEN '04' ELSE '05' END, '03', '0004', 'deadbeef') AS body",
        ).selectExpr("cert_id", "log_key", "ms", "concat(lpad(hex(length(body) div 2), 4, '0'), body) AS item")
        return (
            one.groupBy("cert_id")
            .agg(F.array_join(F.array_sort(F.collect_list(F.struct("log_key", "ms", "item")))["item"], "").alias("all"))
            .selectExpr(
                "cert_id",
                "unhex(concat(lpad(hex(length(all) div 2), 4, '0'), all)) AS sct_list",
                "CASE WHEN cert_id % 2 = 0 THEN 'precert_scts' ELSE 'embedded_scts' END AS extension",
            )
        )

    def torn_sct_lists(self) -> DataFrame:
        """Four in five lists broken or empty: wrong total, a short part ahead, cut by three bytes, no timestamp."""
        return self.sct_lists().selectExpr("cert_id", "hex(sct_list) AS h", "extension").selectExpr(
            "cert_id",
            "unhex(CASE cert_id % 5 WHEN 1 THEN concat('FFFF', substring(h, 5)) "
            "WHEN 2 THEN concat(lpad(hex(length(h) div 2 + 5), 4, '0'), '0005', '0102030405', substring(h, 5)) "
            "WHEN 3 THEN substring(h, 1, length(h) - 6) WHEN 4 THEN '0000' ELSE h END) AS sct_list",
            "extension",
        )

    # --- roots ---------------------------------------------------------------------------

    def log_roots(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "concat('https://log', l_suppkey, '.example') AS log_url",
            "cast(concat(CASE WHEN l_linenumber = 7 THEN 'alt-root-' ELSE 'root-' END, l_partkey) AS binary) AS der",
        ).distinct()

    def root_failures(self) -> DataFrame:
        """Why requests for roots failed; some logs failed once and answered later."""
        return self.table("supplier").where("s_suppkey % 4 <> 3").selectExpr(
            "CASE WHEN s_suppkey % 13 = 12 THEN '' ELSE concat('https://log', s_suppkey, '.example') END AS log_url",
            "concat('timed out after ', lpad(s_suppkey, 6, '0'), ' ', repeat('.', 90)) AS note",
        )

    def some_log_roots(self) -> DataFrame:
        """Roots of two logs in three; the others gave no answer."""
        return self.log_roots().where("cast(regexp_extract(log_url, 'log([0-9]+)', 1) AS bigint) % 3 <> 1")

    def subjects(self) -> DataFrame:
        return self.table("part").selectExpr(
            "sha2(cast(concat('root-', p_partkey) AS binary), 256) AS fingerprint",
            "p_name AS subject_cn", "p_brand AS subject_org",
        )

    # --- names -----------------------------------------------------------------------------

    def psl_rules(self) -> DataFrame:
        from checks.fixtures_sql import PSL_RULES

        values = ", ".join(f"('{r}', '{s}', '{k}')" for r, s, k in PSL_RULES)
        return self.spark.sql(f"SELECT * FROM VALUES {values} AS t(rule, section, kind)")

    def psl_text(self) -> DataFrame:
        """``pos`` and ``line`` of a list in the public format, with rules from the suppliers."""
        head = [
            (0, "// a list of suffixes"), (1, "arpa"), (2, "// ===BEGIN ICANN DOMAINS==="), (3, "com  // note"),
            (4, "CO.UK"), (5, ""), (6, ".cn"), (7, "*.ck"), (8, "!www.ck"), (9, "s0.hosting"),
            (10, "// ===END ICANN DOMAINS==="), (11, "// ===BEGIN PRIVATE DOMAINS==="),
        ]
        fixed = self.spark.createDataFrame(head, "pos bigint, line string")
        rows = self.table("supplier").selectExpr(
            "12 + s_suppkey AS pos",
            "concat(CASE s_suppkey % 3 WHEN 1 THEN '*.' WHEN 2 THEN '!x.' ELSE '' END, 's', s_suppkey, '.hosting') AS line",
        )
        return fixed.unionByName(rows)

    def dns_obs(self) -> DataFrame:
        return self.table("part").selectExpr(
            "concat('p', p_partkey, '.com') AS domain", "'A' AS rdtype",
            "CASE p_partkey % 4 WHEN 0 THEN 'NOERROR' WHEN 1 THEN 'NXDOMAIN' WHEN 2 THEN 'SERVFAIL' ELSE 'REFUSED' END AS rcode",
            "CASE WHEN p_partkey % 8 = 0 THEN array('QR', 'AD') ELSE array('QR') END AS flags",
            "p_partkey % 8 = 0 AS has_ad", "p_partkey % 12 = 0 AS has_rrsig",
        )

    # --- sessions, jobs, matches -----------------------------------------------------------

    def sessions(self) -> DataFrame:
        return self.table("supplier").selectExpr("s_suppkey div 4 AS id").distinct().selectExpr(
            "id", "'2026-01-01' AS interval_from", "'2026-06-30' AS interval_to",
            "100 + id AS target_count",
            "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'q' END AS query",
            "id % 2 = 0 AS nxdomain_mode",
            "CASE WHEN id % 2 = 0 THEN 'running' ELSE 'completed' END AS status",
            "'2026-01-01 00:00:00' AS created_at", "'2026-01-01 00:00:00' AS updated_at",
        )

    def jobs(self) -> DataFrame:
        return self.table("supplier").selectExpr("s_suppkey AS s").selectExpr(
            "s + 1 AS id", "concat('https://log', s % 4, '.example/') AS log_uri",
            "1000 + s AS tree_size_at_start", "900 + s AS next_end_index",
            "cast(100 AS bigint) AS target_count", "s % 50 AS matched_count",
            "CASE WHEN s % 3 = 0 THEN 'running' ELSE 'completed' END AS status",
            "CASE s % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'q2' ELSE 'q3' END AS query",
            "s % 2 = 0 AS nxdomain_mode",
            "CASE WHEN s % 5 <> 4 THEN s div 4 END AS session_id",
            "'2026-01-01 00:00:00' AS created_at", "'2026-01-02 00:00:00' AS updated_at",
        )

    def arrivals(self) -> DataFrame:
        """Matches as they come in, with repeats of (job, name)."""
        return self._arrivals().distinct()

    def _arrivals(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey AS id",
            "l_suppkey + 1 AS job_id", "l_orderkey AS log_index",
            "concat(CASE WHEN l_linenumber % 5 = 0 THEN '*.' ELSE '' END, 'p', l_partkey, '.com') AS domain",
            "concat('CA ', l_suppkey % 7) AS issuer_cn", "concat('Org ', l_suppkey % 5) AS issuer_org",
            "'2026-01-01 00:00:00 UTC' AS not_before", "'2026-12-31 00:00:00 UTC' AS not_after",
            "concat('r', l_partkey % 3) AS rule_name", "'2026-01-03 00:00:00' AS matched_at",
        )

    def matches(self) -> DataFrame:
        from certmill.operators.jobs import dedupe_matches

        # One row is kept of each (job, name), so repeated rows need no shuffle of their own before.
        return dedupe_matches(self._arrivals())
