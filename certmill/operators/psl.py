"""Public suffixes: rule matching and verdicts on names and certificates.

A rule table is small (ten thousand rules or so) and has few distinct depths.
For rows of names every depth is one left join of a name's last labels to the rules of
that depth. The names of certificates are judged inside their array: the rules are a
constant hash table, an array of buckets by the hash of a rule, in which each tail of a
name is looked up. No row is multiplied and none is shuffled. Rules beyond the bound of
a constant take the way of joins.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from certmill.functions import names as nm
from certmill.plans.joins import fits_broadcast, spread_join, with_kept
from certmill.schemas import NOT_AVAILABLE, UNKNOWN

# Verdict texts.
REASON_NOT_DNS = "not a DNS name"
REASON_NOT_FQDN = "not a FQDN"
REASON_IP = "IP address (BR DNS-name PSL rule does not apply)"
REASON_ICANN = "public suffix is in PSL ICANN DOMAINS"
REASON_PRIVATE = (
    "public suffix is in PSL PRIVATE DOMAINS (not an ICANN registry suffix; BR audit risk)"
)
REASON_UNKNOWN = "public suffix section unknown in cached PSL (unknown)"
EMPTY_NAME = "(empty)"

# What a plan may carry as a constant: the published list takes a tenth of it.
TABLE_RULES = 100_000
TABLE_BYTES = 8 << 20
_ENTRY = "struct<k:string,plain:string,wildcard:string,exception:string>"


def _by_depth(rules: DataFrame) -> DataFrame:
    """One row per rule text without its marker: the section of each kind of rule, and the depth."""
    def section(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("section"))).alias(kind)

    bare = F.when(F.col("kind") == "wildcard", F.substring("rule", 3, 2147483647)).otherwise(F.col("rule"))
    return (
        rules.withColumn("_key", bare)
        .groupBy("_key")
        .agg(section("plain"), section("wildcard"), section("exception"))
        .withColumn("_depth", nm.label_count(F.col("_key")))
    )


def _choice(host: Column, found: list[Column]) -> Column:
    """``labels`` and ``section`` of the winning rule; ``found`` are the rules of a host's tails of 1, 2 ... labels.

    Exceptions win and drop their first label; else the rule with most labels; else the last label.
    """
    def pick(section: Column, labels: int, also: Column | None = None) -> Column:
        held = section.isNotNull() if also is None else section.isNotNull() & also
        return F.when(held, F.struct(F.lit(labels).alias("labels"), section.alias("section")))

    depth = len(found)
    picks = [pick(found[d - 1]["exception"], d - 1) for d in range(depth, 0, -1)]
    for d in range(depth + 1, 0, -1):
        if d <= depth:
            picks.append(pick(found[d - 1]["plain"], d))
        if d > 1:
            picks.append(pick(found[d - 2]["wildcard"], d, nm.label_count(host) >= d))
    return F.coalesce(*picks, F.struct(F.lit(1).alias("labels"), F.lit(UNKNOWN).alias("section")))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@dataclass(frozen=True)
class SuffixTable:
    """Rules as constants of a plan: for each depth a JSON array of buckets by hash, and their number."""

    depths: tuple[tuple[str, int], ...]

    @staticmethod
    def _entry(host: Column, labels: int, text: str, buckets: int) -> Column:
        """The rules of a host's last labels, null without any; a shorter host equals no rule of that depth."""
        table = F.from_json(F.lit(text), f"array<array<{_ENTRY}>>")  # folded when the plan is made

        def held(tail: Column) -> Column:
            near = F.get(table, F.pmod(F.xxhash64(tail), F.lit(buckets)).cast("int"))
            return F.get(F.filter(near, lambda r: r["k"] == tail), F.lit(0))

        return _bound(F.call_function("substring_index", host, F.lit("."), F.lit(-labels)), held)

    def suffix(self, host: Column) -> Column:
        """``suffix`` and ``section`` of a canonical host."""
        def chosen(found: Column) -> Column:
            choice = _choice(host, [F.get(found, F.lit(d)) for d in range(len(self.depths))])
            return _bound(choice, lambda c: F.struct(
                F.call_function("substring_index", host, F.lit("."), -c["labels"]).alias("suffix"), c["section"].alias("section")
            ))

        return _bound(F.array(*[self._entry(host, d, *t) for d, t in enumerate(self.depths, 1)]), chosen)


def suffix_table(rules: DataFrame) -> SuffixTable | None:
    """The rules as constants; None where they are more than a plan should carry."""
    if not fits_broadcast(rules, max_rows=TABLE_RULES, max_bytes=TABLE_BYTES):
        return None
    keyed = _by_depth(rules).withColumn("_hash", F.xxhash64("_key")).collect()  # within the bound
    depths = []
    for depth in range(1, max((r["_depth"] for r in keyed), default=0) + 1):
        rows = [r for r in keyed if r["_depth"] == depth]
        table: list[list[dict]] = [[] for _ in range(1 << (2 * len(rows)).bit_length())]
        for r in rows:
            table[r["_hash"] % len(table)].append(
                {"k": r["_key"], "plain": r["plain"], "wildcard": r["wildcard"], "exception": r["exception"]}
            )
        depths.append((json.dumps(table, separators=(",", ":")), len(table)))
    return SuffixTable(tuple(depths))


def with_public_suffix(named: DataFrame, rules: DataFrame, name: str = "domain") -> DataFrame:
    """Add ``host``, ``kind``, ``public_suffix`` and ``psl_section``.

    Exceptions win and drop their first label; else the rule with most labels
    wins; else the last label is the suffix, of section ``unknown``. The
    section is that of the winning rule. Both columns are null for names that
    are not DNS names.
    """
    keyed = _by_depth(rules)
    depth = keyed.agg(F.max("_depth")).first()[0] or 0
    small = fits_broadcast(rules)
    host = F.col("host")
    out = named.withColumn("kind", nm.name_kind(F.col(name))).withColumn(
        "host", F.when(F.col("kind") == "dns_name", nm.canonical_host(F.col(name)))
    )
    # The tail of each depth, so that a join compares plain columns.
    out = out.withColumns({f"_t{d}": nm.last_labels(host, d) for d in range(1, depth + 1)})
    for d in range(1, depth + 1):
        side = keyed.where(F.col("_depth") == d).select(
            F.col("_key").alias(f"_t{d}"),
            F.struct("plain", "wildcard", "exception").alias(f"_r{d}"),
        )
        # One suffix may hold half of all names: beyond the bound the join spreads it.
        joined = out.join(F.broadcast(side), f"_t{d}", "left") if small else spread_join(out, side, [f"_t{d}"])
        out = joined.drop(f"_t{d}")

    found = [F.col(f"_r{d}") for d in range(1, depth + 1)]
    out = out.withColumn("_choice", F.when(F.col("kind") == "dns_name", _choice(host, found)))
    suffix = F.call_function("substring_index", host, F.lit("."), -F.col("_choice.labels"))
    return out.select(
        *named.columns, "kind", "host",
        F.when(F.col("kind") == "dns_name", suffix).alias("public_suffix"),
        F.col("_choice.section").alias("psl_section"),
    )


def _reason(raw: Column, kind: Column, section: Column) -> Column:
    return (
        F.when((raw == "") | F.startswith(raw, F.lit("__cert:")), F.lit(REASON_NOT_DNS))
        .when(kind == "invalid", F.lit(REASON_NOT_FQDN))
        .when(kind == "ip", F.lit(REASON_IP))
        .when(section == "icann", F.lit(REASON_ICANN))
        .when(section == "private", F.lit(REASON_PRIVATE))
        .otherwise(F.lit(REASON_UNKNOWN))
    )


def with_verdict(named: DataFrame, rules: DataFrame, name: str = "domain") -> DataFrame:
    """Add the six verdict columns: ``name``, ``kind``, ``public_suffix``, ``psl_section``, ``ok``, ``reason``.

    ``ok`` is true only in section ``icann``, and null for addresses and invalid names.
    """
    raw = nm.trimmed(F.col(name))
    kind, section = F.col("kind"), F.col("psl_section")
    return (
        with_public_suffix(named, rules, name)
        .withColumn("name", F.when(raw == "", F.lit(EMPTY_NAME)).otherwise(raw))
        .withColumn("ok", F.when(kind == "dns_name", section == "icann"))
        .withColumn("reason", _reason(raw, kind, section))
        .drop("host")
    )


def with_psl_columns(named: DataFrame, rules: DataFrame, name: str = "domain") -> DataFrame:
    """Add the columns that rule text may use: ``psl_public_suffix``, ``psl_section``, ``is_icann_domain``."""
    found = with_public_suffix(named, rules, name)
    return found.select(
        *named.columns,
        F.coalesce("public_suffix", F.lit("")).alias("psl_public_suffix"),
        F.coalesce("psl_section", F.lit("")).alias("psl_section"),
        F.coalesce(F.col("psl_section") == "icann", F.lit(False)).alias("is_icann_domain"),
    )


def _listed() -> Column:
    """The names of a certificate to check: its list, else its subject; null without either."""
    subject = F.when(
        F.col("subject_cn").isNotNull() & ~F.col("subject_cn").isin("", NOT_AVAILABLE),
        F.array("subject_cn"),
    )
    return F.when(F.size("san") > 0, F.col("san")).otherwise(subject)


def _checked_names(certs: DataFrame) -> DataFrame:
    """One row per certificate and name to check; a certificate without names keeps one null row."""
    return certs.select("log_uri", "log_index", F.posexplode_outer(_listed()).alias("pos", "domain"))


def _dns_section(table: SuffixTable, name: Column) -> Column:
    """The section of a DNS name's suffix, null for other names."""
    def section(x: Column) -> Column:
        return F.when(nm.kind_of(x["raw"], x["host"]) == "dns_name", table.suffix(x["host"])["section"])

    return _bound(_forms(name), section)


def _forms(name: Column) -> Column:
    return _bound(nm.trimmed(name), lambda raw: F.struct(raw.alias("raw"), nm.canonical_of(raw).alias("host")))


def _judged(table: SuffixTable, name: Column, pos: Column) -> Column:
    def verdict(x: Column) -> Column:
        raw, kind, found = x["raw"], x["kind"], x["found"]
        return F.struct(
            pos.alias("pos"), F.when(raw == "", F.lit(EMPTY_NAME)).otherwise(raw).alias("name"), kind.alias("kind"),
            found["suffix"].alias("public_suffix"), found["section"].alias("psl_section"),
            F.when(kind == "dns_name", found["section"] == "icann").alias("ok"),
            _reason(raw, kind, found["section"]).alias("reason"),
        )

    def facts(x: Column) -> Column:
        found = lambda k: F.struct(
            x["raw"].alias("raw"), k.alias("kind"), F.when(k == "dns_name", table.suffix(x["host"])).alias("found")
        )
        return _bound(_bound(nm.kind_of(x["raw"], x["host"]), found), verdict)

    return _bound(_forms(name), facts)


def cert_verdict(certs: DataFrame, rules: DataFrame) -> DataFrame:
    """Per certificate: ``dns_checked``, ``dns_failed``, ``all_ok`` and the verdicts of its names."""
    table = suffix_table(rules)
    if table is None:
        return _verdict_by_joins(certs, rules)
    # Names are judged once: a generator is not merged with what reads its column.
    verdicts = F.coalesce(F.transform(_listed(), lambda n, i: _judged(table, n, i)), F.expr(f"cast(array() as {_VERDICTS})"))
    judged = certs.select("log_uri", "log_index", verdicts.alias("domains"))
    bad = F.filter("domains", lambda d: (d["kind"] == "dns_name") & ~F.coalesce(d["ok"], F.lit(True)))
    out = judged.select(
        "log_uri", "log_index", F.size(F.filter("domains", lambda d: d["kind"] == "dns_name")).cast("bigint").alias("dns_checked"),
        F.size(bad).cast("bigint").alias("dns_failed"), "domains",
    )
    return out.select("log_uri", "log_index", "dns_checked", "dns_failed", (F.col("dns_failed") == 0).alias("all_ok"), "domains")


_VERDICTS = "array<struct<pos:int,name:string,kind:string,public_suffix:string,psl_section:string,ok:boolean,reason:string>>"


def _verdict_by_joins(certs: DataFrame, rules: DataFrame) -> DataFrame:
    judged = with_verdict(_checked_names(certs), rules)
    dns = (F.col("kind") == "dns_name") & F.col("pos").isNotNull()
    bad = dns & ~F.coalesce(F.col("ok"), F.lit(True))
    item = F.struct("pos", "name", "kind", "public_suffix", "psl_section", "ok", "reason")
    return judged.groupBy("log_uri", "log_index").agg(
        F.count_if(dns).alias("dns_checked"),
        F.count_if(bad).alias("dns_failed"),
        (F.count_if(bad) == 0).alias("all_ok"),
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), item))).alias("domains"),
    )


def require_icann(certs: DataFrame, rules: DataFrame) -> DataFrame:
    """Certificates whose every DNS name is under an ICANN suffix.

    A filter of the stage that reads the certificates; it stops at the first failing name.
    """
    table = suffix_table(rules)
    if table is None:
        return _require_by_joins(certs, rules)
    return certs.where(~F.coalesce(F.exists(_listed(), lambda n: F.coalesce(_dns_section(table, n) != "icann", F.lit(False))), F.lit(False)))


def _require_by_joins(certs: DataFrame, rules: DataFrame) -> DataFrame:
    """Only the keys of failing names are shuffled against the certificates."""
    judged = with_public_suffix(_checked_names(certs), rules)
    bad = (F.col("kind") == "dns_name") & (F.col("psl_section") != "icann")
    failing = with_kept(judged, "_bad", bad, lambda b: b).select("log_uri", "log_index").distinct()
    return certs.join(failing, ["log_uri", "log_index"], "left_anti")
