"""DNS observations joined to names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from certmill.functions import dns, names as nm
from certmill.plans.joins import lookup_join


def lookup_keys(named: DataFrame, rdtypes: list[str] | None = None, name: str = "domain") -> DataFrame:
    """Distinct (stripped name, record type) worth looking up."""
    types = F.array(*[F.lit(t) for t in (rdtypes or ["A"])])
    return (
        named.select(nm.strip_wildcard(F.col(name)).alias("domain"))
        .distinct()
        .select("domain", F.explode(types).alias("rdtype"))
    )


def enrich(named: DataFrame, observations: DataFrame, rdtype: str = "A", name: str = "domain") -> DataFrame:
    """Add ``rcode``, ``flags``, ``has_ad``, ``has_rrsig`` of each name; ``UNKNOWN`` when not observed.

    Observations have one row per (domain, rdtype). A table beyond the
    broadcast bound is joined salted, so a name in a third of all
    certificates is spread over many tasks.
    """
    facts = observations.where(F.col("rdtype") == rdtype).select(
        F.col("domain").alias("_clean"), "rcode", "flags", "has_ad", "has_rrsig"
    )
    joined = lookup_join(
        named.withColumn("_clean", nm.strip_wildcard(F.col(name))), facts, "_clean", "left"
    )
    return joined.select(
        *named.columns,
        F.coalesce("rcode", F.lit("UNKNOWN")).alias("rcode"),
        F.coalesce("flags", F.array().cast("array<string>")).alias("flags"),
        F.coalesce("has_ad", F.lit(False)).alias("has_ad"),
        F.coalesce("has_rrsig", F.lit(False)).alias("has_rrsig"),
    )


def with_dns_columns(named: DataFrame, observations: DataFrame, rdtype: str = "A") -> DataFrame:
    """Add the columns that rule text may use, from ``dns_status`` to ``is_dnssec_insecure``."""
    found = enrich(named, observations, rdtype)
    rcode, ad, rrsig = F.col("rcode"), F.col("has_ad"), F.col("has_rrsig")
    return found.select(
        *named.columns,
        F.struct("rcode", "flags", "has_ad", "has_rrsig").alias("dns_info"),
        rcode.alias("dns_status"),
        dns.rcode_number(rcode).alias("dns_rcode"),
        F.col("flags").alias("dns_flags"),
        dns.exists(rcode).alias("dns_exists"),
        dns.is_nxdomain(rcode).alias("is_nxdomain"),
        dns.is_dnssec_secure(rcode, ad, rrsig).alias("is_dnssec_secure"),
        dns.is_dnssec_insecure(rcode, ad, rrsig).alias("is_dnssec_insecure"),
    )


def nxdomain_only(named: DataFrame, observations: DataFrame) -> DataFrame:
    """Names observed as NXDOMAIN, reported without wildcard.

    Only the NXDOMAIN observations take part in the join.
    """
    gone = observations.where(
        (F.col("rcode") == "NXDOMAIN") & (F.col("rdtype") == "A")
    ).select(F.col("domain").alias("_clean"))
    kept = lookup_join(
        named.withColumn("_clean", nm.strip_wildcard(F.col("domain"))), gone, "_clean", "left_semi"
    )
    return kept.withColumn("domain", F.col("_clean")).select(*named.columns)
