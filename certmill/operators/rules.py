"""Predicates and named rules, written as Spark SQL text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from certmill.functions import names as nm
from certmill.functions.registry import register_functions

# Names of the hits that no named rule decides.
QUERY_RULE = "query"
EMPTY_SET = "default"
NO_RULES = "all"
UNNAMED = "unnamed"

# Names that hits may be filtered by in call form, ``f(domain)``, and the joined columns they stand for.
_FACTS = {c: c for c in (
    "dns_status", "dns_rcode", "dns_flags", "dns_exists", "is_nxdomain", "is_dnssec_secure", "is_dnssec_insecure",
    "psl_public_suffix", "psl_section", "is_icann_domain",
)} | {"is_br_icann_psl_domain": "is_icann_domain"}
_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`")
_INNERMOST = re.compile(r"(\b\w+)?(\s*)\(([^()]*)\)")
_HELD = re.compile("\x01([0-9]+)\x02")


def predicate_text(text: str) -> str:
    """The predicate without a leading ``WHERE``, with known calls under built-in names.

    ``matches``, ``strip_wildcard`` and ``dns_has_flag`` become Spark's own functions,
    which also work inside arrays, where a SQL function does not, whatever expressions
    they are called with; facts in call form, such as ``is_nxdomain(domain)``, become the
    joined columns. Quoted text is left alone.
    """
    held: list[str] = []

    def hold(code: str) -> str:
        held.append(code)
        return f"\x01{len(held) - 1}\x02"

    code = re.sub(r"^\s*where\s+", "", text, flags=re.IGNORECASE).strip()
    code = _QUOTED.sub(lambda m: hold(m[0]), code)
    # Calls are replaced from the inside out; a finished one is held under its number.
    while m := _INNERMOST.search(code):
        code = code[: m.start()] + hold(_plain_call(m)) + code[m.end():]
    while m := _HELD.search(code):
        code = code[: m.start()] + held[int(m[1])] + code[m.end():]
    return code


def _plain_call(call: re.Match) -> str:
    """One call without further parentheses, under a built-in name."""
    name, inside = (call[1] or "").lower(), call[3]
    if name in _FACTS and inside.strip().lower() == "domain":
        return _FACTS[name]
    if name == "matches":
        return f"regexp_like({inside})"
    if name == "strip_wildcard" and "," not in inside:
        return f"regexp_replace({inside.strip()}, '^[*][.]', '')"
    if name == "dns_has_flag" and inside.count(",") == 1:
        flags, flag = (part.strip() for part in inside.split(","))
        return f"array_contains(split(lower(array_join({flags}, ' ')), ' '), lower({flag}))"
    return call[0]


def predicate(text: str) -> Column:
    return F.expr(predicate_text(text))


def where_certs(df: DataFrame, text: str) -> DataFrame:
    """Rows for which the Spark SQL predicate holds."""
    register_functions(df.sparkSession)
    return df.where(predicate(text))


def expand_names(certs: DataFrame) -> DataFrame:
    """One row per certificate and name: ``pos``, ``domain``, and ``domains`` beside ``san``."""
    return certs.select("*", F.col("san").alias("domains"), F.posexplode("san").alias("pos", "domain"))


def rule_list(rules: DataFrame) -> list[tuple[str, str]]:
    """The rules of a rule table in file order; they are a setting that people write, read to the driver whole."""
    rows = rules.orderBy("pos").select("name", "filter").collect()
    return [(r["name"], r["filter"]) for r in rows]


def combine(query: str | None, rules: list[tuple[str, str]] | None) -> list[tuple[str, str]] | None:
    """The ad-hoc query first, then the named rules; None when neither is given."""
    if query is None and rules is None:
        return None
    head = [(QUERY_RULE, query)] if query else []
    return head + list(rules or [])


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rule_sql(rules: list[tuple[str, str]] | None) -> str:
    """SQL text that names the first true rule, null when none is true."""
    if rules is None:
        return _quote(NO_RULES)
    if not rules:
        return _quote(EMPTY_SET)
    arms = " ".join(f"WHEN ({predicate_text(text)}) THEN {_quote(name)}" for name, text in rules)
    return f"CASE {arms} END"


def rule_column(rules: list[tuple[str, str]] | None) -> Column:
    return F.expr(rule_sql(rules))


def first_rule(named: DataFrame, rules: list[tuple[str, str]] | None) -> DataFrame:
    """Rows of (certificate, name) with ``rule_name``, the first true rule; the others are dropped."""
    register_functions(named.sparkSession)
    return named.withColumn("rule_name", rule_column(rules)).where(F.col("rule_name").isNotNull())


def clean_names(named: DataFrame) -> DataFrame:
    return named.withColumn("clean", nm.strip_wildcard(F.col("domain")))
