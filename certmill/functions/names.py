"""Column expressions over host names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# An IPv4 literal without leading zeros, and its octet.
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = f"({_OCTET}\\.){{3}}{_OCTET}"


# White space that is cut from both ends of a name.
BLANKS = " \t\n\r\x0b\x0c"


def trimmed(name: Column) -> Column:
    return F.trim(F.coalesce(name, F.lit("")), F.lit(BLANKS))


def strip_wildcard(name: Column) -> Column:
    """The name without one leading ``*.``."""
    return F.when(F.startswith(name, F.lit("*.")), F.substring(name, 3, 2147483647)).otherwise(name)


def canonical_host(name: Column) -> Column:
    """Trimmed, without wildcard labels, lower case, no trailing dots."""
    return canonical_of(trimmed(name))


def canonical_of(raw: Column) -> Column:
    """The canonical form of a trimmed name, without up to two wildcard labels."""
    first = F.when(F.startswith(raw, F.lit("*.*.")), 5).when(F.startswith(raw, F.lit("*.")), 3).otherwise(1)
    return F.rtrim(F.lower(F.substring(raw, first, F.lit(2147483647))), F.lit("."))


def _is_ip(host: Column) -> Column:
    """An IPv4 literal, or an IPv6 literal that ends in one (only those contain a dot)."""
    groups = F.size(
        F.filter(F.split(F.regexp_replace(host, f":{IPV4}$", ""), ":"), lambda g: g != "")
    )
    long_form = host.rlike(f"^([0-9a-f]{{1,4}}:){{6}}{IPV4}$")
    short_form = (
        host.rlike(f"^(?=[0-9a-f:]*::)(?!.*::.*::)(?!.*:::)(?!:[^:])[0-9a-f:]*:{IPV4}$")
        & ~host.rlike("[0-9a-f]{5,}")
        & (groups <= 5)
    )
    # Few names end in a digit, so few reach a pattern.
    return F.right(host, F.lit(1)).between("0", "9") & (
        host.rlike(f"^{IPV4}$") | (F.contains(host, F.lit(":")) & (long_form | short_form))
    )


def name_kind(name: Column) -> Column:
    """``invalid``, ``ip`` or ``dns_name``."""
    return kind_of(trimmed(name), canonical_host(name))


def kind_of(raw: Column, host: Column) -> Column:
    """The kind of a name that is trimmed as ``raw`` and canonical as ``host``."""
    return (
        F.when((raw == "") | F.startswith(raw, F.lit("__cert:")), F.lit("invalid"))
        .when(~F.contains(host, F.lit(".")), F.lit("invalid"))
        .when(_is_ip(host), F.lit("ip"))
        .otherwise(F.lit("dns_name"))
    )


def label_count(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def last_labels(host: Column, count: int) -> Column:
    """The last ``count`` labels, null when the host has fewer."""
    return F.when(label_count(host) >= count, F.substring_index(host, ".", -count))
