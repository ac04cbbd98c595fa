"""Column expressions over DNS observations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Response code numbers.
RCODES = {
    "NOERROR": 0, "FORMERR": 1, "SERVFAIL": 2, "NXDOMAIN": 3,
    "NOTIMP": 4, "REFUSED": 5, "UNKNOWN": -1,
}


def rcode_number(rcode: Column) -> Column:
    out = F.when(F.lit(False), F.lit(-1))
    for name, number in RCODES.items():
        out = out.when(rcode == name, F.lit(number))
    return out.otherwise(F.lit(-1))


def has_flag(flags: Column, flag: str | Column) -> Column:
    """Case-insensitive membership."""
    wanted = F.lower(F.lit(flag) if isinstance(flag, str) else flag)
    return F.exists(flags, lambda f: F.lower(f) == wanted)


def exists(rcode: Column) -> Column:
    return rcode == "NOERROR"


def is_nxdomain(rcode: Column) -> Column:
    return rcode == "NXDOMAIN"


def is_dnssec_secure(rcode: Column, has_ad: Column, has_rrsig: Column) -> Column:
    return exists(rcode) & (has_ad | has_rrsig)


def is_dnssec_insecure(rcode: Column, has_ad: Column, has_rrsig: Column) -> Column:
    return exists(rcode) & ~(has_ad | has_rrsig)
