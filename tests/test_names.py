import ipaddress

import pytest
from pyspark.sql import functions as F

from certmill.functions import dns, names as nm
from certmill.operators import dnsobs, psl, rules as rl
from certmill.sources.psl import read_psl_rules

LIST = """// short list
arpa
// ===BEGIN ICANN DOMAINS===
com
CO.UK trailing text
uk
org

*.ck
!www.ck
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
blogspot.com
.github.io
com.example
com.example
"""


@pytest.fixture(scope="module")
def psl_rules(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("psl") / "list.dat"
    path.write_text(LIST)
    return read_psl_rules(spark, str(path)).cache()


def test_list_is_parsed(psl_rules):
    got = {r["rule"]: (r["section"], r["kind"]) for r in psl_rules.collect()}
    assert got == {
        "arpa": ("unknown", "plain"), "com": ("icann", "plain"), "co.uk": ("icann", "plain"),
        "uk": ("icann", "plain"), "org": ("icann", "plain"), "*.ck": ("icann", "wildcard"),
        "www.ck": ("icann", "exception"), "blogspot.com": ("private", "plain"),
        "github.io": ("private", "plain"), "com.example": ("private", "plain"),
    }


CASES = {
    "www.example.com": ("dns_name", "com", "icann", True),
    "foo.blogspot.com": ("dns_name", "blogspot.com", "private", False),
    "blogspot.com": ("dns_name", "blogspot.com", "private", False),
    "myapp.github.io": ("dns_name", "github.io", "private", False),
    "www.example.co.uk": ("dns_name", "co.uk", "icann", True),
    "*.example.com": ("dns_name", "com", "icann", True),
    "*.*.Example.COM.": ("dns_name", "com", "icann", True),
    "  a.org ": ("dns_name", "org", "icann", True),
    "a.b.c.ck": ("dns_name", "c.ck", "icann", True),
    "b.ck": ("dns_name", "b.ck", "icann", True),
    "a.www.ck": ("dns_name", "ck", "icann", True),
    "x.nowhere": ("dns_name", "nowhere", "unknown", False),
    "x.arpa": ("dns_name", "arpa", "unknown", False),
    "notexample.com.": ("dns_name", "com", "icann", True),
    "192.0.2.1": ("ip", None, None, None),
    "::ffff:192.0.2.1": ("ip", None, None, None),
    "localhost": ("invalid", None, None, None),
    "2001:db8::1": ("invalid", None, None, None),
    "__cert:7__": ("invalid", None, None, None),
    "": ("invalid", None, None, None),
}


def test_verdicts(spark, psl_rules):
    named = spark.createDataFrame([(n,) for n in CASES], "domain string")
    got = {r["domain"]: (r["kind"], r["public_suffix"], r["psl_section"], r["ok"])
           for r in psl.with_verdict(named, psl_rules).collect()}
    assert got == CASES


def test_reasons(spark, psl_rules):
    named = spark.createDataFrame([("",), ("localhost",), ("192.0.2.1",), ("a.com",)], "domain string")
    rows = {r["domain"]: r for r in psl.with_verdict(named, psl_rules).collect()}
    assert rows[""]["name"] == "(empty)" and rows[""]["reason"] == "not a DNS name"
    assert rows["localhost"]["reason"] == "not a FQDN"
    assert rows["192.0.2.1"]["reason"].startswith("IP address")
    assert rows["a.com"]["reason"] == "public suffix is in PSL ICANN DOMAINS"


def test_both_ways_of_joining_rules_agree(spark, psl_rules, monkeypatch):
    named = spark.createDataFrame([(n,) for n in CASES], "domain string")
    small = sorted(map(str, psl.with_public_suffix(named, psl_rules).collect()))
    monkeypatch.setattr(psl, "fits_broadcast", lambda *a: False)
    assert sorted(map(str, psl.with_public_suffix(named, psl_rules).collect())) == small


def test_addresses_are_told_as_python_tells_them(spark):
    names = [
        "1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "1.2.3.4.5", "0.0.0.0", "255.255.255.255",
        "::1.2.3.4", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "1::2:1.2.3.4",
        "1::2::3:1.2.3.4", ":1:1.2.3.4", "12345::1.2.3.4", "1:2:3:4:5::1.2.3.4", "1:2:3:4:5:6::1.2.3.4",
        "g::1.2.3.4", ":::1.2.3.4", "a.b", "fe80::1.2.3.4",
    ]

    def is_ip(n):
        try:
            ipaddress.ip_address(n)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: r["k"] == "ip" for r in df.select("n", nm.name_kind(F.col("n")).alias("k")).collect()}
    assert got == {n: is_ip(n) for n in names}


def test_certificate_roll_up(make_certs, psl_rules):
    certs = make_certs([["www.example.com", "foo.blogspot.com"], ["a.example.com", "b.example.org"], ["192.0.2.1"], []])
    rows = {r["log_index"]: r for r in psl.cert_verdict(certs, psl_rules).collect()}
    assert [(rows[i]["all_ok"], rows[i]["dns_checked"], rows[i]["dns_failed"]) for i in range(4)] == [
        (False, 2, 1), (True, 2, 0), (True, 0, 0), (True, 0, 0)
    ]
    assert [d["name"] for d in rows[0]["domains"]] == ["www.example.com", "foo.blogspot.com"]
    assert rows[3]["domains"] == []
    kept = {r["log_index"] for r in psl.require_icann(certs, psl_rules).collect()}
    assert kept == {1, 2, 3}


def test_subject_is_checked_when_san_is_empty(make_certs, psl_rules):
    row = psl.cert_verdict(make_certs([[]], subject_cn="x.github.io"), psl_rules).first()
    assert (row["all_ok"], row["dns_failed"]) == (False, 1)


@pytest.fixture(scope="module")
def observations(spark):
    return spark.createDataFrame(
        [("a.com", "A", "NOERROR", ["QR", "AD"], True, False), ("b.com", "A", "NXDOMAIN", ["QR"], False, False),
         ("c.com", "A", "NOERROR", ["QR"], False, False), ("a.com", "AAAA", "SERVFAIL", [], False, False)],
        "domain string, rdtype string, rcode string, flags array<string>, has_ad boolean, has_rrsig boolean",
    )


def test_dns_columns(make_certs, observations):
    named = rl.expand_names(make_certs([["*.a.com", "b.com"], ["c.com", "d.com"]]))
    got = {r["domain"]: r for r in dnsobs.with_dns_columns(named, observations).collect()}
    assert [(got[d]["dns_status"], got[d]["dns_rcode"]) for d in ("*.a.com", "b.com", "c.com", "d.com")] == [
        ("NOERROR", 0), ("NXDOMAIN", 3), ("NOERROR", 0), ("UNKNOWN", -1)
    ]
    assert got["*.a.com"]["is_dnssec_secure"] and got["c.com"]["is_dnssec_insecure"]
    assert not got["d.com"]["dns_exists"] and not got["d.com"]["is_dnssec_insecure"]
    assert got["d.com"]["dns_flags"] == []
    wide = dnsobs.with_dns_columns(named, observations)
    flagged = rl.where_certs(wide, "dns_has_flag(dns_flags, 'ad') AND dns_info.has_ad")
    assert [r["domain"] for r in flagged.collect()] == ["*.a.com"]


def test_only_nxdomain_names(make_certs, observations):
    named = rl.expand_names(make_certs([["*.b.com", "a.com"], ["b.com"]]))
    got = [(r["log_index"], r["domain"]) for r in dnsobs.nxdomain_only(named, observations).orderBy("log_index").collect()]
    assert got == [(0, "b.com"), (1, "b.com")]


def test_lookup_keys_are_distinct(make_certs):
    named = rl.expand_names(make_certs([["*.b.com", "b.com"], ["b.com"]]))
    assert sorted(tuple(r) for r in dnsobs.lookup_keys(named, ["A", "AAAA"]).collect()) == [("b.com", "A"), ("b.com", "AAAA")]


def test_response_codes(spark):
    df = spark.createDataFrame([(r,) for r in ("NOERROR", "REFUSED", "UNKNOWN", "YXDOMAIN")], "r string")
    assert [r[0] for r in df.select(dns.rcode_number(F.col("r"))).collect()] == [0, 5, -1, -1]
