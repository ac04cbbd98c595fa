"""Rows that used to be lost, cut or doubled silently."""

import struct

import pytest

from certmill.functions import framing as fr
from certmill.operators import entries as en, rules as rl, scan, scts
from certmill.plans import audits as pl
from certmill.sinks import files as sk
from pyspark.sql import functions as F


def sizes_of(spark, *rows):
    return spark.createDataFrame(list(rows), "log_uri string, tree_size bigint")


def test_entries_without_fields_have_a_row(spark):
    decoded = spark.createDataFrame([(1, 5, "t", b"aa", None), (2, 6, "t", b"bb", None), (3, 7, "t", None, "bad")],
                                    "index bigint, timestamp_ms bigint, timestamp_utc string, der binary, error string")
    fields = spark.createDataFrame([("CA", "O", "S", "N/A", "2024", "2025", ["x.com"], b"aa")],
                                   "issuer_cn string, issuer_org string, subject_cn string, subject_org string, not_before string, not_after string, san array<string>, der binary")
    fields = fields.withColumn("fingerprint", fr.fingerprint(F.col("der")))
    got = {r["index"]: r for r in en.parsed_rows(decoded, fields).collect()}
    assert set(got) == {1, 2} and got[1].domain == "x.com" and got[1].fields_known
    assert (got[2].issuer_cn, got[2].san, got[2].domain, got[2].fields_known) == ("N/A", [], "", False)
    assert [r["index"] for r in en.parsed_first(decoded, fields, 1).collect()] == [1]


def test_equal_indices_of_two_logs_are_two_files(spark, tmp_path):
    rows = [("https://a.example/", 1, b"x"), ("https://b.example/x/", 1, b"y"), ("https://a.example/", 2, b"p"), ("https://a.example/", 2, b"q")]
    hits = spark.createDataFrame(rows, "log_uri string, log_index bigint, der binary")
    out = {r.file_name: r.outcome for r in sk.write_cert_files(hits, str(tmp_path / "c"), "der").collect()}
    assert out == {"a.example-1.der": "written", "b.example_x-1.der": "written", "a.example-2.der": "conflict"}
    assert (tmp_path / "c" / "b.example_x-1.der").read_bytes() == b"y"


def sct(n):
    return struct.pack(">H", n) + b"s" * n


def test_broken_timestamp_lists_are_named_and_walked_to_the_end(spark):
    whole = lambda body: struct.pack(">H", len(body)) + body
    lists = [whole(sct(50) + sct(50)), whole(sct(50) + sct(5) + sct(50)), struct.pack(">H", 255) + sct(50), whole(sct(50) + struct.pack(">H", 90)), whole(b""), None]
    df = spark.createDataFrame([(i, b, "ext") for i, b in enumerate(lists)], "cert_id bigint, sct_list binary, extension string")
    got = [(r.n, r.e) for r in df.select(F.size(fr.split_scts(F.col("sct_list"))).alias("n"), fr.sct_list_error(F.col("sct_list")).alias("e")).collect()]
    assert got[:5] == [(2, None), (2, "bad_length"), (1, "length_mismatch"), (1, "bad_length"), (0, None)] and got[5][1] is None
    assert {r.cert_id: r.error for r in scts.broken_lists(df).collect()} == {1: "bad_length", 2: "length_mismatch", 3: "bad_length"}


def test_timestamps_behind_a_short_part_keep_their_ordinal(spark):
    body = sct(50) + sct(5) + sct(0) + sct(60)
    df = spark.createDataFrame([(1, struct.pack(">H", len(body)) + body, "ext")], "cert_id bigint, sct_list binary, extension string")
    rows = scts.explode_scts(df).collect()
    assert sorted(r.ordinal for r in rows) == [1, 4]
    # Their bytes say an instant that no calendar holds; it must not end the job.
    assert {(r.timestamp, r.timestamp_ms > 10**17) for r in rows} == {("", True)}


def test_certificates_without_timestamps_are_summed_to_zero(spark):
    looked = spark.createDataFrame([(1, True), (1, False)], "cert_id bigint, matched boolean")
    certs = spark.createDataFrame([(1,), (2,)], "cert_id bigint")
    assert sorted(tuple(r) for r in scts.sct_summary(looked, certs).collect()) == [(1, 2, 1, 1), (2, 0, 0, 0)]


def test_rows_outside_the_tree_are_counted(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("a", 6), ("b", 0)], "log_uri string, log_index bigint")
    got = {tuple(r) for r in scan.outside_tree(rows, sizes_of(spark, ("a", 5))).collect()}
    assert got == {("a", 2, 0), ("b", 0, 1)}


@pytest.mark.parametrize("target", [None, 100])
def test_logs_without_ranks_and_repeated_entries_hit_once(spark, make_certs, target):
    a = make_certs([["a.test"], ["b.test"]], log_uri="https://a.example/")
    b = make_certs([["c.test"], ["d.test"]], log_uri="https://b.example/")
    certs = a.union(b).union(a)
    sizes = sizes_of(spark, ("https://a.example/", 2), ("https://b.example/", 2))
    hits = pl.scan_logs(certs, sizes, pl.ScanOptions(query="domain LIKE '%.test'", target=target)).collect()
    assert sorted(r["domain"] for r in hits) == ["a.test", "b.test", "c.test", "d.test"]
    assert len({r["ord"] for r in hits}) == 4


def test_calls_of_facts_and_functions_in_rules(spark, make_certs):
    text = "is_nxdomain(domain) = true AND PSL_SECTION( domain ) = 'is_nxdomain(domain)' OR is_br_icann_psl_domain(domain)"
    assert rl.predicate_text(text) == "is_nxdomain = true AND psl_section = 'is_nxdomain(domain)' OR is_icann_domain"
    certs = make_certs([["*.a.test", "b.test"]])
    opts = pl.ScanOptions(query="strip_wildcard(domain) = 'a.test'", target=None)
    hits = pl.scan_logs(certs, sizes_of(spark, ("https://a.example/", 1)), opts).collect()
    assert [r["domain"] for r in hits] == ["*.a.test"]


def test_names_are_cut_at_any_white_space(spark):
    from certmill.functions import names

    df = spark.createDataFrame([("\t*.A.Example.\r\n",)], "n string")
    assert df.select(names.canonical_host(F.col("n"))).first()[0] == "a.example"
