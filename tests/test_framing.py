import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from certmill.functions import framing as fr
from certmill.operators import entries as en, scan


def leaf(ms=1720000000000, kind=0, body=b"\x30\x03\x01\x02\x03", version=0, size=None):
    out = bytes([version, 0]) + ms.to_bytes(8, "big") + kind.to_bytes(2, "big")
    if kind == 0:
        out += (len(body) if size is None else size).to_bytes(3, "big") + body
    return out


def chain(body, size=None):
    return (len(body) if size is None else size).to_bytes(3, "big") + body


def b64(data):
    return base64.b64encode(data).decode()


CASES = [
    (leaf(), b"", b"\x30\x03\x01\x02\x03", None),
    (leaf(kind=1), chain(b"\x30\x03\xaa\xbb\xcc") + b"rest", b"\x30\x03\xaa\xbb\xcc", None),
    (b"\x00\x00", b"", None, "leaf_too_short"),
    (leaf(version=1), b"", None, "unsupported_header"),
    (leaf(kind=7), b"", None, "unknown_entry_type"),
    (leaf(size=99), b"", None, "length_exceeds_buffer"),
    (leaf(kind=1), b"", None, "missing_extra_data"),
    (leaf(kind=1), b"\x00\x00", None, "extra_data_too_short"),
    (leaf(kind=1), chain(b"xy", 3), None, "length_exceeds_buffer"),
    (leaf()[:13], b"", None, "leaf_too_short"),
    (leaf(body=b""), b"", b"", None),
]


@pytest.fixture(scope="module")
def decoded(spark):
    rows = [(i, {"leaf_input": b64(a), "extra_data": b64(b)}) for i, (a, b, _, _) in enumerate(CASES)]
    rows.append((len(CASES), {"leaf_input": "@@@", "extra_data": ""}))
    df = spark.createDataFrame(rows, "index bigint, entry struct<leaf_input: string, extra_data: string>")
    return {r["index"]: r for r in en.decode_entries(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_entry_certificate(decoded, i):
    _, _, der, error = CASES[i]
    assert decoded[i]["error"] == error
    assert (None if decoded[i]["der"] is None else bytes(decoded[i]["der"])) == der


def test_broken_base64_is_reported(decoded):
    assert decoded[len(CASES)]["error"] == "bad_base64"


def test_timestamp(decoded):
    assert decoded[0]["timestamp_ms"] == 1720000000000
    assert decoded[0]["timestamp_utc"] == "2024-07-03T09:46:40+00:00"
    assert decoded[2]["timestamp_ms"] is None


def test_timestamp_fraction_and_range(spark):
    df = spark.createDataFrame([(1720000000120,), (2**62,), (0,)], "ms bigint")
    got = [r[0] for r in df.select(fr.millis_to_iso(F.col("ms"))).collect()]
    assert got == ["2024-07-03T09:46:40.120000+00:00", None, "1970-01-01T00:00:00+00:00"]


def test_x509_helper_refuses_precert(spark):
    df = spark.createDataFrame([(leaf(kind=1),)], "leaf binary")
    row = df.select(fr.x509_der(F.col("leaf")), fr.x509_error(F.col("leaf"))).first()
    assert tuple(row) == (None, "not_x509_entry")


def test_fingerprint_text(spark):
    df = spark.createDataFrame([("AA:BB:cc",)], "t string")
    row = df.select(fr.normalize_fingerprint(F.col("t")), fr.is_sha256_hex(F.col("t"))).first()
    assert tuple(row) == ("aabbcc", False)


@pytest.mark.parametrize("size", [0, 1, 47, 48, 49, 300])
def test_pem_round_trip(spark, size):
    data = bytes(i % 256 for i in range(size))
    df = spark.createDataFrame([(data,)], "d binary")
    text, back = df.select(fr.pem(F.col("d")).alias("p"), "d").select(
        "p", fr.pem_to_der(F.col("p").cast("binary"))
    ).first()
    body = text.splitlines()
    assert body[0] == "-----BEGIN CERTIFICATE-----" and body[-1] == "-----END CERTIFICATE-----"
    assert all(len(line) == 64 for line in body[1:-2])
    assert base64.b64decode("".join(body[1:-1])) == data
    if size:
        assert bytes(back) == data


def test_first_certificate_of_a_pem_counts(spark):
    one, two = (f"-----BEGIN CERTIFICATE-----\n{b64(x)}\n-----END CERTIFICATE-----\n" for x in (b"one", b"two"))
    df = spark.createDataFrame([(("text\n" + one + two).encode(),), (b"\x30\x82\x01",)], "d binary")
    got = [bytes(r[0]) for r in df.select(fr.pem_to_der(F.col("d"))).collect()]
    assert got == [b"one", b"\x30\x82\x01"]


def sct(log_id, ms, ext=b"", algorithm=4):
    return (b"\x00" + log_id + ms.to_bytes(8, "big") + len(ext).to_bytes(2, "big") + ext
            + bytes([algorithm, 3]) + b"\x00\x04sign")


def sct_list(items):
    body = b"".join(len(i).to_bytes(2, "big") + i for i in items)
    return len(body).to_bytes(2, "big") + body


def test_sct_walk(spark):
    from certmill.operators.scts import explode_scts

    ids = [hashlib.sha256(bytes([i])).digest() for i in range(5)]
    whole = sct_list([sct(d, 1_700_000_000_000 + i, b"x" * i, 4 + i % 3) for i, d in enumerate(ids)])
    df = spark.createDataFrame(
        [("a", whole, "precert_scts"), ("cut", whole[:-3], "precert_scts"), ("none", b"\x00\x00", "embedded_scts")],
        "cert_id string, sct_list binary, extension string",
    )
    rows = explode_scts(df).orderBy("cert_id", "ordinal").collect()
    a = [r for r in rows if r["cert_id"] == "a"]
    assert [r["log_id_b64"] for r in a] == [b64(d) for d in ids]
    assert [r["timestamp_ms"] for r in a] == [1_700_000_000_000 + i for i in range(5)]
    assert [r["hash_algorithm"] for r in a] == ["sha256", "sha384", "sha512", "sha256", "sha384"]
    assert [r["ordinal"] for r in a] == [1, 2, 3, 4, 5]
    assert a[0]["timestamp"] == "2023-11-14 22:13:20 UTC"
    # A list cut short keeps the timestamps that are whole.
    assert len([r for r in rows if r["cert_id"] == "cut"]) == 4
    assert not [r for r in rows if r["cert_id"] == "none"]


def test_entry_ranges(spark):
    got = [tuple(r) for r in scan.log_ranges(2, 5, 2, spark).orderBy("batch_start").collect()]
    assert got == [(2, 3), (4, 5)]
    assert [tuple(r) for r in scan.log_ranges(0, 0, 10, spark).collect()] == [(0, 0)]
    for args in [(0, 5, 0), (-1, 5, 2), (5, 4, 2)]:
        with pytest.raises(ValueError):
            scan.log_ranges(*args, spark)


def test_index_slice_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS index").write.parquet(str(tmp_path / "e"))
    df = en.index_slice(spark.read.parquet(str(tmp_path / "e")), 2, 5)
    assert sorted(r[0] for r in df.collect()) == [2, 3, 4, 5]
    with pytest.raises(ValueError):
        en.index_slice(df, 5, 4)


def test_decode_audit(spark):
    rows = [("https://a.example/", i, None if i % 5 else "bad_base64") for i in range(23)]
    decoded = spark.createDataFrame(rows, "log_uri string, index bigint, error string")
    sizes = spark.createDataFrame([("https://a.example/", 23)], "log_uri string, tree_size bigint")
    got = en.decode_audit(decoded, sizes, 10).orderBy("scan_batch").collect()
    assert [(r["received"], r["parsed"], r["unparsed"], r["total_parsed"]) for r in got] == [
        (10, 8, 2, 8), (10, 8, 2, 16), (3, 2, 1, 18)
    ]
    assert [r["position_pct"] for r in got] == [13 / 23 * 100.0, 3 / 23 * 100.0, 0.0]
