"""Steps whose cost a row must not pay several times."""

import random
import struct

from pyspark.sql import functions as F

from certmill.functions import framing as fr
from certmill.operators import scts


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def error_of(blob):
    """Plain walk over a timestamp list."""
    if blob is None:
        return None
    if len(blob) < 2 or struct.unpack(">H", blob[:2])[0] != len(blob) - 2:
        return "length_mismatch"
    at, short = 2, False
    while at + 2 <= len(blob):
        size = struct.unpack(">H", blob[at : at + 2])[0]
        if at + 2 + size > len(blob):
            break
        at, short = at + 2 + size, short or size < 47
    return "bad_length" if short or at != len(blob) else None


def test_broken_lists_are_walked_once_and_told_as_by_a_plain_walk(spark):
    rng, lists = random.Random(3), [None, b"", b"\x00", b"\x00\x00", b"\x00\x01\x00"]
    for _ in range(150):
        body = b"".join(struct.pack(">H", n) + b"\x00" * n for n in rng.choices([0, 1, 46, 47, 60, 300], k=rng.randrange(7)))
        body = body[: len(body) - rng.choice([0, 0, 0, 1, 2, 5])]
        lists.append(struct.pack(">H", len(body) + rng.choice([0, 0, 0, 1])) + body)
    df = spark.createDataFrame(list(enumerate(lists)), "cert_id bigint, sct_list binary").select("*", F.lit("x").alias("extension"))
    found = scts.broken_lists(df)
    assert found.columns == ["cert_id", "extension", "error"]
    want = {i: e for i, b in enumerate(lists) if (e := error_of(b)) is not None}
    assert {r.cert_id: r.error for r in found.collect()} == want and len(set(want.values())) == 2
    # One walk and its rest behind the bound, not one of each for every use of the result.
    assert plan(found).count("aggregate(") <= 2


def test_fingerprints_between_colons_need_no_replacement_by_pattern(spark):
    texts = ["AA:BB:cc", "aabb\n", " a:b ", "g1:h2", "\u00e9AF:09", "", ":", "ABC:\r\n", "0x12", "a\u2028", "AA BB-CC", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(fr.normalize_fingerprint(F.col("t"))).collect()]
    assert got == [t if t is None else "".join(c for c in t if c in "0123456789abcdefABCDEF").lower() for t in texts]
    long = df.limit(1).select(fr.is_sha256_hex(F.lit("AB:" * 32)).alias("a"), fr.is_sha256_hex(F.lit("AB" * 32 + "\n")).alias("b"), fr.is_sha256_hex(F.lit("AB:" * 31)).alias("c"))
    assert tuple(long.first()) == (True, True, False)
    assert "RLIKE" in plan(df.select(fr.normalize_fingerprint(F.col("t"))))


def test_matches_are_told_apart_by_one_shuffle(spark, tmp_path):
    from certmill.operators.jobs import dedupe_matches
    from checks.fixtures import Fixtures

    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([1, 2, 5, None]), rng.choice([4, 5, 6, None]), rng.choice([7, 8])) for _ in range(120)]
    schema = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint"
    spark.createDataFrame(rows + rows[:40], schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    x = Fixtures(spark, str(tmp_path))
    got, want = x.matches(), dedupe_matches(x.arrivals())
    key = lambda df: {tuple(r) for r in df.where("id IS NOT NULL").collect()}
    assert key(got) == key(want) and got.count() == want.count()
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
