import random

import pytest

from certmill.operators import entries as en


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(1)
    held = {"a": [i for i in range(95) if not 20 <= i < 47 and r.random() < .8], "b": list(range(10, 30)), "c": [3, 3, 3], "x": [1, 2]}
    rows = [(u, i) for u, s in held.items() for i in s] + [("a", held["a"][0])] * 4 + [("b", 200), ("b", 200)]
    sizes = {"a": 90, "b": 30, "c": 4, "none": 7, "empty": 0}
    return (
        spark.createDataFrame(rows, "log_uri string, index bigint"), spark.createDataFrame(list(sizes.items()), "log_uri string, tree_size bigint"),
        rows, sizes,
    )


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_ranges_are_all_that_is_missing(tables, block):
    entries, heads, rows, sizes = tables
    got = en.missing_ranges(entries, heads, block=block).collect()
    gone = {(r.log_uri, i) for r in got for i in range(r.first_missing, r.last_missing + 1)}
    assert gone == {(u, i) for u, n in sizes.items() for i in range(n)} - set(rows)
    # No two ranges touch.
    assert not any((a.log_uri, a.last_missing + 1) == (b.log_uri, b.first_missing) for a in got for b in got)


def test_counts_of_each_log(tables):
    entries, heads, rows, sizes = tables
    got = {r.log_uri: r for r in en.entry_coverage(entries, heads).collect()}
    assert got.keys() == {"a", "b", "c", "x", "none", "empty"}
    for u, r in got.items():
        own, n = [i for v, i in rows if v == u], sizes.get(u)
        below = [i for i in own if n is not None and i < n]
        assert (r.received, r.distinct_indices, r.repeated) == (len(own), len(set(below)), len(below) - len(set(below)))
        assert r.beyond_tree == (0 if n is None else len(own) - len(below)) and r.no_size == (len(own) if n is None else 0)
        assert r.missing == (0 if n is None else n - len(set(below)))


def test_parsed_rows_decode_when_used(spark):
    """Building the frame reads the field side alone: a side that fails when it is read is not noticed."""
    from pyspark.sql import functions as F

    decoded = spark.range(5).select(
        F.col("id").alias("index"), F.lit(1).alias("timestamp_ms"), F.lit("t").alias("timestamp_utc"),
        F.when(F.col("id") >= 0, F.raise_error(F.lit("read"))).cast("binary").alias("der"),
    )
    fields = spark.createDataFrame([], "fingerprint string, issuer_cn string, issuer_org string, subject_cn string, subject_org string, not_before string, not_after string, san array<string>")
    frame = en.parsed_rows(decoded, fields)
    with pytest.raises(Exception, match="read"):
        frame.collect()
