import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from certmill.llm import exact_dedup as e


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    texts = [None, "", " ", "a  b", "a\tb", "a b", "x" * 5000] + ["".join(r.choice("ab ") for _ in range(r.choice([3, 9, 41]))) for _ in range(80)]
    texts += texts[:40]
    return [(i if i % 17 else None, t, "k", 1) for i, t in enumerate(texts)] + [(3, "a  b", "k", 1)] * 2


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, key string, rank int")


# The second key puts all contents under three keys, so every level has ranks.
@pytest.mark.parametrize("key", [e.hash_key, lambda *c: F.pmod(F.xxhash64(*c), F.lit(3))])
def test_equal_texts_share_a_name_and_others_do_not(docs, rows, key):
    want = {}
    for d, t, *_ in rows:
        want.setdefault(norm(t), []).append(d)
    by = {}
    for g in e.exact_copies(docs, block=16, key=key).collect():
        by.setdefault(g.text_sha256, []).append(g)
    assert len(by) == len(want)
    for n, ids in want.items():
        got = by[hashlib.sha256(n.encode()).hexdigest()]
        assert sorted(map(str, (g.doc_id for g in got))) == sorted(map(str, ids))
        keep = min((x for x in ids if x is not None), default=None)
        assert {g.keep_id for g in got} == {keep} and {g.group_size for g in got} == {len(ids)}
        assert sum(g.kept for g in got) == 1


def test_kept_rows_keep_all_columns(docs, rows):
    got = e.drop_copies(docs, block=64)
    assert got.columns == docs.columns
    assert sorted(norm(r.text) for r in got.collect()) == sorted({norm(t) for _, t, *_ in rows})


def test_no_column_is_lost(spark):
    data = [(1, "a  b", "x", "p"), (2, "a b", "y", "q"), (2, "a b", "y", "q"), (None, "c", "z", None), (None, "c", "a", None), (5, "null", "k", "k"), (None, None, "n", "n")]
    docs = spark.createDataFrame(data, "doc_id long, text string, _row_key string, key string").withColumn("row", F.lit(7)).withColumn("same_id", F.map_from_arrays(F.array("_row_key"), F.array(F.lit(1))))
    got = e.drop_copies(docs)
    assert got.dtypes == docs.dtypes
    # Of rows equal in id and text the smallest by their columns stays.
    kept = {(r.doc_id, r.text, r._row_key, r.key, r.row, r.same_id[r._row_key]) for r in got.collect()}
    assert kept == {(1, "a  b", "x", "p", 7, 1), (None, "c", "a", None, 7, 1), (5, "null", "k", "k", 7, 1), (None, None, "n", "n", 7, 1)}


def test_null_and_the_text_null_are_two_ids(spark):
    docs = spark.createDataFrame([(None, "t"), ("null", "t"), ("null", "u")], "doc_id string, text string")
    assert sorted(map(str, e.drop_copies(docs).collect())) == sorted(["Row(doc_id='null', text='t')", "Row(doc_id='null', text='u')"])


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert e.exact_copies(none).count() == 0 and e.drop_copies(none).count() == 0
