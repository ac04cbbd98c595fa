"""Names judged inside their array: the same verdicts as by joins, in one stage."""

import random

import pytest

from certmill.operators import psl

RULES = [
    ("com", "icann", "plain"), ("uk", "icann", "plain"), ("co.uk", "icann", "plain"), ("ck", "icann", "plain"), ("*.ck", "icann", "wildcard"),
    ("www.ck", "icann", "exception"), ("github.io", "private", "plain"), ("*.deep.host.io", "private", "wildcard"),
    ("a.b.c.d.e", "private", "plain"), ("x.a.deep.host.io", "icann", "exception"), ("blogspot.com", "private", "plain"),
]
ENDS = ["com", "co.uk", "uk", "ck", "www.ck", "q.ck", "github.io", "deep.host.io", "a.deep.host.io", "x.a.deep.host.io", "a.b.c.d.e", "b.c.d.e", "blogspot.com", "none"]


@pytest.fixture(scope="module")
def certs(spark):
    r = random.Random(4)
    odd = ["", " ", None, "com", "*.com", "*.*.x.com", "*.*.*.com", "A.COM.", " b.com\t", "192.0.2.1", "1::ffff:192.0.2.1", "__cert:5", "a..com", ".com", "ä.uk", "x.ck.", "\x0bz.co.uk"]
    rows = []
    for i in range(300):
        names = [r.choice(odd) if r.random() < .3 else r.choice(["", "a.", "*.", "b.c.", "W."]) + r.choice(ENDS) for _ in range(r.randrange(0, 5))]
        rows.append((f"https://{i % 2}/", i, r.choice([None, "", "N/A", "s.com", "t.github.io", "nodot"]), r.choice([names, names, names, None])))
    return spark.createDataFrame(rows, "log_uri string, log_index bigint, subject_cn string, san array<string>")


@pytest.mark.parametrize("count", [0, 1, 5, len(RULES)])
def test_equal_to_the_way_of_joins(spark, certs, count):
    rules = spark.createDataFrame(RULES[:count], "rule string, section string, kind string")
    def key(rows):
        return {(r.log_uri, r.log_index): tuple(r) for r in rows.collect()}

    assert psl.suffix_table(rules) is not None
    got, want = psl.cert_verdict(certs, rules), psl._verdict_by_joins(certs, rules)
    assert got.columns == want.columns and key(got) == key(want)
    assert key(psl.require_icann(certs, rules)) == key(psl._require_by_joins(certs, rules))


def test_many_rules(spark, certs):
    more = [(f"t{i}.com", "private", "plain") for i in range(3000)]
    rules = spark.createDataFrame(RULES + more, "rule string, section string, kind string")
    named = spark.createDataFrame([("u", 1, None, ["a.t7.com"]), ("u", 2, None, ["a.t3000.com"])], certs.schema)
    assert [r.log_index for r in psl.require_icann(named, rules).collect()] == [2]


def test_one_stage(spark, certs, tmp_path):
    certs.write.parquet(str(tmp_path / "c"))
    rules = spark.createDataFrame(RULES, "rule string, section string, kind string")
    for df in (psl.cert_verdict(spark.read.parquet(str(tmp_path / "c")), rules), psl.require_icann(spark.read.parquet(str(tmp_path / "c")), rules)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Exchange" not in plan and "Join" not in plan and "from_json" not in plan


def test_too_many_rules_take_the_way_of_joins(spark, certs, monkeypatch):
    rules = spark.createDataFrame(RULES, "rule string, section string, kind string")
    want = sorted(map(str, psl.cert_verdict(certs, rules).collect()))
    monkeypatch.setattr(psl, "TABLE_RULES", 2)
    assert psl.suffix_table(rules) is None
    assert sorted(map(str, psl.cert_verdict(certs, rules).collect())) == want
