import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from certmill.operators import rules as rl, scan
from certmill.sources.rules import read_rules


@pytest.fixture(scope="module")
def named(make_certs):
    return rl.expand_names(make_certs([["a.test", "*.b.cn"], ["c.com"], ["x_y.com"]]))


def names(df):
    return sorted(r["domain"] for r in df.select("domain").collect())


@pytest.mark.parametrize("text, want", [
    ("domain LIKE '%.test'", ["a.test"]),
    ("domain NOT LIKE '%.com'", ["*.b.cn", "a.test"]),
    ("issuer_org = 'Let''s Encrypt' AND domain = 'c.com'", ["c.com"]),
    ("WHERE domain IN ('c.com')", ["c.com"]),
    ("where domain NOT IN ('c.com', 'x_y.com')", ["*.b.cn", "a.test"]),
    ("issuer_country IN ('CN','US') AND domain = 'c.com' OR FALSE", ["c.com"]),
    ("subject_cn IS NULL", []),
    ("subject_cn IS NOT NULL AND subject_cn = 'N/A' AND contains(domain, 'b.')", ["*.b.cn"]),
    ("endswith(domain, '.cn')", ["*.b.cn"]),
    ("matches(domain, 'y[.]c')", ["x_y.com"]),
    ("NOT matches(domain, '[.](com|test)$')", ["*.b.cn"]),
    ("domain = 'matches(' OR domain = 'a.test'", ["a.test"]),
    ("not_before >= '2026' AND log_index > 1", ["x_y.com"]),
])
def test_predicates(named, text, want):
    assert names(rl.where_certs(named, text)) == want


def test_quoted_text_is_left_alone():
    assert rl.predicate_text("a = 'matches (x' AND matches (b, 'c')") == "a = 'matches (x' AND regexp_like(b, 'c')"
    assert rl.predicate_text("  WHERE x = 1") == "x = 1"


def test_calls_of_any_expression_work_inside_arrays(spark, named):
    text = rl.predicate_text
    assert text("STRIP_WILDCARD( lower(trim(domain)) ) = ')('") == "regexp_replace(lower(trim(domain)), '^[*][.]', '') = ')('"
    assert text("a IN (1, (2)) AND (b OR matches(strip_wildcard(d), '(x)'))") == (
        "a IN (1, (2)) AND (b OR regexp_like(regexp_replace(d, '^[*][.]', ''), '(x)'))")
    assert text("`strip_wildcard(a)` = concat(b, 'it''s (') AND is_nxdomain(DOMAIN)") == "`strip_wildcard(a)` = concat(b, 'it''s (') AND is_nxdomain"
    assert text("unbalanced((a)") == "unbalanced((a)" and text("is_nxdomain(other)") == "is_nxdomain(other)"
    certs = named.groupBy("log_index").agg(F.collect_list("domain").alias("san")).withColumn("flags", F.expr("array('QR', 'AD')"))

    def kept(predicate):
        found = certs.select(F.explode(F.expr(f"filter(san, domain -> {text(predicate)})")).alias("domain"))
        return names(found)

    assert kept("strip_wildcard(lower(concat(domain, ''))) = 'b.cn'") == ["*.b.cn"]
    assert kept("dns_has_flag(flags, lower('AD')) AND endswith(strip_wildcard(upper(domain)), '.COM')") == ["c.com", "x_y.com"]
    assert kept("NOT dns_has_flag(flags, 'qr')") == []


def test_first_true_rule_names_the_hit(named):
    rules = rl.combine("domain = 'c.com'", [("it's com", "endswith(domain, '.com')"), ("cn", "domain LIKE '%.cn'")])
    got = {r["domain"]: r["rule_name"] for r in rl.first_rule(named, rules).collect()}
    assert got == {"c.com": "query", "x_y.com": "it's com", "*.b.cn": "cn"}


def test_rule_sets_without_rules(named):
    assert {r["rule_name"] for r in rl.first_rule(named, rl.combine(None, [])).collect()} == {"default"}
    assert {r["rule_name"] for r in rl.first_rule(named, rl.combine(None, None)).collect()} == {"all"}


def test_failing_rule_fails_the_job(named):
    with pytest.raises(PySparkException):
        rl.first_rule(named, [("bad", "cast(domain AS int) = 1")]).collect()


def test_first_match_agrees_with_rows(make_certs):
    certs = make_certs([["a.cn", "b.com", "c.com"], ["d.cn"], ["*.e.com"], []])
    got = {r["log_index"]: (r["domain"], r["rule_name"])
           for r in scan.first_match(certs, [("com", "matches(domain, 'com$')")]).collect()}
    assert got == {0: ("b.com", "com"), 2: ("*.e.com", "com")}
    everything = {r["log_index"]: r["domain"] for r in scan.first_match(certs, None).collect()}
    assert everything == {0: "a.cn", 1: "d.cn", 2: "*.e.com", 3: "__cert:3__"}


@pytest.mark.parametrize("wrap", [lambda r: r, lambda r: {"rules": r}])
def test_rule_files(spark, tmp_path, wrap):
    rules = [{"name": "b", "filter": "issuer_country = 'CN'"}, {"filter": "true"}, {"name": "a"}]
    (tmp_path / "rules.json").write_text(json.dumps(wrap(rules), indent=1))
    got = rl.rule_list(read_rules(spark, str(tmp_path / "rules.json")))
    assert got == [("b", "issuer_country = 'CN'"), ("unnamed", "true"), ("a", "true")]


def test_after_date_compares_text(make_certs):
    certs = make_certs([["a"]])
    assert scan.after_date(certs, "2026-01-01").count() == 1
    assert scan.after_date(certs, "2026-01-02").count() == 0


def test_first_match_has_no_shuffle(make_certs):
    df = scan.first_match(make_certs([["a.com"]]), [("com", "domain LIKE '%.com'")])
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_tail_order(spark):
    certs = spark.createDataFrame([("u", i) for i in range(7)], "log_uri string, log_index bigint")
    sizes = spark.createDataFrame([("u", 7)], "log_uri string, tree_size bigint")
    got = scan.with_scan_position(certs, sizes, 3).orderBy("scan_pos").collect()
    # Batches 4-6, 1-3, 0, each ascending.
    assert [r["log_index"] for r in got] == [4, 5, 6, 1, 2, 3, 0]
    ordered = scan.with_scan_position(certs, sizes, 3).orderBy(*scan.scan_order()).collect()
    assert [r["log_index"] for r in ordered] == [4, 5, 6, 1, 2, 3, 0]
