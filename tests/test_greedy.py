import random

import pytest
from pyspark.sql import DataFrameReader, functions as F

from certmill.operators import greedy, jobs as jb, loglist as ll
from certmill.plans import audits as pl


def walk(certs, known=(), target=None):
    """Certificates one by one, each its first name that nobody holds."""
    taken, hits = set(known), []
    for ord_, names in sorted(certs):
        for n in names:
            if n not in taken:
                taken.add(n)
                hits.append((ord_, n))
                break
        if target is not None and len(hits) >= target:
            break
    return hits[:target] if target is not None else hits


def options(spark, certs):
    rows = [(o, [{"clean": n, "domain": n, "rule_name": "all"} for n in names]) for o, names in certs]
    return spark.createDataFrame(
        rows, "ord bigint, options array<struct<clean: string, domain: string, rule_name: string>>"
    )


def random_certs(seed, certs, names):
    rng = random.Random(seed)
    return [
        (o, [f"n{rng.randrange(names)}" for _ in range(rng.randrange(0, 6))])
        for o in rng.sample(range(certs * 3), certs)
    ]


@pytest.mark.parametrize("seed, certs, names", [(1, 20, 6), (2, 60, 20), (3, 300, 60), (4, 300, 900), (5, 40, 200)])
def test_equals_the_walk(spark, seed, certs, names):
    data = random_certs(seed, certs, names)
    got = sorted((r["ord"], r["clean"]) for r in greedy.greedy_hits(options(spark, data)).collect())
    assert got == walk(data)


@pytest.mark.parametrize("data", [
    [(0, ["x", "y"]), (1, ["x", "y"])],
    [(0, []), (1, [])],
    # Every certificate is displaced by the one before it.
    [(0, ["a"])] + [(i, [f"{chr(96 + i)}", f"{chr(97 + i)}"]) for i in range(1, 8)],
    # One name wanted by all, then a name of its own.
    [(i, ["hot", f"own{i}"]) for i in range(200)],
    # Equal lists.
    [(i, ["a", "b", "c", "d"]) for i in range(10)],
    # Repeats in one list.
    [(0, ["x"]), (1, ["x", "x", "y"]), (2, ["y", "x", "z"])],
])
def test_special_cases(spark, data):
    got = sorted((r["ord"], r["clean"]) for r in greedy.greedy_hits(options(spark, data)).collect())
    assert got == walk(data)


def bare(spark, data):
    return spark.createDataFrame(data, "ord bigint, names array<string>")


def places(assignment):
    return sorted((r["ord"], r["name"]) for r in assignment.owners().collect())


@pytest.mark.parametrize("seed, certs, names, part", [(6, 200, 50, 7), (7, 300, 900, 1), (8, 120, 30, 20)])
def test_walks_over_parts_equal_the_walk(spark, seed, certs, names, part):
    data = random_certs(seed, certs, names)
    found = greedy.Assignment(bare(spark, data), walk_certs=part)
    assert places(found) == walk(data)
    # Ever fewer move, the last round none.
    assert len(found.moved) > 2 and found.moved[-1] == 0


def test_equal_lists_need_one_round(spark):
    data = [(i, [f"n{k}" for k in range(60)]) for i in range(400)]
    found = greedy.Assignment(bare(spark, data))
    assert found.moved == [0] and places(found) == [(i, f"n{i}") for i in range(60)]
    # Equal lists in several parts: what is left is the wish of one part for names of another.
    parts = greedy.Assignment(bare(spark, data), walk_certs=100)
    assert places(parts) == places(found)


def test_a_round_reads_the_buckets_of_its_movers(spark):
    # One chain of displacements among many certificates that never move.
    data = [(1000 + i, [f"own{i}"]) for i in range(500)]
    data += [(i, [f"c{i:02}", f"c{i + 1:02}"]) for i in range(12)] + [(-1, ["zz", "c00"]), (-2, ["zz"])]
    found = greedy.Assignment(bare(spark, data), walk_certs=1)
    assert places(found) == walk(data)
    assert max(found.moved) <= 14 and len(found.moved) > 10
    assert found.opened and all(n <= m for n, m in zip(found.opened, found.moved, strict=False))
    plan = found.held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1].split("PushedFilters")[0]


@pytest.mark.parametrize("most_asked", [-1, 100_000])
def test_holders_are_found_by_bits_or_names(spark, monkeypatch, most_asked):
    monkeypatch.setattr(greedy, "MAX_ASKED", most_asked)
    monkeypatch.setattr(greedy, "MERGE_ROUNDS", 1)
    # Two parts at least want the name null, which is a name like others.
    data = random_certs(9, 50, 20) + [(1000, ["a", None, "end1"]), (1001, ["a", None, "end2"]), (1002, ["z", None]), (-1, ["z"]), (-2, ["a"])]
    found = greedy.Assignment(bare(spark, data), walk_certs=10)
    assert places(found) == walk(data) and len(found.moved) > 2
    plan = found._asked(found.held.select("name"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(name" not in plan and "hashpartitioning(_clean" not in plan


def test_a_round_lists_its_own_table(spark, monkeypatch):
    monkeypatch.setattr(greedy, "MERGE_ROUNDS", 100, raising=False)
    opened, parquet = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **o: (opened.extend(paths), parquet(self, *paths, **o))[1])
    data = [(i, [f"c{i:02}", f"c{i + 1:02}"]) for i in range(7)] + [(-1, ["zz", "c00"]), (-2, ["zz"])]
    found = greedy.Assignment(bare(spark, data), walk_certs=1)
    assert places(found) == walk(data)
    assert len(found.moved) > 6 and len(opened) == len(found.moved) == len(set(opened))


def sizes(certs):
    return certs.groupBy("log_uri").agg((F.max("log_index") + 1).alias("tree_size"))


def scan_key(n, batch):
    return lambda i: ((n - 1 - i) // batch, i)


@pytest.mark.parametrize("target, factor", [(0, 1), (1, 1), (9, 1), (9, 3), (9, 100), (1000, 1)])
def test_scan_of_one_log(spark, make_certs, monkeypatch, target, factor):
    monkeypatch.setattr(pl, "TAIL_FACTOR", factor)
    monkeypatch.setattr(pl, "TAIL_GROWTH", 2)
    rng = random.Random(5)
    sans = [[f"{'*.' if rng.random() < .3 else ''}n{rng.randrange(12)}.com" for _ in range(rng.randrange(1, 4))] for _ in range(40)]
    certs = make_certs(sans)
    order = sorted(range(40), key=scan_key(40, 7))
    clean = lambda n: n[2:] if n.startswith("*.") else n
    want = walk([(k, [clean(n) for n in sans[i]]) for k, i in enumerate(order)], target=target)
    opts = pl.ScanOptions(batch_size=7, target=target)
    got = pl.scan_logs(certs, sizes(certs), opts).orderBy("ord").collect()
    assert [(r["log_index"], r["clean"]) for r in got] == [(order[k], n) for k, n in want]
    assert all(r["domain"] in sans[r["log_index"]] and r["rule_name"] == "all" for r in got)


def test_joined_facts_give_the_same_scan(spark, make_certs):
    certs = make_certs([["a.github.io", "b.com"], ["b.com", "c.com"], ["*.c.com"]])
    rules = spark.createDataFrame([("com", "icann", "plain"), ("github.io", "private", "plain")], "rule string, section string, kind string")
    opts = pl.ScanOptions(query="is_icann_domain", psl_rules=rules, target=None)
    got = {r["log_index"]: r["domain"] for r in pl.scan_logs(certs, sizes(certs), opts).collect()}
    assert got == {0: "b.com", 1: "c.com"}
    strict = pl.ScanOptions(query="is_icann_domain", psl_rules=rules, target=None, require_icann=True)
    got = {r["log_index"]: r["domain"] for r in pl.scan_logs(certs, sizes(certs), strict).collect()}
    assert got == {1: "b.com", 2: "*.c.com"}


def test_nxdomain_scan_reports_stripped_names(spark, make_certs):
    certs = make_certs([["a.com", "*.gone.com"], ["gone.com"]])
    obs = spark.createDataFrame([("gone.com", "A", "NXDOMAIN", ["QR"], False, False)],
                                "domain string, rdtype string, rcode string, flags array<string>, has_ad boolean, has_rrsig boolean")
    opts = pl.ScanOptions(nxdomain=True, dns_obs=obs, target=None)
    got = [(r["log_index"], r["domain"]) for r in pl.scan_logs(certs, sizes(certs), opts).collect()]
    assert got == [(0, "gone.com")]


def test_session_over_logs(spark, make_certs, monkeypatch):
    logs = spark.createDataFrame(
        [("new b", "https://b2", "2026-01-01", "N/A", "usable", "B"), ("old b", "https://b1/", "2025-01-01", "N/A", "usable", "B"),
         ("a", "https://a/", "2024-01-01", "N/A", "usable", "A")],
        "description string, url string, start string, end string, state string, operator string",
    )
    sans = {"https://b1/": [["x", "y"], ["z"]], "https://b2/": [["x", "w"]], "https://a/": [["x"], ["y", "q"]]}
    certs = None
    for uri, s in sans.items():
        one = make_certs(s, log_uri=uri)
        certs = one if certs is None else certs.unionByName(one)
    line, key = [], 0
    for uri in ("https://a/", "https://b2/", "https://b1/"):
        for i, s in enumerate(sans[uri]):
            line.append((key, s, uri, i))
            key += 1
    want = walk([(k, s) for k, s, _, _ in line])
    opts = pl.ScanOptions(target=None)
    got = pl.scan_session(certs, sizes(certs), logs, opts).orderBy("ord").collect()
    assert [(r["log_uri"], r["log_index"], r["clean"]) for r in got] == [(line[k][2], line[k][3], n) for k, n in want]
    for target in (1, 2, 3, 4):
        # The tries end inside, at and behind the first log.
        monkeypatch.setattr(pl, "TAIL_FACTOR", 1)
        opts = pl.ScanOptions(target=target, batch_size=1)
        got = pl.scan_session(certs, sizes(certs), logs, opts).collect()
        tails = line_in_batches(sans)
        want = walk([(k, s) for k, s, _, _ in tails], target=target)
        assert [(r["log_uri"], r["log_index"], r["clean"]) for r in got] == [(tails[k][2], tails[k][3], n) for k, n in want]


def line_in_batches(sans):
    """The session's certificates in scan order with batches of one: each log from its tail."""
    line = []
    for uri in ("https://a/", "https://b2/", "https://b1/"):
        line += [(uri, i) for i in reversed(range(len(sans[uri])))]
    return [(k, sans[u][i], u, i) for k, (u, i) in enumerate(line)]


def test_resume_goes_on_below_the_checkpoint(spark, make_certs):
    sans = [[f"n{i % 6}.com", f"m{i % 4}.com"] for i in range(30)]
    certs = make_certs(sans)
    jobs = spark.createDataFrame(
        [(4, "https://a.example/", 30, 17, 8, 3, "running", None, False, None, "t", "t")],
        "id bigint, log_uri string, tree_size_at_start bigint, next_end_index bigint, target_count bigint, matched_count bigint, "
        "status string, query string, nxdomain_mode boolean, session_id bigint, created_at string, updated_at string",
    )
    matches = spark.createDataFrame([(1, 4, "*.n1.com"), (2, 4, "n2.com"), (3, 9, "n3.com")], "id bigint, job_id bigint, domain string")
    order = sorted(range(18), key=scan_key(18, 5))
    want = walk([(k, sans[i]) for k, i in enumerate(order)], known={"n1.com", "n2.com"}, target=5)
    got = pl.resume_scan(certs, jb.active_job(jobs), matches, pl.ScanOptions(batch_size=5)).orderBy("ord").collect()
    assert [(r["log_index"], r["clean"]) for r in got] == [(order[k], n) for k, n in want]
    assert {r["job_id"] for r in got} == {4}


def test_log_ranks(spark):
    logs = spark.createDataFrame(
        [("x", "https://x", "2025-01-01", "B"), ("y", "https://y/", "2026-01-01", "B"), ("z", "https://z/", "N/A", "A")],
        "description string, url string, start string, operator string",
    )
    got = {r["log_uri"]: r["log_rank"] for r in ll.log_ranks(logs).collect()}
    assert got == {"https://z/": 0, "https://y/": 1, "https://x/": 2}


def test_tail_reaches_the_scan(spark, make_certs, tmp_path):
    for uri in ("https://a/", "https://b/", "https://c/"):
        make_certs([[f"n{i}"] for i in range(20)], log_uri=uri).write.mode("append").partitionBy("log_uri").parquet(str(tmp_path / "certs"))
    certs = spark.read.parquet(str(tmp_path / "certs"))
    heads = [("https://a/", 20), ("https://b/", 20), ("https://c/", 20)]
    one = pl.scan_tail(certs, heads, 7, 5)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(log_index,10)" in plan and "PartitionFilters: [isnotnull(log_uri" in plan
    assert sorted((r["log_uri"], r["log_index"]) for r in one.collect()) == [("https://a/", i) for i in range(10, 20)]
    two = pl.scan_tail(certs, heads, 23, 5)
    assert two.groupBy("log_uri").count().count() == 2 and two.count() == 25
    assert pl.scan_tail(certs, heads, 60, 5).count() == 60


@pytest.mark.parametrize("target, factor", [(0, 1), (3, 1), (8, 1), (8, 50), (500, 1), (None, 1)])
def test_first_hits_come_from_tails(spark, make_certs, monkeypatch, target, factor):
    monkeypatch.setattr(pl, "TAIL_FACTOR", factor)
    monkeypatch.setattr(pl, "TAIL_GROWTH", 2)
    rng = random.Random(6)
    sans = {u: [[f"n{rng.randrange(9)}.{rng.choice(['com', 'net'])}" for _ in range(rng.randrange(0, 4))] for _ in range(n)] for u, n in (("https://a/", 30), ("https://b/", 25))}
    certs = make_certs(sans["https://a/"], log_uri="https://a/").unionByName(make_certs(sans["https://b/"], log_uri="https://b/"))
    want = []
    for uri, s in sans.items():
        for i in sorted(range(len(s)), key=scan_key(len(s), 7)):
            passing = [n for n in s[i] if n.endswith(".com")]
            want += [(uri, i, passing[0])] if passing else []
    opts = pl.ScanOptions(query="domain LIKE '%.com'", batch_size=7, target=target)
    got = [(r["log_uri"], r["log_index"], r["domain"]) for r in pl.first_hits(certs, sizes(certs), opts).collect()]
    assert got == want[:target] if target is not None else sorted(got) == sorted(want)


def test_first_hits_read_what_they_need(spark, make_certs, tmp_path, monkeypatch):
    """The rows read for a target do not grow with the log."""
    read = []
    first_match = pl.scan.first_match
    monkeypatch.setattr(pl.scan, "first_match", lambda part, rules: (read.append(part.count()), first_match(part, rules))[1])
    for n in (300, 3000):
        make_certs([[f"n{i}.com"] for i in range(n)]).write.parquet(str(tmp_path / str(n)))
        certs = spark.read.parquet(str(tmp_path / str(n)))
        heads = spark.createDataFrame([("https://a.example/", n)], "log_uri string, tree_size bigint")
        assert pl.first_hits(certs, heads, pl.ScanOptions(target=2, batch_size=10)).count() == 2
    assert read == [200, 200]
