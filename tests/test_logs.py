import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from certmill.operators import loglist as ll, roots as rt, scts as sc
from certmill.plans import joins
from certmill.sources import loglist as src
from certmill.sources.roots import read_roots

DOC = {
    "operators": [
        {"name": "Google", "email": ["a@g.example", "", "b@g.example"], "logs": [
            {"description": "Argon", "log_id": "abc123", "url": "https://argon.example/", "mmd": 86400,
             "state": {"usable": {"timestamp": "2024-05-01T10:20:30Z"}},
             "temporal_interval": {"start_inclusive": "2026-01-01T00:00:00Z", "end_exclusive": "2026-07-01T00:00:00Z"}},
            {"description": "No id", "url": "https://noid.example"},
        ], "tiled_logs": [
            {"description": "Tiled", "log_id": "abc123", "submission_url": "https://tiled.example", "log_type": "monitoring_only",
             "state": {"retired": {"timestamp": "2025-01-01T00:00:00Z"}}},
        ]},
        {"name": "Solo", "email": "ops@solo.example", "logs": [{"log_id": "zzz", "monitoring_url": "https://m.example///"}]},
        {"name": "Silent", "logs": []},
        {"logs": [{"log_id": "", "description": "empty id"}]},
    ]
}


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("list") / "all.json"
    p.write_text(json.dumps(DOC, indent=2))
    return str(p)


def test_operators(spark, path):
    ops = src.read_operators(spark, path)
    assert {r["name"]: r["emails"] for r in ops.collect()} == {
        "Google": ["a@g.example", "b@g.example"], "Solo": ["ops@solo.example"], "Silent": [], "Unknown": []
    }
    shown = ops.select("name", ll.contact(F.col("emails")).alias("c"))
    assert {r["name"]: r["c"] for r in shown.collect()}["Silent"] == "—"


def test_classic_logs(spark, path):
    rows = {r["description"]: r for r in src.read_log_list(spark, path).collect()}
    argon = rows["Argon"]
    assert (argon["year"], argon["start"], argon["end"], argon["state"], argon["operator"]) == (
        "2026", "2026-01-01", "2026-07-01", "usable", "Google")
    bare = rows["No id"]
    assert (bare["year"], bare["start"], bare["end"], bare["state"]) == ("Unknown", "N/A", "N/A", "unknown")
    assert rows["N/A"]["url"] == "" and len(rows) == 4


def test_lookup_entries(spark, path):
    rows = src.read_log_entries(spark, path).orderBy("pos").collect()
    assert [(r["log_kind"], r["log_id"], r["url"]) for r in rows] == [
        ("classic", "abc123", "https://argon.example/"), ("tiled", "abc123", "https://tiled.example/"),
        ("classic", "zzz", "https://m.example/"),
    ]
    assert rows[0]["state_timestamp"] == "2024-05-01 10:20:30" and rows[0]["mmd"] == 86400
    assert rows[1]["log_type"] == "monitoring_only" and rows[1]["mmd"] is None and rows[2]["state_timestamp"] == ""


def test_last_entry_of_a_log_id_counts(spark, path):
    got = {r["log_id"]: r["description"] for r in ll.log_id_index(src.read_log_entries(spark, path)).collect()}
    assert got == {"abc123": "Tiled", "zzz": "N/A"}


def test_sct_lookup(spark, path):
    scts = spark.createDataFrame([("c1", "abc123"), ("c1", "missing"), ("c2", "zzz")], "cert_id string, log_id_b64 string")
    found = sc.lookup_scts(scts, src.read_log_entries(spark, path))
    rows = {r["log_id_b64"]: r for r in found.collect()}
    hit, miss = rows["abc123"], rows["missing"]
    assert (hit["matched"], hit["operator"], hit["operator_contact"], hit["period"], hit["mmd"]) == (
        True, "Google", "a@g.example, b@g.example", "N/A ~ N/A", "—")
    assert not miss["matched"] and all(miss[c] == "—" for c in sc.LOOKUP_COLUMNS + ["period"])
    assert {tuple(r) for r in sc.sct_summary(found).collect()} == {("c1", 2, 1, 1), ("c2", 1, 1, 0)}


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(
        [("h1", "https://h1", "2026", "2026-01-01", "2026-07-01", "usable", "G", 0),
         ("h2", "https://h2/", "2026", "2026-07-01", "2027-01-01", "retired", "G", 1),
         ("open", "https://o/", "2025", "2025-03-01", "N/A", "usable", "C", 2),
         ("bad", "https://b/", "Unknown", "soon", "2027-01-01", "usable", "C", 3),
         ("blank", "  ", "2026", "2026-01-01", "2026-13-99", "usable", "C", 4)],
        "description string, url string, year string, start string, end string, state string, operator string, pos bigint",
    )


def test_interval(logs):
    def met(lo, hi):
        return {r["description"] for r in ll.interval_overlap(logs, lo, hi).collect()}

    assert met(date(2026, 1, 1), date(2026, 6, 30)) == {"h1", "open", "blank"}
    assert met(date(2026, 7, 1), date(2026, 12, 31)) == {"h2", "open", "blank"}
    assert met(date(2024, 1, 1), date(2025, 2, 28)) == set()
    with pytest.raises(ValueError):
        ll.interval_overlap(logs, date(2026, 2, 1), date(2026, 1, 1))


@pytest.mark.parametrize("small", [True, False])
def test_interval_join_equals_the_filter(spark, logs, small, monkeypatch):
    monkeypatch.setattr(ll, "fits_broadcast", lambda *a: small)
    spans = [(i, date(2024 + i // 4, 1 + (i * 5) % 12, 1 + i), date(2025 + i // 4, 1 + (i * 7) % 12, 28)) for i in range(14)]
    spans = [s for s in spans if s[1] <= s[2]]
    df = spark.createDataFrame(spans, "id int, interval_from date, interval_to date")
    for days in (3, 366):
        got = sorted((r["id"], r["description"]) for r in ll.overlap_join(df, logs, days).collect())
        want = sorted((i, r["description"]) for i, lo, hi in spans for r in ll.interval_overlap(logs, lo, hi).collect())
        assert got == want


@pytest.mark.parametrize("small", ["intervals", "logs", "none"])
def test_pairs_of_one_slot_are_dealt_to_many_tasks(spark, small, monkeypatch):
    monkeypatch.setattr(ll, "fits_broadcast", lambda df, *a: {"intervals": "interval_from", "logs": "start"}.get(small) in df.columns)
    spans = spark.range(20_000).selectExpr("id", "date'2024-02-01' AS interval_from", "date'2024-02-09' AS interval_to")
    known = spark.range(20_000 if small != "logs" else 19_999).selectExpr("id AS pos", "'2024-01-15' AS start", "'2024-02-15' AS end")
    # 400 million pairs in one slot; only their tasks are counted here.
    assert ll.overlap_join(spans, known).rdd.getNumPartitions() >= 20


def test_blocks_of_a_slot_lose_and_repeat_no_pair(spark, logs, monkeypatch):
    monkeypatch.setattr(ll, "fits_broadcast", lambda *a: False)
    monkeypatch.setattr(ll, "BLOCK_ROWS", 3)
    spans = [(i // 2, date(2024 + i // 20, 1 + (i * 5) % 12, 1 + i // 4), date(2025 + i // 20, 1 + (i * 7) % 12, 28)) for i in range(40)]
    spans = [s for s in spans if s[1] <= s[2]] + [(99, None, date(2026, 1, 1)), (98, date(2026, 1, 1), None)]
    spans += spans[:9]  # rows that come twice give their pairs twice
    twice = logs.unionByName(logs.where("pos < 3"))
    df = spark.createDataFrame(spans, "id int, interval_from date, interval_to date")
    got = ll.overlap_join(df, twice, 200)
    assert got.columns == [*df.columns, *logs.columns]
    want = [(i, r["description"]) for i, lo, hi in spans if lo and hi for r in ll.interval_overlap(twice, lo, hi).collect()]
    assert sorted((r["id"], r["description"]) for r in got.collect()) == sorted(want)
    assert ll.overlap_join(df.limit(0), twice).count() == ll.overlap_join(df, twice.limit(0)).count() == 0


def test_select_logs(logs):
    got = [r["description"] for r in ll.select_logs(logs, today=date(2026, 8, 1), lo=date(2026, 1, 1)).collect()]
    assert got == ["h1", "open"]
    got = [r["description"] for r in ll.select_logs(logs, date(2026, 8, 1), any_state=True).collect()]
    assert got == ["h2", "h1", "open"]


def test_operator_of_a_log(spark, logs):
    rows = spark.createDataFrame([("https://h1///",), ("https://nowhere/",)], "log_uri string")
    assert {r["log_uri"]: r["operator"] for r in ll.log_operator(rows, logs).collect()} == {
        "https://h1///": "G", "https://nowhere/": "manual"
    }


def test_groupings(spark, logs):
    assert [tuple(r) for r in ll.usable_by_year(logs).collect()] == [("Unknown", 1, 1), ("2026", 2, 3), ("2025", 1, 1)]
    targets = logs.selectExpr("operator", "url AS uri", "description AS label")
    got = [(r["operator"], len(r["targets"])) for r in ll.group_targets(targets).collect()]
    assert got == [("C", 3), ("G", 2)]
    ops = spark.createDataFrame([("g", []), ("G", ["x@g"]), ("a", [])], "name string, emails array<string>")
    assert [tuple(r) for r in ll.logs_per_operator(ops, logs).collect()] == [("a", "—", 0), ("G", "x@g", 2), ("g", "—", 0)]


def b64(x):
    import base64

    return base64.b64encode(x).decode()


def test_roots(spark, tmp_path, logs):
    for name, certs in (("h1", [b"one", b"two"]), ("h2", [b"two"]), ("o", [])):
        folder = tmp_path / f"log_url=https:%2F%2F{name}"
        folder.mkdir()
        (folder / "r.json").write_text(json.dumps({"certificates": [b64(c) for c in certs]}, indent=1))
    roots = read_roots(spark, str(tmp_path))
    assert [bytes(r["der"]) for r in roots.where("log_url LIKE '%h1'").orderBy("pos").collect()] == [b"one", b"two"]
    cover = rt.root_coverage(logs, roots, rt.target_fingerprint(der=b"one"))
    got = {r["description"]: (r["has_root"], r["roots"]) for r in cover.collect()}
    assert got == {"h1": ("yes", "2"), "h2": ("no", "1"), "open": ("no", "0"), "bad": ("error", "—"), "blank": ("error", "—")}
    assert {r["description"] for r in rt.root_missing(cover).collect()} == {"h2", "open"}
    assert {r["description"] for r in rt.hide_present(cover).collect()} == {"h2", "open", "bad", "blank"}
    assert tuple(rt.root_summary(cover).first()) == (1, 2, 2, 5)
    ops = spark.createDataFrame([("G", ["a@g", "b@g"])], "name string, emails array<string>")
    failed = spark.createDataFrame([("https://h1/", "late"), ("https://bad/", "x" * 200), ("https://bad", None)], "log_url string, note string")
    report = rt.coverage_report(cover, ops, failed)
    bad = logs.where("description = 'bad'").first()["url"]
    assert report.columns == [*cover.columns, "contact", "note"] and report.count() == 5
    notes = {r["description"]: r["note"] for r in rt.coverage_report(
        cover, ops, failed.unionByName(spark.createDataFrame([(bad, "y" * 200)], "log_url string, note string"))).collect()}
    assert notes["bad"] == "y" * 80 and notes["h1"] == notes["open"] == ""
    assert {r["contact"] for r in report.collect()} == {"a@g, b@g", "—"}
    subjects = spark.createDataFrame([(rt.target_fingerprint(der=b"one"), "One CA", "One")], "fingerprint string, subject_cn string, subject_org string")
    listed = {(r["description"], r["root_no"]): r["subject_cn"] for r in rt.roots_by_log(logs, roots, subjects).collect()}
    assert listed == {("h1", 1): "One CA", ("h1", 2): "?", ("h2", 1): "?"}


def test_root_numbers_without_places(spark):
    rows = [("https://x", f"r{i}".encode()) for i in range(500)]
    roots = spark.createDataFrame(rows, "log_url string, der binary")
    logs = spark.createDataFrame([("https://x/", "d", "o")], "url string, description string, operator string")
    subjects = spark.createDataFrame([], "fingerprint string, subject_cn string, subject_org string")
    got = [r["root_no"] for r in rt.roots_by_log(logs, roots, subjects).orderBy("fingerprint_sha256").collect()]
    assert got == list(range(1, 501))


def test_target_fingerprint():
    assert rt.target_fingerprint("AB:" * 31 + "cd") == "ab" * 31 + "cd"
    for bad in ({"text": "aabb"}, {}, {"text": "ab" * 32, "der": b"x"}):
        with pytest.raises(ValueError):
            rt.target_fingerprint(**bad)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_join_equals_the_broadcast(spark, how):
    big = spark.range(2000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS k", "id")
    small = spark.range(30).selectExpr("concat('k', id) AS k", "id * 10 AS v").union(spark.createDataFrame([("hot", 1)], "k string, v bigint"))
    a = joins.lookup_join(big, small, "k", how)
    b = joins.lookup_join(big, small, "k", how, max_rows=5)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert "_salt" in b._jdf.queryExecution().analyzed().toString()
    assert "BroadcastExchange" in a._jdf.queryExecution().executedPlan().toString()


def test_size_check(spark):
    assert joins.fits_broadcast(spark.range(10), max_rows=10)
    assert not joins.fits_broadcast(spark.range(11), max_rows=10)
    wide = spark.createDataFrame([(b"x" * 1000,)] * 5, "d binary")
    assert not joins.fits_broadcast(wide, max_bytes=4000) and joins.fits_broadcast(wide, max_bytes=8000)


def test_hot_key_is_spread_over_tasks(spark):
    big = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS k", "id")
    other = big.select("k").distinct().withColumn("v", F.length("k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.spread_join(big, other, ["k"], "inner")
        tasks = out.where("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(tasks) == 4 and sum(t["count"] for t in tasks) == 10_000
    assert out.count() == 30_000
