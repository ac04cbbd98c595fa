import random

import pytest
from pyspark.sql import functions as F

from certmill.operators import jobs as jb, known as kn
from certmill.plans.numbering import number_rows
from certmill.schemas import EXPORT_COLUMNS, JOBS, MATCHES, SESSIONS

URI = "https://a.example/"


def job(i, status="completed", session=None, uri=URI, query=None):
    return (i, uri, 100, 99, 10, 0, status, query, False, session, "t0", "t0")


def match(i, job_id, domain, index=1):
    return (i, job_id, index, domain, "R3", "LE", "nb", "na", "all", "t0")


@pytest.fixture(scope="module")
def tables(spark):
    jobs = spark.createDataFrame([job(1), job(2, session=1), job(3, "running", session=1), job(4, "running", session=2)], JOBS)
    matches = spark.createDataFrame(
        [match(1, 2, "a.com", 5), match(2, 2, "b.com", 3), match(3, 3, "a.com", 3), match(4, 4, "z.com")], MATCHES)
    sessions = spark.createDataFrame(
        [(1, "2026-01-01", "2026-06-30", 10, None, False, "running", "t0", "t0"),
         (2, "2026-01-01", "2026-06-30", 10, "", False, "running", "t0", "t0"),
         (3, "2026-01-01", "2026-06-30", 10, "q", False, "completed", "t0", "t0")], SESSIONS)
    return matches, jobs, sessions


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


def test_jobs_and_hits(tables):
    m, j, _ = tables
    assert [(r["id"], r["hit_count"]) for r in jb.job_hit_counts(m, j).collect()] == [(4, 1), (3, 1), (2, 2), (1, 0)]
    assert [r["id"] for r in jb.job_hit_counts(m, j, 2).collect()] == [4, 3]
    assert jb.latest_completed_job(j).first()["id"] == 2
    assert jb.active_job(j).first()["id"] == 4
    assert jb.latest_completed_job(j.where("id > 9")).collect() == []
    assert [tuple(r) for r in jb.job_log_indices(m, 2).collect()] == [(2, 3), (2, 5)]
    assert jb.count_matches(m).first()[0] == 4 and jb.count_matches(m, 2).first()[0] == 2
    assert jb.job_by_id(j, 3).first()["status"] == "running"


def test_same_name_counts_once_in_a_session(tables):
    m, j, _ = tables
    assert ids(jb.session_known(m, j, 1), "domain") == ["a.com", "b.com"]
    assert {tuple(r) for r in jb.session_unique_count(m, j).collect()} == {(1, 2), (2, 1)}


def test_status(tables):
    m, j, _ = tables
    row = jb.scan_status(m, j).first()
    assert (row["total_hits"], row["active_job"], row["progress"]) == (4, "#4", "0/10")
    idle = jb.scan_status(m, j.where("status = 'completed'")).first()
    assert (idle["total_hits"], idle["active_job"], idle["log_uri"]) == (4, "none", None)


def test_find_session(tables):
    s = tables[2]
    assert jb.find_session(s, "2026-01-01", "2026-06-30", None, False).first()["id"] == 2
    assert jb.find_session(s, "2026-01-01", "2026-06-30", "q", False).collect() == []
    assert jb.find_session(s, "2026-01-01", "2026-06-30", None, True).collect() == []


def test_running_job(tables):
    j = tables[1]
    assert jb.running_job_for_log(j, URI, 1).first()["id"] == 3
    assert jb.running_job_for_log(j, URI, None).collect() == []
    assert {(r["session_id"], r["id"]) for r in jb.running_job_for_log(j).collect()} == {(1, 3), (2, 4)}


def test_completed_logs_are_skipped(spark, tables):
    logs = spark.createDataFrame([("https://a.example",), ("https://b.example/",)], "url string")
    assert ids(jb.skip_completed_logs(logs, tables[1], 1), "url") == ["https://b.example/"]
    assert len(ids(jb.skip_completed_logs(logs, tables[1], 2), "url")) == 2


def test_known_names_are_compared_stripped(spark):
    known = spark.createDataFrame([("*.x.com",)], "domain string")
    named = spark.createDataFrame([("x.com",), ("*.x.com",), ("y.com",)], "domain string")
    assert ids(jb.skip_known(named, known), "domain") == ["y.com"]


@pytest.mark.parametrize(("max_rows", "max_bytes"), [(10**6, 1 << 20), (0, 1 << 20), (0, 0)])
def test_stored_names_give_the_same_rows(spark, monkeypatch, max_rows, max_bytes):
    monkeypatch.setattr(kn, "MAX_BYTES", max_bytes)
    known = spark.range(20_000).selectExpr("concat(IF(id % 3 = 0, '*.', ''), 'n', id % 15000, '.com') AS domain").unionByName(
        spark.createDataFrame([(None,)], "domain string"))
    names = kn.store_known(known)
    assert names.rows == 15_000 and names.names.count() == 15_000
    # A third of the rows are of one known name, some have none.
    rows = spark.range(30_000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN '*.n7.com' WHEN id % 100 = 1 THEN NULL ELSE concat('n', id, '.com') END AS domain"
    ).withColumn("_clean", F.regexp_replace("domain", r"^\*\.", ""))
    want = {i for i in range(30_000) if i % 3 and (i % 100 == 1 or i >= 15_000)}
    assert {r.id for r in kn.without_known(rows, names, max_rows).select("id").collect()} == want
    assert {r.id for r in kn.only_known(rows, names, max_rows).select("id").collect()} == set(range(30_000)) - want


def test_few_new_names_pass_the_filter(spark):
    names = kn.store_known(spark.range(5_000).selectExpr("concat('n', id, '.com') AS domain"))
    assert names.width == 65_536
    rows = spark.range(20_000).selectExpr("concat('n', id, '.com') AS _clean")
    marked = kn.may_be_known(rows, names)
    n = {r["k"]: r["c"] for r in marked.where("_maybe").groupBy(F.expr("CAST(substring(_clean, 2, length(_clean) - 5) AS INT) < 5000").alias("k")).agg(F.count("*").alias("c")).collect()}
    assert n[True] == 5_000 and n[False] < 0.15 * 15_000
    assert "Exchange hashpartitioning" not in marked._jdf.queryExecution().executedPlan().toString()
    none = kn.store_known(spark.createDataFrame([], "domain string"))
    assert none.rows == 0 and kn.without_known(rows, none, -1).count() == 20_000 and kn.only_known(rows, none, -1).count() == 0


def test_options_without_stored_names(spark, monkeypatch):
    certs = spark.createDataFrame(
        [(1, [("*.a.com", "a.com"), ("b.com", "b.com")]), (2, [("b.com", "b.com")]), (3, [])],
        "ord bigint, options array<struct<domain: string, clean: string>>",
    )
    known = spark.createDataFrame([("a.com",), ("*.c.com",)], "domain string")
    plain = jb.skip_known_options(certs, known).orderBy("ord").collect()
    assert plain == jb.skip_known_options(certs, kn.store_known(known)).orderBy("ord").collect()
    assert [[o["clean"] for o in r["options"]] for r in plain] == [["b.com"], ["b.com"], []]


def test_first_arrival_is_kept(spark):
    arrivals = spark.createDataFrame([match(3, 1, "a"), match(1, 1, "a", 7), match(2, 2, "a")], MATCHES)
    assert ids(jb.dedupe_matches(arrivals)) == [1, 2]
    stored = spark.createDataFrame([match(0, 2, "a")], MATCHES)
    assert ids(jb.dedupe_matches(arrivals, stored)) == [1]


def test_purges(tables):
    m, j, s = tables
    left_m, left_j = jb.purge_job(m, j, 2)
    assert ids(left_m) == [3, 4] and ids(left_j) == [1, 3, 4]
    left = jb.purge_completed(m, j, s)
    assert [ids(t) for t in left] == [[3, 4], [3, 4], [1, 2]]
    assert tuple(jb.purge_counts(m, j).first()) == (2, 2)
    assert [t.count() for t in jb.purge_all(m.sparkSession)] == [0, 0, 0]
    assert jb.purge_all(m.sparkSession)[1].columns == j.columns


@pytest.mark.parametrize("scope, n", [(None, 4), (1, 0), (2, 2), (3, 1)])
def test_export_scope(tables, scope, n):
    m, j, _ = tables
    rows = jb.export_rows(m, j, scope).orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(1, n + 1))
    assert jb.export_rows(m, j, scope).columns == EXPORT_COLUMNS


def test_row_numbers_with_uneven_keys(spark):
    rng = random.Random(3)
    keys = rng.sample(range(10**6), 3000) + [10**15, 2 * 10**15, -5]
    df = spark.createDataFrame([(k,) for k in keys], "id bigint")
    got = {r["id"]: r["index"] for r in number_rows(df, ["id"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys), 1)}
    assert number_rows(df.where("id = 7.5"), ["id"]).collect() == []


def test_checkpoints_and_status_changes(spark, tables):
    _, j, s = tables
    progress = spark.createDataFrame([(3, 50, 1, "t1"), (3, 20, 4, "t2")], "job_id bigint, next_end_index bigint, matched_count bigint, updated_at string")
    new = {r["id"]: r for r in jb.apply_checkpoints(j, progress).collect()}
    assert (new[3]["next_end_index"], new[3]["matched_count"], new[3]["updated_at"]) == (20, 4, "t2")
    assert new[4]["next_end_index"] == 99 and len(new) == 4
    done = {r["id"]: (r["status"], r["updated_at"]) for r in jb.complete_session_jobs(j, 1, "now").collect()}
    assert done == {1: ("completed", "t0"), 2: ("completed", "t0"), 3: ("completed", "now"), 4: ("running", "t0")}
    assert {r["id"]: r["status"] for r in jb.complete_session(s, 1, "now").collect()}[1] == "completed"
    assert {r["id"]: r["status"] for r in jb.complete_job(j, 4, "now").collect()}[4] == "completed"


def test_new_rows_take_the_next_id(spark, tables):
    _, j, s = tables
    row = jb.start_job(j, URI, 500, 10, "q", True, "now", 1).where("id = 5").first()
    assert (row["next_end_index"], row["matched_count"], row["status"], row["session_id"]) == (499, 0, "running", 1)
    first = jb.start_job(j.limit(0), URI, 1, 1, None, False, "now").first()
    assert (first["id"], first["session_id"]) == (1, None)
    row = jb.start_session(s, "a", "b", 3, None, False, "now").where("id = 4").first()
    assert (row["status"], row["query"]) == ("running", None)


def test_old_tables_get_the_missing_column(tables):
    j = tables[1]
    assert jb.add_missing_column(j.drop("session_id")).where(F.col("session_id").isNull()).count() == 4
    assert jb.add_missing_column(j).columns == j.columns


def test_union_of_known_names(tables):
    m, j, _ = tables
    assert ids(jb.known_union(jb.job_known(m, 4), jb.session_known(m, j, 1)), "domain") == ["a.com", "b.com", "z.com"]


def test_rows_are_numbered_with_one_sort_and_one_read(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).selectExpr("id", "pmod(hash(id), 700) AS k", "id AS _metadata", "'u' AS _x")
    numbered = number_rows(df, ["k", "id"])
    want = [r["id"] for r in sorted(df.collect(), key=lambda r: (r["k"], r["id"]))]
    got = sorted((r["index"], r["id"], r["_metadata"]) for r in numbered.collect())
    assert got == [(n + 1, i, i) for n, i in enumerate(want)]
    plan = numbered.select("*")._jdf.queryExecution().executedPlan().toString()
    # The sizes are read from footers: that scan has no column.
    assert plan.count("FileScan parquet") == 2 and plan.count("ReadSchema: struct<>") == 1
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    try:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", 90)
        cut = number_rows(df.select("k", "id"), ["k", "id"])
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", before)
    assert [r["id"] for r in cut.orderBy("index").collect()] == want
    assert cut.agg(F.max("index"), F.count_distinct("index")).first() == (3000, 3000)


def test_all_hot_keys_are_spread(spark):
    from certmill.plans import joins

    # 600 keys with 250 rows each, far above the share, beside 3,000 rare ones.
    big = spark.range(150_000).selectExpr("id % 600 AS k").unionByName(spark.range(1000, 4000).selectExpr("id AS k"))
    assert len(joins._hot_hashes(big, ["k"])) == 600
    other = spark.range(500, 4000).selectExpr("id AS k", "-id AS v")
    for how in ("left", "left_anti"):
        got, want = joins.spread_join(big, other, ["k"], how), big.join(other, "k", how)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()
