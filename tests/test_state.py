import random

import pytest
from pyspark.sql import functions as F

from certmill.operators import jobs as jb
from certmill.plans import audits as pl, state as ss

NOW = "2026-02-01 00:00:00"
LOGS = ("https://a/", "https://b2/", "https://b1/")  # in scan order


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(
        [("new b", "https://b2", "2026-01-01", "usable", "B"), ("old b", "https://b1/", "2025-01-01", "usable", "B"), ("a", "https://a/", "2024-01-01", "usable", "A")],
        "description string, url string, start string, state string, operator string",
    )


@pytest.fixture(scope="module")
def sans():
    r = random.Random(9)
    return {u: [[f"{'*.' if r.random() < .2 else ''}n{r.randrange(40)}.com" for _ in range(r.randrange(1, 4))] for _ in range(n)] for u, n in zip(LOGS, (23, 31, 17))}


@pytest.fixture(scope="module")
def certs(spark, make_certs, sans):
    out = None
    for uri, s in sans.items():
        one = make_certs(s, log_uri=uri).withColumn("der", F.encode(F.concat("log_uri", F.col("log_index").cast("string")), "UTF-8"))
        out = one if out is None else out.unionByName(one)
    return out


@pytest.fixture(scope="module")
def heads(spark, sans):
    return spark.createDataFrame([(u, len(s)) for u, s in sans.items()], "log_uri string, tree_size bigint")


def started(spark, path, target):
    store = ss.StateStore.create(spark, str(path))
    state = store.load()
    sessions = jb.start_session(state.sessions, "2026-01-01", "2026-06-30", target, None, False, NOW)
    store.commit(state, "start", sessions, state.jobs, state.matches.limit(0))
    return store


def content(store):
    s = store.load()
    jobs = {(j.id, j.log_uri, j.next_end_index, j.matched_count, j.status, j.session_id, j.tree_size_at_start) for j in s.jobs.collect()}
    matches = {(m.id, m.job_id, m.log_index, m.domain, m.rule_name) for m in s.matches.collect()}
    assert len(matches) == s.matches.count()
    return jobs, matches, [(r.id, r.status) for r in s.sessions.collect()]


def walk(sans, target, batch):
    """The session one certificate after the other, as (log, index, name), and what is left of each log."""
    known, hits, left = set(), [], {}
    for uri in LOGS:
        end = len(sans[uri]) - 1
        while end >= 0 and len(hits) < target:
            first = max(0, end - batch + 1)
            for i in range(first, end + 1):
                for n in sans[uri][i]:
                    clean = n.removeprefix("*.")
                    if clean not in known and len(hits) < target:
                        known.add(clean)
                        hits.append((uri, i, n))
                        break
            end = first - 1
        if end < len(sans[uri]) - 1:
            left[uri] = end
        if len(hits) >= target:
            break
    return hits, left


def run(store, certs, heads, logs, entries):
    opts, steps = pl.ScanOptions(batch_size=5), 1
    while not ss.advance_session(store, 1, certs, heads, logs, opts, NOW, entries):
        steps += 1
    return steps


@pytest.mark.parametrize("target", [9, 1000])
def test_steps_equal_one_scan(spark, certs, heads, logs, sans, tmp_path, target):
    one, more = started(spark, tmp_path / "one", target), started(spark, tmp_path / "more", target)
    assert run(one, certs, heads, logs, None) == 1
    steps = run(more, certs, heads, logs, 36 if target > 100 else 4)
    assert steps > 1 and content(one) == content(more)
    hits, left = walk(sans, target, 5)
    jobs, matches, sessions = content(one)
    uris = {j[0]: j[1] for j in jobs}
    assert [(uris[m[1]], m[2], m[3]) for m in sorted(matches)] == hits
    assert {j[1]: j[2] for j in jobs} == left and {j[4] for j in jobs} == {"completed"} and sessions == [(1, "completed")]
    # A completed session has nothing to do.
    before = one.load().version
    assert ss.advance_session(one, 1, certs, heads, logs, pl.ScanOptions(batch_size=5), NOW) and one.load().version == before


def test_a_step_that_dies_has_done_nothing(spark, certs, heads, logs, tmp_path, monkeypatch):
    opts = pl.ScanOptions(batch_size=5)
    plain, hurt = started(spark, tmp_path / "plain", 12), started(spark, tmp_path / "hurt", 12)
    assert not ss.advance_session(plain, 1, certs, heads, logs, opts, NOW, 10)
    before = content(hurt)
    with monkeypatch.context() as m:
        m.setattr(ss.StateStore, "_publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            ss.advance_session(hurt, 1, certs, heads, logs, opts, NOW, 10)
    assert content(hurt) == before
    assert not ss.advance_session(hurt, 1, certs, heads, logs, opts, NOW, 10)
    assert content(hurt) == content(plain)


def test_two_writers_are_noticed(spark, tmp_path):
    store = started(spark, tmp_path / "s", 3)
    old = store.load()
    store.commit(old, "one", old.sessions, old.jobs, old.matches.limit(0))
    with pytest.raises(RuntimeError):
        store.commit(old, "two", old.sessions, old.jobs, old.matches.limit(0))


def test_parts_are_written_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ss, "MAX_PARTS", 3)
    store = ss.StateStore.create(spark, str(tmp_path / "s"))
    for i in range(6):
        state = store.load()
        row = spark.createDataFrame([(i, 1, i, f"n{i}", "", "", "", "", "all", NOW)], state.matches.schema)
        store.commit(state, "add", state.sessions, state.jobs, row)
    assert len(store.load().parts) <= 3 and store.load().matches.count() == 6


def test_certificates_of_hits(spark, certs, heads, logs, tmp_path):
    store = started(spark, tmp_path / "s", 9)
    run(store, certs, heads, logs, None)
    state = store.load()
    got = ss.hit_certificates(state.matches, state.jobs, certs).collect()
    assert len(got) == 9 and all(bytes(r.der).decode() == f"{r.log_uri}{r.log_index}" for r in got)
