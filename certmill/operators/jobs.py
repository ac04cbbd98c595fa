"""Scan sessions, jobs and matches as tables.

Operators that change a table return its next version; the caller writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from certmill.functions.names import strip_wildcard
from certmill.operators.known import KnownNames, only_known, without_known
from certmill.operators.loglist import slash_url
from certmill.plans.joins import lookup_join
from certmill.plans.numbering import number_rows
from certmill.schemas import EXPORT_COLUMNS, JOBS, MATCHES, SESSIONS

RUNNING = "running"
COMPLETED = "completed"


def _one(df: DataFrame, column: str, value: int | None) -> DataFrame:
    return df if value is None else df.where(F.col(column) == value)


# --- names already known ---------------------------------------------------------------

def _session_names(matches: DataFrame, jobs: DataFrame, session_id: int | None) -> DataFrame:
    owned = _one(jobs.where(F.col("session_id").isNotNull()), "session_id", session_id)
    side = owned.select(F.col("id").alias("job_id"), "session_id")
    return lookup_join(matches.select("job_id", "domain"), side, "job_id", "inner")


def session_known(matches: DataFrame, jobs: DataFrame, session_id: int | None = None) -> DataFrame:
    """Distinct names hit in a session, or in every session."""
    return _session_names(matches, jobs, session_id).select("session_id", "domain").distinct()


def job_known(matches: DataFrame, job_id: int | None = None) -> DataFrame:
    """Names hit in a job, or in every job."""
    return _one(matches, "job_id", job_id).select("job_id", "domain")


def known_union(*name_tables: DataFrame) -> DataFrame:
    """All names of the given tables, once each."""
    out = name_tables[0].select("domain")
    for t in name_tables[1:]:
        out = out.union(t.select("domain"))
    return out.distinct()


def skip_known(named: DataFrame, known: DataFrame | KnownNames, name: str = "domain") -> DataFrame:
    """Rows whose name is not known; both sides are compared without wildcard.

    Names stored by :func:`certmill.operators.known.store_known` are looked up behind their filter.
    """
    marked = named.withColumn("_clean", strip_wildcard(F.col(name)))
    if isinstance(known, KnownNames):
        return without_known(marked, known).drop("_clean")
    seen = known.select(strip_wildcard(F.col("domain")).alias("_clean")).distinct()
    return lookup_join(marked, seen, "_clean", "left_anti", check=known.select("domain")).drop("_clean")


def skip_known_options(certs: DataFrame, known: DataFrame | KnownNames) -> DataFrame:
    """``options`` without known names, order kept.

    The known names of a session are few beside the certificates; they are
    turned into (ord, name) pairs only for certificates that carry one. Of names stored
    with their filter, a pair without a set bit goes no further than its own task.
    """
    pairs = certs.select("ord", F.explode(F.transform("options", lambda o: o["clean"])).alias("_clean"))
    if isinstance(known, KnownNames):
        found = only_known(pairs, known)
    else:
        seen = known.select(strip_wildcard(F.col("domain")).alias("_clean")).distinct()
        found = lookup_join(pairs, seen, "_clean", "left_semi", check=known.select("domain"))
    joined = certs.join(found.groupBy("ord").agg(F.collect_set("_clean").alias("_bad")), "ord", "left")
    return joined.withColumn(
        "options",
        F.when(F.col("_bad").isNull(), F.col("options")).otherwise(
            F.filter("options", lambda o: ~F.array_contains(F.col("_bad"), o["clean"]))
        ),
    ).drop("_bad")


def skip_completed_logs(logs: DataFrame, jobs: DataFrame, session_id: int | None = None) -> DataFrame:
    """Logs not yet completed: of one session, or (session, log) pairs of all sessions.

    For all sessions ``logs`` carries a ``session_id`` column.
    """
    done = jobs.where((F.col("status") == COMPLETED) & F.col("session_id").isNotNull())
    done = _one(done, "session_id", session_id).select(
        "session_id", slash_url(F.col("log_uri")).alias("_url")
    ).distinct()
    keys = ["_url"] if session_id is not None else ["session_id", "_url"]
    marked = logs.withColumn("_url", slash_url(F.col("url")))
    return lookup_join(marked, done.select(*keys), keys, "left_anti").drop("_url")


# --- counts and single rows ------------------------------------------------------------

def session_unique_count(matches: DataFrame, jobs: DataFrame, session_id: int | None = None) -> DataFrame:
    """Distinct names per session; names are made unique before they are counted."""
    return session_known(matches, jobs, session_id).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("unique_domains")
    )


def _hits_per_job(matches: DataFrame) -> DataFrame:
    return matches.groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("hit_count"))


def job_hit_counts(matches: DataFrame, jobs: DataFrame, limit: int = 100) -> DataFrame:
    """The newest ``limit`` jobs with their hits, 0 kept; only their matches are counted."""
    newest = jobs.orderBy(F.desc("id")).limit(limit)
    return (
        newest.join(_hits_per_job(matches), "id", "left")
        .withColumn("hit_count", F.coalesce("hit_count", F.lit(0).cast("bigint")))
        .select(*jobs.columns, "hit_count")
        .orderBy(F.desc("id"))
    )


def count_matches(matches: DataFrame, job_id: int | None = None, per_job: bool = False) -> DataFrame:
    rows = _one(matches, "job_id", job_id)
    return (rows.groupBy("job_id") if per_job else rows.groupBy()).agg(
        F.count(F.lit(1)).alias("matches")
    )


def job_log_indices(matches: DataFrame, job_id: int | None = None) -> DataFrame:
    """Distinct log indices per job, sorted."""
    return (
        _one(matches, "job_id", job_id).select("job_id", "log_index").distinct()
        .orderBy("job_id", "log_index")
    )


def active_job(jobs: DataFrame) -> DataFrame:
    """The newest running job."""
    return jobs.where(F.col("status") == RUNNING).orderBy(F.desc("id")).limit(1)


def job_by_id(jobs: DataFrame, job_id: int) -> DataFrame:
    return _one(jobs, "id", job_id)


def latest_completed_job(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") == COMPLETED).agg(F.max("id").alias("id")).where(
        F.col("id").isNotNull()
    )


def scan_status(matches: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: total hits, the active job, its progress and next index; ``none`` without one."""
    total = matches.agg(F.count(F.lit(1)).alias("total_hits")).withColumn("_k", F.lit(1))
    active = active_job(jobs).select(
        F.lit(1).alias("_k"),
        F.concat(F.lit("#"), F.col("id").cast("string")).alias("active_job"),
        "log_uri",
        F.concat_ws("/", F.col("matched_count").cast("string"), F.col("target_count").cast("string"))
        .alias("progress"),
        F.col("next_end_index").alias("next_end_index"),
        "status",
    )
    return (
        total.join(active, "_k", "left")
        .withColumn("active_job", F.coalesce("active_job", F.lit("none")))
        .drop("_k")
    )


def find_session(
    sessions: DataFrame, interval_from: str, interval_to: str, query: str | None, nxdomain_mode: bool
) -> DataFrame:
    """The newest running session of the same interval, mode and query; no query equals an empty one."""
    return (
        sessions.where(
            (F.col("status") == RUNNING)
            & (F.col("interval_from") == interval_from)
            & (F.col("interval_to") == interval_to)
            & (F.coalesce("query", F.lit("")) == (query or ""))
            & (F.col("nxdomain_mode") == F.lit(nxdomain_mode))
        )
        .orderBy(F.desc("id"))
        .limit(1)
    )


def _newest(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of highest ``id`` per key, by partial aggregation instead of a window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "id").alias("_r")).select(
        *keys, "_r.*"
    ).select(*rows.columns)


def running_job_for_log(
    jobs: DataFrame, log_uri: str | None = None, session_id: int | None = None
) -> DataFrame:
    """The newest running job of a log in a session (null for none), or of every such pair."""
    running = jobs.where(F.col("status") == RUNNING)
    if log_uri is None:
        return _newest(running, "log_uri", "session_id")
    wanted = F.lit(session_id).cast("bigint")
    return (
        running.where((F.col("log_uri") == log_uri) & F.col("session_id").eqNullSafe(wanted))
        .orderBy(F.desc("id"))
        .limit(1)
    )


# --- writing matches -------------------------------------------------------------------

def dedupe_matches(arrivals: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per (job, name), the first arrival by ``id``; names already stored are left out."""
    keys = ["job_id", "domain"]
    rest = [c for c in arrivals.columns if c not in keys]
    first = (
        arrivals.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), "id").alias("_r"))
        .select(*keys, "_r.*")
        .select(*arrivals.columns)
    )
    return first if stored is None else first.join(stored.select(*keys), keys, "left_anti")


def export_rows(matches: DataFrame, jobs: DataFrame, job_id: int | None = None) -> DataFrame:
    """Matches of one job, or of all known jobs, in the export's columns, numbered by match id."""
    if job_id is None:
        known = jobs.select(F.col("id").alias("job_id"))
        rows = lookup_join(matches, known, "job_id", "left_semi")
    else:
        rows = _one(matches, "job_id", job_id)
    return number_rows(rows, ["id"]).withColumnRenamed("rule_name", "matched_rule").select(
        *EXPORT_COLUMNS
    )


# --- next versions of the tables -------------------------------------------------------

def apply_checkpoints(jobs: DataFrame, progress: DataFrame) -> DataFrame:
    """Jobs with the latest ``next_end_index``, ``matched_count`` and ``updated_at`` of their progress rows."""
    latest = progress.groupBy(F.col("job_id").alias("id")).agg(
        F.max_by(F.struct("next_end_index", "matched_count", "updated_at"), "updated_at").alias("_p")
    )
    new = {
        c: F.coalesce(F.col(f"_p.{c}"), F.col(c))
        for c in ("next_end_index", "matched_count", "updated_at")
    }
    return jobs.join(latest, "id", "left").withColumns(new).select(*jobs.columns)


def _complete(rows: DataFrame, which: Column, now: str) -> DataFrame:
    hit = F.coalesce(which, F.lit(False))
    return rows.withColumns({
        "status": F.when(hit, F.lit(COMPLETED)).otherwise(F.col("status")),
        "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at")),
    })


def complete_job(jobs: DataFrame, job_id: int, now: str) -> DataFrame:
    return _complete(jobs, F.col("id") == job_id, now)


def complete_session(sessions: DataFrame, session_id: int, now: str) -> DataFrame:
    return _complete(sessions, F.col("id") == session_id, now)


def complete_session_jobs(jobs: DataFrame, session_id: int, now: str) -> DataFrame:
    """All running jobs of a session completed."""
    return _complete(jobs, (F.col("session_id") == session_id) & (F.col("status") == RUNNING), now)


def purge_job(matches: DataFrame, jobs: DataFrame, job_id: int) -> tuple[DataFrame, DataFrame]:
    """Matches and jobs without one job."""
    return matches.where(F.col("job_id") != job_id), jobs.where(F.col("id") != job_id)


def purge_completed(
    matches: DataFrame, jobs: DataFrame, sessions: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without completed jobs, their matches, and completed sessions."""
    done = jobs.where(F.col("status") == COMPLETED).select(F.col("id").alias("job_id"))
    return (
        lookup_join(matches, done, "job_id", "left_anti"),
        jobs.where(F.col("status") != COMPLETED),
        sessions.where(F.col("status") != COMPLETED),
    )


def purge_counts(matches: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: matches and jobs that :func:`purge_completed` removes."""
    done = jobs.where(F.col("status") == COMPLETED).select(F.col("id").alias("job_id"))
    gone = lookup_join(matches, done, "job_id", "left_semi").agg(
        F.count(F.lit(1)).alias("matches_deleted")
    ).withColumn("_k", F.lit(1))
    jobs_gone = done.agg(F.count(F.lit(1)).alias("jobs_deleted")).withColumn("_k", F.lit(1))
    return gone.join(jobs_gone, "_k").drop("_k")


def purge_all(spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Empty matches, jobs and sessions to overwrite the stored ones with."""
    return tuple(spark.createDataFrame([], s) for s in (MATCHES, JOBS, SESSIONS))


def add_missing_column(jobs: DataFrame, name: str = "session_id", kind: str = "bigint") -> DataFrame:
    """Jobs of an older table with the column it lacks, as nulls."""
    if name in jobs.columns:
        return jobs
    return jobs.withColumn(name, F.lit(None).cast(kind))


def _next_id(rows: DataFrame) -> DataFrame:
    return rows.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))


def start_session(
    sessions: DataFrame, interval_from: str, interval_to: str, target_count: int,
    query: str | None, nxdomain_mode: bool, now: str,
) -> DataFrame:
    """Sessions with a new running one under the next id. One writer at a time is assumed."""
    row = _next_id(sessions).select(
        "id",
        F.lit(interval_from).alias("interval_from"), F.lit(interval_to).alias("interval_to"),
        F.lit(target_count).cast("bigint").alias("target_count"),
        F.lit(query).cast("string").alias("query"), F.lit(nxdomain_mode).alias("nxdomain_mode"),
        F.lit(RUNNING).alias("status"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
    )
    return sessions.unionByName(row)


def start_job(
    jobs: DataFrame, log_uri: str, tree_size: int, target_count: int, query: str | None,
    nxdomain_mode: bool, now: str, session_id: int | None = None,
) -> DataFrame:
    """Jobs with a new running one under the next id, to be read from the tail with no hits yet."""
    row = _next_id(jobs).select(
        "id",
        F.lit(log_uri).alias("log_uri"),
        F.lit(tree_size).cast("bigint").alias("tree_size_at_start"),
        F.lit(tree_size - 1).cast("bigint").alias("next_end_index"),
        F.lit(target_count).cast("bigint").alias("target_count"),
        F.lit(0).cast("bigint").alias("matched_count"),
        F.lit(RUNNING).alias("status"), F.lit(query).cast("string").alias("query"),
        F.lit(nxdomain_mode).alias("nxdomain_mode"),
        F.lit(session_id).cast("bigint").alias("session_id"),
        F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
    )
    return jobs.unionByName(row)
