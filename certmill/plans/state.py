"""Scan state as one versioned set of tables, and sessions that go on from it.

A step writes its new matches and the next jobs and sessions to a folder of their own,
and then one manifest row that names them. Readers see what the newest manifest row
names and nothing else, so a step that dies before its row has done nothing, and is
run again from the same version with the same result. Matches are appended: a step
writes what it found, not what is known.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from certmill.operators import jobs as jb
from certmill.operators.loglist import log_ranks, slash_url
from certmill.plans.audits import ScanOptions, scan_logs, scan_tail
from certmill.plans.joins import lookup_join
from certmill.plans.numbering import number_rows
from certmill.schemas import JOBS, MATCHES, SESSIONS
from certmill.session import stored

MANIFEST = "version BIGINT, step STRING, sessions STRING, jobs STRING, matches ARRAY<STRING>"
# More parts of matches than this are written together by the next step.
MAX_PARTS = 64


@dataclass(frozen=True)
class State:
    """The tables of one version; ``parts`` are the folders of its matches."""

    version: int
    sessions: DataFrame
    jobs: DataFrame
    matches: DataFrame
    parts: tuple[str, ...]


class StateStore:
    """Sessions, jobs and matches under one folder that every executor reaches. One writer at a time is assumed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, state: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> StateStore:
        """A new store, empty or with (sessions, jobs, matches)."""
        store = cls(spark, path)
        sessions, jobs, matches = state or (spark.createDataFrame([], s) for s in (SESSIONS, JOBS, MATCHES))
        store._write(State(-1, None, None, None, ()), "create", sessions, jobs, matches)
        return store

    def load(self) -> State:
        """The newest version."""
        rows = self.spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{self.path}/manifest")
        row = rows.orderBy(F.desc("version")).first()
        if row is None:
            raise ValueError(f"no state under {self.path}")

        def read(schema: str, *parts: str) -> DataFrame:
            return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in parts])

        return State(row["version"], read(SESSIONS, row["sessions"]), read(JOBS, row["jobs"]), read(MATCHES, *row["matches"]), tuple(row["matches"]))

    def commit(self, base: State, step: str, sessions: DataFrame, jobs: DataFrame, found: DataFrame) -> State:
        """The version after ``base``: its matches and ``found``, and the given sessions and jobs."""
        if self.load().version != base.version:
            raise RuntimeError(f"another step was committed after version {base.version}")
        self._write(base, step, sessions, jobs, found)
        return self.load()

    def _write(self, base: State, step: str, sessions: DataFrame, jobs: DataFrame, found: DataFrame) -> None:
        part, old = f"parts/{base.version + 1}-{uuid.uuid4().hex}", base.parts
        if len(old) >= MAX_PARTS:
            found, old = base.matches.unionByName(found), ()
        for name, table, schema in (("matches", found, MATCHES), ("jobs", jobs, JOBS), ("sessions", sessions, SESSIONS)):
            columns = self.spark.createDataFrame([], schema).schema
            out = table.select(*[F.col(c.name).cast(c.dataType) for c in columns])
            (out if name == "matches" else out.coalesce(1)).write.parquet(f"{self.path}/{part}/{name}")
        self._publish(base.version + 1, step, part, [*old, f"{part}/matches"])

    def _publish(self, version: int, step: str, part: str, matches: list[str]) -> None:
        """One row in one file: what is moved into place at once makes the version visible."""
        row = self.spark.createDataFrame([(version, step, f"{part}/sessions", f"{part}/jobs", matches)], MANIFEST)
        row.coalesce(1).write.parquet(f"{self.path}/manifest/{version}-{uuid.uuid4().hex}")


@dataclass(frozen=True)
class _Log:
    """What is left of one log in a session: indices below ``size``."""

    uri: str
    size: int
    tree_size: int
    job: dict | None


def _logs_left(state: State, session_id: int, heads: DataFrame, ranks: DataFrame) -> list[_Log]:
    """Logs of a session in scan order that are not completed; the list of logs is small by nature."""
    own = state.jobs.where(F.col("session_id") == session_id).withColumn("log_uri", slash_url(F.col("log_uri")))
    jobs: dict[str, dict] = {}
    for r in own.orderBy("id").collect():
        job = r.asDict()
        if jobs.get(r["log_uri"], {}).get("status") != jb.COMPLETED:
            jobs[r["log_uri"]] = job
    out = []
    for r in lookup_join(heads, ranks, "log_uri", "inner").orderBy("log_rank").collect():
        job = jobs.get(r["log_uri"])
        if job is None or job["status"] != jb.COMPLETED:
            size = r["tree_size"] if job is None else min(r["tree_size"], job["next_end_index"] + 1)
            out.append(_Log(r["log_uri"], size, r["tree_size"] if job is None else job["tree_size_at_start"], job))
    return out


def _read(logs: list[_Log], entries: int | None, batch_size: int) -> dict[str, int]:
    """How many entries of each log a scan over ``entries`` entries reads, in whole batches."""
    out, left = {}, entries
    for log in logs:
        if left is not None and left <= 0:
            break
        take = log.size if left is None else min(log.size, -(-min(log.size, left) // batch_size) * batch_size)
        out[log.uri] = take
        left = None if left is None else left - take
    return out


def advance_session(
    store: StateStore, session_id: int, certs: DataFrame, heads: DataFrame, logs: DataFrame,
    opts: ScanOptions, now: str, entries: int | None = None,
) -> bool:
    """Take a session one step on and commit it; True when the session is completed.

    ``heads`` holds ``log_uri, tree_size``, ``logs`` the list of logs; completed logs are
    skipped, each other log goes on below its checkpoint, and a name that the session
    holds is not hit again. The target is the session's, over all its logs. A step
    reads ``entries`` entries in whole batches, or all that is left. When the target is
    reached in some batch, the logs behind it are not touched and its log stops there.
    Steps of any length give the same matches and, in the end, the same checkpoints as one.
    """
    state = store.load()
    session = state.sessions.where(F.col("id") == session_id).first()
    if session is None:
        raise ValueError(f"no session {session_id}")
    if session["status"] == jb.COMPLETED:
        return True
    ranks = stored(log_ranks(logs), "log-ranks")
    left = _logs_left(state, session_id, heads, ranks)
    known = stored(jb.session_known(state.matches, state.jobs, session_id).select("domain"), "known-names")
    target = session["target_count"] - known.count()
    reads = _read(left, entries if target > 0 else 0, opts.batch_size)
    counts: dict[str, int] = {}
    found, reached = store.spark.createDataFrame([], MATCHES), target <= 0
    if reads and not reached:
        sizes = store.spark.createDataFrame([(x.uri, x.size) for x in left], "log_uri STRING, tree_size BIGINT")
        part = certs if entries is None else scan_tail(certs, [(x.uri, x.size) for x in left], entries, opts.batch_size)
        hits = stored(scan_logs(part, sizes, replace(opts, target=target), ranks=ranks, known=known), "session-hits")
        counts = {r["log_uri"]: r["count"] for r in hits.groupBy("log_uri").count().collect()}
        reached = sum(counts.values()) >= target
        if reached:
            last = hits.orderBy(F.desc("ord")).select("log_uri", "scan_batch").first()
            order = list(reads)
            reads = {u: reads[u] for u in order[: order.index(last["log_uri"]) + 1]}
            reads[last["log_uri"]] = min(reads[last["log_uri"]], (last["scan_batch"] + 1) * opts.batch_size)
        found = hits
    next_id = (state.jobs.agg(F.max("id")).first()[0] or 0) + 1
    changed = []
    for log in left:
        if log.uri not in reads:
            continue
        job = log.job or {
            "id": next_id, "log_uri": log.uri, "tree_size_at_start": log.tree_size, "target_count": session["target_count"],
            "matched_count": 0, "query": session["query"], "nxdomain_mode": session["nxdomain_mode"], "session_id": session_id,
            "created_at": now,
        }
        next_id += log.job is None
        end = log.size - reads[log.uri] - 1
        changed.append(job | {
            "next_end_index": end, "matched_count": job["matched_count"] + counts.get(log.uri, 0),
            "status": jb.COMPLETED if end < 0 else jb.RUNNING, "updated_at": now,
        })
    schema = store.spark.createDataFrame([], JOBS).schema
    rows = store.spark.createDataFrame([tuple(j[c] for c in schema.names) for j in changed], schema)
    jobs = state.jobs.where(~F.col("id").isin([j["id"] for j in changed])).unionByName(rows)
    sessions = state.sessions
    done = reached or all(reads.get(x.uri) == x.size for x in left)
    if done:
        jobs = jb.complete_session_jobs(jobs, session_id, now)
        sessions = jb.complete_session(sessions, session_id, now)
    if counts:
        base = state.matches.agg(F.max("id")).first()[0] or 0
        by_log = rows.select("log_uri", F.col("id").alias("job_id"))
        numbered = lookup_join(number_rows(found, ["ord"]), by_log, "log_uri", "inner")
        found = numbered.withColumn("id", F.col("index") + base).withColumn("matched_at", F.lit(now))
    store.commit(state, f"session {session_id}", sessions, jobs, found)
    return done


def hit_certificates(matches: DataFrame, jobs: DataFrame, certs: DataFrame) -> DataFrame:
    """``log_uri, log_index, der`` of the certificates that matches name, once each, for the file sink.

    Only the matched rows of ``certs`` meet the matches; a match whose entry is not there has null bytes.
    """
    logs = jobs.select(F.col("id").alias("job_id"), "log_uri")
    keys = lookup_join(matches.select("job_id", "log_index"), logs, "job_id", "inner").select("log_uri", "log_index").distinct()
    keys = stored(keys, "hit-keys")
    held = lookup_join(certs.select("log_uri", "log_index", "der"), keys, ["log_uri", "log_index"], "left_semi")
    one = held.groupBy("log_uri", "log_index").agg(F.min("der").alias("der"))
    return keys.join(one, ["log_uri", "log_index"], "left")
