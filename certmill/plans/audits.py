"""Whole audits, put together from the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from certmill.functions.registry import register_functions
from certmill.operators import dnsobs, greedy, jobs as jb, psl, roots as rt, rules as rl, scan
from certmill.operators.entries import decode_entries, parsed_rows
from certmill.operators.loglist import log_ranks
from certmill.plans.joins import lookup_join
from certmill.session import stored
from certmill.sources.dump import read_dump

# A target's first try reads this many entries per wanted hit; each further try reads more.
TAIL_FACTOR = 100
TAIL_GROWTH = 16


@dataclass
class ScanOptions:
    """What a scan looks for.

    ``query`` and ``rules`` are Spark SQL. ``dns_obs`` and ``psl_rules`` make
    the columns of :func:`~certmill.operators.dnsobs.with_dns_columns` and
    :func:`~certmill.operators.psl.with_psl_columns` available to them.
    """

    query: str | None = None
    rules: list[tuple[str, str]] | None = None
    batch_size: int = 50
    target: int | None = 100
    after: str | None = None
    nxdomain: bool = False
    require_icann: bool = False
    psl_rules: DataFrame | None = None
    dns_obs: DataFrame | None = None


_CERT_COLUMNS = [
    "log_uri", "log_index", "issuer_cn", "issuer_org", "not_before", "not_after",
]


def _candidates(certs: DataFrame, sizes: DataFrame, ranks: DataFrame | None, opts: ScanOptions) -> DataFrame:
    """Certificates in scan order with their passing names as ``options``.

    Cheap filters come first. Without joined facts this stays one narrow stage.
    """
    register_functions(certs.sparkSession)
    if opts.after:
        certs = scan.after_date(certs, opts.after)
    if opts.require_icann:
        if opts.psl_rules is None:
            raise ValueError("require_icann needs psl_rules")
        certs = psl.require_icann(certs, opts.psl_rules)
    placed = scan.with_rank(scan.with_scan_position(certs, sizes, opts.batch_size), ranks)
    rules = rl.combine(opts.query, opts.rules)
    if opts.psl_rules is None and opts.dns_obs is None:
        out = scan.with_options(placed, rules)
        return out.select(*_CERT_COLUMNS, "scan_batch", "ord", "options")

    named = rl.expand_names(scan.with_names(placed))
    if opts.nxdomain:
        if opts.dns_obs is None:
            raise ValueError("nxdomain needs dns_obs")
        named = dnsobs.nxdomain_only(named, opts.dns_obs)
    if opts.psl_rules is not None:
        named = psl.with_psl_columns(named, opts.psl_rules)
    if opts.dns_obs is not None:
        named = dnsobs.with_dns_columns(named, opts.dns_obs)
    return scan.options_from_names(named, [*_CERT_COLUMNS, "scan_batch", "ord"], rules)


def _heads(sizes: DataFrame, ranks: DataFrame | None) -> list[tuple[str, int]]:
    """Logs in scan order with their sizes: one row per log of a list that is small by nature."""
    if ranks is None:
        rows = sizes.select("log_uri", "tree_size", F.lit(0).alias("log_rank"))
    else:
        rows = lookup_join(sizes, ranks, "log_uri", "inner")
    found = rows.select("log_rank", "log_uri", "tree_size").collect()
    return [(r["log_uri"], r["tree_size"]) for r in sorted(found)]


def scan_tail(certs: DataFrame, heads: list[tuple[str, int]], entries: int, batch_size: int) -> DataFrame:
    """The certificates that a scan reads within its first ``entries`` entries, in whole batches.

    Plain bounds on ``log_uri`` and ``log_index``, which reach the table's
    partitions and the Parquet statistics: only the tails of logs are read.
    """
    bound, whole, left = F.lit(False), [], entries
    for uri, size in heads:
        if left <= 0:
            break
        take = -(-min(size, left) // batch_size) * batch_size
        if take >= size:
            whole.append(uri)
        else:
            bound = (F.col("log_uri") == uri) & (F.col("log_index") >= size - take)
        left -= min(take, size)
    return certs.where(F.col("log_uri").isin(whole) | bound if whole else bound)


def scan_logs(
    certs: DataFrame,
    sizes: DataFrame,
    opts: ScanOptions,
    ranks: DataFrame | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Hits of a scan: every name once, each certificate at most once, in scan order up to the target.

    ``ranks`` orders several logs (see :func:`~certmill.operators.loglist.log_ranks`);
    without it they are read in URL order. ``known`` names are not hit again. An
    entry that is stored twice is one entry.

    A scan never looks behind the hit that reaches its target, so with a
    target growing tails of the logs are tried first; the first tail with
    enough hits gives the exact answer and the rest is not read.
    """
    def hits_in(part: DataFrame) -> DataFrame:
        # Dealt by place first: rows are sorted once, behind the shuffle, not on both sides of it.
        able = _candidates(part, sizes, ranks, opts).repartition("ord").dropDuplicates(["ord"])
        if known is not None:
            able = jb.skip_known_options(able, known).where(F.size("options") > 0)
        return greedy.greedy_hits(able)

    if ranks is None and sizes.count() > 1:
        ranks = stored(scan.ranks_by_url(sizes), "log-ranks")
    if opts.target is None:
        return hits_in(certs)
    return _from_tails(certs, _heads(sizes, ranks), opts.batch_size, opts.target, ["ord"], hits_in)


def _from_tails(
    certs: DataFrame, heads: list[tuple[str, int]], batch_size: int, target: int, order: list,
    hits_in: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """The first ``target`` hits of a scan, from the shortest of growing tails that holds as many.

    Entries outside a tail come after all of it in scan order, so no row that was not
    read can precede a hit of the tail.
    """
    if target < 0:
        raise ValueError("target must not be negative")
    total, entries = sum(n for _, n in heads), max(batch_size, TAIL_FACTOR * target)
    while entries < total:
        hits = stored(hits_in(scan_tail(certs, heads, entries, batch_size)), "tail-hits")
        if hits.count() >= target:
            return hits.orderBy(*order).limit(target)
        entries *= TAIL_GROWTH
    return hits_in(certs).orderBy(*order).limit(target)


def first_hits(certs: DataFrame, sizes: DataFrame, opts: ScanOptions) -> DataFrame:
    """The first ``opts.target`` certificates of a scan with a passing name, each with its first one.

    Names may repeat among hits. Logs are read in URL order, each from its tail; ``sizes``
    (``log_uri, tree_size``) are the heads. Only tails of the logs are read (see :func:`scan_tail`)
    until one holds enough hits; certificates are not read to find the heads.
    """
    register_functions(certs.sparkSession)
    rules = rl.combine(opts.query, opts.rules)
    heads = _heads(sizes, stored(scan.ranks_by_url(sizes), "log-ranks"))

    def hits_in(part: DataFrame) -> DataFrame:
        part = scan.after_date(part, opts.after) if opts.after else part
        return scan.with_scan_position(scan.first_match(part, rules), sizes, opts.batch_size)

    if opts.target is None:
        return hits_in(certs)
    return _from_tails(certs, heads, opts.batch_size, opts.target, scan.scan_order(), hits_in)


def scan_session(
    certs: DataFrame, sizes: DataFrame, logs: DataFrame, opts: ScanOptions,
    known: DataFrame | None = None,
) -> DataFrame:
    """One unique-name target over many logs: operators by name, their logs newest first."""
    return scan_logs(certs, sizes, opts, ranks=log_ranks(logs), known=known)


def resume_scan(
    certs: DataFrame, job: DataFrame, matches: DataFrame, opts: ScanOptions, known: DataFrame | None = None
) -> DataFrame:
    """Continue one job below its checkpoint: its names excluded, its hits carried on.

    ``known`` are further names that are not hit again, such as those of the job's session.

    ``job`` is the job's row; batches go on from ``next_end_index``.
    """
    row = job.select("id", "log_uri", "next_end_index", "target_count", "matched_count").first()
    if row is None:
        raise ValueError("no such job")
    rest = certs.where(
        (F.col("log_uri") == row["log_uri"]) & (F.col("log_index") <= row["next_end_index"])
    )
    sizes = certs.sparkSession.range(1).select(
        F.lit(row["log_uri"]).alias("log_uri"),
        F.lit(row["next_end_index"] + 1).cast("bigint").alias("tree_size"),
    )
    left = None if opts.target is None else max(0, row["target_count"] - row["matched_count"])
    again = ScanOptions(**{**opts.__dict__, "target": left})
    own = jb.job_known(matches, row["id"])
    hits = scan_logs(rest, sizes, again, known=own if known is None else own.unionByName(known.select(*own.columns)))
    return hits.withColumn("job_id", F.lit(row["id"]).cast("bigint"))


def hit_certificates(hits: DataFrame, certs: DataFrame) -> DataFrame:
    """``log_uri``, ``log_index`` and ``der`` of the hits' certificates, to be written by ``write_cert_files``.

    Scans leave the bytes out, so that they shuffle none; they are read back for the
    hits alone. The hits' index span in each log bounds the read, and reaches the
    partitions and statistics of the table.
    """
    keys = ["log_uri", "log_index"]
    wanted = stored(hits.select(*keys).distinct(), "hit-keys")
    spans = wanted.groupBy("log_uri").agg(F.min("log_index").alias("lo"), F.max("log_index").alias("hi")).collect()
    bound = F.lit(False)
    for r in spans:  # one row for each log with a hit
        bound = bound | ((F.col("log_uri") == r["log_uri"]) & F.col("log_index").between(r["lo"], r["hi"]))
    return lookup_join(certs.where(bound).select(*keys, "der"), wanted, keys, "left_semi")


def parse_dump(spark, path: str, fields: DataFrame) -> DataFrame:
    """The twelve parsed columns of a dump; ``fields`` holds certificate fields by fingerprint."""
    return parsed_rows(decode_entries(read_dump(spark, path)), fields)


def check_root(logs: DataFrame, log_roots: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Coverage per log, and the summary row."""
    coverage = rt.root_coverage(logs, log_roots, target)
    return coverage, rt.root_summary(coverage)
