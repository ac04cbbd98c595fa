"""Scan order, batches and hits of a log read backward from its tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from certmill.functions import fields, names as nm
from certmill.operators import rules as rl
from certmill.plans.joins import lookup_join, with_kept
from certmill.session import stored

# Positions of one log stay below 2^40, so log rank and position share one BIGINT.
RANK_SHIFT = 40


def entry_ranges(bounds: DataFrame, batch_size: int) -> DataFrame:
    """Closed ranges of ``batch_size`` indices that cover ``range_start``..``range_end`` of each row."""
    if batch_size <= 0:
        raise ValueError("batch_size must be > 0")
    lo, hi = F.col("range_start"), F.col("range_end")
    bad = F.raise_error(F.concat(F.lit("invalid range: "), lo.cast("string"), F.lit(".."), hi.cast("string")))
    steps = F.sequence(
        F.lit(0).cast("bigint"), F.floor((hi - lo) / batch_size), F.lit(1).cast("bigint")
    )
    checked = F.when((lo < 0) | (hi < lo), bad.cast("array<bigint>")).otherwise(steps)
    keep = [c for c in bounds.columns if c not in ("range_start", "range_end")]
    return bounds.select(*keep, "range_start", "range_end", F.explode(checked).alias("_step")).select(
        *keep,
        (lo + F.col("_step") * batch_size).alias("batch_start"),
        F.least(hi, lo + (F.col("_step") + 1) * batch_size - 1).alias("batch_end"),
    )


def log_ranges(start: int, end: int, batch_size: int, spark) -> DataFrame:
    """``entry_ranges`` of one pair of bounds, checked at once."""
    if batch_size <= 0:
        raise ValueError("batch_size must be > 0")
    if start < 0 or end < start:
        raise ValueError(f"invalid range: {start}..{end}")
    one = spark.range(1).select(
        F.lit(start).cast("bigint").alias("range_start"), F.lit(end).cast("bigint").alias("range_end")
    )
    return entry_ranges(one, batch_size)


def tree_sizes(certs: DataFrame, index: str = "log_index") -> DataFrame:
    """Number of indices of each log, when the log heads are not given.

    One row per log, stored: the table is read once however often it is used.
    """
    return stored(certs.groupBy("log_uri").agg((F.max(index) + 1).alias("tree_size")), "tree-sizes")


def with_scan_position(
    df: DataFrame, sizes: DataFrame, batch_size: int, index: str = "log_index"
) -> DataFrame:
    """Add ``tree_size``, ``scan_batch`` and ``scan_pos`` in closed form.

    Batches run from the tail, indices ascend inside a batch. ``sizes`` has one
    row per log.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be > 0")
    i, n = F.col(index), F.col("tree_size")
    batch = F.floor((n - 1 - i) / batch_size)
    first = F.greatest(F.lit(0).cast("bigint"), n - (F.col("scan_batch") + 1) * batch_size)
    return (
        lookup_join(df, sizes.select("log_uri", "tree_size"), "log_uri", "inner")
        .where(i < n)
        .withColumn("scan_batch", batch)
        .withColumn("scan_pos", F.col("scan_batch") * batch_size + (i - first))
    )


def outside_tree(df: DataFrame, sizes: DataFrame, index: str = "log_index") -> DataFrame:
    """Per log the rows that no scan reads: ``beyond_tree`` at or above the tree size, ``no_size`` without one.

    One row per log that has such rows; an audit that reports them loses none silently.
    """
    joined = lookup_join(df.select("log_uri", index), sizes.select("log_uri", "tree_size"), "log_uri", "left")
    beyond, unknown = F.col(index) >= F.col("tree_size"), F.col("tree_size").isNull()
    return joined.where(beyond | unknown).groupBy("log_uri").agg(
        F.count_if(beyond).alias("beyond_tree"), F.count_if(unknown).alias("no_size")
    )


def ranks_by_url(sizes: DataFrame) -> DataFrame:
    """``log_uri`` and ``log_rank`` in URL order; the list of logs is small by nature."""
    return sizes.select("log_uri").distinct().select(
        "log_uri", (F.row_number().over(W.orderBy("log_uri")) - 1).alias("log_rank")
    )


def scan_order() -> list[Column]:
    """Sort key of one log's scan, logs in URL order."""
    return [F.col("log_uri").asc(), F.col("scan_batch").asc(), F.col("log_index").asc()]


def with_rank(df: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """Add ``ord``: one BIGINT that sorts by log rank, then by scan position.

    Without ``ranks`` (``log_uri``, ``log_rank``) the frame is one log's scan.
    """
    if ranks is None:
        return df.withColumn("ord", F.col("scan_pos"))
    ranked = lookup_join(df, ranks.select("log_uri", "log_rank"), "log_uri", "inner")
    fits = (F.col("scan_pos") < (1 << RANK_SHIFT)) & (F.col("log_rank") < (1 << (62 - RANK_SHIFT)))
    value = F.shiftleft(F.col("log_rank").cast("bigint"), RANK_SHIFT) + F.col("scan_pos")
    return ranked.withColumn(
        "ord",
        F.when(fits, value).otherwise(F.raise_error(F.lit("scan position out of range")).cast("bigint")),
    ).drop("log_rank")


def after_date(df: DataFrame, since: str) -> DataFrame:
    """Certificates whose ``not_before`` text is not below ``since``."""
    return df.where(F.col("not_before") >= F.lit(since))


def with_names(certs: DataFrame) -> DataFrame:
    """Certificates with at least the placeholder name."""
    san = F.when(F.size("san") > 0, F.col("san")).otherwise(F.array(fields.placeholder(F.col("log_index"))))
    return certs.withColumn("san", san)


def _named_certs(certs: DataFrame) -> DataFrame:
    return with_names(certs).withColumn("domains", F.col("san"))


def _options(rules: list[tuple[str, str]] | None) -> Column:
    clean = "CASE WHEN startswith(domain, '*.') THEN substring(domain, 3) ELSE domain END"
    return F.expr(
        f"transform(filter(transform(san, domain -> named_struct('domain', domain, "
        f"'rule_name', {rl.rule_sql(rules)})), x -> x.rule_name IS NOT NULL), "
        f"x -> named_struct('clean', {clean.replace('domain', 'x.domain')}, "
        "'domain', x.domain, 'rule_name', x.rule_name))"
    )


def with_options(certs: DataFrame, rules: list[tuple[str, str]] | None) -> DataFrame:
    """Add ``options``, the names of a certificate that pass the rules, in SAN order; drop rows without one.

    Each option is a struct of ``clean`` (without wildcard), ``domain`` and
    ``rule_name``. The rules run inside the array, so no row is multiplied and
    nothing is shuffled. Rules may use every certificate column and ``domain``;
    the columns of joined facts need :func:`options_from_names`.
    """
    return with_kept(
        _named_certs(certs), "options", _options(rules), lambda o: F.size(o) > 0
    ).drop("domains")


def options_from_names(named: DataFrame, keys: list[str], rules: list[tuple[str, str]] | None) -> DataFrame:
    """``keys`` and ``options`` from one row per (certificate, name) with joined facts.

    Grouping is by certificate; the names of one certificate are a small group.
    """
    hit = rl.rule_column(rules)
    clean = nm.strip_wildcard(F.col("domain"))
    return (
        named.withColumn("rule_name", hit)
        .where(F.col("rule_name").isNotNull())
        .groupBy(*keys)
        .agg(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct("pos", clean.alias("clean"), "domain", "rule_name"))
                ),
                lambda x: F.struct(x["clean"].alias("clean"), x["domain"].alias("domain"),
                                   x["rule_name"].alias("rule_name")),
            ).alias("options")
        )
    )


def first_match(certs: DataFrame, rules: list[tuple[str, str]] | None) -> DataFrame:
    """At most one hit per certificate: the first name in SAN order that passes. No shuffle."""
    verdicts = F.expr(f"transform(san, domain -> {rl.rule_sql(rules)})")
    # The first verdict that is not null, and its place.
    found = F.expr("filter(transform(_v, (v, i) -> named_struct('i', i, 'rule_name', v)), x -> x.rule_name IS NOT NULL)")
    kept = with_kept(
        _named_certs(certs), "_v", verdicts, lambda v: F.exists(v, lambda r: r.isNotNull())
    )
    return (
        kept.withColumn("_hit", F.get(found, F.lit(0)))
        .withColumn("domain", F.get("san", F.col("_hit.i")))
        .withColumn("rule_name", F.col("_hit.rule_name"))
        .drop("_hit", "_v", "domains")
    )


def target_limit(hits: DataFrame, target: int) -> DataFrame:
    """The first ``target`` hits in scan order."""
    return hits.orderBy(*scan_order()).limit(target)
