"""The list of known logs: filters, intervals, operators, groupings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from certmill.plans.joins import MAX_ROWS, fits_broadcast, lookup_join
from certmill.schemas import DASH
from certmill.session import stored

# Default start of an open interval, operator of a log outside the list.
FIRST_DAY = date(2013, 1, 1)
MANUAL = "manual"

# A range join deals its pairs to tasks as blocks of about so many rows of each side.
BLOCK_ROWS = 4096
MAX_TASKS = 10_000


def slash_url(url: Column) -> Column:
    """The URL with exactly one trailing slash."""
    return F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/"))


def log_date(text: Column) -> Column:
    """A day from the first ten characters; null for missing and unreadable text."""
    head = F.substring(text, 1, 10)
    return F.when(head.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def contact(emails: Column) -> Column:
    return F.when(F.size(emails) > 0, F.array_join(emails, ", ")).otherwise(F.lit(DASH))


def usable_only(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("state") == "usable")


def url_present(logs: DataFrame) -> DataFrame:
    """Logs with a URL, which gets one trailing slash."""
    return logs.where(F.trim("url") != "").withColumn("url", slash_url(F.col("url")))


def _overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """[start, end) meets the closed [lo, hi]; a log without start never does, without end it is open."""
    return (start <= hi) & (end.isNull() | (end > lo))


def interval_overlap(logs: DataFrame, lo: date, hi: date) -> DataFrame:
    if lo > hi:
        raise ValueError("start date must be on or before end date")
    return logs.where(
        _overlaps(log_date(F.col("start")), log_date(F.col("end")), F.lit(lo), F.lit(hi))
    )


def overlap_join(intervals: DataFrame, logs: DataFrame, slot_days: int = 366) -> DataFrame:
    """Every (interval, log) that meet; ``intervals`` has DATE columns ``interval_from`` and ``interval_to``.

    A range join over slots of days: both sides name the slots they touch and
    are joined on the slot, so the join is an equi join that shuffles on a key.
    A pair is kept only in the first slot that both touch, so none is repeated.
    Slots are few and each holds many pairs, so :func:`_slot_pairs` deals them to
    tasks by their number, not by their slot.
    """
    def slots(lo: Column, hi: Column) -> Column:
        zero = F.lit(date(1970, 1, 1))
        return F.sequence(
            F.floor(F.datediff(lo, zero) / slot_days), F.floor(F.datediff(hi, zero) / slot_days)
        )

    dated = logs.withColumn("_s", log_date(F.col("start"))).withColumn("_e", log_date(F.col("end")))
    dated = dated.where(F.col("_s").isNotNull())
    # A log without end reaches the last day that any interval asks for.
    last = intervals.agg(F.max("interval_to")).first()[0]
    if last is None:
        return intervals.join(dated.drop("_s", "_e").limit(0), F.lit(False), "inner")
    dated = dated.where(F.col("_s") <= F.lit(last)).withColumn(
        "_hi", F.least(F.coalesce("_e", F.lit(last)), F.lit(last))
    )
    left = intervals.withColumn("_slots", slots(F.col("interval_from"), F.col("interval_to")))
    right = dated.where(F.col("_hi") >= F.col("_s")).withColumn(
        "_lslots", slots(F.col("_s"), F.col("_hi"))
    )
    left = left.select("*", F.explode("_slots").alias("_slot"), F.get("_slots", F.lit(0)).alias("_a"))
    right = right.select("*", F.explode("_lslots").alias("_slot"), F.get("_lslots", F.lit(0)).alias("_b"))
    met = _slot_pairs(left.drop("_slots"), right.drop("_lslots", "_hi")).where(
        _overlaps(F.col("_s"), F.col("_e"), F.col("interval_from"), F.col("interval_to"))
        & (F.col("_slot") == F.greatest("_a", "_b"))
    )
    return met.drop("_slot", "_a", "_b", "_s", "_e")


def _slot_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """The inner join on ``_slot``, each task with about the pairs of two blocks.

    The smaller side is broadcast if it is proven small, and the rows of the other are dealt
    evenly. Else the rows of a slot are cut into blocks on both sides, each block
    is copied for every block of the other side, and two blocks that meet are one key.
    """
    def per_slot(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy("_slot").agg(F.count(F.lit(1)).alias(n))

    # Sums are doubles: pairs of two large tables pass BIGINT.
    size = per_slot(left, "l").join(per_slot(right, "r"), "_slot", "full").agg(
        F.sum(F.col("l").cast("double") * F.col("r")).alias("pairs"), F.sum("l").alias("l"),
        F.sum("r").alias("r"), F.max("l").alias("most_l"), F.max("r").alias("most_r"),
    ).first()
    rows_l, rows_r = size["l"] or 0, size["r"] or 0
    tasks = int((size["pairs"] or 0) // BLOCK_ROWS**2) + 1

    def dealt(df: DataFrame, rows: int) -> DataFrame:
        return df if tasks == 1 else df.repartition(min(max(tasks, rows // MAX_ROWS + 1), MAX_TASKS))

    if rows_l <= rows_r and fits_broadcast(left):
        return F.broadcast(left).join(dealt(right, rows_r), "_slot")
    if fits_broadcast(right):
        return dealt(left, rows_l).join(F.broadcast(right), "_slot")
    keys = ["_slot", "_block_l", "_block_r"]
    blocks_l, blocks_r = (-(-(n or 1) // BLOCK_ROWS) for n in (size["most_l"], size["most_r"]))

    def blocked(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        # Stored, so a task that runs again finds its rows in the same blocks, and equal rows need not share one.
        cut = stored(df.withColumn(own, F.floor(F.rand() * n).cast("int")), own.strip("_"))
        copies = cut.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        return copies.repartition(min(max(tasks, (rows_l + rows_r) // MAX_ROWS + 1), MAX_TASKS), *keys)

    return blocked(left, "_block_l", blocks_l, "_block_r", blocks_r).join(
        blocked(right, "_block_r", blocks_r, "_block_l", blocks_l), keys
    ).drop("_block_l", "_block_r")


def select_logs(
    logs: DataFrame,
    today: date,
    lo: date | None = None,
    hi: date | None = None,
    any_state: bool = False,
) -> DataFrame:
    """Logs to scan for an interval, newest start first, then description, both descending."""
    kept = logs if any_state else usable_only(logs)
    met = interval_overlap(url_present(kept), lo or FIRST_DAY, hi or today)
    return met.orderBy(log_date(F.col("start")).desc(), F.col("description").desc())


def contact_map(logs: DataFrame, operators: DataFrame) -> DataFrame:
    """Add ``contact``, the operator's addresses, to each log."""
    known = operators.select(
        F.col("name").alias("operator"), contact(F.col("emails")).alias("contact")
    )
    return lookup_join(logs, known, "operator").withColumn(
        "contact", F.coalesce("contact", F.lit(DASH))
    )


def log_operator(rows: DataFrame, logs: DataFrame, url: str = "log_uri") -> DataFrame:
    """Add ``operator`` of each row's log by URL, ``manual`` for logs outside the list.

    Of several logs with one URL the first in the list counts.
    """
    known = (
        logs.groupBy(slash_url(F.col("url")).alias("_url"))
        .agg(F.min_by("operator", "pos").alias("operator"))
    )
    return (
        lookup_join(rows.withColumn("_url", slash_url(F.col(url))), known, "_url")
        .withColumn("operator", F.coalesce("operator", F.lit(MANUAL)))
        .drop("_url")
    )


def log_id_index(entries: DataFrame) -> DataFrame:
    """One entry per ``log_id``, the last in document order."""
    rest = [c for c in entries.columns if c != "log_id"]
    return entries.groupBy("log_id").agg(
        F.max_by(F.struct(*rest), "pos").alias("_e")
    ).select("log_id", "_e.*")


def logs_per_operator(operators: DataFrame, logs: DataFrame) -> DataFrame:
    """Operator, contact and number of logs, by lower-case name."""
    counts = logs.groupBy("operator").agg(F.count(F.lit(1)).alias("logs"))
    known = operators.select(
        F.col("name").alias("operator"), contact(F.col("emails")).alias("contact")
    )
    return (
        known.join(counts, "operator", "left")
        .withColumn("logs", F.coalesce("logs", F.lit(0).cast("bigint")))
        .orderBy(F.lower("operator"), "operator")
    )


def _usable_total(logs: DataFrame, *keys: str) -> DataFrame:
    return logs.groupBy(*keys).agg(
        F.count_if(F.col("state") == "usable").alias("usable"), F.count(F.lit(1)).alias("total")
    )


def usable_by_year(logs: DataFrame) -> DataFrame:
    return _usable_total(logs, "year").orderBy(F.desc("year"))


def usable_by_operator(logs: DataFrame) -> DataFrame:
    return _usable_total(logs, "year", "operator").orderBy(F.desc("year"), "operator")


def group_targets(targets: DataFrame) -> DataFrame:
    """Scan targets (``operator``, ``uri``, ``label``) nested by operator, operators in name order."""
    return (
        targets.groupBy("operator")
        .agg(F.array_sort(F.collect_list(F.struct("uri", "label"))).alias("targets"))
        .orderBy("operator")
    )


def log_ranks(logs: DataFrame) -> DataFrame:
    """``log_uri`` and ``log_rank``: operators in name order, newest logs first in each.

    The list of logs is small; a window over all of it is one small task.
    """
    order = W.orderBy(
        "operator", log_date(F.col("start")).desc(), F.col("description").desc(), "url"
    )
    one = logs.groupBy(slash_url(F.col("url")).alias("url")).agg(
        F.min(F.struct("operator", "start", "description")).alias("_l")
    ).select("url", "_l.*")
    return one.select(F.col("url").alias("log_uri"), (F.row_number().over(order) - 1).alias("log_rank"))
