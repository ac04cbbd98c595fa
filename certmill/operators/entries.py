"""Log entries: from raw dump rows to certificate bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from certmill.functions import framing as fr
from certmill.functions.fields import missing
from certmill.operators import scan
from certmill.plans.joins import lookup_join, with_kept
from certmill.schemas import PARSED_COLUMNS
from certmill.session import stored


def decode_entries(entries: DataFrame) -> DataFrame:
    """Add ``timestamp_ms``, ``timestamp_utc``, ``entry_type``, ``der`` and ``error``.

    A refused entry keeps its row, with null bytes and the reason in ``error``.
    """
    leaf, extra = F.col("_leaf"), F.col("_extra")
    ms = fr.leaf_timestamp(leaf)
    # The generator keeps later filters from repeating the base64 step; one step per
    # level of framing keeps every expression small enough to be compiled.
    packed = F.struct(
        fr.from_base64(F.col("entry.leaf_input")).alias("_leaf"),
        fr.from_base64(F.coalesce(F.col("entry.extra_data"), F.lit(""))).alias("_extra"),
    )
    return (
        entries.select("*", F.inline(F.array(packed)))
        .withColumn("_head", fr.header_error(leaf))
        .withColumn("_data", F.when(F.col("_head").isNull(), fr.payload(leaf, extra)))
        .withColumn("_size", fr.payload_size(F.col("_data")))
        .withColumn("timestamp_ms", ms)
        .withColumn("entry_type", fr.entry_type(leaf))
        .withColumn(
            "error",
            F.coalesce(
                F.col("_head"),
                fr.payload_error(F.col("_data"), F.col("_size"), F.col("entry_type") == 1),
            ),
        )
        .select(
            *entries.columns,
            "timestamp_ms",
            fr.millis_to_iso(F.col("timestamp_ms")).alias("timestamp_utc"),
            "entry_type",
            F.when(F.col("error").isNull(), F.substring(F.col("_data"), 4, F.col("_size"))).alias("der"),
            "error",
        )
    )


def index_slice(entries: DataFrame, start: int, end: int) -> DataFrame:
    """Entries of the closed index range; the range reaches the Parquet scan."""
    if start < 0 or end < start:
        raise ValueError(f"invalid range: {start}..{end}")
    return entries.where(F.col("index").between(start, end))


def decode_audit(decoded: DataFrame, tree_sizes: DataFrame, batch_size: int) -> DataFrame:
    """Per log and scan batch: received, parsed, unparsed, running parsed total, position in percent.

    The batches are counted before anything is ordered, so the running total
    sorts one row per batch; they are stored, so entries are read once. It is built in two steps, sums within blocks of
    batches and sums of whole blocks, so that one huge log is not one task.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be > 0")
    batches = stored(
        scan.with_scan_position(decoded, tree_sizes, batch_size, index="index")
        .groupBy("log_uri", "tree_size", "scan_batch")
        .agg(
            F.count(F.lit(1)).alias("received"),
            F.count_if(F.col("error").isNull()).alias("parsed"),
            F.count_if(F.col("error").isNotNull()).alias("unparsed"),
        )
        .withColumn("_block", F.floor(F.col("scan_batch") / 100_000)),
        "batches",
    )
    inside = W.partitionBy("log_uri", "_block").orderBy("scan_batch")
    before = W.partitionBy("log_uri").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        batches.groupBy("log_uri", "_block")
        .agg(F.sum("parsed").alias("_sum"))
        .select("log_uri", "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    )
    first = F.greatest(F.lit(0), F.col("tree_size") - (F.col("scan_batch") + 1) * batch_size)
    return (
        batches.withColumn("_run", F.sum("parsed").over(inside))
        .join(blocks, ["log_uri", "_block"])
        .select(
            "log_uri", "scan_batch", "received", "parsed", "unparsed",
            (F.col("_base") + F.col("_run")).alias("total_parsed"),
            (first / F.col("tree_size") * F.lit(100.0)).alias("position_pct"),
        )
    )


def entry_coverage(entries: DataFrame, tree_sizes: DataFrame, index: str = "index") -> DataFrame:
    """Per log what a read of its entries holds and lacks, and what no scan sees.

    ``received`` rows, ``distinct_indices`` below the tree size, ``repeated`` rows of an index
    that was there already, ``missing`` indices, ``beyond_tree`` rows at or above the size, ``no_size`` rows of a log
    without one. Logs with a size and no row are there too.
    """
    rows = entries.groupBy("log_uri", F.col(index).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    sized = lookup_join(rows, tree_sizes.select("log_uri", "tree_size"), "log_uri", "left")
    inside, n = F.coalesce(F.col("i") < F.col("tree_size"), F.lit(False)), F.col("n")
    counts = sized.groupBy("log_uri").agg(
        F.sum("n").alias("received"), F.count_if(inside).alias("distinct_indices"),
        F.sum(F.when(inside, n - 1).otherwise(0)).alias("repeated"),
        F.sum(F.when(F.col("tree_size").isNotNull() & ~inside, n).otherwise(0)).alias("beyond_tree"),
        F.sum(F.when(F.col("tree_size").isNull(), n).otherwise(0)).alias("no_size"),
    )
    zero = [c for c in counts.columns if c != "log_uri"]
    every = counts.join(tree_sizes.select("log_uri", "tree_size"), "log_uri", "full").fillna(0, zero)
    return every.withColumn("missing", F.coalesce(F.col("tree_size") - F.col("distinct_indices"), F.lit(0)))


def missing_ranges(entries: DataFrame, tree_sizes: DataFrame, index: str = "index", block: int = 1_000_000) -> DataFrame:
    """Closed ranges of the indices below the tree size that no row of ``entries`` has: ``log_uri, first_missing, last_missing``.

    Gaps inside blocks of ``block`` indices come from a window over each block; those between
    blocks from one row per block, so that a huge log is many tasks.
    """
    i, size = F.col("i"), F.col("tree_size")
    held = lookup_join(entries.select("log_uri", F.col(index).alias("i")), tree_sizes.select("log_uri", "tree_size"), "log_uri", "inner")
    held = stored(held.where(i < size).select("log_uri", "i").distinct().withColumn("block", F.floor(i / block)), "held-indices")
    before = F.lag("i").over(W.partitionBy("log_uri", "block").orderBy("i"))
    inside = held.withColumn("before", before).where(i - F.col("before") > 1).select(
        "log_uri", (F.col("before") + 1).alias("first_missing"), (i - 1).alias("last_missing")
    )
    ends = held.groupBy("log_uri", "block").agg(F.min("i").alias("low"), F.max("i").alias("high"))
    # The end of the tree is a block of its own.
    last = tree_sizes.select("log_uri", F.lit(2**62).alias("block"), size.alias("low"), size.alias("high"))
    earlier = F.coalesce(F.lag("high").over(W.partitionBy("log_uri").orderBy("block")), F.lit(-1))
    between = ends.unionByName(last).withColumn("before", earlier).where(F.col("low") - F.col("before") > 1).select(
        "log_uri", (F.col("before") + 1).alias("first_missing"), (F.col("low") - 1).alias("last_missing")
    )
    return inside.unionByName(between)


def parsed_rows(decoded: DataFrame, certs: DataFrame) -> DataFrame:
    """Decoded entries with the certificate fields that ``certs`` holds for the same bytes.

    Every entry that was not refused has a row; without fields its texts are the
    sentinel, its ``san`` is empty and ``fields_known`` is false. The field side is made
    unique and stored, so Spark knows its size: a small one is broadcast, with a large one
    both sides are shuffled on the digest, and adaptive execution splits a digest that very many entries
    share. Entries are decoded once, when the frame is used; building it reads the field side alone.
    """
    # Refused entries have no digest.
    good = with_kept(decoded, "fingerprint", fr.fingerprint(F.col("der")), lambda d: d.isNotNull())
    fields = [
        "issuer_cn", "issuer_org", "subject_cn", "subject_org", "not_before", "not_after", "san",
    ]
    known = stored(certs.groupBy("fingerprint").agg(F.min(F.struct(*fields)).alias("_f")), "cert-fields")
    joined = good.join(known, "fingerprint", "left").select("*", "_f.*")
    known_text = {c: F.when(F.col("_f").isNull(), missing(F.col(c))).otherwise(F.col(c)) for c in fields[:-1]}
    no_names = F.array().cast("array<string>")
    return (
        joined.withColumns(known_text)
        .withColumn("san", F.when(F.col("_f").isNull(), no_names).otherwise(F.col("san")))
        .withColumn("domain", F.coalesce(F.get("san", F.lit(0)), F.lit("")))
        .withColumn("cert_der_b64", fr.to_base64(F.col("der")))
        .select(*PARSED_COLUMNS, F.col("_f").isNotNull().alias("fields_known"))
    )


def parsed_first(decoded: DataFrame, certs: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` parsed rows by index: the limit is taken before the fields are joined."""
    first = stored(decoded.where(F.col("error").isNull()).orderBy("index").limit(limit), "first-entries")
    asked = first.select(fr.fingerprint(F.col("der")).alias("fingerprint")).distinct()
    return parsed_rows(first, lookup_join(certs, asked, "fingerprint", "left_semi")).orderBy("index")


def parse_limit(parsed: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` parsed rows by index."""
    return parsed.orderBy("index").limit(limit)
