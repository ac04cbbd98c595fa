"""Length buckets with least padding, and token-budget batches inside each bucket.

A dynamic program over the global histogram of lengths chooses the bucket
boundaries, exactly: the histogram is a grouped count of every distinct length, and
each step of the program keeps the lower hull of its choices, so it takes time in
proportion to the number of lengths. Different lengths are few (hundreds of thousands
of them would need documents of as many tokens). Only beyond the documented bound
``PackOptions.cells`` do neighbouring lengths share a cell, which keeps the driver's
table bounded; each cell then has its exact count, sum and largest length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from certmill.plans.numbering import number_within
from certmill.session import stored


@dataclass(frozen=True)
class PackOptions:
    """``buckets`` at most, batches of at most ``budget`` tokens with padding.

    Boundaries are optimal up to ``cells`` different lengths; beyond, for cells of lengths.
    """

    buckets: int = 16
    budget: int = 65_536
    cells: int = 1 << 18


def word_count(text: Column) -> Column:
    """White-space separated tokens of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def length_histogram(lengths: DataFrame, cells: int = PackOptions.cells) -> list[tuple[int, int, int]]:
    """(largest length, count, sum) of each length, or of each of at most ``cells`` ranges of lengths, by length."""
    n = F.col("n_tokens")
    exact = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c"))
    rows = exact.limit(cells + 1).collect()
    if len(rows) <= cells:
        return sorted((r["n_tokens"], r["c"], r["n_tokens"] * r["c"]) for r in rows)
    # Ranges of equal ratio: as many as there may be, over the 64 doublings a length can have.
    cell = F.floor(F.log2(n + 1) * (cells // 64))
    rows = exact.groupBy(cell.alias("cell")).agg(F.max(n).alias("m"), F.sum("c").alias("c"), F.sum(n * F.col("c")).alias("s")).collect()
    return sorted((r["m"], r["c"], r["s"]) for r in rows)


def best_boundaries(cells: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets, with the least total padding over the cells.

    A bucket of cells i to j-1 costs top * (count[j] - count[i]) - (total[j] - total[i]). As a
    function of its top each start i is a line of slope -count[i]; starts come by falling slope
    and tops by rising value, so the lowest lines form a hull that is walked once. Whole numbers
    throughout. Of equal choices the earliest start stands.
    """
    n = len(cells)
    if not n:
        return []
    top = [c[0] for c in cells]
    count, total = [0], [0]
    for _, c, s in cells:
        count.append(count[-1] + c)
        total.append(total[-1] + s)
    best: list[int | None] = [0, *[None] * n]
    back = []
    for _ in range(min(buckets, n)):
        new: list[int | None] = [None] * (n + 1)
        start = [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []
        at = 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                line = (-count[j - 1], best[j - 1] + total[j - 1], j - 1)
                while len(hull) - at >= 2:
                    (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                    if (line[1] - b1) * (m1 - m2) >= (b2 - b1) * (m1 - line[0]):
                        break
                    hull.pop()
                hull.append(line)
            if at == len(hull):
                continue
            x = top[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            m, b, start[j] = hull[at]
            new[j] = m * x + b + x * count[j] - total[j]
        back.append((new, start))
        best = new
    k = min((i for i, (new, _) in enumerate(back) if new[n] is not None), key=lambda i: back[i][0][n])
    bounds, j = [], n
    while j > 0:
        bounds.append(top[j - 1])
        j = back[k][1][j]
        k -= 1
    return bounds[::-1]


def pack(
    docs: DataFrame, opts: PackOptions = PackOptions(), doc_id: str = "doc_id", length: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, bucket, padded_to, batch, slot, batch_capacity``.

    A batch holds documents of one bucket, each padded to ``padded_to`` tokens, at
    most ``budget`` in all. A document longer than the budget is whole, in a batch of
    its own bucket size. ``batch`` counts from 0 within a bucket. Null ids come
    first, repeated rows are rows of their own, an empty table has no batches. The columns ``keep`` of
    ``docs`` follow under their names, which must not be those above; rows of a batch then lie together.

    Rows are numbered without the kept columns, since a range of rows has no bound in bytes
    (all long texts share a bucket); these meet their numbers by a row key and are dealt by batch, which has one.
    """
    size = word_count(F.col("text")) if length is None else length
    kept = F.struct(*[F.col(c) for c in keep]).alias("kept")
    key = F.monotonically_increasing_id().alias("row")
    lengths = stored(docs.select(F.col(doc_id).alias("doc_id"), size.alias("n_tokens"), *([kept, key] if keep else [])), "lengths")
    bounds = best_boundaries(length_histogram(lengths, opts.cells), opts.buckets) or [0]
    ends = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.size(F.filter(ends, lambda b: b < F.col("n_tokens")))
    placed = lengths.drop("kept").withColumn("bucket", bucket)
    numbered = number_within(placed, "bucket", ["doc_id", "n_tokens"], "no")
    padded = F.element_at(ends, F.col("bucket") + 1)
    fits = F.greatest(F.lit(1), F.expr(f"{opts.budget} div greatest(padded_to, 1)"))
    batches = (
        numbered.withColumn("padded_to", padded)
        .withColumn("batch_capacity", fits.cast("long"))
        .withColumn("batch", F.expr("(no - 1) div batch_capacity"))
        .withColumn("slot", (F.col("no") - 1) % F.col("batch_capacity"))
    )
    shown = ["doc_id", "n_tokens", "bucket", "padded_to", "batch", "slot", "batch_capacity"]
    if not keep:
        return batches.select(*shown)
    whole = lengths.select("row", "kept").join(batches.select("row", *shown), "row")
    return whole.repartition("bucket", "batch").select(*shown, *[f"kept.{c}" for c in keep])
