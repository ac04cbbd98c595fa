"""Places of pattern matches in texts, and digests of them, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPAN = "struct<start:int,no:int,end:int,kind:string,match:string>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"


# Arrays are summed in blocks of this many, so work grows with their length, not its square.
BLOCK = 256
# Texts are cut in pieces of this many characters, so that a place is found without reading up to it.
PIECE = 1000


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before_each(xs: Column, value: Callable[[Column], Column], merge: Callable[[Column, Column], Column]) -> Column:
    """For each element the merged values of all elements before it, 0 before the first.

    ``value`` is a whole number not below 0, ``merge`` a sum or a maximum. Blocks are
    merged first, then places inside each block.
    """
    none = F.expr("cast(array() as array<int>)")

    def inside(block: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct(merge(acc["at"], value(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(block, begin, step)

    def joined(blocks: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
        step = lambda acc, b: F.struct(merge(acc["at"], b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        starts = F.aggregate(blocks, begin, step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: F.transform(b["out"], lambda a: merge(s, a))))

    last = F.floor((F.size(xs) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: inside(F.slice(xs, i * BLOCK + 1, F.lit(BLOCK))))
    return bound(blocks, joined)


def pieces(text: Column) -> Column:
    """The text as an array of pieces of equal length, for :func:`cut`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` up to ``end`` of a text in pieces; nothing where ``end`` is not above ``start``."""
    first = F.floor(start / PIECE).cast("int")
    count = F.floor((end - 1) / PIECE).cast("int") - first + 1
    near = F.array_join(F.slice(parts, first + 1, F.greatest(count, F.lit(0))), "")
    return F.when(end > start, F.substring(near, start % PIECE + 1, end - start)).otherwise("")


def match_spans(text: Column, pattern: str, kind: str, no: int, likely: Column | None = None) -> Column:
    """Leftmost non-overlapping matches with start and end in code points, end exclusive.

    The pieces between matches and the matches alternate, so the sums of their
    lengths are the places. ``no`` orders kinds that start together. Texts that
    are not ``likely`` to match, by a cheap test, are not searched.
    """
    # The last gap follows the last match and has none itself.
    found = F.filter(F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")
    ), lambda x: x["match"].isNotNull())

    def span(x: Column, before: Column) -> Column:
        begin = before + F.length(x["gap"])
        return F.struct(
            begin.alias("start"), F.lit(no).alias("no"), (begin + F.length(x["match"])).alias("end"),
            F.lit(kind).alias("kind"), x["match"].alias("match"),
        )

    def placed(xs: Column) -> Column:
        ends = before_each(xs, lambda x: F.length(x["gap"]) + F.length(x["match"]), lambda a, b: a + b)
        return F.when(F.size(xs) > 0, F.zip_with(xs, ends, span))

    spans = bound(found, placed)
    return F.coalesce(spans if likely is None else F.when(likely, spans), F.expr(NO_SPANS))


def in_order(*groups: Column) -> Column:
    """All spans by start, then kind."""
    return F.sort_array(F.concat(*groups))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(spans: Column) -> Column:
    return F.sha2(listed(spans), 256)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
