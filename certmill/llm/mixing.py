"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Sources share all words by weight, none above a multiple of its own words. Of all
rates for a source's documents that give its target, those nearest to 1 in relative
entropy are ``exp(a * size)``, held to the cap, for one number ``a`` of the source: the
solution of a convex dual, found by Newton steps on the logarithm of the words taken and
kept inside a bracket. A step reads only the numbers of documents of each size, and sums
whole numbers, so no order of rows changes a bit of the result.

Rates become copies size by size, longest first: running sums of rates are rounded, so a
source misses its target by half of its longest document at most, and one size of each
power of two then takes up what is missing. The copies of a size go to its documents
evenly, the rest by a hash of their ids.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from certmill.plans.joins import lookup_join
from certmill.plans.numbering import number_rows
from certmill.session import stored

WEIGHTS = (5, 2, 1)
CAP = 3
# Rates are whole numbers of this part.
PART = 1_000_000_000
MAX_STEPS = 64


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def _wide(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(38,0)")


def _whole(x: int) -> Column:
    return _wide(F.lit(Decimal(x)))


def with_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sources`` (``key, source_size``) with ``capped`` and ``target``.

    Weights repeat in the order of keys. A source above ``cap`` times its size is held
    there, and the others share the rest by weight until none is above.
    """
    turn = F.pmod(F.col("index") - 1, F.lit(len(weights))).cast("int")
    rows = stored(number_rows(sources, ["key"]).withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), turn)).drop("index"), "sources")
    r = rows.agg(F.sum(_wide("source_size")).alias("words"), F.sum(_wide("weight")).alias("weight")).first()
    words, weight = int(r["words"] or 0), int(r["weight"] or 1)
    rest, shared = words, weight
    while True:
        over = _wide("weight") * _whole(rest) > _wide("source_size") * _whole(cap * shared)
        r = rows.filter(over).agg(F.sum(_wide("source_size")).alias("words"), F.sum(_wide("weight")).alias("weight")).first()
        now = words - cap * int(r["words"] or 0), weight - int(r["weight"] or 0)
        if now == (rest, shared) or not now[1]:
            break
        rest, shared = now
    share = (_wide("weight") * _whole(rest)).cast("double") / F.lit(float(shared))
    return rows.withColumn("capped", over | (F.col("source_size") == 0)).withColumn(
        "target", F.when(over, (F.col("source_size") * cap).cast("double")).otherwise(share)
    )


def _rate(a: Column, size: Column, cap: int) -> Column:
    """The rate in parts; without ``a`` it is the cap."""
    return F.coalesce(F.floor(F.least(F.lit(float(cap)), F.exp(a * size)) * PART + 0.5).cast("long"), F.lit(cap * PART))


def _mean(x: Column, y: Column) -> Column:
    """Between two numbers of one sign, by ratio."""
    return F.when(x < 0, -F.sqrt(x * y)).otherwise(F.sqrt(x * y))


def solve_dual(sizes: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """``key, a`` of each source; ``a`` is null where all rates are the cap.

    ``sizes`` holds ``key, size, n``; ``sources`` comes from :func:`with_targets`, with the
    smallest and largest size above 0, ``least`` and ``most``, and the sum of squares.
    """
    ratio = F.ln(F.col("target") / F.col("source_size"))
    # All rates are at least exp(a * most) and at most exp(a * least), or the other way round.
    low = F.when(ratio < 0, ratio / F.col("least")).otherwise(ratio / F.col("most"))
    high = F.when(ratio < 0, ratio / F.col("most")).otherwise(F.ln(F.lit(float(cap))) / F.col("least"))
    first = ratio * F.col("source_size") / F.col("squares").cast("double")
    open_ = sources.filter("not capped").select("key", "target", low.alias("low"), high.alias("high"), first.alias("a"))
    open_ = stored(open_.withColumn("a", F.greatest("low", F.least("a", "high"))), "dual")
    done = [sources.filter("capped").select("key", F.lit(None).cast("double").alias("a"))]
    for _ in range(MAX_STEPS):
        if open_.isEmpty():
            break
        held = lookup_join(sizes, open_, "key", "inner").withColumn("rate", _rate(F.col("a"), F.col("size"), cap))
        words = _wide("n") * _wide("size") * _wide("rate")
        sums = held.groupBy(*open_.columns).agg(
            F.sum(words).alias("words"),
            F.sum(F.when(F.col("rate") < cap * PART, _wide("n") * _wide("size") * _wide("size") * _wide("rate")).otherwise(_whole(0))).alias("slope"),
        )
        taken = F.col("words").cast("double") / PART
        above = taken > F.col("target")
        sums = sums.withColumn("low", F.when(above, F.col("low")).otherwise(F.col("a"))).withColumn(
            "high", F.when(above, F.col("a")).otherwise(F.col("high"))
        )
        newton = F.col("a") - F.ln(taken / F.col("target")) * F.col("words").cast("double") / F.expr("nullif(cast(slope as double), 0)")
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        after = F.when(inside, newton).otherwise(_mean(F.col("low"), F.col("high")))
        near = F.abs(taken - F.col("target")) <= 0.5 + 1e-7 * F.col("target")
        near = near | (F.col("high") - F.col("low") <= 1e-14 * F.abs("high"))
        step = stored(sums.select("key", "target", "low", "high", F.when(near, F.col("a")).otherwise(after).alias("a"), near.alias("near")), "dual")
        done.append(step.filter("near").select("key", "a"))
        open_ = step.filter("not near").drop("near")
    return reduce(DataFrame.unionByName, [*done, open_.select("key", "a")])


def copies_of_sizes(sizes: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """``sizes`` with ``copies``, the copies that all documents of one source and size take together."""
    dual = stored(solve_dual(sizes, sources, cap), "dual")
    target = F.round("target").cast("long").alias("aim")
    rated = lookup_join(sizes, dual.join(sources.select("key", target), "key"), "key", "inner")
    rated = rated.withColumn("parts", F.when(F.col("size") > 0, _wide("n") * _wide(_rate(F.col("a"), F.col("size"), cap))).otherwise(_whole(0)))
    upto = F.sum("parts").over(W.partitionBy("key").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, W.currentRow))
    rounded = rated.withColumn("upto", upto).withColumn(
        "copies", F.expr(f"(upto + {PART // 2}) div {PART} - (upto - parts + {PART // 2}) div {PART}")
    )
    rounded = stored(rounded.select("key", "size", "n", "copies", "aim"), "copies")
    # Of each power of two the largest size with room for more copies, and with copies to give.
    room = F.when(F.col("size") > 0, F.col("n") * cap - F.col("copies"))
    octaves = rounded.groupBy("key", F.length(F.bin("size")).alias("octave")).agg(
        F.max(F.when(room > 0, F.struct("size", room.alias("room")))).alias("up"),
        F.max(F.when((F.col("copies") > 0) & (F.col("size") > 0), F.struct("size", F.col("copies").alias("room")))).alias("down"),
        F.sum(_wide("copies") * _wide("size")).alias("words"), F.first("aim").alias("aim"),
    )
    missing = F.col("aim") - F.col("words").cast("long")

    def take(acc: Column, x: Column) -> Column:
        c = F.least(x["room"], F.call_function("div", acc["left"], x["size"]))
        change = F.filter(F.array(F.struct(x["size"].alias("size"), c.alias("by"))), lambda y: y["by"] > 0)
        return F.struct((acc["left"] - c * x["size"]).alias("left"), F.concat(acc["out"], change).alias("out"))

    # At most 63 octaves of a source.
    sums = octaves.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("octave")).alias("no"), "up", "down"))).alias("octaves"),
        F.sum("words").alias("words"), F.first("aim").alias("aim"),
    )
    side = F.filter(
        F.transform("octaves", lambda o: F.when(missing > 0, o["up"]).otherwise(o["down"])), lambda o: o.isNotNull()
    )
    begin = F.struct(F.abs(missing).alias("left"), F.expr("cast(array() as array<struct<size:bigint,by:bigint>>)").alias("out"))
    changes = sums.select("key", missing.alias("missing"), F.explode(F.aggregate(side, begin, take, lambda acc: acc["out"])).alias("c"))
    changes = stored(changes.select("key", "c.size", F.when(F.col("missing") > 0, F.col("c.by")).otherwise(-F.col("c.by")).alias("by")), "changes")
    return lookup_join(rounded, changes, ["key", "size"], "left").select(
        "key", "size", "n", (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies")
    )


def mix(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
    weights: Sequence[int] = WEIGHTS, cap: int = CAP,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    ``size`` counts words, cut at space, tab and line ends; ``copies`` (0 to ``cap``) is how often the mix takes
    the document, ``taken`` the words it takes by that, ``target`` the words its source should
    give. Sources are ordered by code point, null is a source of its own and the last one.
    A null text is empty and, like every text without words, takes no copies. Equal sizes
    of a source are dealt by a hash of the id, so repeated rows may differ by one copy.
    The result depends on the rows alone, not on their order or partitions. Other columns are not read.
    """
    key = F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"))
    sized = stored(docs.select(F.col(doc_id).alias("doc_id"), key.alias("key"), count_words(F.col(text)).alias("size")), "sizes")
    sizes = stored(sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    full = F.when(F.col("size") > 0, F.col("size"))
    totals = sizes.groupBy("key").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.min(full).alias("least"), F.max(full).alias("most"),
        F.sum(_wide("size") * _wide("size") * _wide("n")).alias("squares"),
    )
    sources = stored(with_targets(totals, weights, cap), "targets")
    plan = copies_of_sizes(sizes, sources, cap)
    # Rows of one size and source in the order of a hash; what is equal in all that is dealt alike.
    rows = sized.select("*", F.xxhash64("doc_id").alias("h"), F.monotonically_increasing_id().alias("at"))
    numbered = number_rows(rows, ["key", "size", "h", "doc_id", "at"])
    # The first number of each group is one more than the rows before it.
    firsts = numbered.groupBy("key", "size").agg(F.min("index").alias("first"))
    dealt = lookup_join(numbered, stored(plan.join(firsts, ["key", "size"]), "dealt"), ["key", "size"], "left")
    dealt = lookup_join(dealt, sources.select("key", "source_size", "target"), "key", "left")
    each = F.expr("copies div n") + F.when(F.col("index") - F.col("first") < F.col("copies") % F.col("n"), 1).otherwise(0)
    return dealt.withColumn("copies", each.cast("long")).select(
        "doc_id", F.when(~F.col("key.none"), F.col("key.name")).alias("source"), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )
