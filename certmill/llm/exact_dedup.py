"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A normalised text is cut into blocks of a fixed number of bytes. A block's name
is a pair of integers: a 64-bit key of its bytes, and its rank among the sorted
distinct blocks of that key. Pairs of neighbouring names are named in the same
way, level by level, until each document has one name. Two documents of equal
length have equal names exactly when their texts are equal: no hash is trusted,
since every level sorts the distinct contents that share a key apart.

Keys are computed where the text is read, and ranks above 0 exist only where two
contents share a key, so names need no join on the contents: a text that a third
of all rows hold is a third of the rows of no task. The distinct blocks are the
one large shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from certmill.plans.joins import lookup_join
from certmill.session import stored

BLOCK_BYTES = 2048


def normalised(text: Column) -> Column:
    """The text with each run of space, tab and line ends replaced by one space; null is empty.

    The pattern skips single spaces, which stay as they are.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r][\x20\t-\r]*|\x20[\x20\t-\r]+", " ")


def hash_key(*content: Column) -> Column:
    return F.xxhash64(*content)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document: ``doc_id`` and the normalised bytes, computed once."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.explode(F.array(F.encode(normalised(F.col(text)), "UTF-8"))).alias("bytes")
    )


def _starts(block: int) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.octet_length("bytes"), F.lit(1)), F.lit(block))


def _ranks(parts: DataFrame, content: list[str]) -> DataFrame | None:
    """Ranks above 0 of the contents that share a key with a smaller one; None where no key is shared."""
    distinct = parts.select("key", *content).distinct()
    shared = distinct.groupBy("key").count().filter("count > 1").select("key")
    if shared.agg(F.count(F.lit(1))).first()[0] == 0:
        return None
    order = W.partitionBy("key").orderBy(*content)
    ranked = lookup_join(distinct, stored(shared, "shared-keys"), "key", "left_semi").withColumn(
        "rank", F.row_number().over(order) - 1
    )
    return stored(ranked.filter("rank > 0"), "block-ranks")


def _named_apart(rows: DataFrame, ranks: DataFrame, content: list[str]) -> DataFrame:
    """Rows with one part each back to one row per document, with the ranks put in."""
    joined = lookup_join(rows, ranks, ["key", *content], "left")
    return joined.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("text_sha256").alias("text_sha256"),
        F.first("n_bytes").alias("n_bytes"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "key", F.coalesce("rank", "old_rank").alias("rank")))),
            lambda x: F.struct(x["key"].alias("key"), x["rank"].alias("rank")),
        ).alias("names"),
    )


def _first_names(docs: DataFrame, doc_id: str, text: str, block: int, key: Callable[..., Column]) -> DataFrame:
    """Level 0: the names of a document's blocks, in order."""
    texts = _texts(docs, doc_id, text)
    cut = F.expr(f"substring(bytes, start, {block})")
    blocks = texts.select("bytes", F.explode(_starts(block)).alias("start")).select(cut.alias("block"))
    ranks = _ranks(blocks.select(key(F.col("block")).alias("key"), "block"), ["block"])
    rows = texts.withColumn("row_id", F.monotonically_increasing_id()).select(
        "row_id", "doc_id", F.sha2("bytes", 256).alias("text_sha256"), F.octet_length("bytes").alias("n_bytes"), "bytes"
    )
    if ranks is None:
        name = lambda start: F.struct(
            key(F.substring(F.col("bytes"), start, F.lit(block))).alias("key"), F.lit(0).alias("rank")
        )
        return stored(rows.withColumn("names", F.transform(_starts(block), name)).drop("bytes"), "names")
    parts = rows.select("*", F.posexplode(_starts(block)).alias("pos", "start")).withColumn("block", cut)
    parts = parts.withColumn("key", key(F.col("block"))).withColumn("old_rank", F.lit(0)).drop("bytes", "start")
    return stored(_named_apart(parts, ranks, ["block"]), "names")


def _next_names(named: DataFrame, key: Callable[..., Column]) -> DataFrame:
    """One level up: the names of neighbouring pairs; an odd last name is carried."""
    pair = ["left.key", "left.rank", "right.key", "right.rank"]
    flat = ["left_key", "left_rank", "right_key", "right_rank"]

    def both(i: Column) -> Column:
        return F.struct(F.get("names", 2 * i).alias("left"), F.get("names", 2 * i + 1).alias("right"))

    pairs = named.withColumn(
        "pairs", F.transform(F.sequence(F.lit(0), F.expr("cast((size(names) - 1) div 2 as int)")), both)
    )
    found = pairs.select(F.explode("pairs").alias("p")).select("p.*").filter("right is not null")
    contents = found.select(*[F.col(p).alias(f) for p, f in zip(pair, flat, strict=True)])
    ranks = _ranks(contents.withColumn("key", key(*[F.col(f) for f in flat])), flat)

    def name(p: Column) -> Column:
        new = key(p["left"]["key"], p["left"]["rank"], p["right"]["key"], p["right"]["rank"])
        return F.when(p["right"].isNull(), p["left"]).otherwise(F.struct(new.alias("key"), F.lit(0).alias("rank")))

    if ranks is None:
        return pairs.withColumn("names", F.transform("pairs", name)).drop("pairs")
    rows = pairs.select("row_id", "doc_id", "text_sha256", "n_bytes", F.posexplode("pairs").alias("pos", "p"))
    rows = rows.select(
        "row_id", "doc_id", "text_sha256", "n_bytes", "pos", name(F.col("p")).alias("new"),
        *[F.col(f"p.{p}").alias(f) for p, f in zip(pair, flat, strict=True)],
    ).select("*", F.col("new.key").alias("key"), F.col("new.rank").alias("old_rank"))
    return _named_apart(rows.drop("new"), ranks, flat)


def name_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    block: int = BLOCK_BYTES,
    key: Callable[..., Column] = hash_key,
) -> DataFrame:
    """One row per row of ``docs``: ``row_id, doc_id, text_sha256, n_bytes, key, rank``.

    (``n_bytes``, ``key``, ``rank``) is equal for equal normalised texts and for no
    others, whatever ``key`` does. A null text is an empty one, an empty text is
    one empty block. Other columns of ``docs`` are not read.
    """
    # A level is stored, so the next one does not compute it again for each name; a
    # document leaves when it has one name, so levels shrink.
    level = _first_names(docs, doc_id, text, block, key)
    names = level.agg(F.max(F.size("names"))).first()[0] or 1
    done = [level.filter(F.size("names") == 1)]
    while names > 1:
        level = stored(_next_names(level.filter(F.size("names") > 1), key), "names")
        done.append(level.filter(F.size("names") == 1))
        names = (names + 1) // 2
    named = reduce(DataFrame.unionByName, done)
    return named.select("row_id", "doc_id", "text_sha256", "n_bytes", F.get("names", F.lit(0)).alias("name")).select(
        "row_id", "doc_id", "text_sha256", "n_bytes", "name.key", "name.rank"
    )


def exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the smallest ``doc_id`` stays, and is the ``keep_id`` of
    all. Null ids come last. Of rows that repeat id and text exactly one is kept.
    """
    named = name_documents(docs, doc_id, text, **how)
    name = ["n_bytes", "key", "rank"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id"))
    groups = named.groupBy(*name).agg(first.alias("first"), F.count(F.lit(1)).alias("size"))
    many = stored(
        groups.filter("size > 1").select(*name, F.col("first.doc_id").alias("first_id"), F.col("first.row_id").alias("first_row"), "size"),
        "copies",
    )
    return lookup_join(named, many, name, "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row_id") == F.col("first_row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_copies` keeps, with all their columns, whatever their names.

    Of rows that repeat both id and text the one whose columns are smallest as JSON stays.
    Null ids are one id, unlike any text; a null text is empty; an empty table stays empty.
    """
    found = stored(exact_copies(docs, doc_id, text, **how).filter("not kept"), "dropped")

    def key(of: Column, sha: Column) -> Column:
        return F.concat_ws(":", F.coalesce(F.concat(F.lit("="), of.cast("string")), F.lit("null")), sha)

    found = found.select(key(F.col("doc_id"), F.col("text_sha256")).alias("key"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("same_id"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sha = F.sha2(F.encode(normalised(F.col(text)), "UTF-8"), 256)
    rows = docs.select(key(F.col(doc_id), sha).alias("key"), row.alias("row"))
    rows = lookup_join(rows, found.filter("not same_id").select("key").distinct(), "key", "left_anti")
    repeated = found.filter("same_id").select("key").distinct()
    if not repeated.isEmpty():
        once = lookup_join(rows, repeated, "key", "left_anti")
        one = lookup_join(rows, repeated, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
        rows = once.unionByName(one)
    return rows.select("row.*")
