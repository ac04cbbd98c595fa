"""N-gram Jaccard join of documents by chosen paths.

Documents are sets of five-word shingles; documents of equal sets are one class and
take part once. Each set has a signature of minimum hashes. A run starts with one
signature place: sets that agree there share a node. A node with more members than
``leaf_rows`` is split further: places chosen by the node's path alone, so alike for
all members, send each member to one child per place, until nodes are small enough
to compare every pair. Nodes whose members are alike on average, which no split
parts, and those at full depth are compared in blocks of pairs. Runs repeat until a
pair at the threshold is met with the target probability.

A pair that shares several leaves counts in the first of them only, which both rows
know from their own lists of leaves, so links are counted without writing pairs
out: a task emits per set a number of links and one edge to the smallest set of its
linked neighbourhood. Before sets are compared exactly, leaves are thinned to the
sets whose signatures look alike.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from certmill.llm.batches import text_pieces
from certmill.llm.components import smallest_members
from certmill.plans.joins import lookup_join
from certmill.session import stored

PLACES = 64
DENSITY_PLACES = 4
_MIX = np.random.default_rng(20_240_601)
_ODD = _MIX.integers(0, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _MIX.integers(0, 2**63, PLACES, dtype=np.uint64)
_TABLE: list[np.ndarray] = []


@dataclass(frozen=True)
class JoinOptions:
    """Words per shingle, similarity, and the sizes of the search tree."""

    words: int = 5
    threshold: float = 0.8
    recall: float = 0.9999
    leaf_rows: int = 256
    depth: int = 4
    children: int = 3
    block_rows: int = 512
    margin: float = 0.3
    dense_from: float = 0.4

    @property
    def runs(self) -> int:
        """Runs after which a pair at the threshold is met with probability ``recall``, at full depth."""
        step = 1 - (1 - self.threshold) ** self.children
        once = self.threshold * step ** (self.depth - 1)
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - once)))


def _word_chars() -> np.ndarray:
    """For each code point whether it is a letter or digit; made once per worker."""
    if not _TABLE:
        _TABLE.append(np.array([chr(c).isalnum() for c in range(0x110000)], dtype=bool))
    return _TABLE[0]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams, over lower-case runs of letters and digits.

    A text of fewer words is one shingle; a text without words has none.
    """
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _word_chars()[code]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    # A word's hash is the sum of its mixed (character, place in word) pairs.
    place = np.arange(len(code), dtype=np.int64)
    place[start[0] :] -= np.repeat(start, np.diff(np.concatenate([start, [len(code)]])))
    h = _mixed(code.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    total = np.concatenate([[np.uint64(0)], np.cumsum(np.where(inside, h, np.uint64(0)), dtype=np.uint64)])
    word = _mixed(total[end] - total[start])
    n = max(1, len(word) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(word))):
        out = _mixed(out * np.uint64(0xFF51AFD7ED558CCD) + word[k : k + n])
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of ``PLACES`` rehashings, in 32 bits."""
    low = np.full(PLACES, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 2048):
        h = (hashes[at : at + 2048, None] ^ _XOR) * _ODD
        np.minimum(low, (h ^ (h >> np.uint64(29))).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketches(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """One row per document: ``doc_id, set_id`` (null without words) ``, n, signature``."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, signs = [], [], []
            for _, texts in text_pieces(b, "text"):
                for t in texts:
                    h = shingles(t, words)
                    ids.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                    sizes.append(len(h))
                    signs.append(signature(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signs, pa.list_(pa.int32()))],
                ["doc_id", "set_id", "n", "signature"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, set_id binary, n int, signature array<int>")


def _child(path: Column, place: Column) -> Column:
    """The path below ``path`` for a place and the member's value there."""
    return F.xxhash64(path, place, F.element_at("signature", place + 1))


def _place(j: Column) -> Column:
    """The j-th signature place of a node, by its path alone."""
    first, stride = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(PLACES)), F.pmod(F.xxhash64("path", F.lit(2)), F.lit(PLACES // 2)) * 2 + 1
    return F.pmod(first + j * stride, F.lit(PLACES)).cast("int")


def _dense_nodes(rows: DataFrame, opts: JoinOptions) -> DataFrame:
    """Large nodes whose members are alike on average, from four places: splitting would only repeat them.

    The share of pairs that agree at a place estimates the mean similarity. Each
    place is counted by itself, partially where the rows are, so no row is repeated.
    """
    def agreeing(j: int) -> DataFrame:
        value = F.element_at("signature", _place(F.lit(j)) + 1)
        counts = rows.groupBy("path", value.alias("value")).agg(F.count(F.lit(1)).alias("c"), F.max("members").alias("members"))
        return counts.select("path", (F.col("c") * F.col("c") / (F.col("members") * F.col("members"))).alias("share"))

    places = reduce(DataFrame.unionByName, [agreeing(j) for j in range(8, 8 + DENSITY_PLACES)])
    mean = F.sum("share") / DENSITY_PLACES
    return places.groupBy("path").agg(mean.alias("mean")).filter(F.col("mean") >= opts.dense_from).select("path")


def leaves(sets: DataFrame, opts: JoinOptions) -> DataFrame:
    """The leaves of all runs: ``set_id, leaf, members``, from two members on.

    Nodes are counted level by level; only the narrow (set, path) rows move.
    """
    roots = F.transform(
        F.sequence(F.lit(0), F.lit(opts.runs - 1)), lambda r: _child(F.xxhash64(r), F.pmod(r * 37 + 11, F.lit(PLACES)))
    )
    level = sets.select("set_id", F.explode(roots).alias("path"))
    found: DataFrame | None = None
    for depth in range(1, opts.depth + 1):
        level = stored(level, "join-level")
        sizes = stored(level.groupBy("path").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "join-nodes")
        last = depth == opts.depth
        small = sizes if last else sizes.filter(F.col("members") <= opts.leaf_rows)
        done = lookup_join(level, small, "path", "inner").select("set_id", F.col("path").alias("leaf"), "members")
        found = done if found is None else found.unionByName(done)
        if last or sizes.filter(F.col("members") > opts.leaf_rows).isEmpty():
            break
        large = sizes.filter(F.col("members") > opts.leaf_rows)
        rows = lookup_join(level, large, "path", "inner").join(sets.select("set_id", "signature"), "set_id")
        rows = stored(rows, "join-large")
        dense = stored(_dense_nodes(rows, opts), "join-dense")
        found = found.unionByName(lookup_join(rows, dense, "path", "left_semi").select("set_id", F.col("path").alias("leaf"), "members"))
        # Distinct places of the path: steps of an odd stride over a power of two.
        below = F.transform(F.sequence(F.lit(0), F.lit(opts.children - 1)), lambda j: _child(F.col("path"), _place(j)))
        level = lookup_join(rows, dense, "path", "left_anti").select("set_id", F.explode(F.array_distinct(below)).alias("path"))
    return stored(found.distinct(), "join-leaves")


def _cells(rows: DataFrame, opts: JoinOptions) -> DataFrame:
    """Rows with the cells of their leaf: one, or the block pairs that a member of a large leaf is part of.

    ``cell`` names the pair of blocks, ``side`` tells whether a row is in its first (0),
    second (1) or, with equal blocks, only block (2).
    """
    blocks = F.ceil(F.col("members") / opts.block_rows).cast("int")
    own = F.pmod(F.xxhash64("set_id", F.lit(7)), F.col("_blocks").cast("long")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda o: F.struct(
            F.xxhash64("leaf", F.least(o, F.col("_own")), F.greatest(o, F.col("_own"))).alias("cell"),
            F.when(o == F.col("_own"), 2).when(o > F.col("_own"), 0).otherwise(1).alias("side"),
        ),
    )
    split = rows.withColumn("_blocks", blocks).withColumn("_own", own).withColumn("_cells", cells)
    return split.select(*rows.columns, F.explode("_cells").alias("_c")).select(*rows.columns, "_c.cell", "_c.side")


def _met_before(leaf: int, lists: list[np.ndarray]) -> np.ndarray:
    """For each pair of rows whether they share a leaf before this one, in the order of leaf numbers."""
    n = len(lists)
    met = np.zeros((n, n), bool)
    sizes = [len(x) for x in lists]
    if not sum(sizes):
        return met
    all_leaves, owner = np.concatenate(lists), np.repeat(np.arange(n), sizes)
    before = all_leaves < leaf
    all_leaves, owner = all_leaves[before], owner[before]
    order = np.argsort(all_leaves, kind="stable")
    all_leaves, owner = all_leaves[order], owner[order]
    cuts = np.flatnonzero(np.concatenate([[True], all_leaves[1:] != all_leaves[:-1], [True]])) if len(all_leaves) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 1:
            met[np.ix_(owner[a:b], owner[a:b])] = True
    return met


def _pairs_of(leaf: int, lists: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """The pairs that a cell compares, upper half: of different blocks or of its one block, met here first."""
    fresh = np.triu(~_met_before(leaf, lists), 1)
    if (side != 2).any():
        fresh &= side[:, None] != side[None, :]
    return fresh


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of each cell; the rows of a partition come sorted by cell."""
    held: dict[str, list] = {}
    for b in batches:
        columns = b.to_pydict()
        for i in range(b.num_rows):
            if held and held["cell"][-1] != columns["cell"][i]:
                yield held
                held = {}
            if not held:
                held = {c: [] for c in columns}
            for c in columns:
                held[c].append(columns[c][i])
    if held:
        yield held


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell")


def _alike(cells: DataFrame, opts: JoinOptions) -> DataFrame:
    """(cell, set_id) of the rows that have a partner in the cell whose signature looks alike."""
    need = (opts.threshold - opts.margin) * PLACES

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _grouped(batches):
            n = len(g["set_id"])
            if n < 2:
                continue
            sig = np.array(g["signature"], dtype=np.int32)
            pairs = _pairs_of(g["leaf"][0], [np.array(x, np.int64) for x in g["leaves"]], np.array(g["side"]))
            # Sizes alone rule pairs out: the similarity is at most the smaller over the larger.
            size = np.array(g["n"], dtype=np.float64)
            pairs &= np.minimum.outer(size, size) >= opts.threshold * np.maximum.outer(size, size) - 1e-9
            some = np.zeros(n, bool)
            for i in np.flatnonzero(pairs.any(1)):
                partners = np.flatnonzero(pairs[i])
                like = partners[(sig[partners] == sig[i]).sum(1) >= need]
                if len(like):
                    some[i] = True
                    some[like] = True
            kept = np.flatnonzero(some)
            if len(kept):
                yield pa.RecordBatch.from_pydict({
                    "cell": [g["cell"][0]] * len(kept), "set_id": [g["set_id"][i] for i in kept],
                    "side": pa.array([g["side"][i] for i in kept], pa.int32()), "leaf": [g["leaf"][0]] * len(kept),
                })

    rows = cells.select("cell", "side", "leaf", "set_id", "n", "signature", "leaves")
    return _by_cell(rows).mapInArrow(pick, "cell long, set_id binary, side int, leaf long")


def _sets_again(docs: DataFrame, needed: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """``set_id, hashes`` of the needed classes, from the texts of their first documents."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sets = [], []
            for _, texts in text_pieces(b, "text"):
                for t in texts:
                    h = shingles(t, words)
                    ids.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                    sets.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(sets, pa.binary())], ["set_id", "hashes"])

    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**62)))
    rows = lookup_join(docs.select(key.alias("rep"), F.col(text).alias("text")), needed.select("rep").distinct(), "rep", "left_semi")
    built = rows.select("text").mapInArrow(build, "set_id binary, hashes binary").filter("set_id is not null")
    return built.groupBy("set_id").agg(F.first("hashes").alias("hashes"))


def _cell_links(pairs: np.ndarray, sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """The pairs of a cell at or above the threshold, as a matrix, upper half.

    Common shingles of all pairs are counted at once: columns are the shingles that
    more than one row has, and the counts are a product of 0/1 matrices.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    renumber = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = renumber[column[keep]], owner[keep]
    width = int(shared.sum())
    common = np.zeros((n, n), dtype=np.float32)
    step = max(1, (1 << 22) // n)
    starts = np.searchsorted(column, np.arange(0, width + step, step))
    for k, at in enumerate(range(0, width, step)):
        a, b = starts[k], starts[k + 1]
        m = np.zeros((n, min(step, width - at)), dtype=np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        common += m @ m.T
    both = size[:, None] + size[None, :] - common
    return pairs & (common >= threshold * both - 1e-6)


def _links(cells: DataFrame, opts: JoinOptions) -> DataFrame:
    """Per cell and set: ``set_id, links`` (sets linked here first), ``documents`` of those, ``root``."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _grouped(batches):
            n = len(g["set_id"])
            if n < 2:
                continue
            pairs = _pairs_of(g["leaf"][0], [np.array(x, np.int64) for x in g["leaves"]], np.array(g["side"]))
            if not pairs.any():
                continue
            linked = _cell_links(pairs, [np.frombuffer(h, np.uint64) for h in g["hashes"]], opts.threshold)
            linked |= linked.T
            if not linked.any():
                continue
            # Least member of each connected part, numbers by set id.
            rank = np.empty(n, np.int64)
            rank[sorted(range(n), key=lambda i: g["set_id"][i])] = np.arange(n)
            root = rank.copy()
            while True:
                near = np.where(linked, root[None, :], n).min(1)
                new = np.minimum(root, near)
                if (new == root).all():
                    break
                root = new
            name = {int(r): s for r, s in zip(rank, g["set_id"], strict=True)}
            kept = np.flatnonzero(linked.any(1))
            size = np.array(g["size"], dtype=np.int64)
            yield pa.RecordBatch.from_pydict({
                "set_id": [g["set_id"][i] for i in kept], "links": linked[kept].sum(1).astype(np.int64),
                "documents": (linked[kept] @ size).astype(np.int64), "root": [name[int(root[i])] for i in kept],
            })

    rows = cells.select("cell", "side", "leaf", "set_id", "size", "hashes", "leaves")
    return _by_cell(rows).mapInArrow(join, "set_id binary, links long, documents long, root binary")


def similarity_join(docs: DataFrame, opts: JoinOptions = JoinOptions(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, rep_id, class_id, n_links, n_text_links``.

    ``rep_id`` is the smallest id among documents of the same shingle set, ``class_id``
    the smallest among all that links connect to it, ``n_links`` the number of other
    documents with a similarity of at least the threshold, copies included, and
    ``n_text_links`` the number of other shingle sets among them. A document without
    words has no links and is a class of its own. Null ids are larger than others.
    """
    sketches = stored(_sketches(docs, doc_id, text, opts.words), "sketches")
    classes = stored(
        sketches.filter("set_id is not null").groupBy("set_id").agg(
            F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("signature").alias("signature")
        ),
        "shingle-sets",
    )
    found = leaves(classes, opts)
    lists = stored(found.groupBy("set_id").agg(F.sort_array(F.collect_set("leaf")).alias("leaves")), "leaf-lists")
    about = classes.select("set_id", "n", "signature").join(lists, "set_id")
    alike = stored(_alike(_cells(found.join(about, "set_id"), opts), opts), "alike")
    reps = alike.select("set_id").distinct().join(classes.select("set_id", F.coalesce("rep_id", F.lit(-(2**62))).alias("rep")), "set_id")
    sets = stored(_sets_again(docs, stored(reps, "alike-sets"), doc_id, text, opts.words), "sets")
    whole = sets.join(classes.select("set_id", "size"), "set_id").join(lists, "set_id")
    links = stored(_links(alike.join(whole, "set_id"), opts), "links")
    per_set = links.groupBy("set_id").agg(F.sum("links").alias("links"), F.sum("documents").alias("documents"))
    members = smallest_members(links.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    labelled = members.join(classes.select(F.col("set_id").alias("node"), "rep_id"), "node")
    ids = labelled.groupBy("label").agg(F.min("rep_id").alias("class_id"))
    joined = lookup_join(labelled, ids, "label", "inner").select(F.col("node").alias("set_id"), "class_id")
    facts = stored(
        classes.select("set_id", "rep_id", "size").join(joined, "set_id", "left").join(per_set, "set_id", "left")
        .select(
            "set_id", "rep_id", F.coalesce("class_id", "rep_id").alias("class_id"),
            (F.coalesce("documents", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("links", F.lit(0)).alias("n_text_links"),
        ),
        "join-facts",
    )
    rows = lookup_join(sketches.select("doc_id", "set_id"), facts, "set_id", "left")
    return rows.select(
        "doc_id",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("rep_id")).alias("rep_id"),
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"),
    )


def keep_one_of_each(docs: DataFrame, opts: JoinOptions = JoinOptions(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is that of their class, with all their columns, whatever their names.

    Rows without id stay; rows that repeat a kept id stay, since the id names a document.
    """
    found = similarity_join(docs, opts, doc_id, text)
    dropped = stored(found.filter("doc_id <> class_id").select(F.col("doc_id").alias("id")).distinct(), "near-copies")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), row.alias("row"))
    return lookup_join(rows, dropped, "id", "left_anti").select("row.*")
