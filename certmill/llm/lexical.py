"""Ranked lexical search of items by branch-and-bound over document FP-trees.

Documents are reduced to the terms that items hold. Within a block of documents the
terms of each are ordered by frequency, most frequent first, and the sorted vectors are
the paths of a trie, of which the branching nodes are kept. A node knows, of the
documents below it, the largest tf of each term, the smallest m and the smallest id, so
the score of none of them exceeds the node's bound. Each item searches a tree depth
first, best bound first, and leaves out what cannot reach its k-th score; that score is
carried from block to block of a task. The best of all tasks are merged.

Texts are read once to reduce and count them. Items go to the tasks in passes of bounded
bytes; a pass is one reading of the texts, so more items are more passes, not more memory.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window as W, functions as F

from certmill.llm.words import byte_set, pieces, split_words, texts_of
from certmill.plans.joins import lookup_join
from certmill.plans.numbering import number_rows
from certmill.session import stored

# Bytes between terms; the fold lowers A to Z alone.
_CUTS = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20

# Items of one pass hold at most this many bytes of text, or are one item.
PASS_BYTES = 128 << 10
BLOCK_DOCS = 8192
BLOCK_TERMS = 2 << 20
LEAF_DOCS = 64
SALTS = 32
_LAST = 2**63 - 1
_REDUCED = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts in order, and the places at which each text's terms begin."""
    return split_words(texts, _CUTS, _FOLD)


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2.0 * docs + 2) / (2.0 * df + 1)))


def length_norm(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents with ``n`` terms."""
    if len(n) and 75 * int(n.max()) * docs >= 2**63:
        return np.array([25 + 75 * int(x) * docs // total for x in n], np.int64)
    return 25 + 75 * n * docs // max(total, 1)


def _gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to a score."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Tree:
    """The branching nodes of the trie of one block; documents are numbered along its paths.

    Small neighbouring branches are one leaf of at most ``LEAF_DOCS`` documents.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, starts: np.ndarray, ranks: np.ndarray, tfs: np.ndarray, width: int):
        wide = ranks.astype(">u4")
        paths = [wide[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        order = np.array(sorted(range(len(ids)), key=paths.__getitem__), np.int64)
        sizes = np.diff(starts)[order]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(starts[:-1][order] - self.starts[:-1], sizes) + np.arange(len(ranks))
        self.ids, self.ranks = ids[order], ranks[take]
        doc = np.repeat(np.arange(len(ids)), sizes)
        self.gain = _gain(tfs[take], m[order][doc])
        self.shared = self._shared()
        self.children: list[list[int]] = []
        self.leaf: list[tuple[int, int] | None] = []
        self._grow()
        leaves = [i for i, x in enumerate(self.leaf) if x is not None]
        of = np.empty(len(ids), np.int64)
        for i in leaves:
            of[slice(*self.leaf[i])] = i
        most = np.zeros((len(self.leaf), width), np.int64)
        np.maximum.at(most, (of[doc], self.ranks), tfs[take])
        least = np.full(len(self.leaf), _LAST)
        np.minimum.at(least, of, m[order])
        self.first = np.full(len(self.leaf), _LAST)
        np.minimum.at(self.first, of, self.ids)
        for i in range(len(self.leaf) - 1, -1, -1):  # children come after their parent
            if below := self.children[i]:
                most[i], least[i], self.first[i] = most[below].max(0), least[below].min(), self.first[below].min()
        self.most = _gain(most, least[:, None])

    def _shared(self) -> np.ndarray:
        """How many first terms each document shares with the one before it."""
        out, live, depth = np.zeros(len(self.ids), np.int64), np.arange(1, len(self.ids)), 0
        while len(live):
            a, b = self.starts[live - 1] + depth, self.starts[live] + depth
            held = (a < self.starts[live]) & (b < self.starts[live + 1])
            live, a, b = live[held], a[held], b[held]
            live = live[self.ranks[a] == self.ranks[b]]
            out[live] += 1
            depth += 1
        return out

    def _node(self, lo: int, hi: int, leaf: bool) -> int:
        self.children.append([])
        self.leaf.append((lo, hi) if leaf else None)
        return len(self.leaf) - 1

    def _grow(self) -> None:
        todo = [(0, len(self.ids), self._node(0, len(self.ids), len(self.ids) <= LEAF_DOCS))]
        while todo:
            lo, hi, node = todo.pop()
            if self.leaf[node] is not None:
                continue
            inner = self.shared[lo + 1 : hi]
            edges = [lo, *(np.flatnonzero(inner == inner.min()) + lo + 1).tolist(), hi]
            start = lo
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                big = b - a > LEAF_DOCS
                if start < a and (big or b - start > LEAF_DOCS):
                    self.children[node].append(self._node(start, a, True))
                    start = a
                if big:
                    child = self._node(a, b, False)
                    self.children[node].append(child)
                    todo.append((a, b, child))
                    start = b
            if start < hi:
                self.children[node].append(self._node(start, hi, True))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """The ``k`` best (-score, id) of ``best`` and this block."""
        bounds = self.most[:, terms] @ weights
        weight = np.zeros(self.most.shape[1], np.int64)
        weight[terms] = weights
        stack = [0]
        while stack:
            node = stack.pop()
            bound = int(bounds[node])
            if bound <= 0 or len(best) == k and (-bound, self.first[node]) > best[-1]:
                continue
            if self.leaf[node] is None:
                stack += sorted(self.children[node], key=bounds.__getitem__)
                continue
            lo, hi = self.leaf[node]
            a, b = self.starts[lo], self.starts[hi]
            scores = np.add.reduceat(weight[self.ranks[a:b]] * self.gain[a:b], self.starts[lo:hi] - a)
            able = scores >= max(1, -best[-1][0] if len(best) == k else 1)
            if able.any():
                best = sorted(best + list(zip((-scores[able]).tolist(), self.ids[lo:hi][able].tolist(), strict=True)))[:k]
        return best


def _reduced(docs: DataFrame, doc_id: str, text: str, vocabulary: list[bytes]) -> DataFrame:
    """One stored row per document: its id, its number of terms, and tf of the vocabulary's terms in it."""
    values = pa.array(vocabulary, pa.large_binary())

    def reduce_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            for at, to in pieces(texts):
                terms, bounds = terms_of(texts.slice(at, to - at))
                code = pc.index_in(terms, value_set=values).fill_null(-1).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(to - at), np.diff(bounds))
                held = code >= 0
                pair, tf = np.unique(doc[held] * len(vocabulary) + code[held], return_counts=True)
                found, term = np.divmod(pair, len(vocabulary))
                starts = pa.array(np.searchsorted(found, np.arange(to - at + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, to - at), pa.array(np.diff(bounds)),
                    pa.ListArray.from_arrays(starts, pa.array(term, pa.int32())), pa.ListArray.from_arrays(starts, pa.array(tf, pa.int64())),
                ], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(reduce_texts, _REDUCED), "restricted-terms")


def _one_pass(docs: DataFrame, items: list[Row], k: int, doc_id: str, text: str) -> DataFrame:
    """The best documents of some items: ``no, score, doc_id``, at most ``k`` of each item and task."""
    terms, bounds = terms_of(pa.array([i["text"] for i in items], pa.large_string()))
    words = terms.to_pylist()
    asked = [Counter(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    vocabulary = sorted(set(words))
    reduced = _reduced(docs, doc_id, text, vocabulary)
    count = reduced.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    docs_n, total = count["docs"], count["total"]
    df = np.zeros(len(vocabulary), np.int64)  # as many rows as the pass has terms
    for r in reduced.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    rank_of = np.empty(len(vocabulary), np.int64)
    rank_of[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    code = {w: i for i, w in enumerate(vocabulary)}
    queries = []
    for item, held in zip(items, asked, strict=True):
        codes = [code[w] for w in held]
        weights = [c * term_weight(docs_n, int(df[t])) for t, c in zip(codes, held.values(), strict=True)]
        queries.append((item["index"], rank_of[np.array(codes, np.int64)], np.array(weights, np.int64)))
    width = len(vocabulary)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        null_best: list[list[tuple[int, int]]] = [[] for _ in queries]

        def look(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            terms, tfs = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
            sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            rank = rank_of[terms.flatten().to_numpy(zero_copy_only=False)]
            order = np.argsort(np.repeat(np.arange(len(sizes)), sizes) * width + rank)
            rank, tf = rank[order], tfs.flatten().to_numpy(zero_copy_only=False)[order]
            m = length_norm(table.column("n").to_numpy(), docs_n, total)
            ids = table.column("doc_id").combine_chunks()
            nameless = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for missing, into in ((False, best), (True, null_best)):
                rows = np.flatnonzero(nameless == missing)
                if not len(rows):
                    continue
                size = sizes[rows]
                at = np.concatenate([[0], np.cumsum(size)])
                take = np.repeat(starts[:-1][rows] - at[:-1], size) + np.arange(at[-1])
                tree = Tree(ids[rows], m[rows], at, rank[take], tf[take], width)
                for i, (_, terms_i, weights_i) in enumerate(queries):
                    into[i] = tree.search(terms_i, weights_i, into[i], k)

        held, rows, size = [], 0, 0
        for batch in batches:
            lengths = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                done = int(lengths[at - 1]) if at else 0
                to = min(batch.num_rows, at + BLOCK_DOCS - rows, max(at + 1, int(np.searchsorted(lengths, done + BLOCK_TERMS - size, side="right"))))
                held.append(batch.slice(at, to - at))
                rows, size, at = rows + to - at, size + int(lengths[to - 1]) - done, to
                if rows >= BLOCK_DOCS or size >= BLOCK_TERMS:
                    look(held)
                    held, rows, size = [], 0, 0
        if held:
            look(held)
        no, score, found = [], [], []
        for (index, _, _), ours, nameless in zip(queries, best, null_best, strict=True):
            for s, d in ours + [(s, None) for s, _ in nameless]:
                no.append(index)
                score.append(-s)
                found.append(d)
        yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(score, pa.int64()), pa.array(found, pa.int64())], names=["no", "score", "doc_id"])

    return reduced.filter(F.size("terms") > 0).mapInArrow(search, "no bigint, score bigint, doc_id bigint")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """The ``k`` documents of highest score of each item: ``item_id, rank, doc_id, score``.

    Terms, weights and scores are those of the module's contract: only documents with a
    score above 0 are returned, ties go to the smaller ``doc_id`` (a whole number; null is
    the largest). A null text has no terms. Repeated rows of ``items`` are one item, an id
    with several texts is several items with ranks of their own; repeated documents
    each take a rank. Without documents or items the result is empty. Other columns of
    either table are not read.
    """
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    numbered = stored(number_rows(asked, ["item_id", "text"]), "items")
    sizes = numbered.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("longest")).first()
    each = max(1, pass_bytes // max(1, sizes["longest"] or 1))
    passes = [
        # At most pass_bytes of text, or one item.
        _one_pass(docs, numbered.filter(F.col("index").between(at, at + each - 1)).collect(), k, doc_id, text)
        for at in range(1, sizes["n"] + 1, each)
    ]
    empty = docs.sparkSession.createDataFrame([], "no bigint, score bigint, doc_id bigint")
    found = reduce(DataFrame.unionByName, passes, empty)
    better = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    for part in (["no", salt], ["no"]):
        found = found.withColumn("rank", F.row_number().over(W.partitionBy(*part).orderBy(*better))).filter(F.col("rank") <= k)
    names = numbered.select(F.col("index").alias("no"), "item_id")
    return lookup_join(found, names, "no", "inner").select("item_id", "rank", "doc_id", "score")
