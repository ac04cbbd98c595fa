"""Token counts of a piece model, by a two-tier lookup of pre-tokens without shuffling them.

A pre-token is a run of spaces and the word after it. No piece of the model has a
space after another character, so merges never cross from one pre-token to the next
and the counts of a text's pre-tokens add up to that of the text; this is checked
against the vocabulary when a model is loaded, and texts are encoded whole where it
does not hold.

First tier: a broadcast hash table of the lengths of the most frequent pre-tokens of
all documents, at most ``TABLE_ROWS`` of at most ``TABLE_CHARS`` characters, whose
lengths are found once. It holds no text: 16 bytes of a pre-token's hash and its length,
300 kB in all. Each task counts its own pre-tokens and passes on its most frequent ones,
so only bounded summaries move; which ones these are decides where a length is looked
up, never what it is.
Second tier: a cache in each worker of the pre-tokens it met, bounded by rows and by
bytes, filled from the table or by encoding what the table misses. A pre-token of more
than ``KEPT_CHARS`` characters is encoded each time and never kept.

Repeated rows are counted each by itself; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from certmill.llm.batches import text_pieces

TABLE_ROWS = 16_384
TABLE_CHARS = 48
TASK_ROWS = 8_192
CACHE_ROWS = 400_000
CACHE_BYTES = 64 << 20
KEPT_CHARS = 1_024
_PIECE = re.compile(" +[^ ]*")
_LOADED: dict[str, tuple] = {}


class Lengths:
    """Token counts of pre-tokens by text, within bounds of rows and bytes: when one is passed, all go."""

    def __init__(self) -> None:
        self.by_word: dict[str, int] = {}
        self.size = 0

    def add(self, words: list[str], counts: list[int], rows: int, most: int) -> None:
        for w, n in zip(words, counts, strict=True):
            cost = 160 + 4 * len(w)
            if len(w) > KEPT_CHARS or cost > most:
                continue
            if len(self.by_word) >= rows or self.size + cost > most:
                self.by_word.clear()
                self.size = 0
            self.by_word[w] = n
            self.size += cost


def load(path: str) -> tuple:
    """The model at ``path``, whether its counts add up over pre-tokens, and the worker's cache."""
    if path not in _LOADED:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        inside = re.compile("[^▁]▁")
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        adds_up = not any(inside.search(p) for p in pieces) and model.encode("a", out_type=str)[0].startswith("▁")
        adds_up = adds_up and len(model.encode("  a")) > len(model.encode("a"))
        _LOADED[path] = (model, adds_up, Lengths())
    return _LOADED[path]


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space; the model adds one in front of the text."""
    t = text.replace("▁", " ")
    if "  " not in t and t[:1] != " " and t[-1:] != " ":
        return t.split(" ") if t else []
    return [p[1:] for p in _PIECE.findall(" " + t)] if t else []


def piece_lengths(model, words: list[str]) -> list[int]:
    """Tokens of each pre-token. A lone pre-token space is one token; the library adds one to anything else by itself."""
    return [len(ids) if w else 1 for w, ids in zip(words, model.encode(words, num_threads=1), strict=True)]


def hashes(words: list[str]) -> np.ndarray:
    """The 128-bit hash of each word, as two numbers."""
    digests = b"".join(xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")) for w in words)
    return np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)


@dataclass(frozen=True)
class LengthTable:
    """Lengths by hash, sorted by the hash's first half. Entries of one first half are none of the table's."""

    first: np.ndarray
    second: np.ndarray
    length: np.ndarray

    @staticmethod
    def of(words: list[str], counts: list[int]) -> LengthTable:
        h = hashes(words)
        first, at, times = np.unique(h[:, 0], return_index=True, return_counts=True)
        alone = times == 1
        return LengthTable(first[alone], h[at[alone], 1], np.array(counts, np.uint16)[at[alone]])

    def find(self, words: list[str]) -> np.ndarray:
        """The length of each word, or -1 where the table lacks it; both halves of the hash must be equal."""
        if not words or not len(self.first):
            return np.full(len(words), -1, np.int64)
        h = hashes(words)
        at = np.minimum(np.searchsorted(self.first, h[:, 0]), len(self.first) - 1)
        same = (self.first[at] == h[:, 0]) & (self.second[at] == h[:, 1])
        return np.where(same, self.length[at].astype(np.int64), -1)


def frequent_pre_tokens(texts: DataFrame, text: str, rows: int = TABLE_ROWS) -> list[str]:
    """The most frequent pre-tokens over all documents, from each task's most frequent ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for _, found in text_pieces(b, text):
                for t in found:
                    if t:
                        seen.update(pre_tokens(t))
                if len(seen) > 16 * TASK_ROWS:
                    seen = Counter(dict(seen.most_common(8 * TASK_ROWS)))
        top = [(w, n) for w, n in seen.most_common(TASK_ROWS) if len(w) <= TABLE_CHARS]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"]
        )

    found = texts.select(text).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r["piece"] for r in found.orderBy(F.col("n").desc(), "piece").limit(rows).collect()]


def token_counts(
    docs: DataFrame, model_path: str, keys: list[Column], text: str = "text", cache_rows: int = CACHE_ROWS
) -> DataFrame:
    """``keys`` and ``n_bytes, n_tokens``: the counts the library gives for each whole text.

    No begin, end or added tokens; a null text counts as empty, an empty text has none.
    """
    plain = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    frequent = frequent_pre_tokens(plain, "_text")
    shared = docs.sparkSession.sparkContext.broadcast(LengthTable.of(frequent, piece_lengths(load(model_path)[0], frequent)))
    rows = docs.select(*keys, F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    names = rows.columns[:-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, adds_up, cache = load(model_path)

        def lengths(words: list[str]) -> list[int]:
            found = shared.value.find(words)
            missed = np.flatnonzero(found < 0)
            found[missed] = piece_lengths(model, [words[i] for i in missed])
            return found.tolist()

        for b in batches:
            totals: list[int] = []
            for _, texts in text_pieces(b, "_text"):
                if not adds_up:
                    totals.extend(len(ids) for ids in model.encode(texts, num_threads=1))
                    continue
                split = [pre_tokens(t) for t in texts]
                known = {w: cache.by_word.get(w) for words in split for w in words}
                missing = [w for w, n in known.items() if n is None]
                counts = lengths(missing)
                known.update(zip(missing, counts, strict=True))
                cache.add(missing, counts, cache_rows, CACHE_BYTES)
                totals.extend(sum(map(known.__getitem__, words)) for words in split)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(len(names))], pa.array(totals, pa.int64())], [*names, "n_tokens"]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(count, f"{kinds}, n_tokens long")
