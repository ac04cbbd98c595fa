"""Byte-level BPE encoding and decoding with a rank file, by recursive DuckDB queries in each task.

A text is split by the vocabulary's pattern. The distinct words of a piece of a
partition that the worker has not met become rows of (word, position, token), each
with the row that follows it; a recursive query joins them to the table of merges and
contracts each word's leftmost pair of least rank until none is left. Decoding looks the
bytes of all tokens up in one Arrow array and cuts them at the ends of the lists. Words
and their results stay in a bounded cache of the worker; nothing is shuffled.

The query's rows grow with the square of a word's length. Words of more than
``LONG_WORD`` bytes, which ordinary text does not have, are merged with a heap
instead, by the same rule.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from certmill.llm.batches import text_pieces

LONG_WORD = 256
#: Squared bytes of the words of one query, which bound its rows.
QUERY_SQUARES = 1 << 22
CACHE_ROWS = 300_000
PIECE_CHARS = 1 << 22
_CODERS: dict[tuple[str, str], Coder] = {}
_NUMBER, _IDS, _BYTES = itemgetter(0), itemgetter(1), itemgetter(2)

ENCODE = """
WITH RECURSIVE step AS (
  SELECT 0 AS k, w, p, t, next_p, next_t FROM source
  UNION ALL
  (WITH least AS (
     SELECT n.w, min((m.merged::BIGINT << 32) + (n.p << 16) + n.next_p) AS best
     FROM step n JOIN merges m ON m.a = n.t AND m.b = n.next_t GROUP BY n.w),
   pick AS (
     SELECT l.w, (l.best >> 16) & 65535 AS p, g.p AS gone, (l.best >> 32)::INT AS merged, g.next_p, g.next_t
     FROM least l JOIN step g ON g.w = l.w AND g.p = l.best & 65535)
   SELECT n.k + 1, n.w, n.p, CASE WHEN n.p = x.p THEN x.merged ELSE n.t END,
     CASE WHEN n.p = x.p THEN x.next_p ELSE n.next_p END,
     CASE WHEN n.p = x.p THEN x.next_t WHEN n.next_p = x.p THEN x.merged ELSE n.next_t END
   FROM step n JOIN pick x ON x.w = n.w WHERE n.p <> x.gone)
), last AS (SELECT w, max(k) AS k FROM step GROUP BY w)
SELECT s.w, s.t FROM step s JOIN last l ON s.w = l.w AND s.k = l.k ORDER BY s.w, s.p
"""

# Letters, digits and white space up to U+00FF: for such texts the plain pattern
# language has the classes that the vocabulary's pattern names. Fixed values.
_LETTER, _DIGIT, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_WIDE_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NARROW = re.compile("[\x00-\xff]*")


def _splitters(pattern: str):
    """The pattern for texts up to U+00FF, and for all others; white space is Unicode's White_Space."""
    import regex

    narrow = (
        pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{_LETTER}{_DIGIT}]").replace(r"\p{L}", f"[{_LETTER}]")
        .replace(r"\p{N}", f"[{_DIGIT}]").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
    )
    wide = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{_WIDE_SPACE}\p{{L}}\p{{N}}]")
    wide = wide.replace(r"\S", f"[^{_WIDE_SPACE}]").replace(r"\s", f"[{_WIDE_SPACE}]")
    return re.compile(narrow), regex.compile(wide)


class Spellings:
    """What each id is written as, bytes by id in one array; an id without an entry is written as nothing."""

    def __init__(self, by_id: dict[int, bytes]) -> None:
        self.none = max(by_id) + 1
        self.table = pa.array([by_id.get(i, b"") for i in range(self.none + 1)], pa.large_binary())

    def of(self, sizes: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of successive lists of ids, put together list by list."""
        known = np.where((ids >= 0) & (ids < self.none), ids, self.none)
        written = self.table.take(pa.array(known, pa.int64()))
        ends = np.frombuffer(written.buffers()[1], np.int64)[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        data = (written.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Coder:
    """One vocabulary in one worker: its tables in DuckDB, and the words met so far."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte_ids = np.array([self.ranks[bytes([c])] for c in range(256)], np.int32)
        self.narrow, self.wide = _splitters(pattern)
        # Two generations: when the younger is full it becomes the older, and words in use move back.
        # A word's number of ids, its ids with a comma after each, and the bytes that they stand for.
        self.words: dict[str, tuple[int, bytes, bytes]] = {}
        self.older: dict[str, tuple[int, bytes, bytes]] = {}
        merges = [
            (self.ranks[t[:i]], self.ranks[t[i:]], r)
            for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        self.tokens = Spellings({r: t for t, r in self.ranks.items()})
        self.numbers = Spellings({r: b"%d," % r for r in self.ranks.values()})
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        self._fill("merges", {"a": [m[0] for m in merges], "b": [m[1] for m in merges], "merged": [m[2] for m in merges]})

    def _fill(self, name: str, columns: dict[str, list[int] | np.ndarray | pa.Array]) -> None:
        self.db.register("_incoming", pa.table({k: pa.array(v, pa.int32()) for k, v in columns.items()}))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM _incoming")
        self.db.unregister("_incoming")

    def _rows(self, sizes: np.ndarray, tokens: np.ndarray) -> None:
        """The tokens of successive lists of one token at least as rows of the table ``source``.

        A row is (word, position, token) and the next row's position and token, null in a word's last row.
        """
        ends = np.cumsum(sizes)
        place = np.arange(len(tokens)) - np.repeat(ends - sizes, sizes)
        last = np.zeros(len(tokens), bool)
        last[ends - 1] = True
        self._fill("source", {
            "w": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes),
            "p": place.astype(np.int32),
            "t": tokens,
            "next_p": pa.array((place + 1).astype(np.int32), mask=last),
            "next_t": pa.array(np.roll(tokens, -1), mask=last),
        })

    def split(self, text: str) -> list[str]:
        return (self.narrow if _NARROW.fullmatch(text) else self.wide).findall(text)

    def _encoded(self, words: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The words' places in the order in which their ids follow, each one's number of ids, and all ids.

        A word has its own rank, or its bytes' tokens merged until no pair has a rank.
        """
        order = [i for i, w in enumerate(words) if w in self.ranks]
        sizes = [np.ones(len(order), np.int64)]
        ids = [np.array([self.ranks[words[i]] for i in order], np.int32)]
        open_words = [i for i, w in enumerate(words) if w not in self.ranks]
        at = 0
        while at < len(open_words):
            chunk, squares = [], 0
            while at < len(open_words) and squares < QUERY_SQUARES:
                i = open_words[at]
                at += 1
                if not words[i] or len(words[i]) > LONG_WORD:
                    merged = self._merge_long(words[i])
                    order.append(i)
                    sizes.append(np.array([len(merged)], np.int64))
                    ids.append(np.array(merged, np.int32))
                else:
                    chunk.append(i)
                    squares += len(words[i]) ** 2
            if chunk:
                lengths = np.fromiter((len(words[i]) for i in chunk), np.int64, len(chunk))
                self._rows(lengths, self.byte_ids[np.frombuffer(b"".join([words[i] for i in chunk]), np.uint8)])
                got = self.db.execute(ENCODE).fetchnumpy()
                order += chunk
                sizes.append(np.bincount(got["w"], minlength=len(chunk)))
                ids.append(got["t"])
        return order, np.concatenate(sizes), np.concatenate(ids)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        out: list[list[int]] = [[] for _ in words]
        order, sizes, ids = self._encoded(words)
        for i, got in zip(order, np.split(ids, np.cumsum(sizes))[:-1], strict=True):
            out[i] = got.tolist()
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        """The same rule over a linked list, with a heap of (rank, place)."""
        part: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(part):
                both = part[i] + part[after[i]]
                if both in self.ranks:
                    heapq.heappush(heap, (self.ranks[both], i, both))

        for i in range(len(word) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if part[i] is not None else len(part)
            if j >= len(part) or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, None
            after[i] = after[j]
            if after[i] < len(part):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [self.ranks[p] for p in part if p is not None]

    def decode_lists(self, lists: list[list[int]]) -> list[bytes]:
        """Bytes of each list of ids; an id without a token gives none."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return self.tokens.of(sizes, np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())))

    def learn(self, split: list[list[str]]) -> None:
        """Encode and decode the words that are not in the cache."""
        every = set().union(*split)
        missing = every.difference(self.words)
        if len(self.words) + len(missing) > CACHE_ROWS:
            self.older, self.words = self.words, {}
            missing = every
        for w in [w for w in missing if w in self.older]:
            self.words[w] = self.older[w]
            missing.discard(w)
        missing = list(missing)
        order, sizes, ids = self._encoded([w.encode("utf-8") for w in missing])
        found = zip(sizes.tolist(), self.numbers.of(sizes, ids), self.tokens.of(sizes, ids), strict=True)
        self.words.update(zip([missing[i] for i in order], found, strict=True))


def coder(path: str, pattern: str) -> Coder:
    """The vocabulary's coder in this worker."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def _added(rows: DataFrame, schema: str, per_piece, column: str) -> DataFrame:
    """The columns of ``rows`` but the last, and those that ``per_piece`` makes of pieces of the last."""
    names = rows.columns[:-1]
    added = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in added]
            for _, texts in text_pieces(b, column, PIECE_CHARS):
                for o, got in zip(out, per_piece(texts), strict=True):
                    o.extend(got)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], *map(pa.array, out)], [*names, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda batches: _typed(run(batches), added, schema), f"{kinds}, {schema}")


def _typed(batches: Iterator[pa.RecordBatch], added: list[str], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    want = [kinds[c.split()[1]] for c in schema.split(", ")]
    for b in batches:
        first = b.num_columns - len(added)
        cols = [b.column(i) if i < first else b.column(i).cast(want[i - first]) for i in range(b.num_columns)]
        yield pa.RecordBatch.from_arrays(cols, b.schema.names)


def encode(docs: DataFrame, path: str, pattern: str, keys: list[Column], text: str = "text") -> DataFrame:
    """``keys`` and ``ids array<int>`` of each whole text, without special tokens; null is empty."""

    def ids(texts: list[str]) -> tuple[list]:
        c = coder(path, pattern)
        split = [c.split(t) for t in texts]
        c.learn(split)
        return ([[int(i) for w in words for i in c.words[w][1].split(b",")[:-1]] for words in split],)

    rows = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return _added(rows, "ids array<int>", ids, "_text")


def decode(docs: DataFrame, path: str, pattern: str, keys: list[Column], ids: str = "ids") -> DataFrame:
    """``keys`` and ``bytes``, what the ids of each row stand for; null is empty."""
    rows = docs.select(*keys, F.coalesce(F.col(ids), F.expr("cast(array() as array<int>)")).alias("_ids"))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            back: list[bytes] = []
            lists = b.column(len(names)).to_pylist()
            for at in range(0, len(lists), 256):
                back.extend(coder(path, pattern).decode_lists(lists[at : at + 256]))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(back, pa.binary())], [*names, "bytes"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, keys: list[Column], text: str = "text") -> DataFrame:
    """``keys`` and ``n_tokens, ids_sha256, decoded_sha256`` of each whole text; null is empty.

    The ids of each distinct word are decoded once in the worker that met it; a
    text's bytes are those of its words in order.
    """

    def digests(texts: list[str]) -> tuple[list, list, list]:
        c = coder(path, pattern)
        split = [c.split(t) for t in texts]
        c.learn(split)
        n, ids, back = [], [], []
        for words in split:
            got = list(map(c.words.__getitem__, words))
            n.append(sum(map(_NUMBER, got)))
            ids.append(hashlib.sha256(b"".join(map(_IDS, got))[:-1]).hexdigest())
            back.append(hashlib.sha256(b"".join(map(_BYTES, got))).hexdigest())
        return n, ids, back

    rows = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return _added(rows, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests, "_text")
