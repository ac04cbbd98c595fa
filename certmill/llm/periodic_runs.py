"""Periodic runs of words from a dictionary of basic factors.

A run is a stretch of words with smallest period q, at least two periods and a given
number of words long, that cannot be extended on either side. Factors whose length is
a power of two get integer names, each level from pairs of names of the level below;
a factor that occurs once in its text is dropped, as no longer one that starts with it
repeats. For a run of period q take the level with L <= q < 2 L: the factor at the run's
first word occurs again q words later. Occurrences at most L / 2 apart form an arithmetic
progression, progressions are more than L / 2 apart, so at most three of them lie within
2 L words, and in each only its first member or the one as far from its end as the factor
is from the end of its own progression can start the second period of a run. These
propose periods; names, longest first, extend them; a multiple of a smaller period covers
the same words and goes.

Texts are independent of each other, so the work is one pass without a shuffle. Memory
is that of one piece of texts, or of one text where it is longer: four bytes for each
word and level at which a factor still repeats.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from certmill.llm.words import SPACES, pieces, split_words, texts_of

LEAST_WORDS = 12
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _factors(names: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, names, names by place) of the factors of 1, 2, 4 ... words that occur more than once."""
    places, length = np.arange(len(names)), 1
    while True:
        often = (np.bincount(names) > 1)[names] if len(names) else np.zeros(0, bool)
        places, names = places[often], names[often]
        if not len(places):
            return
        table = np.full(len(ends), -1, np.int32)
        table[places] = names
        yield places, names, table
        fits = places + 2 * length <= ends[places]
        left, right = names[fits], table[places[fits] + length]
        known = right >= 0
        places = places[fits][known]
        names = pd.factorize(left[known].astype(np.int64) * (int(names.max()) + 1) + right[known])[0]
        length *= 2


def _proposals(places: np.ndarray, names: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) with length <= period < 2 * length, from progressions of equal factors."""
    order = np.argsort(names, kind="stable")
    at, name = places[order], names[order]
    new = np.ones(len(at), bool)
    new[1:] = (name[1:] != name[:-1]) | (2 * np.diff(at) > length)
    chain, first = np.cumsum(new) - 1, np.flatnonzero(new)
    head, tail, of = at[first], at[np.append(first[1:], len(at)) - 1], name[first]
    for step in (1, 2, 3):
        here = np.flatnonzero(chain + step < len(first))
        here = here[of[chain[here] + step] == name[here]]
        i, c = at[here], chain[here]
        for period in (head[c + step] - i, tail[c + step] - tail[c]):
            near = (period >= length) & (period < 2 * length)
            yield i[near], period[near]


def _common(a: np.ndarray, b: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """How many words from places ``a`` on equal those from ``b`` on (a < b), by names of falling length."""
    out = np.zeros(len(a), np.int64)
    for level in range(len(tables) - 1, -1, -1):
        table = tables[level]
        x, y = a + out, b + out
        held = y < len(table)
        left = table[np.where(held, x, 0)]
        out += (held & (left >= 0) & (left == table[np.where(held, y, 0)])).astype(np.int64) << level
    return out


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs by start, then period; starts count over all texts.

    ``words`` are integers, equal for equal words; ``bounds`` are the places at which
    texts begin, with the end added.
    """
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none
    counts = np.diff(bounds)
    text, ends = np.repeat(np.arange(len(counts)), counts), np.repeat(bounds[1:], counts)
    begins = np.repeat(bounds[:-1], counts)
    named = pd.factorize(text * (int(words.max()) + 1) + words)[0]
    tables, starts, periods = [], [none], [none]
    for places, names, table in _factors(named, ends):
        for i, q in _proposals(places, names, 1 << len(tables)):
            opens = (i == begins[i]) | (words[i - 1] != words[i - 1 + q])
            starts.append(i[opens])
            periods.append(q[opens])
        tables.append(table)
    start, period = np.concatenate(starts), np.concatenate(periods)
    length = period + _common(start, start + period, tables)
    long = length >= np.maximum(least, 2 * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[smallest], length[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _columns(texts: pa.Array, least: int) -> list[pa.Array]:
    words, bounds = split_words(texts, SPACES)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start, length, period = find_runs(codes, bounds, least)
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    kept_before = np.concatenate([[0], np.cumsum(kept)])
    left = pa.LargeListArray.from_arrays(kept_before[bounds], words.filter(pa.array(kept)))
    at = np.searchsorted(start, bounds)
    text = np.searchsorted(bounds, start, side="right") - 1
    runs = pa.StructArray.from_arrays([pa.array(start - bounds[text]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    return [
        pa.array(np.diff(bounds)),
        pa.ListArray.from_arrays(pa.array(at, pa.int32()), runs),
        pc.binary_join(left, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string()),
    ]


def periodic_runs(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None, least: int = LEAST_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``doc, n_words, runs, collapsed``.

    ``doc`` is a struct of the columns ``keep``, by default all but the text, so no name
    clashes. ``runs`` holds (start, length, period) by start, then period, counted in words
    from 0. ``collapsed`` are the words that no run repeats, joined by one space: a run
    keeps its first period. Words are cut at space, tab and line ends. A null text is an
    empty one, which has no words, no runs and an empty collapsed text. Equal rows give equal
    rows, an empty table none; texts of any length are read whole.
    """
    names = [c for c in docs.columns if c != text] if keep is None else list(keep)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc") if names else F.lit(None).alias("doc"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc"], *T._parse_datatype_string(f"n_words bigint, runs array<{RUN}>, collapsed string").fields])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            for at, to in pieces(texts):
                out = [batch.column(0).slice(at, to - at), *_columns(texts.slice(at, to - at), least)]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return rows.mapInArrow(search, schema)
