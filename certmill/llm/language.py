"""Language by multinomial naive Bayes over hashed character n-grams.

Counts of all training texts are summed inside each task and then by (language,
stretch of buckets), so a language that most rows have is a few hundred rows of a
shuffle. The matrix of log-probabilities is broadcast: 128 kB for each language of the
training rows, with the default number of buckets. That number is a parameter and does
not follow the data, so predictions do not depend on how many languages there are.

Texts are hashed in stretches of ``STRETCH_CHARS`` characters, so a very long text needs no
more memory than a batch of short ones. Of languages with equal posteriors the first by
name is predicted. Repeated rows each count in training and are rows of the result; an
empty table gives an empty result, also with a model.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from certmill.llm.batches import text_pieces

BUCKETS = 1 << 15
STRETCH_CHARS = 1 << 18
STRETCH = 512
UNKNOWN = "und"
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; made once per worker."""
    if not _TABLE:
        _TABLE.append(np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool))
    return _TABLE[0]


def ngram_stretches(texts: list[str | None], buckets: int, most: int = STRETCH_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all letter bigrams and trigrams in lower case, and how many of them each text has, by stretches.

    Whatever is no letter counts as a space; n-grams without a letter are left out.
    A text's n-grams start from the two spaces before it up to its last character.
    """
    lower = [(t or "").lower() for t in texts]
    ends = np.cumsum([0, *[len(t) + 2 for t in lower]])
    whole = "  " + "  ".join(lower) + "  "
    for start in range(0, int(ends[-1]), most):
        code = np.frombuffer(whole[start : min(start + most, int(ends[-1])) + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[code]
        c = np.where(letter, code, np.uint32(32))
        a, b, d = c[:-2], c[1:-1], c[2:]
        with np.errstate(over="ignore"):
            two = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))
            three = (a * np.uint32(0xC2B2AE3D)) ^ (b * np.uint32(0x27D4EB2F)) ^ (d * np.uint32(0x165667B1))
            out = []
            for h, has in ((two, letter[:-2] | letter[1:-1]), (three, letter[:-2] | letter[1:-1] | letter[2:])):
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                h ^= h >> np.uint32(13)
                out.append((h & np.uint32(buckets - 1), has))
        keep = np.stack([out[0][1], out[1][1]], axis=1).ravel()
        grams = np.stack([out[0][0], out[1][0]], axis=1).ravel()[keep]
        upto = np.concatenate([[0], np.cumsum(keep)])
        yield grams.astype(np.int64), np.diff(upto[2 * np.clip(ends - start, 0, len(a))])


def hashed_ngrams(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`ngram_stretches` as one."""
    size = sum(len((t or "").lower()) + 2 for t in texts)
    return next(ngram_stretches(texts, buckets, max(1, size)), (np.zeros(0, np.int64), np.zeros(0, np.int64)))


@dataclass(frozen=True)
class Model:
    """Languages, and for each the log-probabilities of buckets and of the language itself."""

    langs: list[str]
    log_p: np.ndarray
    log_prior: np.ndarray


def train(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> Model:
    """Counts over all rows with a text and a language. Without any, the model has no language."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(buckets, np.int64))

        def out() -> Iterator[pa.RecordBatch]:
            for name, total in sums.items():
                for at in range(0, buckets, STRETCH):
                    if total[at : at + STRETCH].any():
                        yield pa.RecordBatch.from_pydict(
                            {"lang": [name], "at": pa.array([at], pa.int32()), "counts": [total[at : at + STRETCH].tobytes()]}
                        )
            sums.clear()

        for b in batches:
            names = b.column("lang").to_pylist()
            for first, texts in text_pieces(b, "text"):
                for grams, n in ngram_stretches(texts, buckets):
                    start = 0
                    by: dict[str, list[np.ndarray]] = defaultdict(list)
                    for i, k in enumerate(n):
                        by[names[first + i]].append(grams[start : start + k])
                        start += k
                    for name, parts in by.items():
                        sums[name] += np.bincount(np.concatenate(parts), minlength=buckets)
            if len(sums) > 64:  # many languages: no more than this many tables in a worker
                yield from out()
        yield from out()

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(STRETCH, np.int64)
        for c in part["counts"]:
            total[: len(c) // 8] += np.frombuffer(c, np.int64)
        return pd.DataFrame({"lang": part["lang"][:1], "at": part["at"][:1], "counts": [total.tobytes()]})

    schema = "lang string, at int, counts binary"
    summed = rows.mapInArrow(count, schema).groupBy("lang", "at").applyInPandas(add, schema).collect()
    langs = sorted({r["lang"] for r in summed})
    place = {name: i for i, name in enumerate(langs)}
    log_p = np.full((len(langs), buckets), 0.5)
    for r in summed:
        stretch = np.frombuffer(r["counts"], np.int64)[: buckets - r["at"]]
        log_p[place[r["lang"]], r["at"] : r["at"] + len(stretch)] += stretch
    if langs:
        log_p = np.log(log_p / log_p.sum(1, keepdims=True))
    prior = np.log(np.array([sizes[x] for x in langs], dtype=np.float64) / max(1, sum(sizes[x] for x in langs)))
    return Model(langs, log_p.astype(np.float32), prior)


def predict(docs: DataFrame, model: Model, keys: list[Column], text: str = "text") -> DataFrame:
    """``keys`` and ``lang_pred, score``: the likeliest language and its posterior.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_p, model.log_prior))
    rows = docs.select(*keys, F.col(text).alias("_text"))
    names = rows.columns[:-1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, log_p, prior = shared.value
        buckets = log_p.shape[1]
        for b in batches:
            found: list[str] = []
            scores: list[float] = []
            for _, texts in text_pieces(b, "_text"):
                total, size = np.zeros((len(texts), len(langs))), np.zeros(len(texts), np.int64)
                for grams, n in ngram_stretches(texts, buckets):
                    size += n
                    some = np.flatnonzero(n)
                    if len(some) and langs:
                        starts = np.concatenate([[0], np.cumsum(n)[:-1]])[some]
                        total[some] += np.stack([np.add.reduceat(t[grams], starts, dtype=np.float64) for t in log_p], axis=1)
                some = np.flatnonzero(size)
                lang, best = np.array([UNKNOWN] * len(texts), dtype=object), np.zeros(len(texts))
                if len(some) and langs:
                    whole = total[some] + prior
                    top = whole.max(1, keepdims=True)
                    best[some] = 1 / np.exp(whole - top).sum(1)
                    lang[some] = np.array(langs, dtype=object)[whole.argmax(1)]
                found.extend(lang)
                scores.extend(best)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(len(names))], pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                [*names, "lang_pred", "score"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(score, f"{kinds}, lang_pred string, score double")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is in the fold kept from training; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
