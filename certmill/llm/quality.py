"""Document quality by hierarchical empirical Bayes.

A logistic classifier over surface features of the whole text gives each document
its evidence. Sums over all documents of a site, and of a section (path) within it,
give posteriors: a section shrinks towards its site and a site towards the global
mean, the more the fewer documents it has; the prior strengths come from the spread
of the means (method of moments). A document's own share is taken out of its site
before the two are combined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from certmill.llm.batches import text_pieces
from certmill.plans.joins import lookup_join
from certmill.session import stored

#: The classifier is fitted on at most this many labelled documents, those of smallest hash.
FIT_ROWS = 20_000
KEEP_FROM = 0.5
WINDOW = 1000
FEATURES = ("upper", "symbols", "bangs", "pipes", "digits", "repeats", "distinct", "word_length", "log_words", "commas")


def text_features(text: str | None) -> list[float]:
    """Shares that tell prose from junk; an empty text has zeros throughout."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    upper, lower, digits = raw[65:91].sum(), raw[97:123].sum() + raw[128:].sum(), raw[48:58].sum()
    marks = raw[33:127].sum() - raw[65:91].sum() - raw[97:123].sum() - digits
    plain = raw[[ord(c) for c in ".,;:'\"?!-|()"]].sum()
    n, chars = len(words), max(1, raw.sum())
    # Distinct words of windows over the whole text: their share does not fall with its length.
    distinct = sum(len(set(words[at : at + WINDOW])) for at in range(0, n, WINDOW))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        upper / max(1, upper + lower), (marks - plain) / chars, raw[33] / n, raw[124] / n, digits / chars,
        same / n, distinct / n, min(chars / n, 40.0) / 10, float(np.log1p(n)) / 10, raw[44] / n,
    ]


@dataclass(frozen=True)
class Model:
    """Weights with the intercept last, scaling, and the logit of the labelled share."""

    weights: list[float]
    mean: list[float]
    scale: list[float]
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - np.array(self.mean)) / np.array(self.scale), -8, 8)
        return np.clip(z @ np.array(self.weights[:-1]) + self.weights[-1], -30, 30)


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model:
    """Logistic regression by Newton steps; without both classes the evidence is 0 for all."""
    d = x.shape[1] if len(x) else len(FEATURES)
    if not len(y) or y.min() == y.max():
        return Model([0.0] * (d + 1), [0.0] * d, [1.0] * d, 0.0)
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    w = np.zeros(d + 1)
    penalty = np.diag([ridge] * d + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(w.tolist(), mean.tolist(), scale.tolist(), _logit(float(np.clip(y.mean(), 1e-3, 1 - 1e-3))))


def _features(docs: DataFrame, doc_id: str, text: str, host: Column, path: Column) -> DataFrame:
    """One stored row per document: ``doc_id, host, path, x``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Batch by batch of bounded text, so that no more of it is held than one piece.
            for start, texts in text_pieces(b, "text"):
                part, x = b.slice(start, len(texts)), [text_features(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("host"), part.column("path"), pa.array(x, pa.list_(pa.float64()))],
                    ["doc_id", "host", "path", "x"],
                )

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text).alias("text"),
    )
    schema = "doc_id long, host string, path string, x array<double>"
    return stored(rows.mapInArrow(measure, schema), "quality-features")


def train(features: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", most: int = FIT_ROWS) -> Model:
    """Fit on at most ``most`` labelled documents; a document with several labels takes the lowest."""
    one = (
        labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.min(label).cast("double").alias("y"))
    )
    known = lookup_join(features.select("doc_id", "x"), stored(one, "labels"), "doc_id", "inner")
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(most).select("x", "y").collect()
    return fit(np.array([r["x"] for r in rows], dtype=np.float64), np.array([r["y"] for r in rows], dtype=np.float64))


def _strength(means: DataFrame, spread: Column, n: Column) -> float:
    """Prior strength in documents: within-group variance over the variance between group means."""
    r = means.agg(F.avg(spread).alias("within"), F.var_pop("mean").alias("between"), F.avg(1 / n).alias("inverse")).first()
    if r["within"] is None:
        return 10.0
    between = max((r["between"] or 0.0) - r["within"] * r["inverse"], 1e-6)
    return float(np.clip(r["within"] / between, 1.0, 1000.0))


def _logit_of(model: Model, x: Column) -> Column:
    """:meth:`Model.logits` of one row's features as a column expression; no row goes to Python."""
    clip = lambda v, most: F.least(F.greatest(v, F.lit(-most)), F.lit(most))
    out = F.lit(model.weights[-1])
    for i, (weight, mean, scale) in enumerate(zip(model.weights, model.mean, model.scale, strict=False)):
        out = out + clip((F.get(x, F.lit(i)) - mean) / scale, 8.0) * weight
    return clip(out, 30.0)


def _evidence(model: Model):
    """The classifier over texts, so that rows keep all their columns and nothing is joined by id."""

    @F.arrow_udf(T.DoubleType())
    def of(texts: pa.Array) -> pa.Array:
        m = np.array([text_features(t.as_py()) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))
        return pa.array(model.logits(m), pa.float64())

    return of


@dataclass(frozen=True)
class SitePriors:
    """Sums of each section (stored) and the global figures."""

    sections: DataFrame
    mean: float
    host_strength: float
    path_strength: float


def site_priors(scored: DataFrame) -> SitePriors:
    """Sums of classifier probabilities by site and section, from ``host, path, logit``."""
    p = 1 / (1 + F.exp(-F.col("logit")))
    paths = stored(scored.groupBy("host", "path").agg(F.sum(p).alias("path_p"), F.count(F.lit(1)).alias("path_n")), "sections")
    hosts = paths.groupBy("host").agg(F.sum("path_p").alias("host_p"), F.sum("path_n").alias("host_n"))
    every = hosts.agg(F.sum("host_p").alias("p"), F.sum("host_n").alias("n")).first()
    mean = float(np.clip((every["p"] or 0.0) / (every["n"] or 1), 1e-3, 1 - 1e-3)) if every["n"] else 0.5
    grouped = lambda t, a, n: t.select((F.col(a) / F.col(n)).alias("mean"), F.col(n).alias("n"))
    strength = lambda t: _strength(t, F.col("mean") * (1 - F.col("mean")), F.col("n"))
    sections = stored(lookup_join(paths, hosts, "host", "inner"), "section-sums")
    return SitePriors(sections, mean, strength(grouped(hosts, "host_p", "host_n")), strength(grouped(paths, "path_p", "path_n")))


def combined(rows: DataFrame, priors: SitePriors, base: float) -> DataFrame:
    """``rows`` (with ``host, path, logit``) and ``p_doc``, ``site_prior``, ``p_quality``."""
    p = 1 / (1 + F.exp(-F.col("logit")))
    joined = lookup_join(rows, priors.sections, ["host", "path"], "left")
    host = (priors.host_strength * priors.mean + F.col("host_p") - p) / (priors.host_strength + F.col("host_n") - 1)
    path = (priors.path_strength * host + F.col("path_p") - p) / (priors.path_strength + F.col("path_n") - 1)
    prior = F.least(F.greatest(path, F.lit(0.001)), F.lit(0.999))
    logit = F.col("logit") - base + F.ln(prior / (1 - prior))
    out = joined.withColumn("p_doc", p).withColumn("site_prior", prior).withColumn("p_quality", 1 / (1 + F.exp(-logit)))
    return out.drop("path_p", "path_n", "host_p", "host_n")


def _prepared(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, host: Column, path: Column) -> tuple[Model, SitePriors, DataFrame]:
    features = _features(docs, doc_id, text, host, path)
    model = train(features, labels, doc_id)
    scored = features.select("doc_id", "host", "path", _logit_of(model, F.col("x")).alias("logit"))
    return model, site_priors(scored.select("host", "path", "logit")), scored


def score_quality(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, host, path, p_doc, site_prior, p_quality, keep``.

    Null hosts and paths are empty ones. An empty or null text is scored by the
    classifier like any other. Without labels nothing is rejected.
    """
    model, priors, scored = _prepared(docs, labels, doc_id, text, host, path)
    return combined(scored, priors, model.base).select(
        "doc_id", "host", "path", "p_doc", "site_prior", "p_quality", (F.col("p_quality") >= KEEP_FROM).alias("keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`score_quality` keeps, with all their columns."""
    model, priors, _ = _prepared(docs, labels, doc_id, text, host, path)
    row = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(
        row.alias("row"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"), _evidence(model)(F.col(text)).alias("logit"),
    )
    return combined(rows, priors, model.base).filter(F.col("p_quality") >= KEEP_FROM).select("row.*")
