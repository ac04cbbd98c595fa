"""Each stage of the pipeline against a plain version of it, on its own input."""

import re

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from certmill.llm import pii, quality
from certmill.session import stored
from tests.llm.test_similar import brute
from tests.llm.test_spans import base_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # Columns that stages could use themselves.
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in ("row", "key", "id", "_dropped", "_row_key", "all_spans", "host")})
    found = [docs]
    for name, stage in cp.STAGES:
        found.append(stored(stage(spark, found[-1], SF), f"test-{name}"))
    return found


def test_columns_and_their_values_stay(tables):
    for t in tables[1:5]:
        assert t.dtypes == tables[0].dtypes
        assert all(r.row == f"row{r.doc_id}" and r._dropped == f"_dropped{r.doc_id}" and r.all_spans == f"all_spans{r.doc_id}" for r in t.collect())


def test_quality_keeps_what_its_scores_keep(spark, tables):
    scored = quality.score_quality(tables[0], spark.read.parquet(f"{SF}/labels.parquet"), F.col("source"), F.col("lang"))
    kept = {r.doc_id for r in scored.filter("keep").collect()}
    assert {r.doc_id for r in tables[1].collect()} == kept and 100 < len(kept) < 200


def test_one_of_equal_texts_stays(tables):
    first = {}
    for r in sorted(tables[1].collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in tables[2].collect()) == sorted(first.values())


def test_one_of_each_class_stays(tables):
    rows = sorted(tables[2].collect(), key=lambda r: r.doc_id)
    found = brute([r.text for r in rows])
    assert sorted(r.doc_id for r in tables[3].collect()) == [r.doc_id for i, r in enumerate(rows) if found[i][1] == i]


def test_private_data_is_replaced_and_nothing_else(tables):
    before = {r.doc_id: r.text for r in tables[3].collect()}
    after = {r.doc_id: r for r in tables[4].collect()}
    spans = {r.doc_id: r.all_spans for r in pii.find_private(tables[3].select("doc_id", "text")).withColumnRenamed("all_spans", "all_spans").collect()}
    assert after.keys() == before.keys()
    for d, t in before.items():
        assert {(k, s, e) for k, s, e in base_spans(t or "")} <= {(x.kind, x.start, x.end) for x in spans[d]}
        if not spans[d]:
            assert after[d].text == t
        else:
            assert base_spans(after[d].text) == [] and after[d].n_chars == len(after[d].text)


def test_batches_hold_every_document_with_its_text(tables):
    texts = {r.doc_id: r.text for r in tables[4].collect()}
    packed = tables[5].collect()
    assert {r.doc_id: r.text for r in packed} == texts and len(packed) == len(texts)
    used = {}
    for r in packed:
        assert r.n_tokens == len((r.text or "").split()) <= r.padded_to
        used.setdefault((r.bucket, r.batch), []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in used.values())


def test_windows_cover_the_whole_text():
    few = "a b c d e " * 200
    many = " ".join(f"w{i}" for i in range(1000))
    at = quality.FEATURES.index("distinct")
    assert quality.text_features(few)[at] == 5 / 1000
    # What follows the first thousand words counts as much as they do.
    assert quality.text_features(many + " " + few)[at] == pytest.approx(1005 / 2000)
    assert quality.text_features(few + many)[at] == pytest.approx(1005 / 2000)
