import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from certmill.llm import language, packing, quality, topk

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held", language.held_out(F.col("doc_id")))
    model = language.train(docs.filter("not held"))
    rows = language.predict(docs.filter("held"), model, [F.col("doc_id"), F.col("lang")]).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_texts_without_letters_are_unknown(spark):
    docs = spark.createDataFrame(
        [(1, "the cat", "en", 1.0), (2, "le chat", "fr", 1.0), (3, None, "en", 1.0), (4, "12 !", None, 1.0), (5, "", "en", 1.0), (6, "the the", None, 1.0)],
        "doc_id long, text string, lang string, score double",
    )
    rows = {r.doc_id: r for r in language.predict(docs, language.train(docs), [F.col("doc_id")]).collect()}
    assert [rows[i].lang_pred for i in range(1, 7)] == ["en", "fr", "und", "und", "und", "en"]
    none = language.train(docs.filter("false"))
    assert {r.lang_pred for r in language.predict(docs, none, [F.col("doc_id")]).collect()} == {"und"}


def test_ngrams_do_not_cross_texts():
    one = language.hashed_ngrams(["ab c"], 1024)
    both = language.hashed_ngrams(["xyz", "ab c", "", None, "q"], 1024)
    start = both[1][0]
    assert both[0][start : start + both[1][1]].tolist() == one[0].tolist() and both[1][2] == both[1][3] == 0


def test_stretches_give_the_same_ngrams():
    texts = ["Σας ab c", "", None, "x" * 50, "é漢 12 z!"]
    grams, n = language.hashed_ngrams(texts, 4096)
    parts = list(language.ngram_stretches(texts, 4096, 7))
    assert np.concatenate([g for g, _ in parts]).tolist() == grams.tolist()
    assert sum(k for _, k in parts).tolist() == n.tolist() and len(parts) > 8


def plain_ngrams(text, buckets):
    """The same n-grams one by one, in plain whole numbers."""
    c = [ord(x) if x.isalpha() else 32 for x in "  " + text.lower() + "  "]
    m = 0xFFFFFFFF
    for a, b, d in zip(c, c[1:], c[2:], strict=False):
        two = (a * 0x9E3779B1 & m) ^ (b * 0x85EBCA77 & m)
        three = (a * 0xC2B2AE3D & m) ^ (b * 0x27D4EB2F & m) ^ (d * 0x165667B1 & m)
        for h, some in ((two, (a, b)), (three, (a, b, d))):
            if any(x != 32 for x in some):
                h = (h ^ h >> 15) * 0x2C1B3C6D & m
                yield (h ^ h >> 13) % buckets


def test_languages_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language, "STRETCH_CHARS", 64)
    rows = [(i, t, lang) for i, (t, lang) in enumerate(
        [("the cat sat on the mat", "en"), ("a dog and the cat", "en"), ("le chat est sur la table", "fr"), ("der Hund und die Katze", "de"),
         ("le chien " * 60, "fr"), ("the cat sat on the mat", "en"), ("Katze 12", None), ("chat cat", None), ("the " * 200, None), ("12", None)]
    )]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs = sorted({x for *_, x in rows if x})
    counts = {x: np.full(512, 0.5) for x in langs}
    for _, t, x in rows:
        for g in plain_ngrams(t, 512) if x else ():
            counts[x][g] += 1
    share = {x: sum(r[2] == x for r in rows) / sum(r[2] is not None for r in rows) for x in langs}
    got = {r.doc_id: r for r in language.predict(docs, language.train(docs, buckets=512), [F.col("doc_id")]).collect()}
    for i, t, _ in rows[:-1]:
        grams = list(plain_ngrams(t, 512))
        logs = [np.log(share[x]) + np.log(counts[x] / counts[x].sum())[grams].sum() for x in langs]
        p = np.exp(np.array(logs) - max(logs))
        assert got[i].lang_pred == langs[int(np.argmax(logs))] and got[i].score == pytest.approx(p.max() / p.sum(), rel=1e-3)
    assert got[9].lang_pred == "und"


def test_ties_repeats_and_empty_tables_of_languages(spark):
    docs = spark.createDataFrame([(1, "ab", "y"), (2, "ab", "x"), (2, "ab", "x"), (1, "ab", "y")], "doc_id long, text string, lang string")
    model = language.train(docs)
    rows = language.predict(docs, model, [F.col("doc_id")]).collect()
    assert [r.lang_pred for r in rows] == ["x"] * 4 and all(r.score == pytest.approx(0.5) for r in rows)
    assert language.predict(docs.filter("false"), model, [F.col("doc_id")]).count() == 0


def test_many_languages_keep_the_buckets(spark):
    docs = spark.range(700).selectExpr("concat('w', id, ' text') AS text", "concat('lang', id) AS lang")
    assert language.train(docs).log_p.shape == (700, language.BUCKETS)


def test_quality_of_documents_that_were_not_fitted_on(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    scored = quality.score_quality(docs, labels.filter(~fold), F.col("source"), F.col("lang")).join(labels.filter(fold), "doc_id").collect()
    assert len(scored) > 100 and np.mean([r.keep == bool(r.quality) for r in scored]) > 0.95


def test_quality_finds_junk_and_keeps_the_rest(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_quality(docs, labels, F.col("source"), F.col("lang")).join(labels, "doc_id").collect()
    assert np.mean([r.keep == bool(r.quality) for r in scored]) > 0.97
    kept = quality.keep_good(docs, labels, F.col("source"), F.col("lang"))
    assert kept.columns == docs.columns and {r.doc_id for r in scored if r.keep} <= {r.doc_id for r in kept.collect()}


def test_sparse_sites_shrink_to_the_mean(spark):
    rows = [("big", "a", 3.0)] * 200 + [("bad", "a", -3.0)] * 200 + [("one", "a", -3.0), ("", "", 0.0)]
    scored = spark.createDataFrame(rows, "host string, path string, logit double")
    out = {r.host: r.site_prior for r in quality.combined(scored, quality.site_priors(scored), 0.0).collect()}
    assert out["bad"] < 0.2 < 0.35 < out["one"] < 0.65 < out["big"]


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, "x"), (1, "", "s", "p", "x"), (1, "", "s", "p", "x")], "doc_id long, text string, source string, lang string, logit string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(docs, labels, F.col("source"), F.col("lang")).count() == 3
    assert quality.keep_good(docs.filter("false"), labels, F.col("source"), F.col("lang")).count() == 0


def test_boundaries_are_optimal():
    r = random.Random(3)
    lengths = [r.choice([1, 2, 3, 7, 8, 20, 21, 50]) for _ in range(60)]
    cells = [(n, lengths.count(n), n * lengths.count(n)) for n in sorted(set(lengths))]

    def padding(bounds):
        return sum(min(b for b in bounds if b >= n) - n for n in lengths)

    tops = [c[0] for c in cells]
    for k in (1, 2, 3, 5):
        best = min(padding([*c, tops[-1]]) for c in itertools.combinations(tops[:-1], min(k, len(tops)) - 1))
        assert padding(packing.best_boundaries(cells, k)) == best and len(packing.best_boundaries(cells, k)) <= k


def test_boundaries_of_many_lengths_are_optimal():
    r = random.Random(5)
    lengths = sorted(min(20_000, int(r.lognormvariate(6, 1.2))) for _ in range(3000))
    tops = sorted(set(lengths))
    cells = [(n, lengths.count(n), n * lengths.count(n)) for n in tops]
    count, total = np.cumsum([0, *[c[1] for c in cells]]), np.cumsum([0, *[c[2] for c in cells]])
    best = np.array([0.0, *[np.inf] * len(cells)])
    for k in range(1, 17):
        best = np.array([np.inf, *[
            (best[:j] + tops[j - 1] * (count[j] - count[:j]) - (total[j] - total[:j])).min() for j in range(1, len(cells) + 1)
        ]])
        bounds = packing.best_boundaries(cells, k)
        ends = np.array(bounds)[np.searchsorted(bounds, lengths)]
        assert len(bounds) == k and int((ends - np.array(lengths)).sum()) == int(best[-1])


def test_histogram_is_exact_within_its_bound(spark):
    lengths = spark.range(3000).selectExpr("id * id % 2003 AS n_tokens")
    seen = [i * i % 2003 for i in range(3000)]
    want = [(n, seen.count(n), n * seen.count(n)) for n in sorted(set(seen))]
    assert packing.length_histogram(lengths) == want
    cells = packing.length_histogram(lengths, 640)
    assert len(cells) <= 640 and [sum(c[i] for c in cells) for i in (1, 2)] == [3000, sum(seen)] and cells[-1][0] == max(seen)


def test_a_document_over_the_budget_is_whole(spark):
    docs = spark.createDataFrame([("a", "w " * 90), ("b", "w " * 3), ("c", "w " * 3), ("d", None)], "doc_id string, text string")
    rows = {r.doc_id: r for r in packing.pack(docs, packing.PackOptions(buckets=2, budget=50)).collect()}
    assert (rows["a"].n_tokens, rows["a"].padded_to, rows["a"].batch_capacity) == (90, 90, 1)
    assert {rows[i].padded_to for i in "bcd"} == {3} and sorted(rows[i].slot for i in "bcd") == [0, 1, 2]


def test_batches_hold_their_budget(spark):
    docs = spark.createDataFrame(
        [(i % 50 if i % 7 else None, None if i % 11 == 0 else "w " * (i * i % 900), i) for i in range(200)], "doc_id long, text string, batch int"
    )
    rows = packing.pack(docs, packing.PackOptions(buckets=4, budget=500)).collect()
    assert len(rows) == 200 and sum(r.n_tokens for r in rows) == sum(i * i % 900 for i in range(200) if i % 11)
    batches = {}
    for r in rows:
        assert r.n_tokens <= r.padded_to
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for b in batches.values():
        assert sorted(r.slot for r in b) == list(range(len(b))) and (len(b) == 1 or len(b) * b[0].padded_to <= 500)
    assert packing.pack(docs.filter("false")).count() == 0


def brute(rows, k):
    v = {i: [int(np.floor(64 * x)) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = {}
    for q in (i for i in v if i % 20 == 0):
        s = sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=False)), i) for i in v if i != q)[:k]
        out.update({(q, r + 1): (i, -x) for r, (x, i) in enumerate(s)})
    return out


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_products_equal_brute_force(spark, scale):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.float32(r.normal(size=12) * r.choice([0.1, 1, 3]) * scale)]) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(40)] + [(400, None), (420, [1.0, None]), (440, [float("nan")]), (460, [0.5, 1.0]), (None, [1.0]), (480, [])]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<float>, score int")
    v = topk.integer_vectors(df)
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk.top_products(v, v.filter("vec_id % 20 = 0"), 7, block=64).collect()}
    assert got == brute(rows, 7)
    none = v.filter("false")
    assert topk.top_products(none, none).count() == 0


def test_kept_columns_meet_their_rows_and_batches_lie_together(spark):
    rows = [(None, "a"), (1, ""), (1, ""), (2, None), (3, "w " * 700)] + [(i, f"t{i} " * (1 + i % 9)) for i in range(10, 400)]
    docs = spark.createDataFrame([(i, t, f"k{n}", n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, kept string, row int")
    packed = packing.pack(docs, packing.PackOptions(buckets=4, budget=60), keep=["text", "kept", "row"])
    plain = packing.pack(docs, packing.PackOptions(buckets=4, budget=60))
    placed = packed.select(F.spark_partition_id().alias("p"), "*").collect()
    assert sorted((r.row, r.kept, r.doc_id, r.text) for r in placed) == [(n, f"k{n}", i, t) for n, (i, t) in enumerate(rows)]
    assert all(r.n_tokens == len((r.text or "").split()) for r in placed)
    assert packed.select(*plain.columns).exceptAll(plain).count() == 0
    assert len({(r.bucket, r.batch) for r in placed}) == len({(r.bucket, r.batch, r.p) for r in placed})
    assert packing.pack(docs.limit(0), keep=["text"]).count() == 0
