import numpy as np
from pyspark.sql import functions as F

from certmill.llm import quality


def test_logits_of_features_are_columns_and_equal_the_model(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(40, 10)) * 3, np.zeros((1, 10)), np.full((1, 10), 1e6), np.full((1, 10), -1e6)])
    model = quality.fit(x[:40], (x[:40, 0] + rng.normal(size=40) > 0).astype(float))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>")
    got = df.select("i", quality._logit_of(model, F.col("x")).alias("logit")).orderBy("i").collect()
    assert np.allclose([r.logit for r in got], model.logits(x), rtol=0, atol=1e-9)
    flat = quality.fit(x[:40], np.ones(40))
    assert {r[0] for r in df.select(quality._logit_of(flat, F.col("x"))).collect()} == {0.0}


def test_scores_need_python_for_the_features_only(spark):
    rows = [(i, None if i == 3 else ("word " * (i % 5 + 1) + "!" * (i % 3)) * (40_000 if i == 7 else 1), "abc"[i % 3], "en") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    scored = quality.score_quality(docs, labels, F.col("source"), F.col("lang"))
    assert scored.count() == 30 and {r.doc_id for r in scored.collect()} == set(range(30))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    kept = {r.doc_id for r in quality.keep_good(docs, labels, F.col("source"), F.col("lang")).collect()}
    assert kept == {r.doc_id for r in scored.where("keep").collect()}
