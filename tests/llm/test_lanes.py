import random

import pytest
from pyspark.sql import functions as F

from certmill.llm import topk


@pytest.fixture
def plain(spark):
    """No adaptive merging of partitions, as many of them as there are blocks."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_many_partitions_lanes_and_query_blocks_equal_brute_force(plain):
    r = random.Random(8)
    data = [(i, [float(r.randrange(-30, 30)) * (1 + i % 7) for _ in range(5)]) for i in range(900)]
    data += [(1000 + i, list(data[3][1])) for i in range(40)] + [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0]), (None, [1.0] * 5)]
    frame = plain.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("lane", F.lit(1)).withColumn("norm", F.lit("x"))
    vectors = topk.integer_vectors(frame, scale=1.0)
    got = {}
    for x in topk.top_products(vectors, vectors.filter("vec_id % 9 = 0"), 6, block=16).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    held = {i: [int(c) for c in v] for i, v in data[:940]}
    assert got.keys() == {i for i in held if i % 9 == 0}
    for q, found in got.items():
        scores = sorted((-sum(a * b for a, b in zip(held[q], v, strict=True)), i) for i, v in held.items() if i != q)[:6]
        assert sorted(found) == [(rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]


@pytest.mark.parametrize("partitions, blocks, lanes", [(400, 64, 64), (1000, 61, 1024), (200, 4, 4)])
def test_lanes_are_even(spark, partitions, blocks, lanes):
    ids = spark.range(partitions * blocks).select((F.shiftleft(F.expr(f"id div {blocks}"), 33) + F.col("id") % blocks).alias("block"))
    counts = [r["count"] for r in ids.groupBy(topk.lane_of(F.col("block"), lanes)).count().collect()]
    assert len(counts) == lanes and max(counts) <= 2.5 * partitions * blocks / lanes
