import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from certmill.llm import mixing


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight, the excess of capped sources reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in held]
        rest, shared = total - sum(held.values()), sum(w[s] for s in open_)
        over = [s for s in open_ if Fraction(rest * w[s], shared) > cap * sizes[s]]
        if not over:
            return {**held, **{s: rest * w[s] / shared for s in open_}}
        held |= {s: cap * sizes[s] for s in over}


def tilted(sizes, target, cap=3):
    """Rates exp(a * size), at most ``cap``, whose words are the target, by bisection."""
    if target >= cap * sum(sizes):
        return [cap] * len(sizes)
    lo, hi = -50.0, 50.0
    for _ in range(200):
        a = (lo + hi) / 2
        if sum(x * min(cap, math.exp(min(a * x, 5))) for x in sizes) > target:
            hi = a
        else:
            lo = a
    return [min(cap, math.exp(min(lo * x, 5))) for x in sizes]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    out = []
    for i in range(900):
        source = r.choice(["a", "a", "a", "a", "b", "c", "B", None, "é", "tiny"] if i else ["tiny"])
        if source == "tiny" and i > 40:
            source = "a"
        out.append((i, " ".join(["w"] * r.choice([1, 2, 3, 5, 8, 40, 41, 300, r.randrange(900)])), source, "x", 1))
    out += [(901, None, "b", "x", 1), (902, "", "b", "x", 1), (903, " \t", None, "x", 1), (None, "u v", "c", "x", 1)]
    return out + [(5, "same row", "c", "x", 1)] * 30 + [(910, None, "empty", "x", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string, key int")


@pytest.fixture(scope="module")
def mixed(docs):
    return mixing.mix(docs).collect()


def test_sizes_and_targets(mixed, rows):
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += size_of(text)
    want = targets(sizes)
    assert len(mixed) == len(rows)
    assert Counter((m.doc_id, m.size) for m in mixed) == Counter((d, size_of(t)) for d, t, *_ in rows)
    for m in mixed:
        assert m.source_size == sizes[m.source] and m.target == pytest.approx(want[m.source], rel=1e-12)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_sources_meet_their_targets(mixed):
    taken, aim = Counter(), {}
    for m in mixed:
        assert 0 <= m.copies <= 3 and m.taken == m.copies * m.size <= 3 * m.size
        taken[m.source] += m.taken
        aim[m.source] = m.target
    for s, t in aim.items():
        assert abs(taken[s] - t) <= 3, s
    assert aim["empty"] == 0 and taken["tiny"] == aim["tiny"]  # held at three times its size


def test_rates_are_tilted_by_one_number_of_the_source(mixed, rows):
    by = defaultdict(list)
    for m in mixed:
        if m.size:
            by[m.source].append(m)
    for found in by.values():
        found.sort(key=lambda m: -m.size)
        rates = tilted([m.size for m in found], found[0].target)
        upto = copies = 0
        for i, (m, rate) in enumerate(zip(found, rates, strict=True)):
            upto, copies = upto + rate, copies + m.copies
            if i + 1 == len(found) or found[i + 1].size != m.size:
                # One size of each power of two is changed afterwards, by few copies.
                assert abs(upto - copies) <= 16, (m.source, m.size)


def test_equal_sizes_are_dealt_evenly(mixed):
    by = defaultdict(list)
    for m in mixed:
        by[m.source, m.size].append(m.copies)
    assert all(max(c) - min(c) <= 1 for c in by.values())


def test_order_and_partitions_do_not_matter(docs, mixed):
    again = mixing.mix(docs.repartition(7, F.rand(3)).select("text", "source", "doc_id")).collect()
    assert Counter(again) == Counter(mixed)


def test_empty_tables(spark, docs):
    assert mixing.mix(docs.filter("false")).count() == 0
    none = mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()
    assert {(m.size, m.target, m.taken) for m in none} == {(0, 0.0, 0)}
