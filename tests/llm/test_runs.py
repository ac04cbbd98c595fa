import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from certmill.llm import periodic_runs as p


def brute(x, least=12):
    """(start, length, period) by trying every period."""
    out = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            length = q + i - start
            if length >= max(least, 2 * q):
                out.setdefault((start, length), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(x, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(x) if i not in drop)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4), st.sampled_from([2, 5, 12]))
def test_equals_brute_force(texts, least):
    bounds = np.cumsum([0] + [len(t) for t in texts])
    got = list(zip(*[a.tolist() for a in p.find_runs(np.array(sum(texts, []), np.int64), bounds, least)], strict=True))
    assert got == [(s + int(b), n, q) for t, b in zip(texts, bounds, strict=False) for s, n, q in brute(t, least)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 9), st.integers(1, 40)), max_size=5), st.randoms(use_true_random=False))
def test_repeated_stretches(parts, r):
    text = []
    for letters, period, length in parts:
        block = [r.randint(0, letters) for _ in range(period)]
        text += [block[i % period] for i in range(length)]
    got = list(zip(*[a.tolist() for a in p.find_runs(np.array(text, np.int64), np.array([0, len(text)]))], strict=True))
    assert got == brute(text)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "a " * 12), (4, "a" + " b a" * 7), (5, "a\x0bb\x1fc " * 9), (6, "é ü ö " * 8), (7, "a " * 11)]
    for i in range(8, 80):
        words = [r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.choice([5, 40, 200]))]
        a, q = r.randrange(len(words)), r.randint(1, 30)
        words = words[:a] + [words[min(len(words) - 1, a + (k - a) % q)] for k in range(a, len(words))]
        out.append((i, r.choice([" ", "  ", "\n"]).join(words)))
    return out + [(None, "x y " * 20), (3, "a " * 12)]


def test_whole_texts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'mine' AS runs", "1 AS doc", "array(2) AS collapsed")
    got = p.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    for g in got:
        assert (g.doc.runs, g.doc.doc, g.doc.collapsed) == ("mine", 1, [2])
    by = {}
    for g in got:
        by.setdefault(g.doc.doc_id, []).append(g)
    for d, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want = brute(words)
        for g in by[d]:
            assert g.n_words == len(words) and [tuple(x) for x in g.runs] == want
            assert g.collapsed == collapsed(words, want)


def test_one_very_long_text(spark):
    text = "lead " + "a b c " * 200_000 + "tail"
    got = p.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in got.runs] == [(1, 600_000, 3)] and got.collapsed == "lead a b c tail"


def test_empty_table_and_no_other_column(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert p.periodic_runs(none).count() == 0
    assert p.periodic_runs(spark.createDataFrame([("a " * 20,)], "text string")).first().runs[0].length == 20
