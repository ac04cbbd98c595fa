import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from certmill.llm import lexical

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs]
    n = [sum(c.values()) for _, c in held]
    big_n, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for item, text in dict.fromkeys(items):
        found = []
        for (d, c), length in zip(held, n, strict=True):
            score = 0
            for t in terms(text):
                if c[t]:
                    m = 100 - 75 + (75 * length * big_n) // total
                    w = math.floor(1000 * math.log((2.0 * big_n + 2) / (2.0 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, d is None, d, len(found)))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out |= {(item, text, rank, f[2], -f[0]) for rank, f in enumerate(found[:k], 1)}
    return out


@pytest.fixture(scope="module")
def tables():
    r = random.Random(3)
    words = ["Ab", "ab", "Äb", "äb", "c1", "x-y", "日本", "z"] + [f"w{i}" for i in range(60)]
    text = lambda n: "".join(r.choice(words[: r.choice([8, 20, 68])]) + r.choice([" ", ", ", "\n", "_"]) for _ in range(n))
    docs = [(i, text(r.choice([1, 3, 20, 60]))) for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(200)] + [docs[9]] * 5
    docs += [(None, docs[3][1]), (None, None), (2000, None), (2001, ""), (2002, "-- .."), (2003, text(20000))]
    items = [(i, text(r.choice([1, 4, 30]))) for i in range(25)] + [(50, docs[7][1]), (50, docs[8][1]), (51, None), (52, "nowhere"), (None, "w1 w2"), (3, "w1")]
    return docs, items + items[:4]


@pytest.mark.parametrize("leaf, block", [(2, 50), (64, 8192)])
def test_equals_brute_force(spark, tables, monkeypatch, leaf, block):
    monkeypatch.setattr(lexical, "LEAF_DOCS", leaf)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS terms", "2 AS score")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS rank")
    got = lexical.rank_documents(d, i, 10, pass_bytes=400 if leaf == 2 else lexical.PASS_BYTES)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute(docs, items, 10)
    assert Counter(tuple(r) for r in got.collect()) == Counter((i, rank, d, s) for i, _, rank, d, s in want)


def test_tree_bounds_hold_and_prune():
    r = np.random.default_rng(1)
    sizes = r.integers(1, 12, 600)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ranks = np.concatenate([np.sort(r.choice(40, s, replace=False)) for s in sizes])
    tfs, m = r.integers(1, 9, starts[-1]), r.integers(25, 200, 600)
    tree = lexical.Tree(np.arange(600), m, starts, ranks, tfs, 40)
    for node, leaf in enumerate(tree.leaf):
        if leaf is not None:
            for doc in range(*leaf):
                a, b = tree.starts[doc], tree.starts[doc + 1]
                assert (tree.gain[a:b] <= tree.most[node][tree.ranks[a:b]]).all()
        else:
            assert all((tree.most[c] <= tree.most[node]).all() and tree.first[node] <= tree.first[c] for c in tree.children[node])
    assert sorted(x for leaf in tree.leaf if leaf for x in range(*leaf)) == list(range(600))
    assert len([x for x in tree.leaf if x]) > 5


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical.rank_documents(none, items).count() == 0
    assert lexical.rank_documents(docs, items.filter("false")).count() == 0
    assert lexical.rank_documents(docs, items).count() == 1


def test_long_norms_do_not_overflow():
    n = np.array([10**6, 1])
    assert lexical.length_norm(n, 10**13, 10**17).tolist() == [25 + 75 * 10**19 // 10**17, 25]
