import random
import re

import pytest

from certmill.llm import jaccard_join as j
from certmill.llm.components import smallest_members


def sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    out = [None, "", "?!", "one", "One.", "one two three"]
    shared = " ".join(word() for _ in range(40))
    for _ in range(25):
        base = [word() for _ in range(80)]
        for k in range(6):
            w = list(base)
            for _ in range(k % 3):
                w[r.randrange(80)] = word()
            out.append(" ".join(w) + (" " + shared if k == 5 else "."))
    hot = [word() for _ in range(120)]
    for _ in range(150):  # one large group, and its copies
        w = list(hot)
        w[r.randrange(120)] = word()
        out.append(" ".join(w))
    return out + out[-20:]


def brute(texts, threshold=0.8):
    s = sets(texts)
    n = len(s)
    links = [[k for k in range(n) if k != i and s[i] and s[k] and len(s[i] & s[k]) >= threshold * len(s[i] | s[k]) - 1e-9] for i in range(n)]
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([label[i], *(label[k] for k in links[i])])
            changed |= low != label[i]
            label[i] = low
    return {
        i: (min([i, *(k for k in links[i] if s[k] == s[i])]), label[i], len(links[i]), len({frozenset(s[k]) for k in links[i] if s[k] != s[i]}))
        for i in range(n)
    }


# Small leaves and blocks, so that nodes split and large ones are compared in block pairs.
@pytest.mark.parametrize("opts", [j.JoinOptions(), j.JoinOptions(leaf_rows=8, block_rows=16, recall=0.999999)])
def test_links_and_classes_equal_brute_force(spark, texts, opts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, size string")
    got = {r.doc_id: (r.rep_id, r.class_id, r.n_links, r.n_text_links) for r in j.similarity_join(docs, opts).collect()}
    assert got == brute(texts)


def test_one_of_each_group_stays(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id here", "x")], "doc_id long, text string, rep string")
    kept = j.keep_one_of_each(docs)
    want = {i for i, f in brute(texts).items() if f[1] == i} | {None}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_no_column_is_lost(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-(2**62), "far away")], "doc_id long, text string").selectExpr(
        "*", "concat('a', doc_id) AS _dropped", "concat('b', doc_id) AS id", "concat('c', doc_id) AS row"
    )
    kept = j.keep_one_of_each(docs).collect()
    assert all((r._dropped, r.id, r.row) == (f"a{r.doc_id}", f"b{r.doc_id}", f"c{r.doc_id}") for r in kept)
    assert -(2**62) in {r.doc_id for r in kept}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert j.similarity_join(none).count() == 0 and j.keep_one_of_each(none).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in smallest_members(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}
