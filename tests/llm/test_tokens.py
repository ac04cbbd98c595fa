import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from certmill.llm import bpe, token_counts as tc

RANKS, MODEL = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "a ", " a", "a  b\n\n c\t", "<|endoftext|> <s> </s>", "don't we'll", "ﬁ 漢字 😀 x", "a\x1cb \x1f", "É" * 300, "ab" * 20_000, "▁a ▁▁ b▁", "\x85 \xa0 b"]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def piece():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")


def test_ids_and_round_trip(docs, tik):
    rows = {r.doc_id: r for r in bpe.round_trip(docs, RANKS, P.PATTERN, [F.col("doc_id")]).collect()}
    for i, t in enumerate(TEXTS):
        ids = tik.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_decode_inverts_encode(docs):
    ids = bpe.encode(docs, RANKS, P.PATTERN, [F.col("doc_id")])
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(ids, RANKS, P.PATTERN, [F.col("doc_id")]).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text_encodes_as_the_library_does(texts):
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.coder(RANKS, P.PATTERN).ranks, special_tokens={})
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    c = bpe.coder(RANKS, P.PATTERN)
    for t in texts:
        words = c.split(t)
        assert [i for w in c.encode_words([w.encode() for w in words]) for i in w] == tik.encode_ordinary(t)


def test_long_words_follow_the_same_rule():
    c = bpe.coder(RANKS, P.PATTERN)
    words = [b"international" * 9, b"aaaaaaa" * 20, "straße".encode() * 20]
    assert [c._merge_long(w) for w in words] == c.encode_words(words)


def test_a_round_of_merges_sorts_nothing_and_decoding_asks_no_query(monkeypatch):
    c = bpe.Coder(RANKS, P.PATTERN)
    assert c.encode_words([]) == [] and c.encode_words([b"", b"abcabc qq"])[0] == []
    steps = "\n".join(r[1] for r in c.db.execute("EXPLAIN " + bpe.ENCODE).fetchall()).upper()
    assert "CTE" in steps and "WINDOW" not in steps
    ids = c.encode_words([" straße".encode(), b"a", b"qzxqzx"])
    monkeypatch.setattr(c, "db", None)
    assert c.decode_lists([*ids, [], [10**9, -1, *ids[1]]]) == [" straße".encode(), b"a", b"qzxqzx", b"", b"a"]
    assert c.decode_lists([]) == []


def test_counts_equal_the_library(docs, piece):
    rows = {r.doc_id: r for r in tc.token_counts(docs, MODEL, [F.col("doc_id")], cache_rows=5).collect()}
    for i, t in enumerate(TEXTS):
        assert (rows[i].n_tokens, rows[i].n_bytes) == (len(piece.encode(t or "")), len((t or "").encode())), t


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=" ab▁\n\té漢<s>", max_size=30))
def test_pre_tokens_add_up(t):
    model = tc.load(MODEL)[0]
    assert sum(len(model.encode(w)) if w else 1 for w in tc.pre_tokens(t)) == len(model.encode(t))


def test_table_finds_its_own_words_only():
    words = [f"w{i}" for i in range(500)] + ["", "é漢"]
    table = tc.LengthTable.of(words, list(range(502)))
    assert table.find(words).tolist() == list(range(502)) and (table.find([f"x{i}" for i in range(500)]) == -1).all()
    one = tc.LengthTable(table.first, table.second + np.uint64(1), table.length)
    assert (one.find(words) == -1).all() and tc.LengthTable.of([], []).find(["a"]).tolist() == [-1] and len(table.find([])) == 0


def test_equal_first_halves_are_left_to_the_second_tier(monkeypatch):
    monkeypatch.setattr(tc, "hashes", lambda ws: np.array([[len(w), sum(w.encode())] for w in ws], np.uint64).reshape(-1, 2))
    assert tc.LengthTable.of(["ab", "cd", "xyz"], [1, 2, 3]).find(["ab", "cd", "xyz", "zyx", "abc"]).tolist() == [-1, -1, 3, 3, -1]


def test_lengths_kept_by_a_worker_are_bounded():
    kept = tc.Lengths()
    kept.add([f"{i:05d}" * 20 for i in range(10_000)] + ["x" * 5000], list(range(10_001)), 100_000, 1 << 20)
    assert kept.size <= 1 << 20 and len(kept.by_word) <= (1 << 20) // 560 and "x" * 5000 not in kept.by_word
    kept.add(["a", "b", "c"], [1, 1, 1], 2, 1 << 20)
    assert kept.by_word == {"c": 1} or len(kept.by_word) <= 2


def test_long_pre_tokens_and_repeated_rows(spark, piece):
    texts = ["漢字" * 25_000, "QUJD" * 25_000 + " a", "a b", "a b", "a b"]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = tc.token_counts(docs, MODEL, [F.col("doc_id")]).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((i // 2, len(piece.encode(t))) for i, t in enumerate(texts))


def test_empty_table(docs):
    none = docs.filter("false")
    assert bpe.round_trip(none, RANKS, P.PATTERN, [F.col("doc_id")]).count() == 0
    assert tc.token_counts(none, MODEL, [F.col("doc_id")]).count() == 0
