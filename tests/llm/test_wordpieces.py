from __future__ import annotations

import random

from pricewake.llm import wordpieces
from pricewake.llm.tokens import public_tokenizer
from pricewake.llm.wordpieces import PieceCounter, read_ranks, token_counts


def greedy(word: bytes, first: set[bytes], later: set[bytes]) -> int:
    n, entries = 0, first
    while word:
        size = max((k for k in range(1, len(word) + 1) if word[:k] in entries), default=0)
        if not size:
            return -1
        word, entries, n = word[size:], later, n + 1
    return n


def test_counts_equal_greedy_splitting():
    rng = random.Random(2)
    for _ in range(600):
        some = lambda n: {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(n)}
        first, later = some(rng.randint(0, 12)), some(rng.randint(0, 12))
        counter = PieceCounter(first, later)
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14))) for _ in range(30)] + [b"a" * 70, b"abc" * 30]
        expected = [greedy(w, first, later) for w in words]
        assert [counter.count(w) for w in words] == expected
        assert counter.count_all(words).tolist() == expected


def test_a_long_word_takes_linear_steps():
    counter = PieceCounter([b"a" * k for k in (1, 2, 50)], [b"a" * k for k in (1, 2, 50)])
    assert counter.count(b"a" * 200_001) == 4000 + 1


def test_edges_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(wordpieces, "KEPT_WORDS", 3)
    rows = [(1, None, 5), (2, "", 5), (3, " \n ab abab x ab", 5), (None, "ab", 5), (3, "ab é", 5)]
    docs = spark.createDataFrame(rows, "id int, text string, n_tokens int")
    found = token_counts(docs, [b"ab", b"a"], [b"b", b"ab"])
    assert found.columns == ["id", "text", "n_words", "n_tokens", "n_unknown"]
    got = sorted([tuple(r)[2:] for r in found.collect()])
    assert got == sorted([(0, 0, 0), (0, 0, 0), (4, 1 + 2 + 1 + 1, 1), (1, 1, 0), (2, 2, 1)])
    assert token_counts(docs.limit(0), [b"a"], []).count() == 0
    assert [r["n_unknown"] for r in token_counts(docs, [], []).orderBy("n_unknown").collect()] == [0, 0, 1, 2, 4]


def test_query_equals_greedy_splitting(spark, sf_dir):
    entries = set(read_ranks(public_tokenizer("byte_bpe_50k.tiktoken")))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in wordpieces.op5_token_counts(spark, sf_dir).collect():
        words = texts[r["doc_id"]].encode().split()
        assert r["n_words"] == len(words) and r["n_unknown"] == 0
        assert r["n_tokens"] == sum(greedy(b" " + w, entries, entries) for w in words)
