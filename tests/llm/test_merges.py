from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from pricewake.llm import merges
from pricewake.llm.merges import CorpusEncoder, MergeTable, decode_ids, encode_texts, read_ranks
from pricewake.llm.tokens import public_tokenizer

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
SIGNS = [*"abcdeaaabÉéßıİΣςſ \n\t\r   .,!?'s't1259#$é́漢字🙂\x1c\x85_-", "the", "ing", "tion", "====", "aaaa", "ha"]


def library(name):
    import public_tokenizers
    import tiktoken

    ranks = read_ranks(public_tokenizer(name))
    return ranks, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_by(encoding, text: str) -> bytes:
    return np.array(encoding.encode_ordinary(text), "<u4").tobytes()


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("long_word", [2, 1024])
def test_ids_equal_the_library(monkeypatch, name, long_word):
    """Words merged together and by themselves."""
    ranks, pattern, encoding = library(name)
    monkeypatch.setattr(merges, "LONG_WORD", long_word)
    rng = random.Random(3)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice("ab") for _ in range(300)) for _ in range(20)]
    texts += ["a" * n for n in range(70)] + ["ha" * 50, "na " * 50, "=" * 999, " " * 77, "\n" * 9 + "x", "<|endoftext|>"]
    encoder = CorpusEncoder(MergeTable(ranks), pattern)
    numbers = [encoder.add(t) for t in texts]
    encoder.replay()
    for text, found in zip(texts, numbers):
        assert encoder.join(found) == ids_by(encoding, text), repr(text)


def plain_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """By definition: the leftmost pair of lowest rank, again and again."""
    if word in ranks:
        return [ranks[word]]
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 40), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_any_vocabulary_is_replayed_by_definition(monkeypatch):
    """Ranks in random order, so that merges open pairs of lower rank all the time."""
    rng = random.Random(8)
    for trial in range(60):
        monkeypatch.setattr(merges, "LONG_WORD", rng.choice([0, 1024]))
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(1, 80))}
        tokens = [*tokens, *(bytes([b]) for b in range(256))]
        rng.shuffle(tokens)
        ranks = {t: i for i, t in enumerate(tokens)}
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40))) for _ in range(60)]
        for word, ids in zip(words, MergeTable(ranks).replay(words)):
            assert np.frombuffer(ids, "<u4").tolist() == plain_merges(word, ranks), (trial, word)


def test_a_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError, match="every single byte"):
        MergeTable({b"a": 0})


def test_round_trip_over_a_table(spark):
    """Null, empty, long and repeated texts, null ids, and columns with the names of the result."""
    ranks, pattern, encoding = library(FILES[0])
    rng = random.Random(5)
    texts = [None, "", "one two", "one two", " ", "tail \n\n", "word " * 300_000, "".join(rng.choice(SIGNS) for _ in range(9000))]
    rows = [(None if i == 3 else i, t, "kept", 1.5, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `odd.name` string, N_Tokens double, Decoded string")
    coded = encode_texts(docs, ranks, pattern)
    assert coded.columns == ["doc_id", "text", "odd.name", "Decoded", "n_tokens", "ids"]
    back = decode_ids(coded, ranks)
    assert back.columns == ["doc_id", "text", "odd.name", "n_tokens", "ids", "decoded"]
    found = back.collect()
    assert len(found) == len(rows)
    for row in found:
        text = row["text"] or ""
        assert bytes(row["ids"]) == ids_by(encoding, text) and row["n_tokens"] == len(row["ids"]) // 4
        assert bytes(row["decoded"]) == text.encode() and row["odd.name"] == "kept"
    assert encode_texts(docs.limit(0), ranks, pattern).count() == 0
    nothing = decode_ids(spark.createDataFrame([(None,)], "ids binary"), ranks).collect()
    assert nothing[0]["decoded"] is None


def test_words_are_forgotten_between_corpora(spark, monkeypatch):
    ranks, pattern, encoding = library(FILES[0])
    encoder = CorpusEncoder(MergeTable(ranks), pattern)
    monkeypatch.setattr(merges, "KEPT_WORDS", 10)
    for k in range(5):
        texts = [f"word{k} and more{j} of it" for j in range(20)]
        numbers = [encoder.add(t) for t in texts]
        encoder.replay()
        assert [encoder.join(x) for x in numbers] == [ids_by(encoding, t) for t in texts]
        encoder.forget()
        assert not encoder.ids


def test_query_equals_the_library(spark, sf_dir):
    _, _, encoding = library(FILES[0])
    found = {r["doc_id"]: r for r in merges.op12_byte_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for doc_id, text in docs:
        ids = ids_by(encoding, text or "")
        row = found[doc_id]
        assert row["n_tokens"] == len(ids) // 4
        assert row["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
