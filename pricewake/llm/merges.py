"""Byte-level BPE by replaying the merges of a vocabulary over a corpus of distinct words.

A corpus is what a task has gathered: the distinct matches of the word pattern
that it has not seen before. An inverted index leads from a pair, named by the
rank of what it spells, to the positions where it stands in any word. Merges are
applied to all words at once, lowest rank first; only the pairs beside a merge
are looked up anew.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewake.llm.common import columns_without, prepare_python, table, text_of, worker_cache
from pricewake.llm.tokens import public_tokenizer

_SHIFT = 21
_NOTHING = (1 << _SHIFT) - 1


class MergeTable:
    """Ranks of a vocabulary, and which pairs of tokens spell another token."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary holds every single byte")
        if len(set(ranks.values())) < len(ranks) or max(ranks.values()) >= _NOTHING:
            raise ValueError("ranks are distinct and below 2 million")
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, made = [], []
        # Ranks whose token is part of one with a lower rank: a merge may open a more urgent one.
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << _SHIFT | b)
                    made.append(rank)
                    self.opens[[x for x in (a, b) if x > rank]] = True
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.made = np.append(np.array(made, np.int64)[order], -1)
        self.spelled: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.spelled[rank] = token

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each pair spells, -1 where that is no token."""
        wanted = left << _SHIFT | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.made[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word as little-endian unsigned 32-bit integers.

        Merges go by rank over all words, within a word from left to right, as
        if each word merged its pair of lowest rank, the leftmost of equal ones,
        until none is left. A rank that may open a lower one is applied once a
        word before the index is asked again; words with thousands of bytes are
        therefore merged by themselves.
        """
        found: list[bytes] = [b""] * len(words)
        joint = []
        for i, word in enumerate(words):
            rank = self.ranks.get(word)
            if rank is not None:
                found[i] = rank.to_bytes(4, "little")
            elif len(word) > LONG_WORD:
                found[i] = self._replay_alone(word)
            elif word:
                joint.append(i)
        if joint:
            for i, ids in zip(joint, self._replay_jointly([words[i] for i in joint])):
                found[i] = ids
        return found

    def _replay_jointly(self, words: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        # Place n stands for the outside of every word.
        token = np.append(self.bytes[np.frombuffer(b"".join(words), np.uint8)], _NOTHING)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        after = np.arange(1, n + 2, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        after[ends - 1] = after[n] = n
        before[ends - sizes] = before[n] = n
        pair = self.pair_ranks(token, token[after]).astype(np.int32)
        first = np.flatnonzero(pair >= 0)
        first = first[np.argsort(pair[first], kind="stable")]
        starts = np.flatnonzero(np.diff(pair[first], prepend=-1))
        index = {int(pair[p[0]]): p for p in np.split(first, starts[1:]) if len(p)}
        later: dict[int, list[int]] = {}
        waiting = list(index)
        heapify(waiting)
        opens = self.opens
        while waiting:
            rank = heappop(waiting)
            at = index.pop(rank, None)
            more = later.pop(rank, None)
            if more:
                more = np.array(more)
                at = np.unique(more if at is None else np.concatenate([at, more]))
            elif at is None:
                continue
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                if opens[rank]:
                    again = word[at[1:]] == word[at[:-1]]
                    if again.any():
                        again = np.append(False, again)
                        index[rank] = at[again]
                        heappush(waiting, rank)
                        at = at[~again]
                else:
                    at = _every_other(at, after)
            gone = after[at]
            follows = after[gone]
            token[at], token[gone] = rank, _NOTHING
            pair[gone] = -1
            after[at] = follows
            before[follows] = at
            ahead = before[at]
            touched = np.concatenate([at, ahead[ahead != n]])
            made = self.pair_ranks(token[touched], token[after[touched]])
            pair[touched] = made
            new = made >= 0
            for r, p in zip(made[new].tolist(), touched[new].tolist()):
                if r in later:
                    later[r].append(p)
                else:
                    later[r] = [p]
                    if r not in index:
                        heappush(waiting, r)
        kept = token[:n] != _NOTHING
        ids = token[:n][kept].astype("<u4").tobytes()
        stops = (4 * np.cumsum(kept)[ends - 1]).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def _replay_alone(self, word: bytes) -> bytes:
        """One long word, its index a heap of (rank, place)."""
        n = len(word)
        token = self.bytes[np.frombuffer(word, np.uint8)]
        pair = array("i", [*self.pair_ranks(token[:-1], token[1:]), -1])
        token = array("i", token)
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        index = [r << 40 | p for p, r in enumerate(pair) if r >= 0]
        heapify(index)
        known: dict[int, int] = {}
        while index:
            entry = heappop(index)
            rank, at = entry >> 40, entry & ((1 << 40) - 1)
            if pair[at] != rank:
                continue
            gone = after[at]
            follows = after[gone]
            token[at], pair[gone], after[at] = rank, -1, follows
            token[gone] = -1
            if follows < n:
                before[follows] = at
            for p in (before[at], at):
                if p < 0:
                    continue
                q = after[p]
                made = -1
                if q < n:
                    key = token[p] << _SHIFT | token[q]
                    made = known.get(key)
                    if made is None:
                        k = int(np.searchsorted(self.keys, key))
                        made = known[key] = int(self.made[k]) if self.keys[k] == key else -1
                pair[p] = made
                if made >= 0:
                    heappush(index, made << 40 | p)
        merged = np.frombuffer(token, np.int32)
        return merged[merged >= 0].astype("<u4").tobytes()


def _every_other(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of pairs that share a token with the pair before them, the ones a merge from the left takes."""
    shares = after[at[:-1]] == at[1:]
    if not shares.any():
        return at
    begins = np.append(True, ~shares)
    place = np.arange(len(at))
    return at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]


# Bytes from which a word is merged by itself.
LONG_WORD = 1024
# Bytes of new words that are merged together, and characters that wait for them.
CORPUS_BYTES, WAITING_CHARACTERS = 3_000_000, 16_000_000
# Words whose ids a worker keeps, some 200 bytes each.
KEPT_WORDS = 800_000
# Characters of a long text that are matched at once.
_STRETCH = 1_000_000


class _Numbers(dict):
    """A number for every word, in the order of their first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class CorpusEncoder:
    """Ids of texts; new words gather until they are worth a replay."""

    def __init__(self, merges: MergeTable, pattern: str):
        import regex

        self.merges = merges
        self.matches = regex.compile(pattern).findall
        # Before the last white space of a run no match can go on, if the pattern is one of this kind.
        self.gap = regex.compile(r"\s(?=\S)") if pattern.endswith(r"|\s+(?!\S)|\s+") else None
        self.numbers, self.ids = _Numbers(), []
        self.new_bytes = 0

    def add(self, text: str) -> np.ndarray:
        """Numbers of the words of a text."""
        parts = []
        for stretch in self._stretches(text):
            known = len(self.numbers)
            matches = self.matches(stretch)
            parts.append(np.fromiter(map(self.numbers.__getitem__, matches), np.int32, len(matches)))
            if len(self.numbers) > known:
                # An estimate from the share of new words is enough here.
                self.new_bytes += 8 * (len(self.numbers) - known)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]

    def _stretches(self, text: str) -> Iterator[str]:
        begin = 0
        while self.gap is not None and len(text) - begin > _STRETCH:
            cut = self.gap.search(text, begin + _STRETCH)
            if cut is None:
                break
            yield text[begin : cut.start()]
            begin = cut.start()
        yield text[begin:] if begin else text

    def replay(self) -> None:
        """Ids of all words that have none yet."""
        known = len(self.ids)
        words = list(self.numbers)[known:] if known < len(self.numbers) else []
        group, size = [], 0
        for word in words:
            raw = word.encode()
            group.append(raw)
            size += len(raw)
            if size > CORPUS_BYTES:
                self.ids += self.merges.replay(group)
                group, size = [], 0
        self.ids += self.merges.replay(group)
        self.new_bytes = 0

    def forget(self) -> None:
        if len(self.ids) > KEPT_WORDS:
            self.numbers, self.ids = _Numbers(), []

    def join(self, numbers: np.ndarray) -> bytes:
        return b"".join(map(self.ids.__getitem__, numbers.tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 token and its rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


def encode_texts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """Every column of ``docs``, ``n_tokens`` (long) and ``ids`` (binary, little-endian unsigned 32-bit).

    Each match of ``pattern`` is encoded by itself by the ranks, without special
    tokens. A null or empty text has no ids. Rows are handled one by one, so
    repeats, ties, null ids and an empty table need no care; columns of ``docs``
    with the two names, in any case, are replaced. The vocabulary is a broadcast
    parameter; nothing is shuffled. Memory: the waiting texts, the kept words,
    and the longest text with its ids.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    shared = spark.sparkContext.broadcast((ranks, pattern))
    key = hashlib.blake2b(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = worker_cache("merges", key, lambda: CorpusEncoder(MergeTable(shared.value[0]), shared.value[1]))

        def finish(waiting: list[list[np.ndarray]]) -> Iterator[pa.Array]:
            encoder.replay()
            for numbers in waiting:
                ids = [encoder.join(x) for x in numbers]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.StructArray.from_arrays([counts, pa.array(ids, pa.binary())], ["n_tokens", "ids"])
            encoder.forget()

        waiting: list[list[np.ndarray]] = []
        characters = 0
        for batch in batches:
            texts = batch.to_pylist()
            waiting.append([encoder.add(t) for t in texts])
            characters += sum(map(len, texts))
            if encoder.new_bytes > CORPUS_BYTES or characters > WAITING_CHARACTERS:
                yield from finish(waiting)
                waiting, characters = [], 0
        if waiting:
            yield from finish(waiting)

    coded = F.arrow_udf(encode, "n_tokens long, ids binary")
    kept = columns_without(docs, ["n_tokens", "ids"])
    found = docs.select(F.struct(*kept).alias("kept"), coded(text_of(text)).alias("coded"))
    return found.select("kept.*", "coded.n_tokens", "coded.ids")


def decode_ids(frame: DataFrame, ranks: dict[bytes, int], ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Every column of ``frame`` and ``into``: the bytes that the ids spell, as binary.

    Null ids give null, no ids empty bytes; an id that the vocabulary lacks
    raises. A column of that name, in any case, is replaced.
    """
    spark = frame.sparkSession
    prepare_python(spark)
    shared = spark.sparkContext.broadcast(ranks)

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spelled = {rank: token for token, rank in shared.value.items()}

        def bytes_of(raw: bytes) -> bytes:
            numbers = np.frombuffer(raw, "<u4")
            some = [b"".join(map(spelled.__getitem__, numbers[k : k + _STRETCH].tolist())) for k in range(0, len(numbers), _STRETCH)]
            return some[0] if len(some) == 1 else b"".join(some)

        for batch in batches:
            yield pa.array([None if x is None else bytes_of(x) for x in batch.to_pylist()], pa.binary())

    spell = F.arrow_udf(decode, "binary")
    kept = columns_without(frame, [into])
    found = frame.select(F.struct(*kept).alias("kept"), spell(F.col(f"`{ids}`")).alias("spelled"))
    return found.select("kept.*", F.col("spelled").alias(into))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all ``documents`` and of the bytes they decode to."""
    import public_tokenizers

    ranks = read_ranks(public_tokenizer("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_texts(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids")
    return decode_ids(coded, ranks).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
