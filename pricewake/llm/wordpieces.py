"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes the longest vocabulary entry a word starts
with, then the longest continuation entry, and so on. The automaton finds how
many pieces that gives without building any: a trie over the bytes of the
vocabulary, where every node has a failure link and the number of pieces that
are complete ("popped") when the link is taken. A word is read byte by byte,
each byte once, with at most as many links as bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewake.llm.common import columns_without, prepare_python, quoted, table, text_of, worker_cache
from pricewake.llm.tokens import public_tokenizer

DEAD = -1
# Words of more bytes are read one by one; shorter ones side by side.
SIDE_BY_SIDE = 64


class PieceCounter:
    """Automaton of a vocabulary: ``first`` are pieces a word may start with, ``later`` its continuations.

    Nodes are places in two tries that share their node numbers: strings a word
    starts with, and strings that follow a complete piece (below ``self.root``).
    For a node v with string s, greedy matching of s pops ``pops[v]`` pieces and
    leaves the node ``link[v]`` of what remains. If s is itself a piece, that is
    one piece and the empty rest. Otherwise the pops of its parent are taken and
    the last byte is followed from there, further pops being added on the way.
    """

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes]):
        first, later = {x for x in first if x}, {x for x in later if x}
        nodes: dict[tuple[int, int], int] = {}
        # 0 is where a word starts, 1 where a continuation starts.
        parent, byte, piece = [DEAD, DEAD], [0, 0], [False, False]
        for at, entries in ((0, first), (1, later)):
            for entry in sorted(entries):
                v = at
                for b in entry:
                    w = nodes.get((v, b))
                    if w is None:
                        w = nodes[v, b] = len(parent)
                        parent.append(v)
                        byte.append(b)
                        piece.append(False)
                    v = w
                piece[v] = True
        n = len(parent)
        self.root = 1
        depth = [0] * n
        for v in range(2, n):
            depth[v] = depth[parent[v]] + 1
        link, pops = [DEAD] * n, [0] * n
        for v in sorted(range(2, n), key=depth.__getitem__):
            if piece[v]:
                link[v], pops[v] = 1, 1
                continue
            z, popped = link[parent[v]], pops[parent[v]]
            while z != DEAD and (z, byte[v]) not in nodes:
                popped += pops[z]
                z = link[z]
            if z != DEAD:
                link[v], pops[v] = nodes[z, byte[v]], popped
        self.link, self.pops = np.array(link), np.array(pops)
        self.nodes, self.links, self.pop_list = nodes, link, pops
        self.keys = np.array(sorted(v << 8 | b for v, b in nodes), np.int64)
        self.targets = np.array([nodes[k >> 8, k & 255] for k in self.keys.tolist()], np.int64)

    def count(self, word: bytes) -> int:
        """Pieces of one word; -1 if greedy matching fails."""
        nodes, link, pops = self.nodes, self.links, self.pop_list
        v = total = 0
        for b in word:
            w = nodes.get((v, b))
            while w is None:
                total += pops[v]
                v = link[v]
                if v == DEAD:
                    return -1
                w = nodes.get((v, b))
            v = w
        while v > 1:
            total += pops[v]
            v = link[v]
        return total if v != DEAD else -1

    def _step(self, v: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(v), DEAD)
        wanted = v << 8 | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.targets[at], DEAD)

    def count_all(self, words: list[bytes]) -> np.ndarray:
        """``count`` of every word, all words read side by side."""
        result = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > SIDE_BY_SIDE):
            result[i] = self.count(words[i])
        rows = np.flatnonzero(sizes <= SIDE_BY_SIDE)
        rows = rows[np.argsort(-sizes[rows], kind="stable")]
        if not len(rows):
            return result
        sizes = sizes[rows]
        width = int(sizes[0])
        letters = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows), np.uint8)
        letters = letters.reshape(len(rows), width) if width else letters.reshape(len(rows), 0)
        state, total = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k in range(width):
            live = np.flatnonzero((state[: np.searchsorted(-sizes, -k)] != DEAD))
            while len(live):
                to = self._step(state[live], letters[live, k].astype(np.int64))
                moved = to != DEAD
                state[live[moved]] = to[moved]
                live = live[~moved]
                total[live] += self.pops[state[live]]
                state[live] = self.link[state[live]]
                live = live[state[live] != DEAD]
        live = np.flatnonzero(state > 1)
        while len(live):
            total[live] += self.pops[state[live]]
            state[live] = self.link[state[live]]
            live = live[state[live] > 1]
        result[rows] = np.where(state == DEAD, -1, total)
        return result


def read_ranks(path: str) -> list[bytes]:
    """Entries of a vocabulary file with one base64 token and rank a line."""
    with open(path, "rb") as file:
        return [base64.b64decode(line.split()[0]) for line in file if line.strip()]


# Words whose counts a worker keeps.
KEPT_WORDS = 1_000_000


def token_counts(
    docs: DataFrame,
    first: list[bytes],
    later: list[bytes],
    text: str = "text",
    lead: bytes = b"",
) -> DataFrame:
    """Every column of ``docs`` and ``n_words``, ``n_tokens``, ``n_unknown`` (all long).

    Words are what stands between white space (ASCII); each is preceded by
    ``lead`` and split greedily. A word that cannot be split counts as one
    unknown token, in ``n_tokens`` too. A null or empty text has no words.
    Columns of ``docs`` with these three names, in any case, are replaced. Rows are handled
    one by one: repeats, ties and an empty table need no care. The vocabulary is
    a broadcast parameter; nothing is shuffled.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    vocabulary = spark.sparkContext.broadcast((list(first), list(later)))
    key = hashlib.blake2b(b"\0".join(first) + b"\1" + b"\0".join(later) + b"\1" + lead).hexdigest()

    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter, known = worker_cache("wordpieces", key, lambda: (PieceCounter(*vocabulary.value), {}))
        for given in texts:
            split = [t.encode().split() for t in given.to_pylist()]
            new = list(set().union(*split).difference(known))
            if len(known) + len(new) > KEPT_WORDS:
                known.clear()
                new = list(set().union(*split))
            known.update(zip(new, counter.count_all([lead + w for w in new]).tolist()))
            get = known.__getitem__
            found = [np.fromiter(map(get, words), np.int64, len(words)) for words in split]
            unknown = [int((x < 0).sum()) for x in found]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([int(x.sum()) + 2 * u for x, u in zip(found, unknown)], pa.int64()),
                    pa.array(unknown, pa.int64()),
                ],
                ["n_words", "n_tokens", "n_unknown"],
            )

    counts = F.arrow_udf(count, "n_words long, n_tokens long, n_unknown long")
    names = ["n_words", "n_tokens", "n_unknown"]
    rows = docs.select(F.struct(*columns_without(docs, names)).alias("kept"), counts(text_of(quoted(text))).alias("found"))
    return rows.select("kept.*", *[F.col(f"found.{n}").alias(n) for n in names])


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy piece counts of all ``documents`` over a public byte-level vocabulary, each word led by a space."""
    entries = read_ranks(public_tokenizer("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, entries, entries, lead=b" ")
    return counted.select("doc_id", "n_words", "n_tokens", "n_unknown")
