"""Packing of documents into training sequences by order-preserving dynamic programming.

Documents follow each other in the order of the table within each of its
partitions, so nothing is shuffled. Sequences end where the total of padding and
cut penalties is least: a cut between documents costs nothing, one between
sentences a little, one inside a sentence more.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from pricewake.llm.common import prepare_python, table, text_of
from pricewake.llm.tokens import encoder, public_tokenizer, read_tokenizer


@dataclass(frozen=True)
class Costs:
    """Tokens of padding that a cut of each kind is worth.

    Inside sentences cuts are offered every ``grid`` tokens only, which bounds
    the places to choose from.
    """

    window: int = 1024
    sentence: int = 2
    inside: int = 12
    grid: int = 128
    # So many windows are planned together.
    horizon: int = 256


def plan_cuts(places: list[int], penalties: list[int], window: int) -> list[int]:
    """Places to cut, from the first to the last place, at least total cost.

    With g(j) = cost(j) + place(j), ending a sequence at j after one that ended
    at i within reach gives g(j) = window + penalty(j) + min g(i): the minimum
    over a sliding range, held by a queue of rising g. Every place costs constant
    time on average. Neighbouring places must be at most ``window`` apart. Of
    equal plans the one with the later cut wins.
    """
    g = 0
    queue: deque[tuple[int, int, int]] = deque([(g + places[0], places[0], 0)])
    before = [0] * len(places)
    push, pop, popleft = queue.append, queue.pop, queue.popleft
    for j in range(1, len(places)):
        place = places[j]
        least = place - window
        while queue[0][1] < least:
            popleft()
        low, _, before[j] = queue[0]
        g = window + penalties[j] + low
        while queue and queue[-1][0] >= g:
            pop()
        push((g, place, j))
    cuts = [len(places) - 1]
    while cuts[-1]:
        cuts.append(before[cuts[-1]])
    return [places[i] for i in reversed(cuts)]


class _Packer:
    """Documents waiting to be cut, and the pieces of those that were."""

    def __init__(self, costs: Costs, first_sequence: int, with_ids: bool):
        self.costs, self.with_ids = costs, with_ids
        self.sequence = first_sequence
        # (doc_id, ids, place of its first id in the stream) of documents not fully cut.
        self.docs: list[tuple[object, bytes, int]] = []
        self.stops: list[np.ndarray] = []
        self.begin = self.end = 0

    def add(self, doc_id: object, ids: bytes, stops: np.ndarray) -> None:
        self.docs.append((doc_id, ids, self.end))
        self.stops.append(stops + self.end)
        self.end += len(ids) // 4

    def ready(self) -> bool:
        return self.end - self.begin >= self.costs.horizon * self.costs.window

    def _places(self) -> tuple[list[int], list[int]]:
        c = self.costs
        low = -(-(self.begin + 1) // c.grid) * c.grid
        inside = np.arange(low, self.end, c.grid)
        sentences = np.concatenate([*self.stops, [self.begin]]).astype(np.int64)
        between = np.array([at for _, _, at in self.docs] + [self.begin, self.end], np.int64)
        places = np.concatenate([between, sentences, inside])
        costs = np.concatenate([np.zeros(len(between)), np.full(len(sentences), c.sentence), np.full(len(inside), c.inside)])
        order = np.lexsort((costs, places))
        places, costs = places[order], costs[order].astype(np.int64)
        keep = np.r_[True, places[1:] != places[:-1]] & (places >= self.begin) & (places <= self.end)
        return places[keep].tolist(), costs[keep].tolist()

    def cut(self, last: bool) -> list[tuple]:
        """Pieces of all complete sequences; the last two are planned anew when more follows."""
        if self.end == self.begin:
            return []
        cuts = plan_cuts(*self._places(), self.costs.window)
        if not last:
            cuts = cuts[:-2] if len(cuts) > 3 else cuts[:1]
        rows, doc = [], 0
        for low, high in zip(cuts, cuts[1:]):
            at = low
            while at < high:
                doc_id, ids, start = self.docs[doc]
                n = len(ids) // 4
                stop = min(high, start + n)
                piece = ids[4 * (at - start) : 4 * (stop - start)]
                rows.append((doc_id, at - start, stop - at, zlib.crc32(piece), n, self.sequence, at - low, piece if self.with_ids else None))
                at = stop
                doc += at == start + n
            self.sequence += 1
        self.begin = cuts[-1]
        self.docs = self.docs[doc:]
        rest = np.concatenate(self.stops) if self.stops else np.zeros(0, np.int64)
        self.stops = [rest[rest > self.begin]]
        return rows


# Words whose ids a worker keeps, some 200 bytes each.
KEPT_WORDS = 2_000_000
_NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    costs: Costs = Costs(),
    with_ids: bool = True,
    kept_words: int = KEPT_WORDS,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``costs.window`` tokens.

    Per piece: the id, ``start`` (ids of its document before it), ``length``,
    ``ids_crc32`` (of its ids as little-endian unsigned 32-bit integers),
    ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence and, if wanted,
    ``ids`` as those bytes. ``tokenizer`` is the path of a tokenizer file on the
    driver. Every document ends with ``end_id``; a null or empty text is that id
    alone. Null and repeated ids are packed like others, an empty table gives no
    rows, other columns are dropped. Each partition ends with one sequence that
    is not full. Memory: a few hundred sequences, the longest text,
    and some 200 bytes for each of ``kept_words`` words, whose ids a worker keeps.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    prepare_python(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    columns = [f"`{doc_id}` {kind}", *(f"{n} long" for n in _NAMES), *["ids binary"] * with_ids]
    end = int(end_id).to_bytes(4, "little")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(content.value, kept_words)
        packer = _Packer(costs, TaskContext.get().partitionId() << 40, with_ids)
        schema = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            named = list(zip(*rows))
            arrays = [pa.array(named[0], id_type), *(pa.array(c, pa.int64()) for c in named[1:7])]
            arrays += [pa.array(named[7], pa.binary())] * with_ids
            return pa.RecordBatch.from_arrays(arrays, [doc_id, *_NAMES, *["ids"] * with_ids])

        for given in batches:
            id_type = given.schema.field(0).type
            ids, texts = given.column(0).to_pylist(), given.column(1).to_pylist()
            for low in range(0, len(texts), 64):
                some = texts[low : low + 64]
                for name, whole, (parts, regular) in zip(ids[low : low + 64], some, tokens.parts_and_shape(some)):
                    packer.add(name, b"".join(parts) + end, tokens.sentence_ends(whole, parts, regular))
                    if packer.ready():
                        rows = packer.cut(last=False)
                        if rows:
                            yield batch(rows)
        rows = packer.cut(last=True)
        if rows:
            yield batch(rows)

    return docs.select(doc_id, text_of(text).alias("__text")).mapInArrow(pack, ", ".join(columns))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 1,024 tokens."""
    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizer("byte_bpe_50k.json"), with_ids=False)
