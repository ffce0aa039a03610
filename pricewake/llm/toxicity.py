"""Toxicity from the nearest labelled examples.

Examples and texts are TF-IDF vectors over all their terms; similarity is their
cosine, exact. Examples lie in blocks of an inverted index that knows the
largest weight of every term in every block. For a text this bounds the
similarity of all examples of a block; blocks are read from the highest bound
down, until no bound reaches the k-th best similarity found. Votes of the k
nearest examples, weighted by similarity, are calibrated by a logistic curve
fitted to the examples' own leave-one-out votes; it crosses one half where these
are told apart with fewest errors.

A term weighs (1 + log of its count) times the square of log(documents / documents
with it); the square keeps a few telling terms from drowning in a long text's
common ones. Document frequencies are those of all documents, for every term
that an example has. A term that none has adds to the length of a text alone; it
counts as one that no document has.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewake.llm.common import columns_without, crc_remainder, cut, fit_logistic, free_worker_cache, prepare_python, quoted, table, text_of
from pricewake.llm.sampling import bounded_sample

# A word is a run of letters; so many first letters of a longer one are a term, too.
_LETTERS, _NO_LETTER = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")
START = 4
# Characters that are read side by side.
STRETCH = 1 << 20
# Products of weights that are held at a time, some 50 bytes each.
PRODUCTS = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_BEGINNING = np.uint64(0x632BE59BD9B4E019)


@dataclass(frozen=True)
class Setting:
    """Sample bounds (rows of each label), neighbours, examples of a block, and neighbours shown as evidence.

    ``per_label`` rows of each label are drawn, and up to ``most`` where both labels
    have more; ``neighbours`` go with ``per_label`` and grow with what is drawn.
    """

    per_label: int = 500
    most: int = 500
    neighbours: int = 60
    block: int = 64
    seed: int = 23
    evidence: int = 3

    def drawn(self, sizes: dict[int, int]) -> int:
        """Rows of each label to draw; no more than the rarer one has, so that neither crowds the other out."""
        return max(self.per_label, min(self.most, sizes.get(0, 0), sizes.get(1, 0)))


class _Tables:
    """Which code points are letters, and powers of the hash's step and of its inverse; made once a worker."""

    def __init__(self):
        points = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
        self.letters = np.zeros(0x110000, bool)
        self.letters[np.frombuffer("".join(_LETTERS.findall(points)).encode("utf-32-le"), "<u4")] = True
        self.powers = self.inverses = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n >= len(self.powers):
            n = max(n + 1, 1 << 16)
            self.powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, _STEP)))
            self.inverses = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, _BACK)))


_tables: list[_Tables] = []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX[0]
    h = (h ^ (h >> np.uint64(33))) * _MIX[1]
    return h ^ (h >> np.uint64(33))


def _hashes(text: str) -> np.ndarray:
    """64-bit hashes of the terms of a text in lower case, word by word and beginning by beginning.

    A word's hash is the sum of its letters' values times powers of a step, taken
    from running sums over the text and moved back to the word's first letter.
    """
    if not _tables:
        _tables.append(_Tables())
    table = _tables[0]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    edges = np.flatnonzero(np.diff(table.letters[points].view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    table.reach(len(points))
    values = _mixed(points.astype(np.uint64) + _STEP)
    values *= table.powers[: len(points)]
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    words = (sums[ends] - sums[starts]) * table.inverses[starts]
    longer = starts[ends - starts > START]
    begun = (sums[longer + START] - sums[longer]) * table.inverses[longer] ^ _BEGINNING
    return _mixed(np.concatenate([words, begun]))


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's terms in order, and how often each stands there."""
    text = text.lower()
    found, begin = [], 0
    while len(text) - begin > STRETCH:
        # No word is cut.
        gap = _NO_LETTER.search(text, begin + STRETCH)
        if gap is None:
            break
        found.append(_hashes(text[begin : gap.start()]))
        begin = gap.start()
    found.append(_hashes(text[begin:] if begin else text))
    return np.unique(np.concatenate(found) if len(found) > 1 else found[0], return_counts=True)


def numbers_of(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes among the known ones, which are in order, and which hashes are known at all."""
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    among = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
    return at[among], among


class BlockMaxIndex:
    """Inverted index of vectors, its postings sorted by block and term."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int):
        self.n, self.block = len(vectors), block
        self.n_blocks, self.n_terms = max(1, -(-self.n // block)), max(1, n_terms)
        cells, sizes = self.n_blocks * self.n_terms, [len(t) for t, _ in vectors]
        # Numbers no wider than they need be, as the index lies in every worker.
        cell = np.concatenate([t for t, _ in vectors] or [np.zeros(0)]).astype(np.int32 if cells < 1 << 31 else np.int64)
        # By term and then block, so that what a text reads lies together.
        cell *= self.n_blocks
        cell += np.repeat((np.arange(self.n) // block).astype(cell.dtype), sizes)
        order = np.argsort(cell, kind="stable")
        self.example = np.repeat(np.arange(self.n, dtype=np.min_scalar_type(self.n)), sizes)[order]
        self.weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)])[order]
        self.first = np.zeros(cells + 1, np.int32)
        np.cumsum(np.bincount(cell, minlength=cells), out=self.first[1:])
        self._bound()

    def _bound(self) -> None:
        """Find the largest weight of every term in every block."""
        largest = np.zeros(self.n_blocks * self.n_terms)
        full = np.flatnonzero(np.diff(self.first))
        if len(full):
            largest[full] = np.maximum.reduceat(self.weight, self.first[full])
        self.largest = largest.reshape(self.n_terms, self.n_blocks)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "largest"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._bound()

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples (all but one, if named) and their cosines over 0, nearest first, ties by number.

        Blocks are read in rounds, each of what the k-th best cosine so far
        leaves over; where that is most of them, all are read in one go.
        """
        bound = weights @ self.largest[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[: np.searchsorted(-bound[order], 0.0)]
        sums = np.zeros(self.n)
        best, cosines = np.zeros(0, np.int64), np.zeros(0)
        # The first round takes the blocks whose bounds are not far below the highest.
        high = int(np.searchsorted(-bound[order], -0.5 * bound[order[0]], "right")) if len(order) else 0
        at, width = 0, max(1, -(-2 * k // self.block), high)
        while at < len(order):
            if len(best) >= k:
                # A hair below the bound, as sums in another order differ in the last bits.
                order = order[: np.searchsorted(-bound[order], -(cosines[k - 1] - 1e-9), "right")]
            left = len(order) - at
            if left <= 0:
                break
            if 2 * (left if at else min(width, left)) > self.n_blocks:
                sums[:] = 0
                self._add(sums, terms, weights, np.arange(self.n_blocks))
                at = len(order)
            else:
                self._add(sums, terms, weights, order[at : at + width])
                at, width = at + width, 4 * width
            if 0 <= but < self.n:
                sums[but] = 0
            best = np.flatnonzero(sums > 0)
            if len(best) > k:
                least = np.partition(sums[best], -k)[-k]
                best = best[sums[best] >= least]
            best = best[np.lexsort((best, -sums[best]))][:k]
            cosines = sums[best]
        return best, cosines

    def _add(self, sums: np.ndarray, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> None:
        """Add to each example of the blocks its products with the text; a block's examples are added once."""
        if len(blocks) == self.n_blocks:
            low, high = self.first[terms * self.n_blocks], self.first[(terms + 1) * self.n_blocks]
        else:
            cells = (terms[:, None] * self.n_blocks + blocks).ravel()
            low, high = self.first[cells], self.first[cells + 1]
            weights = np.repeat(weights, len(blocks))
        full = high > low
        low, high, weights = low[full], high[full], weights[full]
        sizes = high - low
        ends = np.cumsum(sizes)
        begin = done = 0
        while begin < len(sizes):
            end = max(begin + 1, int(np.searchsorted(ends, done + PRODUCTS, "right")))
            some, last = sizes[begin:end], int(ends[end - 1])
            shift = low[begin:end] - (ends[begin:end] - some - done).astype(np.int32)
            places = np.repeat(shift, some)
            places += np.arange(last - done, dtype=np.int32)
            products = self.weight.take(places)
            products *= np.repeat(weights[begin:end], some)
            into = self.example.take(places)
            if begin:
                # The sums so far go in front, so that the order of the additions is that of a single part.
                into, products = np.concatenate([np.arange(self.n), into]), np.concatenate([sums, products])
                sums[:] = 0
            sums += np.bincount(into, products, self.n)
            begin, done = end, last


@dataclass
class NearestExamples:
    """The fitted model; its size goes with the examples, which the setting bounds."""

    setting: Setting
    # Hashes of the examples' terms in order; a term's number is its place.
    known: np.ndarray
    idf: np.ndarray
    # Of a term that no example has.
    rarest: float
    labels: np.ndarray
    ids: list
    id_type: str
    vectors: list[tuple[np.ndarray, np.ndarray]]
    slope: float = 0.0
    offset: float = 0.0
    base_rate: float = 0.0
    # Score of a text without any term of an example.
    blank: float = 0.0

    def build_index(self) -> BlockMaxIndex:
        """Index of the vectors; workers get it instead of them."""
        return BlockMaxIndex(self.vectors, len(self.known), self.setting.block)

    @property
    def term_ids(self) -> dict[int, int]:
        return {int(h): i for i, h in enumerate(self.known)}

    def vector(self, numbers: np.ndarray, times: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text that examples have, and their weights in a vector of length 1 over all its terms."""
        weights = (1 + np.log(times)) * self.idf[numbers]
        rest = (1 + np.log(others)) * self.rarest
        length = np.sqrt(weights @ weights + rest @ rest)
        return numbers, weights / (length if length else 1.0)

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic among the neighbours, each counting by its cosine.

        Some far neighbour's weight stands for the base rate, so that a few far
        examples decide nothing.
        """
        return float((cosines @ self.labels[found] + FAR * self.base_rate) / (cosines.sum() + FAR))

    def score(self, text: str, index: BlockMaxIndex) -> tuple[float, np.ndarray, np.ndarray]:
        hashes, times = counts_of(text)
        numbers, among = numbers_of(hashes, self.known)
        numbers, weights = self.vector(numbers, times[among], times[~among])
        if not len(numbers) or not index.n:
            return self.blank, np.zeros(0, np.int64), np.zeros(0)
        found, cosines = index.nearest(numbers, weights, self.setting.neighbours)
        if not len(found):
            return self.blank, found, cosines
        return _logistic(self.slope * self.vote(found, cosines) + self.offset), found, cosines


# The weight of the base rate in a vote.
FAR = 0.2
# For a filter: toxic texts come in bunches, and a few hundred examples miss some. Larger blocks keep the index small.
THOROUGH = Setting(most=2000, block=512)


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def _examples(sample: DataFrame) -> list[tuple[int, object, np.ndarray, np.ndarray]]:
    """(label, id, hashes of its terms, their counts) of every row of a bounded sample."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_cache()
        for batch in batches:
            counts = [counts_of(text) for text in batch.column("text").to_pylist()]
            parts = [pa.array([x[k].tobytes() for x in counts], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("id"), *parts], ["label", "id", "terms", "times"])

    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.select("label", "id", "text").mapInArrow(counted, f"label int, id {kind}, terms binary, times binary").toArrow()
    return [
        (label, name, np.frombuffer(terms, np.uint64), np.frombuffer(times, np.int64))
        for label, name, terms, times in zip(*(rows.column(c).to_pylist() for c in ("label", "id", "terms", "times")))
    ]


def _document_frequencies(docs: DataFrame, text: str, known: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term, over the whole table."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(known)
    n_terms = len(known)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_cache()
        total = np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            for text_ in batch.column(0).to_pylist():
                total[numbers_of(counts_of(text_)[0], sent.value)[0]] += 1
                total[n_terms] += 1
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(total[kept], pa.int64())], ["t", "c"])

    counted = docs.select(text_of(quoted(text)).alias("text")).mapInArrow(count, "t long, c long")
    rows = counted.groupBy("t").agg(F.sum("c").alias("c")).toArrow()
    found = np.zeros(n_terms + 1, np.int64)
    found[rows.column("t").to_numpy()] = rows.column("c").to_numpy()
    return int(found[n_terms]), found[:n_terms]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
    setting: Setting = Setting(),
) -> NearestExamples:
    """Model from a bounded sample of labelled rows; document frequencies are those of all ``docs``.

    ``labels`` has (doc_id, label 0 or 1); rows with a null id or label are not
    used, nor texts that no label belongs to. Without both labels in the sample
    every score is the share of label 1.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    usable = labels.select(quoted(doc_id).alias("id"), quoted(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    base = sizes.get(1, 0) / max(1, sum(sizes.values()))
    drawn = setting.drawn(sizes)
    # A larger sample has more neighbours, so that these stay the same share of it.
    setting = replace(setting, neighbours=round(setting.neighbours * drawn / setting.per_label))
    picked = bounded_sample(usable, "label", "id", drawn, setting.seed)
    texts = docs.select(quoted(doc_id).alias("id"), text_of(quoted(text)).alias("text"))
    examples = _examples(cut(texts.join(F.broadcast(picked), "id")))
    both = {x[0] for x in examples} == {0, 1}
    known = np.unique(np.concatenate([x[2] for x in examples])) if both else np.zeros(0, np.uint64)
    kind = docs.schema[doc_id].dataType.simpleString()
    model = NearestExamples(
        setting, known, np.ones(len(known)), 1.0, np.zeros(0), [], kind, [], base_rate=base, blank=base
    )
    if not len(known):
        return model
    n_docs, frequency = _document_frequencies(docs, text, known)
    model.idf = np.log((1 + n_docs) / (1 + frequency)) ** 2
    model.rarest = float(np.log(1 + n_docs) ** 2)

    vectors = []
    for label_, name, hashes, times in examples:
        vectors.append((label_, name, model.vector(numbers_of(hashes, known)[0], times, np.zeros(0))))
    # Like next to like: by label, then by the heaviest term, so that a block's bounds are tight.
    heaviest = lambda v: int(v[0][v[1].argmax()]) if len(v[0]) else -1
    vectors.sort(key=lambda e: (e[0], heaviest(e[2]), e[1]))
    y = np.array([e[0] for e in vectors], float)
    # Each label weighs as in all labelled rows, not as in the sample.
    weight = np.where(y == 1, base / max(1, y.sum()), (1 - base) / max(1, (1 - y).sum()))
    blank = np.array([not len(e[2][0]) for e in vectors])
    model.labels, model.ids = y, [e[1] for e in vectors]
    model.vectors = [(e[2][0].astype(np.int32), e[2][1]) for e in vectors]
    index = model.build_index()
    model.blank = float((weight[blank] @ y[blank] + 1e-3 * base) / (weight[blank].sum() + 1e-3))
    votes = []
    for i in np.flatnonzero(~blank):
        found, cosines = index.nearest(*vectors[i][2], setting.neighbours, but=i)
        votes.append(model.vote(found, cosines))
    model.slope, model.offset = fit_logistic(np.array(votes), y[~blank], weight[~blank] * len(y))
    return model


def score_toxicity(docs: DataFrame, model: NearestExamples, text: str = "text") -> DataFrame:
    """Every column of ``docs`` and score, predicted, evidence (replaced where present, in any case).

    ``score`` is the calibrated chance of label 1, ``predicted`` whether it is
    at least 0.5, ``evidence`` the nearest examples as (id, cosine, label). A
    null or empty text, or one that shares no term with an example, gets the
    chance of such examples and no evidence. Rows are scored one by one over
    their whole text; the model is broadcast and bounded by its setting.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    sent = spark.sparkContext.broadcast((replace(model, vectors=[]), model.build_index()))

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        free_worker_cache()
        m, index = sent.value
        top, ids, labels = m.setting.evidence, pa.array(m.ids), m.labels.astype(np.int32)
        for batch in batches:
            scored = [m.score(t, index) for t in batch.to_pylist()]
            scores = np.array([s for s, _, _ in scored], float)
            near = np.concatenate([np.zeros(0, np.int64), *(found[:top] for _, found, _ in scored)])
            cosines = np.concatenate([np.zeros(0), *(c[:top] for _, _, c in scored)])
            ends = np.cumsum([0, *(min(top, len(found)) for _, found, _ in scored)])
            shown = [ids.take(pa.array(near)), pa.array(cosines), pa.array(labels[near] if len(near) else [], pa.int32())]
            evidence = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(shown, ["id", "cosine", "label"]))
            yield pa.StructArray.from_arrays(
                [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), evidence], ["score", "predicted", "evidence"]
            )

    kind = f"score double, predicted int, evidence array<struct<id:{model.id_type},cosine:double,label:int>>"
    judged = F.arrow_udf(judge, kind)
    names = ["score", "predicted", "evidence"]
    rows = docs.select(F.struct(*columns_without(docs, names)).alias("kept"), judged(text_of(quoted(text))).alias("found"))
    return rows.select("kept.*", *[F.col(f"found.{n}").alias(n) for n in names])


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Documents that are not predicted toxic, columns unchanged; up to 2,000 examples of each label are learned from."""
    model = fit(docs, labels, text, doc_id, setting=THOROUGH)
    rows = docs.select(F.struct("*").alias("row"), quoted(text).alias("whole"))
    return score_toxicity(rows, model, "whole").where("predicted = 0").select("row.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of documents not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(crc_remainder("doc_id", 5) != 0))
    rows = docs.select("doc_id", "text", (crc_remainder("doc_id", 5) == 0).alias("held_out"))
    return score_toxicity(rows, model).select("doc_id", "held_out", "score", "predicted", "evidence")
