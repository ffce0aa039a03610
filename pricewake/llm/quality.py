"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are those of its own letters and words
and of the lines before and after it; neighbouring labels are tied by transition
weights. Forward-backward marginals give each line's chance to be good, and their
mean, weighted by length, a document's quality, which a logistic curve
calibrates.

Labels exist for documents only. Training starts with every line labelled like
its document; then lines of bad documents that the model is sure are good are
relabelled, and it is trained again.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewake.llm.common import columns_without, crc_remainder, fit_logistic, prepare_python, quoted, table, text_of
from pricewake.llm.sampling import bounded_sample

# Character classes: 0 other signs, 1 lower or uncased letter, 2 upper, 3 digit, 4 space, 5 common punctuation.
_N_CLASSES = 6
OWN = 10


@dataclass(frozen=True)
class Training:
    """Sample bounds (rows of each label, lines of each text) and the fit.

    A text of more than ``lines`` lines gives ``spans`` stretches of neighbouring
    lines, one drawn from each of as many equal parts of it, of so many together.
    """

    per_label: int = 500
    lines: int = 256
    spans: int = 4
    steps: int = 120
    rate: float = 0.15
    ridge: float = 1e-3
    sure: float = 0.9
    seed: int = 31


_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """Class of every code point, made once per worker."""
    if not _classes:
        found = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                found[i] = 2 if c.isupper() else 1
            elif c.isdigit():
                found[i] = 3
            elif c.isspace():
                found[i] = 4
        found[[ord(c) for c in ".,;:'\"?()-"]] = 5
        _classes.append(found)
    return _classes[0]


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, length of each line, number of lines of each text).

    Lines end at line feeds; an empty text is one empty line. The last feature
    is constant. Neighbours' features are 0 beyond the ends of a text.
    """
    split = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in split], np.int64)
    lines = [line for x in split for line in x]
    n = len(lines)
    if not n:
        return np.zeros((0, 3 * OWN + 1)), np.zeros(0), counts
    points = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", "<u4")
    kinds = _class_table()[points]
    sizes = np.fromiter(map(len, lines), np.int64, n)
    starts = np.cumsum(sizes + 1) - sizes - 1
    per_kind = np.stack([np.add.reduceat((kinds == k).astype(np.int32), starts) for k in range(_N_CLASSES)], 1)
    # The line feed itself counts as a space and is taken off.
    per_kind[:, 4] -= 1
    words = [line.split() for line in lines]
    n_words = np.fromiter(map(len, words), np.int64, n)
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, n)
    copies = np.ones(n)
    at = 0
    for x in split:
        if len(x) > 1:
            seen = Counter(x)
            if len(seen) < len(x):
                copies[at : at + len(x)] = [seen[line] if line else 1 for line in x]
        at += len(x)
    size = np.maximum(sizes, 1)
    letters = per_kind[:, 1] + per_kind[:, 2]
    own = np.stack(
        [
            per_kind[:, 0] / size * 4,
            per_kind[:, 2] / np.maximum(letters, 1),
            per_kind[:, 3] / size,
            per_kind[:, 5] / size * 4,
            1 - per_kind[:, 1] / size,
            1 - distinct / np.maximum(n_words, 1),
            (n_words - distinct >= 5).astype(float),
            np.log1p(copies - 1) / 2,
            np.minimum(letters / np.maximum(n_words, 1), 20) / 10,
            np.log1p(sizes) / 6,
        ],
        1,
    )
    first = np.zeros(n, bool)
    first[np.cumsum(counts) - counts] = True
    before = np.vstack([np.zeros((1, OWN)), own[:-1]]) * ~first[:, None]
    after = np.vstack([own[1:], np.zeros((1, OWN))]) * ~np.r_[first[1:], True][:, None]
    return np.hstack([own, before, after, np.ones((n, 1))]), sizes.astype(float), counts


def _message(z: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds sent along a link by a line of log-odds z; t[s, s'] are transition weights."""
    return np.logaddexp(t[0, 1], t[1, 1] + z) - np.logaddexp(t[0, 0], t[1, 0] + z)


@dataclass
class Chains:
    """Chains side by side: the k-th lines of all that have one are handled together."""

    counts: np.ndarray

    def __post_init__(self) -> None:
        order = np.argsort(-self.counts, kind="stable")
        self.firsts = (np.cumsum(self.counts) - self.counts)[order]
        sorted_counts = self.counts[order]
        longest = int(sorted_counts[0]) if len(order) else 0
        self.live = np.searchsorted(-sorted_counts, -np.arange(longest), "left")

    def passes(self, score: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each line from what is before it and itself, and from what is after it."""
        forward, backward = score.copy(), np.zeros_like(score)
        for k in range(1, len(self.live)):
            at = self.firsts[: self.live[k]] + k
            forward[at] += _message(forward[at - 1], t)
        for k in range(len(self.live) - 1, 0, -1):
            at = self.firsts[: self.live[k]] + k
            backward[at - 1] = _message(score[at] + backward[at], t.T)
        return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass(frozen=True)
class LineField:
    """Weights of the features and transitions, and the calibration of document scores."""

    weights: np.ndarray
    transitions: np.ndarray
    slope: float
    offset: float

    def marginals(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Chance of each line to be good, given all lines of its text."""
        forward, backward = Chains(counts).passes(features @ self.weights, self.transitions)
        return _sigmoid(forward + backward)

    def quality(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, number of lines, number of lines more bad than good) of each text."""
        features, sizes, counts = line_features(texts)
        if not len(counts):
            return np.zeros(0), counts, counts
        good = self.marginals(features, counts)
        starts = np.cumsum(counts) - counts
        bad = np.add.reduceat((good < 0.5).astype(np.int64), starts)
        return _sigmoid(self.slope * _mean_by_length(good, sizes, starts) + self.offset), counts, bad


def _mean_by_length(good: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    weight = sizes + 1
    return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)


def _fit_field(x: np.ndarray, y: np.ndarray, weight: np.ndarray, chains: Chains, inner: np.ndarray, how: Training) -> tuple[np.ndarray, np.ndarray]:
    """Largest weighted likelihood of the line labels by Adam steps.

    ``inner`` are the lines that have a line before them; ``weight`` is one for
    each line, equal within a text.
    """
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    moments = [np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)]
    total = weight.sum()
    for step in range(1, how.steps + 1):
        score = x @ w
        forward, backward = chains.passes(score, t)
        p = _sigmoid(forward + backward)
        gradient_w = x.T @ (weight * (y - p)) / total - how.ridge * w
        a, z = forward[inner - 1], score[inner] + backward[inner]
        joint = np.stack([np.zeros(len(inner)) + t[0, 0], t[0, 1] + z, a + t[1, 0], a + z + t[1, 1]], 1)
        joint = np.exp(joint - joint.max(1, keepdims=True))
        joint /= joint.sum(1, keepdims=True)
        seen = np.eye(4)[(2 * y[inner - 1] + y[inner]).astype(int)]
        gradient_t = (weight[inner] @ (seen - joint)) / total - how.ridge * t.ravel()
        g = np.r_[gradient_w, gradient_t]
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = how.rate * moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, t = w + move[: len(w)], t + move[len(w) :].reshape(2, 2)
    return w, t


def drawn_spans(n: int, how: Training, seed: int) -> list[tuple[int, int]]:
    """Stretches (first, end) of the n lines of a text to learn from, in order: all, or ``how.lines`` of them."""
    if n <= how.lines:
        return [(0, n)]
    rng = np.random.default_rng([how.seed, seed])
    length = how.lines // how.spans
    edges = [round(k * n / how.spans) for k in range(how.spans + 1)]
    firsts = [int(rng.integers(low, high - length + 1)) for low, high in zip(edges, edges[1:])]
    return [(x, x + length) for x in firsts]


@dataclass(frozen=True)
class Drawn:
    """What is learned from of one text: features and sizes of its drawn lines, and the lengths of its stretches."""

    label: int
    features: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(label: int, text: str, how: Training) -> Drawn:
        """Features are taken within the whole text, so a stretch's ends know their neighbours."""
        x, sizes, counts = line_features([text])
        spans = drawn_spans(int(counts[0]), how, zlib.crc32(text.encode("utf-8", "surrogatepass")))
        lines = np.concatenate([np.arange(a, b) for a, b in spans])
        return Drawn(label, x[lines], sizes[lines], np.array([b - a for a, b in spans]))


def fit(samples: list[Drawn], share_good: float, how: Training = Training()) -> LineField:
    """Field of drawn texts; ``share_good`` is the share of label 1 in all labelled rows.

    With one label only, or none, every text gets the share as its score.
    """
    samples = sorted(samples, key=lambda s: (s.label, len(s.sizes), s.features.tobytes()))
    label = np.array([s.label for s in samples], float)
    if not len(label) or label.min() == label.max():
        share = min(max(share_good, 1e-6), 1 - 1e-6)
        return LineField(np.zeros(3 * OWN + 1), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    x, sizes = np.concatenate([s.features for s in samples]), np.concatenate([s.sizes for s in samples])
    stretches = np.concatenate([s.counts for s in samples])
    counts = np.array([len(s.sizes) for s in samples])
    chains, starts = Chains(stretches), np.cumsum(counts) - counts
    inner = np.setdiff1d(np.arange(len(x)), np.cumsum(stretches) - stretches)
    owner = np.repeat(np.arange(len(counts)), counts)
    y = label[owner]
    # Each label weighs the same, and a text as much as any other of its label.
    per_text = np.where(label == 1, 1 / label.sum(), 1 / (1 - label).sum()) / counts
    weight = per_text[owner]
    for again in range(2):
        w, t = _fit_field(x, y, weight, chains, inner, how)
        forward, backward = chains.passes(x @ w, t)
        good = _sigmoid(forward + backward)
        if again:
            break
        # The worst line of a bad text stays bad.
        worst = np.minimum.reduceat(good, starts)[owner]
        y = np.where((label[owner] == 0) & (good > how.sure) & (good > worst), 1.0, y)
    natural = np.where(label == 1, share_good / label.sum(), (1 - share_good) / (1 - label).sum()) * len(label)
    slope, offset = fit_logistic(_mean_by_length(good, sizes, starts), label, natural, middle=False)
    return LineField(w, t, slope, offset)


def train(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    how: Training = Training(),
) -> LineField:
    """Field from a bounded sample of labelled texts, long ones too.

    ``labels`` has (doc_id, label 0 or 1); rows with a null id or label are not
    learned from. The driver gets the features of at most ``how.lines`` lines of
    each text of the sample, whatever their length.
    """
    prepare_python(docs.sparkSession)
    usable = labels.select(quoted(doc_id).alias("id"), quoted(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    picked = bounded_sample(usable, "label", "id", how.per_label, how.seed)
    texts = docs.select(quoted(doc_id).alias("id"), text_of(quoted(text)).alias("text"))

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Drawn.of(y, t, how) for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            parts = [[getattr(d, name).tobytes() for d in found] for name in ("features", "sizes", "counts")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p, pa.binary()) for p in parts)], ["label", "features", "sizes", "counts"])

    drawn = texts.join(F.broadcast(picked), "id").select("label", "text")
    rows = drawn.mapInArrow(draw, "label int, features binary, sizes binary, counts binary").toArrow().to_pylist()
    samples = [
        Drawn(r["label"], np.frombuffer(r["features"]).reshape(-1, 3 * OWN + 1), np.frombuffer(r["sizes"]), np.frombuffer(r["counts"], np.int64))
        for r in rows
    ]
    return fit(samples, share, how)


def score_quality(docs: DataFrame, field: LineField, text: str = "text") -> DataFrame:
    """Every column of ``docs`` and score, predicted, n_lines, n_bad_lines (replaced where present, in any case).

    ``score`` is the calibrated chance of label 1, ``predicted`` whether it is
    at least 0.5. A null or empty text is one empty line. Rows are scored one by
    one over all their lines; repeats and an empty table need no care.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    sent = spark.sparkContext.broadcast(field)

    @F.pandas_udf("score double, predicted int, n_lines long, n_bad_lines long")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            texts = batch.tolist()
            # Like with like: chains of about the same length run side by side.
            order = sorted(range(len(texts)), key=lambda i: texts[i].count("\n"))
            out = np.zeros((len(texts), 3))
            for low in range(0, len(order), 128):
                some = order[low : low + 128]
                out[some] = np.stack(model.quality([texts[i] for i in some]), 1)
            yield pd.DataFrame(
                {
                    "score": out[:, 0],
                    "predicted": (out[:, 0] >= 0.5).astype(np.int32),
                    "n_lines": out[:, 1].astype(np.int64),
                    "n_bad_lines": out[:, 2].astype(np.int64),
                }
            )

    names = ["score", "predicted", "n_lines", "n_bad_lines"]
    rows = docs.select(F.struct(*columns_without(docs, names)).alias("kept"), judge(text_of(quoted(text))).alias("found"))
    return rows.select("kept.*", *[F.col(f"found.{n}").alias(n) for n in names])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of documents not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_remainder("doc_id", 3) == 1
    field = train(docs, labels.where(~held_out))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return score_quality(rows, field).select("doc_id", "held_out", "score", "predicted", "n_lines", "n_bad_lines")
