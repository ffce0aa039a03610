"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the runs of two to four characters inside and at the edges
of its words (lower case, everything but letters is an edge). Each is hashed to
one of ``buckets`` vectors; their mean goes through a linear softmax. Vectors and
softmax are trained together by stochastic gradient descent in numpy on a bounded
sample; a share of the sample is kept apart to fit the temperature of the
softmax and the score below which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewake.llm.common import columns_without, crc_remainder, prepare_python, quoted, table, text_of
from pricewake.llm.sampling import bounded_sample

UNKNOWN = "und"


@dataclass(frozen=True)
class Training:
    """The sample bound (rows of each language) and the fit."""

    per_language: int = 400
    buckets: int = 1 << 14
    width: int = 16
    epochs: int = 6
    rate: float = 0.5
    apart: float = 0.25
    precision: float = 0.99
    seed: int = 11


_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter, made once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def subword_buckets(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every subword, its text's index, whether each text has a letter)."""
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.array([len(p) + 2 for p in points], np.int64)
    edge = np.zeros(1, np.uint32)
    line = np.concatenate([x for p in points for x in (edge, p, edge)]) if points else edge
    line = np.where(_letter_table()[np.minimum(line, 0x10FFFF)], line, 0).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    is_letter = line != 0
    # Runs of edges shrink to one, so that length does not depend on spacing.
    keep = is_letter | np.r_[True, is_letter[:-1] | (owner[1:] != owner[:-1])]
    line, owner, is_letter = line[keep], owner[keep], is_letter[keep]
    has = np.zeros(len(texts), bool)
    has[owner[is_letter]] = True
    found, owners = [], []
    mixed = line * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1234567)
    h = mixed.copy()
    for n in (2, 3, 4):
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mixed[n - 1 :]
        whole = np.ones(len(h), bool)
        for k in range(1, n - 1):
            whole &= is_letter[k : len(line) - n + 1 + k]
        whole &= owner[: len(h)] == owner[n - 1 :]
        kept = h[whole]
        kept ^= kept >> np.uint64(32)
        found.append((kept * np.uint64(0x94D049BB133111EB) >> np.uint64(40)).astype(np.int64) % buckets)
        owners.append(owner[: len(h)][whole])
    return np.concatenate(found), np.concatenate(owners), has


@dataclass(frozen=True)
class LanguageModel:
    """``table`` holds each bucket's vector already multiplied by the softmax weights."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(calibrated probabilities per language, whether each text has a letter)."""
        n, k = len(texts), len(self.languages)
        buckets, owner, has = subword_buckets(texts, len(self.table))
        sums = np.stack([np.bincount(owner, self.table[buckets, j], n) for j in range(k)], 1)
        means = sums / np.maximum(np.bincount(owner, minlength=n), 1)[:, None]
        return _softmax((means + self.bias) / self.temperature), has

    def predict(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Every column of ``docs`` and lang_pred, score, accepted (replaced where present, in any case).

        ``lang_pred`` is a learned language, or ``und`` with score 0 for a null
        text, one without a letter, or a model that learned none; ``accepted``
        says whether the score passes the rejection bound. Rows are scored one
        by one over their whole text.
        """
        spark = docs.sparkSession
        prepare_python(spark)
        sent = spark.sparkContext.broadcast(self)

        @F.pandas_udf("lang_pred string, score double, accepted boolean")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = sent.value
            for batch in batches:
                parts = [model._judge(batch.iloc[i : i + 64].tolist()) for i in range(0, len(batch), 64)]
                yield pd.concat(parts) if parts else model._judge([])

        names = ["lang_pred", "score", "accepted"]
        rows = docs.select(F.struct(*columns_without(docs, names)).alias("kept"), score(text_of(quoted(text))).alias("found"))
        return rows.select("kept.*", *[F.col(f"found.{n}").alias(n) for n in names])

    def _judge(self, texts: list[str]) -> pd.DataFrame:
        if not self.languages or not texts:
            n = len(texts)
            return pd.DataFrame({"lang_pred": pd.Series([UNKNOWN] * n, dtype=object), "score": np.zeros(n), "accepted": np.zeros(n, bool)})
        p, has = self.scores(texts)
        best = p.argmax(1)
        names = np.array(self.languages, object)[best]
        names[~has] = UNKNOWN
        score = np.where(has, p.max(1), 0.0)
        return pd.DataFrame({"lang_pred": names, "score": score, "accepted": has & (score >= self.reject_below)})


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], how: Training = Training()) -> LanguageModel:
    """Model of (language, buckets, counts) samples; without any, a model of no language."""
    rng = np.random.default_rng(how.seed)
    samples = sorted((s for s in samples if len(s[1])), key=lambda s: (s[0], len(s[1]), s[1].tobytes(), s[2].tobytes()))
    languages = tuple(sorted({s[0] for s in samples}))
    k = len(languages)
    if not k:
        return LanguageModel((), np.zeros((1, 0)), np.zeros(0), 1.0, 0.0)
    label = np.array([languages.index(s[0]) for s in samples])
    apart = rng.random(len(samples)) < how.apart
    vectors = rng.uniform(-1, 1, (how.buckets, how.width)) / how.width
    weights, bias = np.zeros((how.width, k)), np.zeros(k)
    share = np.array([(label == j).mean() for j in range(k)])
    train = np.flatnonzero(~apart) if (~apart).any() else np.arange(len(samples))
    steps = how.epochs * len(train)
    done = 0
    for _ in range(how.epochs):
        for i in rng.permutation(train):
            _, at, count = samples[i]
            w = count / count.sum()
            mean = w @ vectors[at]
            error = _softmax(mean @ weights + bias)
            error[label[i]] -= 1
            # Rare languages weigh as much as common ones.
            rate = how.rate * (1 - done / steps) * min(4.0, 1 / (k * share[label[i]]))
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            vectors[at] -= rate * 8 * np.outer(w, back)
            done += 1
    folded = vectors @ weights
    held = np.flatnonzero(apart) if apart.any() else train
    logits = np.array([(c / c.sum()) @ folded[b] + bias for _, b, c in (samples[i] for i in held)])
    temperature = min(np.geomspace(0.05, 5, 60), key=lambda t: _loss(logits / t, label[held]))
    p = _softmax(logits / temperature)
    score, right = p.max(1), p.argmax(1) == label[held]
    order = np.argsort(-score)
    enough = np.flatnonzero(np.cumsum(right[order]) >= how.precision * np.arange(1, len(order) + 1))
    reject = float(score[order[enough[-1]]]) if len(enough) else 1.0
    return LanguageModel(languages, folded, bias, float(temperature), reject)


def _loss(logits: np.ndarray, label: np.ndarray) -> float:
    p = _softmax(logits)[np.arange(len(label)), label]
    # Half a count on either side keeps a faultless sample from certainty.
    n = len(label)
    return float(-(np.log(p + 1e-300).sum() + 0.5 * np.log(1 - p + 1e-12).sum() / max(n, 1)) / max(n, 1))


def train(docs: DataFrame, text: str, language: str, id_column: str, how: Training = Training()) -> LanguageModel:
    """Model from a sample of at most about ``per_language`` rows of every non-null language.

    Whole texts become counts of buckets on the executors; those alone, of
    bounded size, come to the driver.
    """
    prepare_python(docs.sparkSession)
    buckets = how.buckets

    @F.pandas_udf("array<int>")
    def counts(texts: pd.Series) -> pd.Series:
        rows = []
        for t in texts:
            found, n = np.unique(subword_buckets([t], buckets)[0], return_counts=True)
            rows.append(np.concatenate([found, n]).astype(np.int32))
        return pd.Series(rows, dtype=object)

    sample = bounded_sample(docs.select(id_column, text, language), language, id_column, how.per_language, how.seed)
    rows = sample.select(F.col(language).alias("language"), counts(text_of(text)).alias("counts")).collect()
    halves = [(r["language"], np.array(r["counts"], np.int64)) for r in rows]
    return fit([(name, x[: len(x) // 2], x[len(x) // 2 :]) for name, x in halves], how)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out: Column = crc_remainder("doc_id", 4) == 2
    model = train(docs.where(~held_out), "text", "lang", "doc_id")
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return model.predict(rows).select("doc_id", "held_out", "lang_pred", "score", "accepted")
