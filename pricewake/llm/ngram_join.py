"""Similarity join on word n-grams with Bayesian pruning of candidates.

1. A text is the set of its shingles: five words in a row, words being what
   stands between white space in the lower-cased text; a text of fewer words is
   one shingle. Texts with equal sets are a class, one row from there on.
2. Classes get MinHash values; those that agree in all values of a band are
   candidates.
3. Candidates' values are compared sixteen at a time. After m agreements in n
   the similarity has, from a uniform prior, the posterior Beta(m + 1, n - m + 1);
   a pair is dropped as soon as its chance to reach the threshold is below the
   tolerance. Survivors tie classes to clusters.
4. Within each cluster all pairs are verified exactly from the texts.

Pairs are never written out: steps 3 and 4 give each class its number of links
and one tie to a class it is connected with.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewake.llm.common import (
    cut,
    fixed_width,
    join_split,
    local_roots,
    prepare_python,
    table,
    text_of,
    whole_groups,
    with_blocks,
    worker_cache,
)
from pricewake.llm.components import connected_components

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(64)], np.uint64)


@dataclass(frozen=True)
class JoinSetting:
    """A pair exactly at similarity 0.8 shares a band with probability 0.99995, and passes all eight
    Bayesian tests with one above 0.9999; nearer pairs with more."""

    threshold: float = 0.8
    words: int = 5
    bands: int = 25
    rows: int = 5
    values: int = 128
    step: int = 16
    tolerance: float = 1e-5
    # Rows of a band's bucket, and of a cluster, that one task compares; more are cut into blocks.
    bucket_block: int = 8192
    cluster_block: int = 512
    # Clustered classes up to this many (some 40 MB) are broadcast to find their texts, more are joined by shuffle.
    broadcast_rows: int = 1_000_000
    seed: int = 3


def least_matches(setting: JoinSetting) -> list[int]:
    """Fewest agreements after each step with which a pair stays.

    The chance that Beta(m + 1, n - m + 1) is at least t equals the chance of at
    most m successes in n + 1 trials with success probability t.
    """
    t, found = setting.threshold, []
    for n in range(setting.step, setting.values + 1, setting.step):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= setting.tolerance:
                break
            m += 1
        found.append(m)
    return found


class _WordHash(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX[0]
    h = (h ^ (h >> np.uint64(33))) * _MIX[1]
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; none for a text without words."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    known = worker_cache("ngram_join", "words", _WordHash)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    if n < width:
        return _mixed((hashes * _POWERS[:n]).sum(keepdims=True) + np.uint64(n))
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += hashes[k : n - width + 1 + k] * _POWERS[k]
    return np.unique(_mixed(total))


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def minhash_values(sets: list[np.ndarray], setting: JoinSetting) -> np.ndarray:
    """16 bits of the least value of every hash function, a row for each (non-empty) set."""
    rng = np.random.default_rng(setting.seed)
    factors = rng.integers(0, 1 << 63, setting.values, np.uint64) * np.uint64(2) + np.uint64(1)
    masks = rng.integers(0, 1 << 63, setting.values, np.uint64)
    every = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    least = np.empty((len(sets), setting.values), np.uint64)
    work = np.empty_like(every)
    for j in range(setting.values):
        np.bitwise_xor(every, masks[j], out=work)
        np.multiply(work, factors[j], out=work)
        least[:, j] = np.minimum.reduceat(work, starts)
    return (_mixed(least) >> np.uint64(48)).astype("<u2")


def band_keys(values: np.ndarray, setting: JoinSetting) -> np.ndarray:
    """A 64-bit number for each row and band, equal where all values of the band are."""
    used = values[:, : setting.bands * setting.rows].reshape(len(values), setting.bands, setting.rows)
    total = (used.astype(np.uint64) + np.uint64(1)) @ _POWERS[1 : setting.rows + 1]
    return _mixed(total + np.arange(setting.bands, dtype=np.uint64) * _MIX[1]).view(np.int64)


def still_likely(a: np.ndarray, b: np.ndarray, setting: JoinSetting, least: list[int]) -> np.ndarray:
    """Which pairs of rows of MinHash values stay through all steps."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for step, m in enumerate(least):
        part = slice(step * setting.step, (step + 1) * setting.step)
        matches = matches + (a[alive, part] == b[alive, part]).sum(1)
        keep = matches >= m
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    found = np.zeros(len(a), bool)
    found[alive] = True
    return found


def _signed(docs: DataFrame, doc_id: str, text: str, setting: JoinSetting) -> DataFrame:
    """(id, key, values); key and values are null for a text without words."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            ids, texts = given.column(0), given.column(1).to_pylist()
            keys: list[bytes | None] = [None] * len(texts)
            values: list[bytes | None] = [None] * len(texts)
            for low in range(0, len(texts), 64):
                sets = [(i, shingle_set(texts[i], setting.words)) for i in range(low, min(low + 64, len(texts)))]
                sets = [(i, s) for i, s in sets if len(s)]
                if not sets:
                    continue
                for (i, s), row in zip(sets, minhash_values([s for _, s in sets], setting)):
                    keys[i], values[i] = set_key(s), row.tobytes()
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["id", "key", "values"])

    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("__text"))
    return named.mapInArrow(sign, f"id {kind}, key binary, values binary")


def _banded(classes: DataFrame, setting: JoinSetting) -> DataFrame:
    """(band, key): a row for every class and band."""

    def band(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            if given.num_rows:
                found = band_keys(fixed_width(pa.chunked_array([given.column(1)]), "<u2"), setting)
                rows = np.repeat(np.arange(given.num_rows), setting.bands)
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), given.column(0).take(pa.array(rows))], ["band", "key"])

    return classes.select("key", "values").mapInArrow(band, "band long, key binary")


def _ties_of_bucket(values: np.ndarray, side: np.ndarray, one: bool, setting: JoinSetting, least: list[int]) -> np.ndarray:
    """Smallest row connected with each row of a bucket by pairs that stay.

    Rows that stay with the first row of their component are not compared with
    each other: that could tie nothing more.
    """
    n = len(values)
    root = np.arange(n)
    pending = np.arange(n)
    while len(pending):
        pivot, pending = pending[0], pending[1:]
        others = np.flatnonzero(root != root[pivot])
        if not one:
            others = others[side[others] != side[pivot]]
        if len(others):
            stay = others[still_likely(np.broadcast_to(values[pivot], (len(others), values.shape[1])), values[others], setting, least)]
            if len(stay):
                merged = np.isin(root, root[np.r_[stay, pivot]])
                root[merged] = root[merged].min()
        # With everything tied, the rest need not be looked at.
        if (root == root[0]).all():
            break
    return root


def _ties(banded: DataFrame, classes: DataFrame, setting: JoinSetting) -> DataFrame:
    """(a, b): classes tied by candidates that survive the Bayesian tests."""
    least = least_matches(setting)

    # Rows are sorted by class within a group, so that a group's ties lead to its smallest class.
    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["band", "block_a", "block_b"]):
            n = rows.num_rows
            sizes = np.diff(np.r_[starts, n])
            if sizes.max() < 2:
                continue
            values = fixed_width(rows["values"], "<u2")
            side = rows["side"].to_numpy()
            one = (rows["block_a"].to_numpy() == rows["block_b"].to_numpy())[starts]
            owner = np.repeat(np.arange(len(starts)), sizes)
            root = np.arange(n)
            # All groups at once: every row against the first of its group.
            first = starts[owner]
            pairs = np.flatnonzero((first != np.arange(n)) & (one[owner] | (side != side[first])))
            stay = pairs[still_likely(values[first[pairs]], values[pairs], setting, least)]
            root[stay] = first[stay]
            # Larger groups with rows that are not tied to the first are looked at one by one.
            loose = np.bincount(owner, root == np.arange(n), len(starts)) > 1
            for g in np.flatnonzero(loose & (sizes > 2)):
                part = slice(starts[g], starts[g] + sizes[g])
                root[part] = starts[g] + _ties_of_bucket(values[part], side[part], bool(one[g]), setting, least)
            tied = np.flatnonzero(root != np.arange(n))
            keys = rows["key"].combine_chunks()
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(tied)), keys.take(pa.array(root[tied]))], ["a", "b"])

    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    candidates = cut(join_split(banded, shared, "band"))
    dealt = with_blocks(candidates, "band", "key", setting.bucket_block)
    valued = join_split(dealt, classes.select("key", "values"), "key")
    keys = ["band", "block_a", "block_b"]
    together = valued.select(*keys, "side", "key", "values").repartition(*keys).sortWithinPartitions(*keys, "key")
    return together.mapInArrow(compare, "a binary, b binary").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Size of the intersection of each set on the left with each on the right.

    Shared shingles become columns of 0/1 matrices, some at a time, whose
    product counts them. Single precision holds such counts exactly to 2^24 in
    one piece; pieces are added as integers.
    """
    n, m = len(left), len(right)
    every = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(n + m), [len(s) for s in (*left, *right)])
    _, number, count = np.unique(every, return_inverse=True, return_counts=True)
    kept = count[number] > 1
    compact = np.cumsum(count > 1) - 1
    number, owner = compact[number[kept]], owner[kept]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    result = np.zeros((n, m), np.int64)
    width = int(number[-1]) + 1 if len(number) else 0
    for low in range(0, width, columns):
        a, b = np.searchsorted(number, [low, low + columns])
        dense = np.zeros((n + m, min(columns, width - low)), np.float32)
        dense[owner[a:b], number[a:b] - low] = 1
        result += np.rint(dense[:n] @ dense[n:].T).astype(np.int64)
    return result


def _verified(texts: DataFrame, clusters: DataFrame, setting: JoinSetting) -> DataFrame:
    """(key, links, low) for classes with a link, from (cluster, key, copies, text); ``clusters`` has its keys alone."""

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["cluster", "block_a", "block_b"]):
            ends = np.r_[starts[1:], rows.num_rows]
            for low, high in zip(starts.tolist(), ends.tolist()):
                if high - low > 1:
                    found = verify_cluster(rows.slice(low, high - low))
                    if found is not None:
                        yield found

    def verify_cluster(rows: pa.Table) -> pa.RecordBatch | None:
        keys, sides, copies = rows["key"].to_pylist(), rows["side"].to_pylist(), rows["copies"].to_pylist()
        one = rows["block_a"][0] == rows["block_b"][0]
        members: dict[tuple[bytes, int], tuple[int, np.ndarray]] = {}
        for key, side, n, text in zip(keys, sides, copies, rows["text"].to_pylist()):
            if (key, side) not in members:
                shingles = shingle_set(text, setting.words)
                # Another text under the same id is not this class.
                if set_key(shingles) == key:
                    members[key, side] = (n, shingles)
        names = [k for k, _ in members]
        weight = np.array([n for n, _ in members.values()], np.int64)
        sets = [s for _, s in members.values()]
        size = np.array([len(s) for s in sets], np.int64)
        side = np.array([s for _, s in members], np.int64)
        left = np.arange(len(sets)) if one else np.flatnonzero(side == 0)
        right = left if one else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return None
        shared = overlaps([sets[i] for i in left], [sets[i] for i in right])
        near = shared / (size[left][:, None] + size[right][None, :] - shared) >= setting.threshold
        if one:
            np.fill_diagonal(near, False)
        links = np.zeros(len(sets), np.int64)
        links[left] += near @ weight[right]
        if not one:
            links[right] += near.T @ weight[left]
        i, j = np.nonzero(near)
        root = local_roots(len(sets), left[i], right[j])
        linked = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array([names[x] for x in linked], pa.binary()), pa.array(links[linked]), pa.array([names[root[x]] for x in linked], pa.binary())],
            ["key", "links", "low"],
        )

    dealt = with_blocks(texts, "cluster", "key", setting.cluster_block, clusters)
    keys = ["cluster", "block_a", "block_b"]
    columns = [*keys, "side", "key", "copies", "text"]
    together = dealt.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "key")
    return together.mapInArrow(verify, "key binary, links long, low binary")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    setting: JoinSetting = JoinSetting(),
) -> DataFrame:
    """(id, class_id, n_links) for every row.

    Two rows are linked if the Jaccard similarity of their shingle sets is at
    least the threshold. ``n_links`` counts the other rows linked directly,
    equal texts included; ``class_id`` is the smallest id reachable by links,
    the row's own without any. Null and empty texts and rows with a null id link
    with nothing. Rows that repeat an id count as several. An empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    signed = cut(_signed(docs, doc_id, text, setting))
    named = signed.where("id is not null and key is not null")
    classes = cut(
        named.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.first("values").alias("values"))
    )
    ties = cut(_ties(_banded(classes, setting), classes, setting))
    clusters = connected_components(ties, "a", "b").select(F.col("node").alias("key"), F.col("component").alias("cluster"))
    wanted = cut(join_split(clusters, classes.select("key", "copies", "least"), "key"))
    source = docs.select(F.col(doc_id).alias("least"), text_of(text).alias("text"))
    if wanted.count() <= setting.broadcast_rows:
        texts = source.join(F.broadcast(wanted), "least")
    else:
        texts = source.join(wanted, "least")
    found = cut(_verified(texts, wanted, setting))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    components = connected_components(found, "key", "low").withColumnRenamed("node", "key")
    placed = classes.select("key", "copies", "least").join(components, "key", "left")
    placed = placed.select("key", "copies", "least", F.coalesce("component", "key").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("class_id"))
    per_class = join_split(placed, smallest, "component").join(links, "key", "left").select(
        "key", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    keyed = signed.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key"))
    members = join_split(keyed, per_class, "key", "left")
    return members.select(
        "id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id, columns unchanged.

    Of rows with one id all stay or all go; rows without an id stay.
    """
    found = near_duplicates(docs, doc_id, text)
    gone = found.where("class_id <> id").select("id").distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(gone, F.col("row")[doc_id] == F.col("id"), "left_anti").select("row.*")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and numbers of links of all ``documents`` at similarity 0.8 of five-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
