"""Near-duplicate embeddings: sign hashing in several tables, exact cosines, components.

Vectors of equal components form a class, which is one row from there on. Each
class's vector gets a bucket in every table: the signs of its products with that
table's random hyperplanes. Vectors that share a bucket in any table are compared
by their exact cosine. A pair is counted in the first table whose bucket it
shares, so links are counted once without listing pairs.

Buckets hold a sketch of each vector, 256 signs, and the vectors themselves are
brought only to those buckets where another sketch is near enough for the
threshold. What is shuffled for an unlike vector is thus some 60 bytes a table.

Bits grow with the logarithm of the number of classes, so that a bucket of
unrelated vectors holds about ``bucket`` of them at any size; the number of
tables follows from the wanted recall at the threshold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewake.llm.common import (
    cut,
    fixed_width,
    groups,
    join_split,
    local_roots,
    prepare_python,
    table,
    with_blocks,
)
from pricewake.llm.components import connected_components


@dataclass(frozen=True)
class Hashing:
    """``recall`` is the chance that a pair exactly at the threshold shares a bucket; nearer pairs have more."""

    recall: float = 0.985
    bucket: int = 16
    # Rows of a bucket that are compared in one task; larger buckets are cut into blocks.
    block: int = 4096
    seed: int = 5

    def bits(self, n: int) -> int:
        return min(31, max(6, math.ceil(math.log2(max(n, 1) / self.bucket)) if n > self.bucket else 6))

    def tables(self, bits: int, threshold: float) -> int:
        same = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - same))) if same < 1 else 1


# Bits of the sketch that a vector is known by in its buckets; a multiple of 64.
SKETCH = 256


def _planes(seed: int, width: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([seed, width, bits, tables]).standard_normal((width, bits * tables))


def _classes(vectors: DataFrame, vector_id: str, vector: str) -> DataFrame:
    """(id, key): key is a digest of the components, null for a vector that links with nothing, and the unit vector."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            keys, units = [], []
            for row, id_ in zip(given.column(1).to_pylist(), given.column(0).to_pylist()):
                key = unit = None
                if id_ is not None and row and None not in row:
                    x = np.array(row, np.float64)
                    # Scaled first, so that neither very large nor very small components leave the range.
                    top = np.abs(x).max()
                    if np.isfinite(x).all() and top > 0:
                        x = x / top
                        unit = (x / np.sqrt(x @ x)).tobytes()
                        key = hashlib.blake2b(np.array(row, np.float64).tobytes(), digest_size=16).digest()
                keys.append(key)
                units.append(unit)
            yield pa.RecordBatch.from_arrays([given.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["id", "key", "unit"])

    kind = vectors.schema[vector_id].dataType.simpleString()
    named = vectors.select(F.col(vector_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return named.mapInArrow(digest, f"id {kind}, key binary, unit binary")


def _signs(x: np.ndarray, planes: np.ndarray, tables: int) -> np.ndarray:
    """A number for every row and table: the signs of the products with the table's planes, as bits."""
    bits = planes.shape[1] // tables
    powers = 1 << np.arange(bits, dtype=np.int64)
    return ((x @ planes).reshape(len(x), tables, bits) > 0) @ powers


def _units(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _hashed(classes: DataFrame, hashing: Hashing, bits: int, tables: int) -> DataFrame:
    """(key, bucket, sketch): one row per class and table; ``bucket`` also names the table and the width.

    The sketch, signs of ``SKETCH`` more planes, stands for the vector until its
    bucket is known to hold another like it.
    """

    def hash_(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            units = given.column(1).to_pylist()
            by_width: dict[int, list[int]] = {}
            for i, u in enumerate(units):
                by_width.setdefault(len(u) // 8, []).append(i)
            for width, rows in by_width.items():
                planes = _planes(hashing.seed, width, bits, tables)
                more = _planes(hashing.seed + 1, width, SKETCH, 1)
                for low in range(0, len(rows), 512):
                    some = rows[low : low + 512]
                    x = _units([units[i] for i in some])
                    number = np.arange(tables, dtype=np.int64) + tables * np.int64(width)
                    buckets = (number << 32) | _signs(x, planes, tables)
                    sketches = np.packbits(x @ more > 0, axis=1)
                    kept = given.column(0).take(pa.array(np.repeat(np.array(some), tables)))
                    each = [s.tobytes() for s in sketches]
                    yield pa.RecordBatch.from_arrays(
                        [kept, pa.array(buckets.ravel(), pa.int64()), pa.array([e for e in each for _ in range(tables)], pa.binary())],
                        ["key", "bucket", "sketch"],
                    )

    return classes.select("key", "unit").mapInArrow(hash_, "key binary, bucket long, sketch binary")


def most_different(threshold: float) -> int:
    """Bits in which sketches of vectors at the threshold differ at most, but for one pair in a billion."""
    p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    return math.floor(SKETCH * p + 6 * math.sqrt(SKETCH * p * (1 - p)))


_KEYS = ["bucket", "block_a", "block_b"]


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows to compare with which rows, and whether those are one block."""
    side = rows["side"].to_numpy()
    one_block = rows["block_a"][0].as_py() == rows["block_b"][0].as_py()
    left = np.arange(rows.num_rows) if one_block else np.flatnonzero(side == 0)
    return left, left if one_block else np.flatnonzero(side == 1), one_block


def _alike(hashed: DataFrame, threshold: float, block: int) -> DataFrame:
    """(bucket, block_a, block_b, side, key) of the rows whose sketch is near that of another in their block."""
    most = most_different(threshold)

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, _KEYS):
            if rows.num_rows < 2:
                continue
            words = fixed_width(rows["sketch"], "<u8")
            left, right, one_block = _sides(rows)
            found = np.zeros(rows.num_rows, bool)
            for low in range(0, len(left), 256):
                some = left[low : low + 256]
                apart = np.zeros((len(some), len(right)), np.uint16)
                for k in range(words.shape[1]):
                    apart += np.bitwise_count(words[some, k][:, None] ^ words[right, k][None, :])
                near = apart <= most
                if one_block:
                    near &= right[None, :] != some[:, None]
                found[some] |= near.any(1)
                found[right] |= near.any(0)
            if found.any():
                yield from rows.select([*_KEYS, "side", "key"]).take(pa.array(np.flatnonzero(found))).to_batches()

    dealt = with_blocks(hashed, "bucket", "key", block)
    together = dealt.select(*_KEYS, "side", "key", "sketch").repartition(*_KEYS).sortWithinPartitions(*_KEYS, "key")
    return together.mapInArrow(choose, "bucket long, block_a int, block_b int, side int, key binary")


def _compared(alike: DataFrame, classes: DataFrame, threshold: float, hashing: Hashing, bits: int, tables: int) -> DataFrame:
    """(key, links, low) per class and block with a link: copies linked first here, and a class linked with it."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, _KEYS):
            n = rows.num_rows
            if n < 2:
                continue
            x = fixed_width(rows["unit"], "<f8")
            copies = rows["copies"].to_numpy()
            this = (rows["bucket"][0].as_py() >> 32) % tables
            # The tables before this one, made anew from the vector.
            planes = _planes(hashing.seed, x.shape[1], bits, tables)[:, : this * bits]
            signs = np.concatenate([_signs(x[k : k + 512], planes, this) for k in range(0, n, 512)]) if this else np.zeros((n, 0), np.int64)
            left, right, one_block = _sides(rows)
            links, ends = np.zeros(n, np.int64), []
            for low in range(0, len(left), 512):
                some = left[low : low + 512]
                near = x[some] @ x[right].T >= threshold
                if one_block:
                    near &= right[None, :] > some[:, None]
                i, j = np.nonzero(near)
                i, j = some[i], right[j]
                if not len(i):
                    continue
                for at in range(0, len(i), 100_000):
                    a, b = i[at : at + 100_000], j[at : at + 100_000]
                    new = (signs[a] != signs[b]).all(1)
                    np.add.at(links, a[new], copies[b[new]])
                    np.add.at(links, b[new], copies[a[new]])
                # Connected rows are enough for the components; pairs go no further.
                root = local_roots(n, np.r_[i, *[e[0] for e in ends]], np.r_[j, *[e[1] for e in ends]])
                tied = np.flatnonzero(root != np.arange(n))
                ends = [(tied, root[tied])]
            if ends:
                root = np.arange(n)
                root[ends[0][0]] = ends[0][1]
                found = np.union1d(np.flatnonzero(links), ends[0][0])
                yield pa.RecordBatch.from_arrays(
                    [rows["key"].combine_chunks().take(pa.array(found)), pa.array(links[found]), rows["key"].combine_chunks().take(pa.array(root[found]))],
                    ["key", "links", "low"],
                )

    whole = join_split(alike, classes.select("key", "copies", "unit"), "key")
    columns = [*_KEYS, "side", "key", "copies", "unit"]
    together = whole.select(*columns).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "key")
    return together.mapInArrow(compare, "key binary, links long, low binary")


def link_vectors(
    vectors: DataFrame,
    vector_id: str = "vec_id",
    vector: str = "embedding",
    threshold: float = 0.9,
    hashing: Hashing = Hashing(),
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Two vectors are linked if they share a bucket and their cosine, in double
    precision, is at least ``threshold`` (over 0). ``n_links`` counts the other
    rows linked directly, ``component_id`` is the smallest id reachable by links,
    ``kept`` whether that is the row's own. Vectors of different widths are never
    linked. Null, empty or zero vectors and vectors with null or non-finite
    components link with nothing, nor do rows with a null id. Rows that repeat an
    id count as several. An empty table gives no rows; other columns are ignored.

    A class of equal vectors is one row, however large; a bucket with very many
    classes is compared block by block. The driver sees the number of classes.
    """
    prepare_python(vectors.sparkSession, 2048)
    rows = _classes(vectors, vector_id, vector)
    classes = cut(
        rows.where("key is not null").groupBy("key")
        .agg(F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"), F.min("id").alias("least"))
    )
    n = classes.count()
    bits = hashing.bits(n)
    tables = hashing.tables(bits, threshold)
    alike = _alike(_hashed(classes, hashing, bits, tables), threshold, hashing.block)
    found = cut(_compared(alike, classes, threshold, hashing, bits, tables))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    components = connected_components(found, "key", "low")
    named = classes.select("key", "copies", "least").join(components.withColumnRenamed("node", "key"), "key", "left")
    named = named.select("key", "copies", "least", F.coalesce("component", "key").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = join_split(named, smallest, "component").join(links, "key", "left").select(
        "key", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    members = join_split(rows.select("id", "key"), per_class, "key", "left")
    component = F.coalesce("component_id", "id")
    return members.select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all ``embeddings`` at cosine 0.9."""
    return link_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
