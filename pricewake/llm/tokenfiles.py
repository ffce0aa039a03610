"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

A folder holds

* ``ranks`` (Parquet: rank, id): ids by falling frequency, ties by id;
* ``files/bucket=N``: one file per range of document ids, in ascending order of
  range; within a file documents ascend too;
* ``manifest`` (Parquet: bucket, n_docs, n_ids, start): what each file holds and
  how many ids come before it.

A file is a row of blocks, each ended by a line end. A block:

    magic            8 bytes  "TOKBLK01"
    documents, ids   2 x u64
    data bytes       u64
    document ids     i64 each, 2^63 - 1 less for a null one (see NULL_ID)
    lengths          u64 each
    control bytes    one per four ids, two bits an id: its number of bytes less one
    data bytes       ranks, little-endian, 1 to 4 bytes each

Each document's ids are filled up to a multiple of four with one-byte zeros, so
that its control bytes stand alone. Control bytes are decoded by table lookup.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewake.llm.common import free_worker_cache, new_folder, prepare_python, remove_folder, table, text_of
from pricewake.llm.tokens import encoder, public_tokenizer, read_tokenizer

MAGIC = b"TOKBLK01"
NULL_ID = -(1 << 63)
BLOCK_IDS = 1 << 20
FILE_IDS = 24 << 20
# Words whose ids a worker keeps, some 200 bytes each.
KEPT_WORDS = 1_200_000
# Files that rows of one id, or without one, may be dealt to.
SPREAD = 1 << 16
# Ranges of ids that are cut at once.
COARSE = 1000

# Control byte -> lengths of its four values, where each starts, and all bytes together.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
STARTS = (np.cumsum(LENGTHS, 1) - LENGTHS).astype(np.uint8)
TOTALS = LENGTHS.sum(1, dtype=np.int64)


def _not_filled(counts: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Which places hold a value when each document's ``counts`` are filled up to ``filled``."""
    held, ends = np.ones(int(filled.sum()), bool), np.cumsum(filled)
    for k in range(3):
        held[ends[filled - counts > k] - 1 - k] = False
    return held


def encode_values(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of unsigned 32-bit values, for each document of ``counts`` values."""
    counts = np.array([len(values)]) if counts is None else counts
    filled = -(-counts // 4) * 4
    ends = np.cumsum(filled)
    every = np.zeros(int(filled.sum()), "<u4")
    every[_not_filled(counts, filled)] = values
    extra = (every > 0xFF).astype(np.uint8) + (every > 0xFFFF) + (every > 0xFFFFFF)
    codes = extra.reshape(-1, 4)
    control = (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).astype(np.uint8).tobytes()
    used = np.arange(4) <= extra[:, None]
    data = every.view(np.uint8).reshape(-1, 4)[used].tobytes()
    sizes = np.cumsum(np.r_[0, extra.astype(np.int64) + 1])
    place = np.r_[0, ends].tolist()
    cuts = sizes[place].tolist()
    return (
        [control[a // 4 : b // 4] for a, b in zip(place, place[1:])],
        [data[a:b] for a, b in zip(cuts, cuts[1:])],
    )


def decode_values(control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """All values of the control bytes, fillers included."""
    totals = TOTALS[control]
    starts = ((np.cumsum(totals) - totals)[:, None] + STARTS[control]).ravel()
    values = data[starts].astype(np.uint32)
    sizes = LENGTHS[control].ravel()
    for k in range(1, int(sizes.max(initial=1))):
        has = np.flatnonzero(sizes > k)
        values[has] |= data[starts[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def write_block(doc_ids: list[int | None], counts: list[int], controls: list[bytes], datas: list[bytes]) -> bytes:
    data = b"".join(datas)
    head = np.array([len(doc_ids), sum(counts), len(data)], "<u8").tobytes()
    ids = np.array([NULL_ID if i is None else i for i in doc_ids], "<i8").tobytes()
    return b"".join([MAGIC, head, ids, np.array(counts, "<u8").tobytes(), *controls, data])


def read_blocks(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, lengths, ranks of all documents together) of each block."""
    at, end = 0, len(content)
    while at < end:
        if content[at : at + 8] != MAGIC:
            raise ValueError("not a token file, or a damaged one")
        n_docs, _, n_data = (int(x) for x in np.frombuffer(content, "<u8", 3, at + 8))
        at += 32
        ids = np.frombuffer(content, "<i8", n_docs, at)
        lengths = np.frombuffer(content, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        at += 16 * n_docs
        filled = -(-lengths // 4) * 4
        n_control = int(filled.sum()) // 4
        control = np.frombuffer(content, np.uint8, n_control, at)
        data = np.frombuffer(content, np.uint8, n_data, at + n_control)
        values = decode_values(control, data)
        yield ids, lengths, values[_not_filled(lengths, filled)]
        at += n_control + n_data + 1


def _tokenized(docs: DataFrame, tokenizer: str, doc_id: str, text: str, end_id: int) -> DataFrame:
    """(doc_id, n, ids, seen, place): ids with the end id as little-endian unsigned integers of 2 or 4 bytes.

    ``seen`` holds, in one row of every batch, the batch's ids and their counts,
    so that frequencies need no second look at the ids. ``place`` counts rows, for
    rows of one id to be dealt by.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    end = int(end_id).to_bytes(4, "little")

    def tokenize(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(content.value, KEPT_WORDS)
        row = TaskContext.get().partitionId()
        narrow = max(tokens.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        for given in batches:
            if not given.num_rows:
                continue
            texts = given.column(1).to_pylist()
            done = [x + end for low in range(0, len(texts), 64) for x in tokens.encode(texts[low : low + 64])]
            counts = [len(x) // 4 for x in done]
            total = np.bincount(np.frombuffer(b"".join(done), "<u4"))
            found = np.flatnonzero(total)
            seen = np.stack([found, total[found]]).astype("<i8").tobytes()
            if narrow:
                done = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in done]
            places = np.arange(row, row + len(done)) % SPREAD
            row += len(done)
            yield pa.RecordBatch.from_arrays(
                [
                    given.column(0).cast(pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(done, pa.binary()),
                    pa.array([seen] + [None] * (len(done) - 1), pa.binary()),
                    pa.array(places, pa.int32()),
                ],
                ["doc_id", "n", "ids", "seen", "place"],
            )

    prepare_python(docs.sparkSession)
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("__text"))
    return named.mapInArrow(tokenize, "doc_id long, n long, ids binary, seen binary, place int")


def _unpack(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, f"<u{len(ids) // n}") if n else np.zeros(0, "<u4")


def _frequencies(tokens: DataFrame) -> DataFrame:
    """(id, count) over all documents, summed in each task before it is shuffled."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_cache()
        total = np.zeros(0, np.int64)
        for given in batches:
            for seen in given.column(0).to_pylist():
                ids, counts = np.frombuffer(seen, "<i8").reshape(2, -1)
                if ids[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(ids[-1] + 1 - len(total), np.int64)])
                total[ids] += counts
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "c"])

    counted = tokens.where("seen is not null").select("seen").mapInArrow(count, "id long, c long")
    return counted.groupBy("id").agg(F.sum("c").alias("count"))


def _range_bounds(tokens: DataFrame, n_files: int) -> set[int]:
    """Ids that cut the rows into about ``n_files`` equal ranges.

    Sketches of a fixed size give up to ``COARSE`` ranges; more are cut again
    within each of those, a sketch for each.
    """
    coarse = min(n_files, COARSE)
    cuts = tokens.approxQuantile("doc_id", [i / coarse for i in range(1, coarse)], 0.1 / coarse)
    found = {int(b) for b in cuts}
    if n_files > coarse:
        inner, limits = -(-n_files // coarse), tokens.sparkSession.sparkContext.broadcast(np.array(sorted(found), np.int64))

        def ranged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for given in batches:
                number = np.searchsorted(limits.value, given.column(0).to_numpy(), side="right")
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), given.column(0)], ["range", "doc_id"])

        named = tokens.where("doc_id is not null").select("doc_id").mapInArrow(ranged, "range long, doc_id long")
        shares = [i / inner for i in range(1, inner)]
        again = named.groupBy("range").agg(F.percentile_approx("doc_id", shares, 100 * inner).alias("cuts"))
        found |= {int(b) for r in again.collect() for b in r["cuts"]}
    return found


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 2,
) -> None:
    """Encode every whole text and write the folder ``path`` (see the module's head).

    A null or empty text is the end id alone. Documents are ordered by id, a null
    id first; repeated ids stand together. Ids are integers. An empty table
    writes an empty folder. Other columns are ignored.

    Texts are tokenized once, into a Parquet table inside ``path`` that is removed
    at the end. What the
    driver collects is the vocabulary's frequencies and the bounds of the
    ranges, one for each file, and the ids that fill more than a file. Rows of
    such an id, or without an id, are dealt to as many files as they fill.
    """
    spark = docs.sparkSession
    _tokenized(docs, tokenizer, doc_id, text, end_id).write.option("compression", "zstd").parquet(f"{path}/tokens")
    tokens = spark.read.parquet(f"{path}/tokens")

    ranked = sorted((-r["count"], r["id"]) for r in _frequencies(tokens).collect())
    ids = [i for _, i in ranked]
    spark.createDataFrame([(r, i) for r, i in enumerate(ids)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(ids, default=0) + 1, "<u4")
    rank_of[ids] = np.arange(len(ids))
    ranks = spark.sparkContext.broadcast(rank_of)

    total = tokens.agg(F.sum("n")).first()[0] or 0
    n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_IDS))
    filled = tokens.groupBy("doc_id").agg(F.sum("n").alias("n")).where(F.col("n") > FILE_IDS).collect()
    parts = {r["doc_id"]: min(SPREAD, -(-r["n"] // FILE_IDS)) for r in filled}
    # An id that fills files has a range of its own.
    own = {b for i in parts if i is not None for b in (i, i + 1) if b < 1 << 63}
    bounds = np.array(sorted({*_range_bounds(tokens, n_files), *own} if total else own), np.int64)
    several = {1 + int(np.searchsorted(bounds, i, "right")): k for i, k in parts.items() if i is not None}
    if None in parts:
        several[0] = parts[None]
    limits = spark.sparkContext.broadcast((bounds, several))

    def bucket_of(ids: pa.Array, places: pa.Array) -> np.ndarray:
        """A number that rises with the id, null first, and by place within an id that fills files.

        Bounds at or below the id give its range, so that ranges never overlap.
        """
        cuts, split = limits.value
        ranges = np.where(ids.is_null().to_numpy(False), 0, 1 + np.searchsorted(cuts, ids.fill_null(0).to_numpy(), side="right"))
        found = ranges.astype(np.int64) * SPREAD
        for number, count in split.items():
            found += np.where(ranges == number, places.to_numpy() % count, 0)
        return found

    def compress(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            n = given.column(1).to_numpy()
            raw = given.column(2).to_pylist()
            buckets = pa.array(bucket_of(given.column(0), given.column(3)), pa.int64())
            for low in range(0, len(raw), 64):
                some = slice(low, low + 64)
                values = np.concatenate([_unpack(x, k) for x, k in zip(raw[some], n[some].tolist())])
                controls, datas = encode_values(ranks.value[values], n[some])
                yield pa.RecordBatch.from_arrays(
                    [buckets.slice(low, 64), *given.slice(low, 64).columns[:2], pa.array(controls, pa.binary()), pa.array(datas, pa.binary())],
                    ["bucket", "doc_id", "n", "control", "data"],
                )

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            block = write_block(*[list(x) for x in zip(*[h[1:] for h in held])])
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int64()), pa.array([block], pa.binary())], ["bucket", "block"])

        for given in batches:
            for row in zip(*[c.to_pylist() for c in given.columns]):
                if held and (row[0] != held[0][0] or size + row[2] > BLOCK_IDS):
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += row[2]
        if held:
            yield done()

    def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            buckets = bucket_of(given.column(0), given.column(2))
            found, place = np.unique(buckets, return_inverse=True)
            ids = np.bincount(place, given.column(1).to_numpy(), len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(np.bincount(place, minlength=len(found))), pa.array(ids)], ["bucket", "docs", "ids"]
            )

    coded = tokens.select("doc_id", "n", "ids", "place").mapInArrow(
        compress, "bucket long, doc_id long, n long, control binary, data binary"
    )
    in_order = coded.repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    lines = in_order.mapInArrow(blocks, "bucket long, block binary")
    # A cast to text keeps the bytes; the writer ends each block with a line end.
    lines.select("bucket", F.col("block").cast("string").alias("value")).write.partitionBy("bucket").text(f"{path}/files")

    held = tokens.select("doc_id", "n", "place").mapInArrow(totals, "bucket long, docs long, ids long").groupBy("bucket")
    held = held.agg(F.sum("docs").alias("n_docs"), F.sum("ids").alias("n_ids"))
    _starts(held, "bucket", "n_ids").coalesce(1).write.parquet(f"{path}/manifest")
    # The files hold all that the table did.
    remove_folder(spark, f"{path}/tokens")


def _starts(rows: DataFrame, order: str, size: str, group: int = 4096) -> DataFrame:
    """Adds ``start``: the sum of ``size`` over smaller ``order`` values (unique integers).

    Summed within groups of neighbouring values and over the groups, so that no
    task holds more than ``group`` rows or one row a group.
    """
    grouped = rows.withColumn("__g", F.floor(F.col(order) / group))
    totals = grouped.groupBy("__g").agg(F.sum(size).alias("__t"))
    totals = totals.select("__g", (F.sum("__t").over(Window.orderBy("__g")) - F.col("__t")).alias("__before"))
    inside = F.sum(size).over(Window.partitionBy("__g").orderBy(order)) - F.col(size)
    placed = grouped.withColumn("__inside", inside).join(totals, "__g")
    return placed.withColumn("start", F.col("__before") + F.col("__inside")).drop("__g", "__before", "__inside")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids.

    ``start`` counts the ids of all documents before it, in file order;
    ``ids_crc32`` is over its ids as little-endian unsigned 32-bit integers.
    """
    by_rank = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    id_of = spark.sparkContext.broadcast(np.array([r["id"] for r in by_rank], "<u4"))

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for bucket, content in zip(given.column(0).to_pylist(), given.column(1)):
                before = 0
                for doc_ids, lengths, values in read_blocks(content.as_py()):
                    ids = id_of.value[values]
                    ends = np.cumsum(lengths)
                    raw = ids.tobytes()
                    parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                    arrays = [
                        pa.array(np.full(len(doc_ids), bucket), pa.int64()),
                        # Rows without an id have files of their own.
                        pa.array(doc_ids, pa.int64(), mask=np.full(len(doc_ids), bucket < SPREAD)),
                        pa.array(before + ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    ]
                    if with_ids:
                        arrays.append(pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(arrays, names)
                    before += int(ends[-1])

    names = ["bucket", "doc_id", "__local", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    schema = "bucket long, doc_id long, __local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not by_rank:
        rows = spark.createDataFrame([], schema)
    else:
        prepare_python(spark)
        files = spark.read.format("binaryFile").load(f"{path}/files")
        rows = files.select(F.col("bucket").cast("long"), "content").mapInArrow(decode, schema)
    starts = spark.read.parquet(f"{path}/manifest").select(F.col("bucket").cast("long"), F.col("start").alias("__start"))
    placed = rows.join(starts, "bucket")
    start = (F.col("__start") + F.col("__local")).alias("start")
    return placed.select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written as token files and read back."""
    path = new_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizer("word_bpe_49k.json"))
    return read_token_files(spark, path, with_ids=False)
