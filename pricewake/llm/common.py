"""What the operators of this package share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may go without; a cluster without the setting raises,
    because a machine-local folder would lose rows there.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    named = named or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="pricewake-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session wrote and no frame in use reads."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def cut(frame: DataFrame) -> DataFrame:
    """The frame computed once and kept in the shared folder, its lineage cut."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(frame.sparkSession))
    return frame.checkpoint()


def columns_without(frame: DataFrame, names: Iterable[str]) -> list[Column]:
    """Columns of the frame but those that bear one of the names, as Spark tells names apart."""
    exact = frame.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    fold = str if exact else str.lower
    taken = {fold(n) for n in names}
    return [quoted(c) for c in frame.columns if fold(c) not in taken]


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(column: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def crc_remainder(id_column: str, by: int) -> Column:
    """crc32 of the id written as text, modulo ``by``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % by, F.lit(-1))


def join_split(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on one column whose hot values adaptive execution can split.

    The second key makes Spark exchange both sides for this join alone, even
    where one is already dealt by the key; only then may a hot share be split.
    """
    guard = f"__{key}_hash"
    l, r = (x.withColumn(guard, F.xxhash64(key)) for x in (left, right))
    return l.join(r, [key, guard], how).drop(guard)


# So many hot keys, some 30 MB, are broadcast; more are joined by shuffle.
HOT_KEYS = 1_000_000


def with_blocks(
    rows: DataFrame, key: str, member: str, size: int, counted: DataFrame | None = None
) -> DataFrame:
    """Rows of each key in blocks, so that every two members of a key meet once.

    Adds ``block_a <= block_b`` and ``side``: a key of up to ``size`` rows is
    one block (0, 0). A larger one is cut into blocks of about that size by the
    hash of ``member``, the same in every run and retry; each row appears once
    for every pair of blocks that contains its own, and ``side`` says which of
    the two it is (0 or 1; 0 in a block's own pair). No task holds more than two
    blocks of a key, and no pair is written out.

    ``counted`` may give the keys of the rows from a smaller frame. The keys
    over ``size`` are few; counting them first spares a shuffle of all rows.
    """
    counts = (rows if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hot = cut(counts.where(F.col("__n") > size).select(key, F.ceil(F.col("__n") / size).cast("int").alias("__g")))
    if hot.count() <= HOT_KEYS:
        dealt = rows.join(F.broadcast(hot), key, "left")
    else:
        dealt = join_split(rows, hot, key, "left")
    dealt = dealt.withColumn("__g", F.coalesce("__g", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(7), member), F.col("__g")).cast("int")
    dealt = dealt.withColumn("__own", F.when(F.col("__g") > 1, own).otherwise(0))
    other = F.explode(F.sequence(F.lit(0), F.col("__g") - 1)).alias("__other")
    return dealt.select("*", other).select(
        *rows.columns,
        F.least("__own", "__other").alias("block_a"),
        F.greatest("__own", "__other").alias("block_b"),
        (F.col("__own") > F.col("__other")).cast("int").alias("side"),
    )


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from sorted batches; holds one group and one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch.column(key).to_numpy(zero_copy_only=False)
            change[1:] |= column[1:] != column[:-1]
            if held:
                change[0] |= column[0] != held[-1].column(key)[-1].as_py()
        starts = np.flatnonzero(change)
        begin = 0
        for at in starts:
            if at > begin:
                held.append(batch.slice(begin, at - begin))
            if held:
                yield pa.Table.from_batches(held)
            held, begin = [], at
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def fixed_width(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """Binary values of one width as rows of a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index linked to each of n indexes, by repeated halving."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if np.array_equal(before, root):
            return root


_held: dict[tuple[str, str], object] = {}


def worker_cache(owner: str, key: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: one thing, of the operator that asked last.

    Workers outlive the operator they were started for. The first task of
    another one that runs in a worker frees what the one before it had kept.
    """
    if (owner, key) not in _held:
        free_worker_cache()
        _held[owner, key] = make()
    return _held[owner, key]


def free_worker_cache() -> None:
    """Give back what the worker keeps, before a step that needs none of it.

    Things may refer to themselves; those go with the next collection only, which would come late.
    """
    if _held:
        _held.clear()
        gc.collect()


_shipped: set[str] = set()


def prepare_python(spark: SparkSession, rows: int = 512) -> None:
    """Make this package importable in the session's Python workers, and their batches small.

    Rows of text come to Python few at a time, as one may be very long. The
    package goes along as a zip file, as executors may not have it installed.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="pricewake-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(rows))


# Smoothing of the count of errors, as a multiple of the curve's own slope.
_SHARPER = 8


def _fewest_errors(x: np.ndarray, y: np.ndarray, weight: np.ndarray, slope: float) -> float | None:
    """The x from which on calling rows 1 errs least, by weight; None if calling all of them the same does."""
    places, width = np.linspace(x.min(), x.max(), 1001, retstep=True)
    sign = np.where(y > 0.5, 1.0, -1.0)
    # Steps are smoothed, so that single rows count little and the last bits of x not at all.
    wrong = np.array([weight @ (1 / (1 + np.exp(np.clip(_SHARPER * slope * sign * (x - t), -500, 500)))) for t in places])
    at = int(wrong.argmin())
    if at in (0, len(places) - 1):
        return None
    below, least, above = wrong[at - 1 : at + 2]
    bend = below - 2 * least + above
    return float(places[at] + (width * 0.5 * (below - above) / bend if bend > 0 else 0.0))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, middle: bool = True) -> tuple[float, float]:
    """Slope and offset by Newton steps, drawn a little towards 0 so that separated classes end.

    ``middle`` then moves the curve to cross one half where fewest rows, by weight,
    lie on the wrong side. Far rows pull the likeliest curve's middle away from there
    where a label comes in several bunches.
    """
    beta = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    ridge = np.diag([1e-4, 1e-6]) * max(weight.sum(), 1e-9)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - ridge @ beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(curve, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    slope, offset = float(beta[0]), float(beta[1])
    if middle and slope > 0 and len(set(x)) > 1:
        place = _fewest_errors(x, y, weight, slope)
        offset = offset if place is None else -slope * place
    return slope, offset


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table of one or more complete groups, place of each group's first row) from sorted batches.

    Holds the rows of one batch and of the group that runs over its end.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    starts: list[int] = []
    size = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = tuple(c[0] for c in columns) != last
        last = tuple(c[-1] for c in columns)
        at = np.flatnonzero(change)
        if len(at):
            # Everything before the last change is complete.
            final = int(at[-1])
            starts += (size + at[:-1]).tolist()
            if size + final:
                done = [*held, batch.slice(0, final)] if final else held
                yield pa.Table.from_batches(done), np.array(starts)
            held, starts, size = [batch.slice(final)], [0], n - final
        else:
            held.append(batch)
            size += n
    if held:
        yield pa.Table.from_batches(held), np.array(starts)
