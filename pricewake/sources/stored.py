"""Tables written once to a shared folder and read as often as needed."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def store(frame: DataFrame, path: str) -> DataFrame:
    """The frame written to ``path`` as Parquet and read back: computed once, lineage cut."""
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


# Scratch folders not removed yet, and the sessions they belong to.
_left: dict[str, SparkSession] = {}


@atexit.register
def _remove_left() -> None:
    for path, spark in list(_left.items()):
        remove_folder(spark, path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """New path under a folder that all executors share, for ``remove_folder`` after use.

    That is ``spark.checkpoint.dir``. A local session without it takes the
    warehouse; a cluster raises, as its warehouse may be a folder of the driver's.
    What is left when the program ends is removed then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def _place(spark: SparkSession, path: str):
    """The path and its file system, which need not be a local one."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(context._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete ``path``; nothing happens once the session has stopped."""
    _left.pop(path, None)
    if spark.sparkContext._jsc is not None:
        target, files = _place(spark, path)
        files.delete(target, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    target, files = _place(spark, path)
    return [x.getPath().getName() for x in files.listStatus(target)] if files.exists(target) else []


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files in a folder; 0 if it does not exist."""
    target, files = _place(spark, path)
    return files.getContentSummary(target).getLength() if files.exists(target) else 0


def read_line(spark: SparkSession, path: str) -> str | None:
    """The text of a small file of one line; None if it does not exist."""
    target, files = _place(spark, path)
    if not files.exists(target):
        return None
    return spark.read.text(path).first()[0]


def switch_line(spark: SparkSession, path: str, line: str) -> None:
    """Replace a small file of one line in one step: readers see the old text or the new one."""
    target, _ = _place(spark, path)
    java = spark.sparkContext._jvm
    context = java.org.apache.hadoop.fs.FileContext.getFileContext(
        target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    draft = java.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    written = draft.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(draft)
    written.write(bytearray(line.encode()))
    written.close()
    options = spark.sparkContext._gateway.new_array(java.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = java.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, target, options)
