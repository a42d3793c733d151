"""Intermediate tables in the folder all machines share."""

from __future__ import annotations

import atexit
import logging
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
#: Largest estimated size of a join side that may be broadcast.
BROADCAST_LIMIT = 64 << 20

_written: dict[str, SparkSession] = {}
_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder every machine sees: `spark.checkpoint.dir` of the session.

    Where the setting is absent, a local session (tests, one machine) gets a
    temporary folder; on a cluster that would lose data, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="quillsieve-"))
    return f"file://{_own_folder[0]}"


def _at(spark: SparkSession, path: str):
    """(file system, Hadoop path), also after the session has stopped."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    settings = context._jsc.hadoopConfiguration() if context._jsc is not None else context._jvm.org.apache.hadoop.conf.Configuration()
    return target.getFileSystem(settings), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _at(spark, path)
    return system.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system it is."""
    system, target = _at(spark, path)
    system.delete(target, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a path; fails if the file system says it didn't."""
    system, old = _at(spark, source)
    new = _at(spark, target)[1]
    if new.getParent() is not None:
        system.mkdirs(new.getParent())
    if not system.rename(old, new):
        raise OSError(f"can't move {source} to {target}")


def _forget(paths: list[str]) -> None:
    for path in paths:
        if spark := _written.pop(path, None):
            try:
                delete(spark, path)
            except Exception as error:  # noqa: BLE001 - one that can't go must not keep the others
                log.warning("intermediate table %s stays: %s", path, error)


@atexit.register
def release() -> None:
    """Delete the intermediate tables written so far (also runs at exit)."""
    _forget(list(_written))
    while _own_folder:
        shutil.rmtree(_own_folder.pop(), ignore_errors=True)


@contextmanager
def scope() -> Iterator[None]:
    """Intermediate tables written inside are deleted at its end; what reads them must be done by then."""
    before = set(_written)
    try:
        yield
    finally:
        _forget([p for p in _written if p not in before])


def discard(df: DataFrame) -> None:
    """Delete the table that `materialize` returned as `df`: nothing may read it any more."""
    if path := getattr(df, "_written_at", None):
        _forget([path])


def reserve(spark: SparkSession, label: str) -> str:
    """A path in the shared folder for an intermediate table; it is deleted like those of `materialize`."""
    path = f"{shared_folder(spark)}/quillsieve/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    Cuts the lineage at files that outlive any executor. The result has the
    rows of one evaluation, so later reads of it agree with each other.
    """
    spark = df.sparkSession
    path = reserve(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def by_size(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """`df` with a broadcast hint if rows x row_bytes is below the limit, else as it is.

    `rows` must be a count of `df`; beyond the limit Spark joins by shuffle.
    """
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT else df
