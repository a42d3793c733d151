"""Helpers shared by the training-data operators.

Intermediate tables and joins by checked size come from the library's storage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import by_size, discard, materialize

__all__ = ["WORD_PATTERN", "as_bytes", "by_size", "discard", "few", "join_dealt", "lower_ascii", "map_arrow", "materialize", "slices", "table"]

#: Keys with more rows than this are hot: they are joined without a shuffle of their rows.
HOT_ROWS = 10_000
#: Rows that Spark packs into one Arrow batch for a worker, where the session doesn't say otherwise. Spark's own
#: default of 10,000 whole texts takes up to 64 MB on either side, for each task.
ARROW_ROWS = 1024
_ARROW_SETTING, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"

#: White space that separates words: U+0020 and U+0009..U+000D, as a Java class.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`; any path Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, to bound a worker's memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """`df.mapInArrow`, with small batches: sets the session's batch size to ARROW_ROWS if it is Spark's default."""
    settings = df.sparkSession.conf
    if settings.get(_ARROW_SETTING, _ARROW_DEFAULT) == _ARROW_DEFAULT:
        settings.set(_ARROW_SETTING, str(ARROW_ROWS))
    return df.mapInArrow(run, ddl)


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def few(df: DataFrame, rows: int, most: int) -> DataFrame:
    """`df` in one partition if its `rows` (a count of it) are at most `most`: what follows needs no shuffle then."""
    return df.coalesce(1) if rows <= most else df


def join_dealt(rows: DataFrame, side: DataFrame, keys: list[str], row_bytes: int, count: str = "n", how: str = "inner") -> DataFrame:
    """`rows` joined with `side`, which has one row for each key and in `count` how many of `rows` have it.

    A small side is broadcast. Beyond that, only hot keys are: there are at most
    rows / HOT_ROWS of them, which is checked too; all other rows meet by shuffle.
    `rows` is evaluated twice then, so it should be a written table.
    """
    total = side.count()
    if by_size(side, total, row_bytes) is not side:
        return rows.join(by_size(side, total, row_bytes), keys, how)
    hot = side.where(F.col(count) > HOT_ROWS)
    many = hot.count()
    flagged = rows.join(by_size(hot.select(*keys), many, row_bytes), keys, "left_semi")
    rest = rows.join(by_size(hot.select(*keys), many, row_bytes), keys, "left_anti")
    return flagged.join(by_size(hot, many, row_bytes), keys).unionByName(rest.join(side.where(F.col(count) <= HOT_ROWS), keys, how))
