"""URL rules by a sort-merge range join.

A host is written with its labels reversed and each followed by a dot
("net.example."), so a host and all its subdomains form one interval of keys.
Rules and URLs are sorted together by key; a sweep keeps the rules whose
interval covers the current key on a stack. Intervals of keys nest or are
apart, so popping the entries that do not cover the key is all it takes.

The key space is cut into ranges of about equal numbers of URLs. A rule goes
to each range that its interval overlaps, so every range is swept on its own.
URLs of one frequent host, and copies of one URL, are told apart by a suffix
of the sort key and may fall into several ranges.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, map_arrow

#: (host, path, action): fixed values of the task.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: So many keys are looked at to choose the ranges' borders; borders only balance the work.
BORDER_SAMPLE, BORDER_CHARS = 20_000, 128
ROWS_PER_RANGE = 20_000


def host_of(url: Column) -> Column:
    """What follows the first ://, up to / ? # or the end; A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    """www.example.net -> net.example.www. (the empty host: the empty key)"""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


class Sweep:
    """Rules come before the URLs of their interval; `best` is the winner for one URL."""

    def __init__(self) -> None:
        self._stack: list[tuple[str, list[tuple[str, str, str]]]] = []

    def move(self, key: str) -> None:
        while self._stack and not key.startswith(self._stack[-1][0]):
            self._stack.pop()

    def push(self, key: str, host: str, path: str, action: str) -> None:
        self.move(key)
        if self._stack and self._stack[-1][0] == key:
            self._stack[-1][1].append((host, path, action))
        else:
            self._stack.append((key, [(host, path, action)]))

    def best(self, key: str, path: str) -> tuple[str, str] | None:
        """(rule, action): the longest host + path; then the longer host; then block before allow."""
        self.move(key)
        found = [(len(h) + len(p), len(h), a == "block", h + p, a) for _, rules in self._stack for h, p, a in rules if path.startswith(p)]
        return max(found)[3:] if found else None


_OUT = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sweep = None, Sweep()
        for batch in batches:
            rows = []
            for at, key, is_url, id_, host, path, action in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if at != current:
                    current, sweep = at, Sweep()
                if is_url:
                    rows.append((id_, host, path, *(sweep.best(key, path) or (None, default))))
                else:
                    sweep.push(key, host, path, action)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    return run


def filter_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url: str = "url", default: str = "allow", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(id_column, host, path, rule, verdict), a row for each row of `pages`.

    `rules` has host, path and action ('block' or 'allow'). A rule fits its host
    and all subdomains where the URL's path starts with the rule's path. The
    longest host + path wins; on equal length the longer host, then block. Without
    a fitting rule, rule is null and the verdict is `default`. A null URL or one
    without :// has empty host and path. Rules with a null or empty host, a null
    path or another action fit nothing. Repeated rows stay repeated; ids may be
    null; other columns are ignored.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_column).cast("long").alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # The suffix keeps interval membership (it only extends the key) and splits equal keys.
    salt = F.concat(F.lit("\x00"), F.col("path"), F.lit("\x00"), F.hex(F.xxhash64("id")))
    urls = urls.withColumn("key", key_of(F.col("host"))).withColumn("sort_key", F.concat("key", salt))
    fit = F.col("action").isin("block", "allow") & (F.col("host") != "") & F.col("path").isNotNull()
    rules = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "action").where(fit).distinct().withColumn("key", key_of(F.col("host")))

    # Any string will do as a border, so long keys are cut.
    keys = urls.select(F.substring("sort_key", 1, BORDER_CHARS).alias("sort_key"), F.xxhash64("sort_key").alias("h"))
    picked = [r[0] for r in keys.orderBy("h", "sort_key").limit(BORDER_SAMPLE).select("sort_key").collect()]
    ranges = max(1, min(urls.count() // rows_per_range + 1, 4096, len(picked)))
    picked.sort(key=lambda s: s.encode())
    borders = [picked[len(picked) * i // ranges].encode() for i in range(1, ranges)]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(borders, k.encode()) for k in batch.column("sort_key").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(batch.column(c) for c in ("key", "sort_key", "id", "host", "path"))], names=["at", "key", "sort_key", "id", "host", "path"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, host, path, action in zip(*(batch.column(c).to_pylist() for c in ("key", "host", "path", "action")), strict=True):
                # U+10FFFF is above every character that may continue the key
                first, last = bisect_right(borders, key.encode()), bisect_right(borders, key.encode() + b"\xf4\x8f\xbf\xbf")
                rows += [(at, key, host, path, action) for at in range(first, last + 1)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.string()] * 4], strict=True)], names=["at", "key", "host", "path", "action"])

    left = urls.transform(map_arrow, placed, "at int, key string, sort_key string, id long, host string, path string").select("at", "key", "sort_key", F.lit(True).alias("is_url"), "id", "host", "path", F.lit(None).cast("string").alias("action"))
    right = rules.transform(map_arrow, spread, "at int, key string, host string, path string, action string").select("at", "key", F.col("key").alias("sort_key"), F.lit(False).alias("is_url"), F.lit(None).cast("long").alias("id"), "host", "path", "action")
    events = left.unionByName(right).repartitionById(ranges, F.col("at")).sortWithinPartitions("at", "sort_key", "is_url")
    out = events.select("at", "key", "is_url", "id", "host", "path", "action").transform(map_arrow, _sweep(default), "id long, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_column)


def rules_table(spark, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "host string, path string, action string")
