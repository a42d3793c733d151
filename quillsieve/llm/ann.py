"""Nearest neighbours by inverted lists and an adaptive dimension scan.

Vectors are dealt to the list of their nearest centroid. A query first scans its
own list; its k-th best distance there is carried as the bound for the further
lists it probes, nearest centroid first in number. A list whose vectors must all
be farther (by its radius and the triangle inequality) is skipped. Inside a
list, vectors are rotated by one random orthogonal matrix and stored column
block by column block. After each block, the partial distance of a candidate,
scaled up to all dimensions, is tested against the bound: for a random rotation
it exceeds the true distance by a factor over (1 + EPSILON / sqrt(d)) with small
probability only, so a candidate beyond that is abandoned. Survivors get their
exact distance, in double precision, from the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_size, map_arrow, materialize

#: There are half as many lists as the root of the number of vectors; each has so many vectors in the sample that
#: centroids are fitted on, which has FIT_SAMPLE at most. Every vector is indexed.
FIT_PER_LIST = 64
FIT_SAMPLE = 1 << 16
#: Share of the lists that a query probes.
PROBE_SHARE = 0.7
EPSILON = 1.5
COLUMNS_PER_BLOCK = 8
#: Most vectors, and most queries, that one call of the scan gets.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024


def rotation(dimension: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def nearest_centroids(x: np.ndarray, centers: np.ndarray, count: int = 1) -> np.ndarray:
    """For each vector the numbers of its `count` nearest centroids, nearest first."""
    weights, out = (centers**2).sum(1), []
    for at in range(0, len(x), 1024):
        away = weights - 2 * x[at : at + 1024] @ centers.T
        out.append(np.argmin(away, axis=1)[:, None] if count == 1 else np.argsort(away, axis=1, kind="stable")[:, :count])
    return np.concatenate(out) if out else np.empty((0, count), dtype=np.int64)


def centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means on the sample; a centroid that loses all its vectors stays where it was."""
    out = sample[np.random.default_rng(seed).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = nearest_centroids(sample, out)[:, 0]
        sums = np.zeros_like(out)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(out))
        out[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return out


def scan(query: np.ndarray, columns: np.ndarray, threshold: float, k: int, epsilon: float = EPSILON, width: int = COLUMNS_PER_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that survive, and their squared distances, both for rotated vectors.

    `columns` has a row for each dimension. `threshold` is a squared distance
    beyond which a candidate is of no use.
    """
    dimension = len(columns)
    alive, partial = None, np.zeros(columns.shape[1], dtype=columns.dtype)
    for start in range(0, dimension, width):
        end = min(start + width, dimension)
        part = columns[start:end] if alive is None else columns[start:end, alive]
        partial = partial + ((part - query[start:end, None]) ** 2).sum(axis=0)
        if end == dimension or math.isinf(threshold):
            continue
        keep = np.flatnonzero(partial * (dimension / end) <= threshold * (1 + epsilon / math.sqrt(end)) ** 2)
        if len(keep) < len(partial):
            alive = keep if alive is None else alive[keep]
            partial = partial[keep]
            if not len(keep):
                break
    return np.arange(columns.shape[1]) if alive is None else alive, partial


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _compact(x: np.ndarray) -> np.ndarray:
    """Single precision, unless squares of the numbers would leave its range."""
    return x.astype(np.float32) if np.abs(x).max(initial=0) < 1e15 else x


_HITS = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_HITS_DDL = "query long, query_id long, row long, vec_id long, score double"


def _search_block(dimension: int, k: int, epsilon: float):
    """Vectors (row, vec_id, vector) and queries (row, vec_id, vector, bound) to each query's k nearest of these vectors."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            turn = rotation(dimension)
            rows, ids, vectors = left["row"].to_numpy(), left["vec_id"].to_numpy(), _matrix(left["vector"], dimension)
            columns = np.ascontiguousarray((_compact(vectors) @ turn).T)
            asked = _matrix(right["vector"], dimension)
            turned = _compact(asked) @ turn
            head = min(len(ids), 8 * k)
            for i, (q, q_id, bound) in enumerate(zip(*(right[c].to_pylist() for c in ("row", "vec_id", "bound")), strict=True)):
                if bound is None:  # the query's own list: the first few candidates give the bound for the rest
                    first = np.sort(((columns[:, :head] - turned[i][:, None]) ** 2).sum(axis=0))
                    own = int((rows[:head] == q).any())
                    limit = float(first[k - 1 + own]) if head >= k + own else math.inf
                else:
                    limit = bound**2
                at, near = scan(turned[i], columns, limit * (1 + 1e-4) + 1e-9, k, epsilon)
                at, near = at[rows[at] != q], near[rows[at] != q]
                if len(at) > k:
                    kth = float(np.partition(near, k - 1)[k - 1])
                    at = at[near <= kth * (1 + 1e-4) + 1e-9]
                distance = np.sqrt(((vectors[at] - asked[i]) ** 2).sum(axis=1))
                best = np.lexsort((rows[at], ids[at], distance))[:k]
                out.append((np.full(len(best), q), np.full(len(best), q_id), rows[at][best], ids[at][best], distance[best]))
        columns_out = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0)] * len(_HITS)
        return pa.Table.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns_out, _HITS, strict=True)], schema=_HITS)

    return run


def _scanned(index: DataFrame, asked: DataFrame, lists: int, dimension: int, k: int, epsilon: float) -> DataFrame:
    """Hits of queries (list, row, vec_id, vector, bound) in their lists of the index.

    A list with many vectors, or with many queries, is cut into blocks; each pair of blocks is one call.
    """
    blocks = lambda df, name, most: df.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    shape = by_size(blocks(index, "v_blocks", BLOCK_VECTORS).join(blocks(asked, "q_blocks", BLOCK_QUERIES), "list"), lists, 32)
    mine = lambda name: F.pmod(F.xxhash64("row", "list"), F.col(name)).cast("int")
    every_of = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = index.join(shape, "list").select("list", mine("v_blocks").alias("v"), every_of("q_blocks").alias("q"), "row", "vec_id", "vector")
    right = asked.join(shape, "list").select("list", mine("q_blocks").alias("q"), every_of("v_blocks").alias("v"), "row", "vec_id", "vector", "bound")
    return left.groupBy("list", "v", "q").cogroup(right.groupBy("list", "v", "q")).applyInArrow(_search_block(dimension, k, epsilon), _HITS_DDL)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("score", "vec_id", "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", vector: str = "embedding", probe_share: float = PROBE_SHARE, lists: int | None = None, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with id divisible by `every`,
    the k nearest rows found, by Euclidean distance; ties to the smaller vec_id.

    Every row but the query's own is a candidate, also one that repeats its id or
    vector; rows that repeat a query's id are queries of their own under that id.
    Vectors that are null or all zero, hold null or non-finite components, or are
    not of the table's most common length take no part, nor do rows without id.
    An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(sound)
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not common:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, total = common[0]
    rows = rows.where(F.size("vector") == dimension)
    lists = max(2, round(math.sqrt(total) / 2)) if lists is None else lists
    sample = rows.select("vector", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(min(FIT_SAMPLE, FIT_PER_LIST * lists)).toArrow()
    centers = centroids(_compact(_matrix(sample["vector"], dimension)), min(lists, sample.num_rows))
    probes = max(1, math.ceil(probe_share * len(centers)))

    def dealt(count: int, skip: int = 0):
        """Each vector with its `count` nearest lists but the first `skip`, and how far their centroids are."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column("vector"), dimension)
                near = nearest_centroids(x.astype(centers.dtype), centers, count)[:, skip:]
                away = np.sqrt(((x[:, None, :] - centers[near]) ** 2).sum(axis=2)) if near.shape[1] <= 4 else np.stack([np.sqrt(((v - centers[n]) ** 2).sum(axis=1)) for v, n in zip(x, near, strict=True)])
                at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                columns = [pa.array(near.ravel().astype(np.int32)), pa.array(away.ravel().astype(np.float64)), *(batch.column(c).take(at) for c in ("row", "vec_id", "vector"))]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "away", "row", "vec_id", "vector"])

        return run

    ddl = "list int, away double, row long, vec_id long, vector array<double>"
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector")
    index = materialize(numbered.transform(map_arrow, dealt(1), ddl), "ann-lists")
    queries = materialize(index.where(F.col("vec_id") % every == 0), "ann-queries")
    near = _best(_scanned(index, queries.withColumn("bound", F.lit(None).cast("double")), len(centers), dimension, k, epsilon), k)
    near = materialize(near.drop("rank"), "ann-near")
    if probes == 1:
        return _best(near, k).select("query_id", "rank", "vec_id", "score")
    # One row a query and one a list; beyond a checked size they meet by shuffle.
    bounds = near.groupBy("query").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(F.lit(math.inf)).alias("bound"))
    radii = index.groupBy("list").agg(F.max("away").alias("radius"))
    asked = queries.select("row", "vec_id", "vector").transform(map_arrow, dealt(probes, 1), ddl)
    asked = asked.join(by_size(bounds, queries.count(), 32), F.col("row") == F.col("query"), "left").join(by_size(radii, len(centers), 24), "list")
    asked = asked.withColumn("bound", F.coalesce("bound", F.lit(math.inf))).where(F.col("away") - F.col("radius") <= F.col("bound") * (1 + 1e-5))
    asked = materialize(asked.select("list", "row", "vec_id", "vector", "bound"), "ann-probes")
    hits = near.unionByName(_scanned(index, asked, len(centers), dimension, k, epsilon))
    return _best(hits, k).select("query_id", "rank", "vec_id", "score")
