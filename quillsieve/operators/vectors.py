"""Vectors: pairs above a cosine, and greedy near-duplicate removal by it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import unit
from ..storage import by_size, materialize
from .greedy import first_independent

THRESHOLD = 0.90
BLOCK = 2048
#: Vectors that all others' angles are taken to.
PIVOTS = 16
#: Texts embedded by one call of an embedding function.
EMBED_BATCH = 64


def embed(rows: DataFrame, text: str, function: Callable[[list[str]], list[list[float]]], name: str = "vector") -> DataFrame:
    """`rows` with the vector of a text column by any function from texts to vectors."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = []
            for i in range(0, len(texts), EMBED_BATCH):
                vectors += [np.asarray(v, dtype=np.float32) for v in function(texts.iloc[i : i + EMBED_BATCH].fillna("").tolist())]
            yield pd.Series(vectors, index=texts.index)

    return rows.withColumn(name, run(F.col(text)))


def _placed(units: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(visit, u, angles, block) and how many pivots: a vector's angles to the pivots, and its block, one of about
    `block` vectors with the same nearest pivot."""
    sample = units.orderBy(F.xxhash64("visit"), "visit").limit(PIVOTS).select("u").collect()
    pivots = np.array([r["u"] for r in sample], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = batch.column("u").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            angles = np.arccos(np.clip(u @ pivots.T, -1, 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * len(pivots)), pa.array(angles.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("visit"), batch.column("u"), lists, pa.array(np.argmin(angles, axis=1).astype(np.int64))], names=["visit", "u", "angles", "near"])

    near = materialize(units.mapInArrow(run, "visit long, u array<double>, angles array<double>, near long"), "angles")
    sizes = near.groupBy("near").agg(F.ceil(F.count("*") / block).alias("parts"))
    placed = near.join(F.broadcast(sizes), "near")  # at most PIVOTS rows
    return placed.select("visit", "u", "angles", (F.col("near") * (1 << 40) + F.pmod(F.xxhash64("visit"), "parts")).alias("block")), len(pivots)


def cosine_pairs(rows: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(earlier, later, cosine) of rows (visit, vector) with a cosine over `threshold`.

    Vectors are dealt into blocks of about `block` by their nearest pivot; each
    pair of blocks is one matrix product in one task, and only pairs over the
    threshold leave it. Angles obey the triangle inequality, so blocks whose angles
    to some pivot lie further apart than the threshold's have no pair and don't
    meet. Zero vectors have no neighbours.
    """
    units = materialize(rows.select("visit", unit(F.col("vector")).alias("u")).where(F.exists("u", lambda x: x != 0)), "units")
    widest = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
    if units.isEmpty():
        return units.select(F.col("visit").alias("earlier"), F.col("visit").alias("later"), F.lit(0.0).alias("cosine"))
    placed, count = _placed(units, block)
    placed = materialize(placed, "placed")
    ranges = placed.groupBy("block").agg(F.array(*[F.min(F.col("angles")[i]) for i in range(count)]).alias("low"), F.array(*[F.max(F.col("angles")[i]) for i in range(count)]).alias("high"))
    ranges = materialize(ranges, "block-ranges")
    a, b = (ranges.select(*[F.col(c).alias(f"{c}_{e}") for c in ("block", "low", "high")]) for e in "ab")
    apart = lambda x, y: F.exists(F.zip_with(x, y, lambda low, high: low - high), lambda gap: gap > widest)
    meet = (F.col("block_a") <= F.col("block_b")) & ~apart("low_a", "high_b") & ~apart("low_b", "high_a")
    met = materialize(a.join(by_size(b, ranges.count(), 64 + 16 * count), meet).select(F.col("block_a").alias("i"), F.col("block_b").alias("j")), "block-pairs")
    vectors = placed.select("block", "visit", "u")
    left = vectors.join(met, F.col("block") == F.col("i")).select("i", "j", F.lit(True).alias("left"), "visit", "u")
    right = vectors.join(met.where("i < j"), F.col("block") == F.col("j")).select("i", "j", F.lit(False).alias("left"), "visit", "u")

    def product(table: pa.Table) -> pa.Table:
        same = table["i"][0].as_py() == table["j"][0].as_py()
        at, left = table["visit"].to_numpy(), table["left"].to_numpy(zero_copy_only=False)
        u = np.stack(table["u"].to_numpy(zero_copy_only=False)).astype(np.float64)
        right = left if same else ~left
        cosine = u[left] @ u[right].T
        x, y = np.nonzero(cosine > threshold)
        x, y, c = at[left][x], at[right][y], cosine[x, y]
        keep = x < y if same else np.ones(len(x), dtype=bool)
        return pa.table({"earlier": np.minimum(x, y)[keep], "later": np.maximum(x, y)[keep], "cosine": c[keep]})

    return left.unionByName(right).groupBy("i", "j").applyInArrow(product, "earlier long, later long, cosine double")


def cosine_dedup(rows: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, kept_id, cosine) of the rows (id, visit, vector) that greedy removal drops.

    Rows are visited in order of `visit`; a row is dropped if its cosine to a kept
    earlier one is over the threshold. kept_id is the most similar of those, the
    earliest of equals.
    """
    pairs = materialize(cosine_pairs(rows, threshold, block), "cosine-pairs")
    decided = first_independent(pairs)
    kept, dropped = (decided.where(F.col("kept") == k).select("node") for k in (True, False))
    near = pairs.join(kept.select(F.col("node").alias("earlier")), "earlier").join(dropped.select(F.col("node").alias("later")), "later")
    best = near.groupBy("later").agg(F.max_by(F.struct("earlier", "cosine"), F.struct("cosine", -F.col("earlier"))).alias("b"))
    ids = rows.select("id", "visit")
    out = best.select("later", F.col("b.earlier").alias("e"), F.col("b.cosine").alias("cosine")).join(ids, F.col("later") == F.col("visit")).drop("visit")
    return out.join(ids.select(F.col("id").alias("kept_id"), "visit"), F.col("e") == F.col("visit")).select("id", "kept_id", "cosine")
