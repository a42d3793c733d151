"""Ranking and vector expressions. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Okapi BM25 parameters; fixed values.
K1, B = 1.5, 0.75


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def term_weight(idf_: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    """What one query term adds to a document's score; without a mean length no normalisation."""
    norm = F.when(mean_length > 0, K1 * (1 - B + B * length / F.nullif(mean_length, F.lit(0.0)))).otherwise(F.lit(K1))
    return idf_ * tf * (K1 + 1) / (tf + norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector scaled to length 1; the zero vector stays."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))
