"""Sequential greedy selection as rounds over whole tables.

A scan that keeps a row unless it conflicts with a kept earlier one gives the
lexicographically first maximal independent set. Rounds give the same: a row
without an undecided earlier neighbour is kept, and rows with a kept earlier
neighbour are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize


def first_independent(edges: DataFrame) -> DataFrame:
    """(node, kept) for the ends of `edges` (earlier, later); other nodes are all kept."""
    open_ = materialize(edges.select("earlier", "later").distinct(), "greedy-edges")
    decided = None
    while not open_.isEmpty():
        # Kept: an earlier end that is nowhere the later one.
        kept = open_.select(F.col("earlier").alias("node")).distinct().join(open_.select(F.col("later").alias("node")), "node", "left_anti")
        kept = materialize(kept, "greedy-kept")
        dropped = materialize(open_.join(kept, F.col("earlier") == F.col("node"), "left_semi").select(F.col("later").alias("node")).distinct(), "greedy-dropped")
        rest = open_.join(dropped, F.col("later") == F.col("node"), "left_anti")
        # A node whose earlier neighbours are all dropped is left without edges to them, and so is kept.
        freed = rest.join(dropped, F.col("earlier") == F.col("node"), "left_semi").select(F.col("later").alias("node"))
        rest = materialize(rest.join(dropped, F.col("earlier") == F.col("node"), "left_anti").join(kept, F.col("earlier") == F.col("node"), "left_anti"), "greedy-edges")
        ends = rest.select(F.col("earlier").alias("node")).unionByName(rest.select(F.col("later").alias("node")))
        freed = freed.distinct().join(ends, "node", "left_anti")
        now = kept.unionByName(freed).withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False)))
        decided = now if decided is None else decided.unionByName(now)
        open_ = rest
    if decided is None:
        return open_.select(F.col("earlier").alias("node"), F.lit(True).alias("kept"))
    # A freed node may also have been listed as kept later; one decision a node.
    return materialize(decided.groupBy("node").agg(F.bool_and("kept").alias("kept")), "greedy")


def first_by_keys(rows: DataFrame, order: str, keys: list[Column]) -> DataFrame:
    """`rows` with `accepted`: a row is rejected if an accepted earlier row has one of its keys.

    Rejected rows claim no key, and a null key claims and meets nothing. Each round
    takes minima by key, so groups of any size are combined before they move.
    """
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    open_ = materialize(rows.select(F.col(order).alias("_o"), *[k.alias(n) for n, k in named.items()]), "keyed")
    done = None
    while not open_.isEmpty():
        ok, best = F.lit(True), open_
        for n in named:
            least = open_.where(F.col(n).isNotNull()).groupBy(n).agg(F.min("_o").alias(f"_min{n}"))
            best = best.join(least, n, "left")
            ok = ok & (F.col(n).isNull() | (F.col("_o") == F.col(f"_min{n}")))
        judged = materialize(best.select("_o", *named, ok.alias("_ok")), "judged")
        discard(open_)
        taken, rest = judged.where("_ok"), judged.where("NOT _ok")
        for n in named:
            rest = rest.join(taken.where(F.col(n).isNotNull()).select(n).distinct(), n, "left_anti")
        done = taken.select("_o") if done is None else done.unionByName(taken.select("_o"))
        open_ = materialize(rest.select("_o", *named), "keyed")
    discard(open_)
    if done is None:
        return rows.withColumn("accepted", F.lit(True))
    out = rows.join(done.withColumn("_ok", F.lit(True)), F.col(order) == F.col("_o"), "left")
    return out.withColumn("accepted", F.coalesce("_ok", F.lit(False))).drop("_o", "_ok")
