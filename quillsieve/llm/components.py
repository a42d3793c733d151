"""Connected components of a graph given as edges, by alternating stars.

Each round hangs every node's larger neighbours on its smallest known neighbour
(large star), then every node's smaller neighbours likewise (small star), until
all edges point at the component's smallest node. Neighbourhoods are never
gathered: a round is two minima by key and two joins. A graph of few edges stays
in one task, whose joins merge sorted rows: nothing of it passes the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few, materialize

#: Up to so many edges, a round is run by one task: its joins need no shuffle then, and no broadcast.
ONE_TASK_EDGES = 200_000


def _star(edges: DataFrame, rows: int) -> DataFrame:
    """(a, b) with b < a: both directions of star hanging in one step, from `edges` and how many they are.

    Every edge's larger end is hung on the smallest neighbour of its smaller end
    and of itself, which is what a large star followed by a small star do.
    """
    edges = few(edges, rows, ONE_TASK_EDGES)
    # A broadcast of a few rows still costs the driver a job, a thread and a table, four times a round.
    side = (lambda df: df.hint("merge")) if rows <= ONE_TASK_EDGES else (lambda df: df)
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    # large star: for each node, its larger neighbours go to its smallest known node
    up = edges.join(side(low.select(F.col("a").alias("b"), "low")), "b", "left").select("a", F.coalesce("low", "b").alias("b"))
    up = up.distinct()
    # small star: what a node hangs on goes to the smallest of them
    low = up.groupBy("a").agg(F.min("b").alias("low"))
    down = up.join(side(low), "a").select(F.greatest("b", "low").alias("x"), F.col("low").alias("y"), "a")
    hung = down.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a > b")
    return few(hung.unionByName(low.select("a", F.col("low").alias("b"))), rows, ONE_TASK_EDGES).distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): every node of an edge with the smallest node it can reach.

    Edges may come in any direction, repeated, or as loops; null ends are left
    out. Nodes without an edge to another node aren't in the result.
    """
    pairs = edges.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).distinct()
    current = materialize(pairs, "edges")
    seen = None
    while True:
        # Equal marks mean an equal set of edges: the round changed nothing.
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        hung = materialize(_star(current, mark[0]), "edges")
        discard(current)
        current = hung
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def first_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, key, rows) of each component's row to keep, from (doc_id, key, root, component_id)."""
    first = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("root", "doc_id", "key").agg(F.count("*").alias("rows"))
    return first.groupBy("root").agg(F.min(F.struct("doc_id", "key", "rows")).alias("k")).select("k.*")
