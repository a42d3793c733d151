"""Mixing to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). The cells' weights are
raked: scaled to the target share of every source, then of every language, then
of every topic, again and again until all three margins hold. A document's
probability is its cell's weight over the cell's tokens. Either it is scaled so
that the largest is 1, or so that a given share of all tokens is expected. In
that case no cell can give more than it has: a scarce one is kept whole, what
its values lack goes to the other values in proportion, and the raking makes up
for it in the other cells. No document is sampled twice.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, by_size, few, materialize

DIMENSIONS = ("source", "lang", "topic")
#: Default targets are the shares of tokens raised to these powers and scaled to 1.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS = 40
#: So many rounds run between two looks at how far the margins are off.
ROUNDS_PER_PLAN = 5
TOLERANCE = 1e-9
#: Most cells for which a margin's sums are taken by window.
WINDOW_MOST = 1_000_000
#: Most cells that one task takes them all of.
ONE_TASK_CELLS = 100_000
#: Values out of reach are scaled up in every round; this keeps them finite.
_RAW_MOST = 1e100
SEED = "mix-1"


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse kind of text by the marks it holds, where no topic column is given."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("@")), "contact").when(F.length(text) < 1000, "short").otherwise("prose")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def default_targets(cells: DataFrame, powers: dict[str, float] | None = None) -> DataFrame:
    """(dimension, value, share) from the cells' own token shares."""
    out = None
    for name, power in (powers or POWERS).items():
        own = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
        own = own.select(F.lit(name).alias("dimension"), "value", F.pow(F.col("t").cast("double"), F.lit(power)).alias("share"))
        out = own if out is None else out.unionByName(own)
    return out


def _within_reach(margin: DataFrame, name: str) -> DataFrame:
    """(name, share) of (name, share, cap): shares summing to 1 and none above its cap, the others in proportion."""
    margin, scale = materialize(margin, "margin-caps"), 1.0
    while True:
        full = F.col("share") * F.lit(scale) >= F.col("cap")
        sums = margin.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("share")))).first()
        # The scale only grows: each look fills further values or is the last.
        grown = max(scale, (1 - (sums[0] or 0.0)) / sums[1]) if sums[1] else scale
        if grown <= scale * (1 + 1e-12):
            return margin.select(name, F.least("cap", F.col("share") * F.lit(scale)).alias("share"))
        scale = grown


def rake(cells: DataFrame, targets: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE, window_most: int = WINDOW_MOST, sample_share: float | None = None) -> DataFrame:
    """(source, lang, topic, tokens, weight): weights with the targets' margins, summing to 1.

    Targets for values that no cell with tokens has are left out, and so are the
    tokens of values without a target (weight 0); shares are scaled to 1 over
    what is left. Stops when no margin is off by more than `tolerance`.

    Up to `window_most` cells, rounds are window sums chained in one plan; with
    more, a margin's sums are aggregated and joined, so that no task gets all
    cells of a value. If margins are off by more than `tolerance` in the end, a warning
    says by how much.

    With `sample_share`, no weight is above the cell's share of the tokens over
    `sample_share`; targets that this leaves out of reach are met as far as it goes.
    """
    current, wanted = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double")), {}
    for name in DIMENSIONS:
        wanted[name] = targets.where((F.col("dimension") == name) & (F.col("share") > 0)).select(F.col("value").alias(name), "share")
        current = current.join(wanted[name].select(name), name, "left_semi")
    current = materialize(current, "cells")
    total, tokens = current.agg(F.count("*"), F.sum("tokens")).first()
    margins, sizes, bounded = {}, {}, sample_share is not None
    # Raking scales `raw`; the weight is what of it the cell can give.
    most = F.col("tokens") / F.lit(sample_share * (tokens or 1)) if bounded else None
    if bounded:
        current = current.withColumnRenamed("weight", "raw")
    held_of = F.sum(F.least("raw", most)) if bounded else F.sum("weight")
    raw = "raw" if bounded else "weight"
    for name in DIMENSIONS:
        own = wanted[name].join(current.select(name).distinct(), name, "left_semi")
        whole = own.agg(F.sum("share").alias("whole"))
        own = own.crossJoin(F.broadcast(whole)).select(name, (F.col("share") / F.col("whole")).alias("share"))  # one row is broadcast
        if bounded:
            own = _within_reach(own.join(current.groupBy(name).agg(F.sum(most).alias("cap")), name), name)
        margins[name] = materialize(own.withColumnRenamed("share", f"{name}_share"), "margin")
        sizes[name] = margins[name].count()
        current = current.join(by_size(margins[name], sizes[name], 64), name)
    columns = current.columns
    # Few cells stay in one partition, where no window needs a shuffle.
    current = few(materialize(current, "cells"), total, ONE_TASK_CELLS)
    done, off = 0, math.inf
    while done < rounds:
        for _ in range(min(ROUNDS_PER_PLAN, rounds - done)):
            for name in DIMENSIONS:
                if total <= window_most:
                    held = held_of.over(Window.partitionBy(name))
                    current = current.withColumn(raw, F.least(F.col(raw) * F.col(f"{name}_share") / held, F.lit(_RAW_MOST)))
                else:
                    sums = materialize(current.groupBy(name).agg(held_of.alias("held")), "held")
                    current = current.join(by_size(sums, sizes[name], 64), name).withColumn(raw, F.least(F.col(raw) * F.col(f"{name}_share") / F.col("held"), F.lit(_RAW_MOST)))
                    current = materialize(current.select(*columns), "cells")
            done += 1
        current = few(materialize(current, "cells"), total, ONE_TASK_CELLS)
        off = 0.0
        for name in DIMENSIONS:
            worst = current.groupBy(name).agg((held_of / F.max(f"{name}_share") - 1).alias("off")).agg(F.max(F.abs("off"))).first()[0]
            off = max(off, worst or 0.0)
        if off <= tolerance:
            break
    if off > tolerance and not bounded:
        warnings.warn(f"raking stopped after {done} rounds with margins off by up to {off:.2g} of their targets", RuntimeWarning, stacklevel=2)
    return current.select(*DIMENSIONS, "tokens", (F.least("raw", most) if bounded else F.col("weight")).alias("weight"))


def mix(docs: DataFrame, targets: DataFrame | None = None, topic: Column | None = None, seed: str = SEED, rounds: int = ROUNDS, sample_share: float | None = None) -> DataFrame:
    """(row, source, lang, topic, n_tokens, probability, sampled), a row for each row of
    `docs`; `row` holds all its columns.

    Null source, language or topic count as ''. A document of a cell without
    weight, or without tokens in its cell, has probability 0. Whether a document
    is sampled depends on its id and cell alone, so repeated rows share their
    fate; an empty table gives no rows.

    Without `sample_share` the largest probability is 1, so the cell that is
    scarcest for its weight sets the size of the sample. With it (above 0, at most
    1), that share of the tokens of all cells with weight is expected in the sample,
    and cells too scarce for their weight are kept whole.
    """
    if sample_share is not None and not 0 < sample_share <= 1:
        raise ValueError("sample_share must be above 0 and at most 1")
    topic = topic_of(F.col("text")) if topic is None else topic
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")],
        F.coalesce(topic.cast("string"), F.lit("")).alias("topic"),
        tokens_of(F.col("text")).alias("n_tokens"),
    )
    cells = materialize(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    count = cells.count()
    # Few cells are read by one task: targets, margins and caps need no shuffle, whose tasks the driver keeps account of.
    cells = few(cells, count, ONE_TASK_CELLS)
    raked = rake(cells, default_targets(cells) if targets is None else targets, rounds, sample_share=sample_share)
    ratio = raked.withColumn("ratio", F.col("weight") / F.col("tokens"))
    if sample_share is None:
        top = ratio.agg(F.max("ratio").alias("top"))
    else:
        top = ratio.agg((1 / (F.lit(sample_share) * F.sum("tokens"))).alias("top"))
    chances = ratio.crossJoin(F.broadcast(top)).select(*DIMENSIONS, F.round(F.least(F.col("ratio") / F.col("top"), F.lit(1.0)), 9).alias("probability"))  # one row is broadcast
    out = rows.join(by_size(chances, count, 160), list(DIMENSIONS), "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    return out.select("row", *DIMENSIONS, "n_tokens", "probability", (uniform(F.col("row.doc_id"), seed) < F.col("probability")).alias("sampled"))
