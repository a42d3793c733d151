"""Corpus filters, with one verdict column in the order the filters apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Leaves that are no documents of their own; fixed values.
JUNK_LEAVES = ("README", "TEMPLATE")
DEFAULT_PRIORITY = 30


def skipped(file_name: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | file_name.startswith(prefix)
    return out


def is_junk(id_: Column) -> Column:
    return tx.leaf_of(id_).isin(*JUNK_LEAVES)


def has_description(description: Column) -> Column:
    return F.coalesce(description, F.lit("")) != ""


def is_valid_extra(id_: Column, name: Column, description: Column) -> Column:
    """All three fields are there and not empty."""
    return F.coalesce(id_ != "", F.lit(False)) & F.coalesce(name != "", F.lit(False)) & F.coalesce(description != "", F.lit(False))


def corpus_verdicts(entries: DataFrame, drops: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """`entries` (id, name, description, ord, ...) with `verdict`.

    In this order: skip-prefix, dropped (an id of `drops`), junk, no-description,
    duplicate (a fingerprint seen before among what passed so far), kept.
    """
    known = drops.select(F.col("id").alias("_drop")).distinct()
    rows = entries.join(known, F.col("id") == F.col("_drop"), "left")
    early = (
        F.when(skipped(F.col("id"), prefixes), "skip-prefix")
        .when(F.col("_drop").isNotNull(), "dropped")
        .when(is_junk(F.col("id")), "junk")
        .when(~has_description(F.col("description")), "no-description")
    )
    rows = rows.withColumn("_early", early).withColumn("_fp", tx.fingerprint(F.col("name"), F.col("description"))).drop("_drop")
    first = rows.where("_early IS NULL").groupBy("_fp").agg(F.min("ord").alias("_first"))
    rows = rows.join(first, "_fp", "left")
    verdict = F.coalesce("_early", F.when(F.col("ord") == F.col("_first"), "kept").otherwise("duplicate"))
    return rows.withColumn("verdict", verdict).drop("_early", "_fp", "_first")


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """(kept, dropped, duplicates): every other verdict counts as dropped."""
    v = F.col("verdict")
    return verdicts.agg(F.count_if(v == "kept").alias("kept"), F.count_if(~v.isin("kept", "duplicate")).alias("dropped"), F.count_if(v == "duplicate").alias("duplicates"))


def with_priority(entries: DataFrame, priorities: DataFrame, default: int = DEFAULT_PRIORITY) -> DataFrame:
    """`priority` of the id's source from (source, priority); `default` where it has none."""
    own = priorities.select(F.col("source").alias("_source"), F.col("priority"))
    return entries.join(own, tx.source_of(F.col("id")) == F.col("_source"), "left").withColumn("priority", F.coalesce("priority", F.lit(default))).drop("_source")


def with_attribution(entries: DataFrame, attributions: DataFrame) -> DataFrame:
    """`url` of the id's source from (source, url); '' where it has none."""
    own = attributions.select(F.col("source").alias("_source"), F.col("url"))
    return entries.join(own, tx.source_of(F.col("id")) == F.col("_source"), "left").withColumn("url", F.coalesce("url", F.lit(""))).drop("_source")
