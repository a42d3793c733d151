"""The inverted index: postings, document lengths, document frequencies, corpus figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.invisible import strip_invisible
from ..storage import materialize

INDEXED = "id, name, description, ord"


@dataclass(frozen=True)
class Index:
    """postings (token, id, tf), docs (id, name, description, dl, ord), terms (token, df), stats (n, avgdl)."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    stats: DataFrame


def first_by_fingerprint(entries: DataFrame, order: str = "ord") -> DataFrame:
    """Of entries with the same fingerprint, the first in corpus order.

    A minimum by key and a join back, so that a key with very many entries is
    combined before it moves and is never gathered.
    """
    keyed = entries.withColumn("_fp", tx.fingerprint(F.col("name"), F.col("description")))
    first = keyed.groupBy("_fp").agg(F.min(order).alias("_first")).select("_first")
    return keyed.join(first, F.col(order) == F.col("_first"), "left_semi").drop("_fp")


def numbered(entries: DataFrame, *order: str) -> DataFrame:
    """`visit`: positions from 0 in the given order.

    Rows are range-partitioned and written once, so that counts by partition and
    numbers inside come from one and the same cut: no task sees all rows.
    """
    dealt = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    at = materialize(dealt.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    counts = at.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    low = F.pmod(F.col("_m"), F.lit(1 << 33))
    return at.join(F.broadcast(before.drop("_n")), "_p").withColumn("visit", F.col("_before") + low).drop("_p", "_m", "_before")  # one row a partition is broadcast


def tokenised(entries: DataFrame) -> DataFrame:
    return entries.withColumn("tokens", tx.tokens(tx.indexed_text(F.col("name"), F.col("description"))))


def term_frequencies(entries: DataFrame) -> DataFrame:
    """(token, id, tf) of entries (id, name, description); words are lower-cased one by one, after the explode."""
    words = tx.words(tx.indexed_text(F.col("name"), F.col("description")))
    return entries.select("id", F.explode(words).alias("word")).groupBy(F.lower("word").alias("token"), "id").agg(F.count("*").alias("tf"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """From postings as they are, whether or not their documents still exist."""
    return postings.groupBy("token").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """(n, avgdl): documents without tokens count; 0.0 for an empty corpus."""
    mean = F.when(F.count("*") > 0, F.coalesce(F.sum("dl"), F.lit(0)) / F.nullif(F.count("*"), F.lit(0))).otherwise(F.lit(0.0))
    return docs.agg(F.count("*").alias("n"), mean.cast("double").alias("avgdl"))


def build_index(entries: DataFrame, dedup: bool = True, sanitize: bool = True) -> Index:
    """Index `name description` of entries (id, name, description, ord).

    Entries without description are left out before stripping. Only the first of
    each fingerprint is indexed. Ids must be unique.
    """
    rows = entries.select("id", "name", "description", "ord").where(F.coalesce("description", F.lit("")) != "")
    if sanitize:
        rows = rows.withColumns({c: strip_invisible(F.col(c)) for c in ("name", "description")})
    if dedup:
        rows = first_by_fingerprint(rows)
    postings = term_frequencies(rows)
    dl = F.size(tx.words(tx.indexed_text(F.col("name"), F.col("description")))).cast("long")
    docs = rows.select("id", "name", "description", dl.alias("dl"), "ord")
    return Index(postings, docs, document_frequencies(postings), corpus_stats(docs))
