"""BM25 top-k over an index, for one query or a table of queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.scoring import idf, term_weight
from .index import Index

DEFAULT_K = 5


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, pos, token): a token that is repeated stays repeated."""
    return queries.select("query_id", F.posexplode(tx.tokens(F.col("text"))).alias("pos", "token"))


def scores(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, id, score, first_pos) of every document with a term of the query.

    Repeats of a term are counted first, so a document's posting is read once.
    """
    terms = query_terms(queries).groupBy("query_id", "token").agg(F.count("*").alias("times"), F.min("pos").alias("pos"))
    hits = terms.join(index.postings, "token").join(index.terms, "token")
    docs = index.docs.select("id", "dl")
    hits = hits.join(docs, "id").crossJoin(F.broadcast(index.stats))  # one row is broadcast
    weight = term_weight(idf(F.col("n"), F.col("df")), F.col("tf"), F.col("dl"), F.col("avgdl"))
    return hits.groupBy("query_id", "id").agg(F.sum(F.col("times") * weight).alias("score"), F.min("pos").alias("first_pos"))


def _order(score: Column) -> list[Column]:
    return [F.desc(score) if isinstance(score, str) else score.desc(), F.col("first_pos"), F.col("ord")]


def search_all(queries: DataFrame, index: Index, k: int = DEFAULT_K) -> DataFrame:
    """(query_id, rank, id, name, description, score): the k best of every query.

    Equal scores go by the first query term that a document has, then by corpus
    order. Scores are rounded to 3 places after ranking.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    found = scores(queries, index).join(index.docs.select("id", "ord"), "id")
    # Scores are compared at 9 places: sums of the same terms may differ in the last bits.
    order = Window.partitionBy("query_id").orderBy(*_order(F.round("score", 9)))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(index.docs.select("id", "name", "description"), "id").select("query_id", "rank", "id", "name", "description", F.round("score", 3).alias("score"))


def search(query: str, index: Index, k: int = DEFAULT_K) -> DataFrame:
    """(rank, id, name, description, score) of one query, best first."""
    if k < 0:
        raise ValueError("k must not be negative")
    spark = index.docs.sparkSession
    queries = spark.createDataFrame([(0, query)], "query_id long, text string")
    # The query's own terms as literals: a filter that reaches the index files, or the words of an index in the making.
    asked = F.col("token").isin([w.lower() for w in re.findall("[a-zA-Z0-9]+", query)])
    index = Index(index.postings.where(asked), index.docs, index.terms.where(asked), index.stats)
    found = scores(queries, index).join(index.docs.select("id", "ord", "name", "description"), "id")
    best = found.orderBy(*_order(F.round("score", 9))).limit(k)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*_order(F.round("score", 9)))))  # k rows
    return ranked.select("rank", "id", "name", "description", F.round("score", 3).alias("score")).orderBy("rank")


def lookup(corpus: DataFrame, id_: str, order: str = "ord") -> DataFrame:
    """The first row with the id; a missing body reads as ''."""
    row = corpus.where(F.col("id") == id_).orderBy(order).limit(1)
    return row.withColumn("body", F.coalesce("body", F.lit("")))
