"""The stateless operators on streams: the expressions are the same as on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.gates import DENSITY_FLOOR, cheap_gates
from ..operators.merge import sanitize_entries


def gate_stream(entries: DataFrame, floor: int = DENSITY_FLOOR) -> DataFrame:
    """Entries with `reason` and `flagged`, row by row; near-duplicates need a table and aren't judged."""
    return cheap_gates(entries, floor)


def sanitize_stream(entries: DataFrame) -> DataFrame:
    return sanitize_entries(entries)


def token_stream(entries: DataFrame) -> DataFrame:
    """(id, token, tf) of each entry as it comes, counted within the entry."""
    tokens = tx.tokens(tx.indexed_text(F.col("name"), F.col("description")))
    each = F.transform(F.array_distinct("_t"), lambda w: F.struct(w.alias("token"), F.size(F.filter("_t", lambda x: x == w)).cast("long").alias("tf")))
    return entries.select("id", tokens.alias("_t")).select("id", F.explode(each).alias("e")).select("id", "e.token", "e.tf")
