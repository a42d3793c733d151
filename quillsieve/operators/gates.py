"""Quality gates: injection, density, near-duplicates; their figures and report."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import invisible
from ..functions import text as tx
from ..functions.text import prose_chars
from ..storage import materialize
from .filters import with_priority
from .index import numbered
from .vectors import THRESHOLD, cosine_dedup, embed

DENSITY_FLOOR = 200
FLAGS_SHOWN = 200


def gate_injection(entries: DataFrame) -> Column:
    return invisible.injection_reason(F.col("name"), F.col("description"), F.col("body"))


def gate_density(body: Column, floor: int = DENSITY_FLOOR) -> Column:
    return F.when(prose_chars(body) < floor, F.lit(f"density:prose<{floor}"))


def cheap_gates(entries: DataFrame, floor: int = DENSITY_FLOOR) -> DataFrame:
    """`entries` with `reason` (null: passed) and `flagged` (a visible phrase, passed rows only)."""
    reason = F.coalesce(gate_injection(entries), gate_density(F.col("body"), floor))
    out = entries.withColumn("reason", reason)
    return out.withColumn("flagged", F.col("reason").isNull() & invisible.visible_injection(F.col("body")))


def run_gates(
    entries: DataFrame,
    priorities: DataFrame,
    floor: int = DENSITY_FLOOR,
    threshold: float = THRESHOLD,
    vectors: DataFrame | None = None,
    embed_function: Callable[[list[str]], list[list[float]]] | None = None,
) -> DataFrame:
    """`entries` (id, name, description, body) with `reason` and `flagged`.

    Vectors for the last gate come from a table (id, vector) or from a function
    over descriptions; with neither the gate is left out. Rows that an earlier
    gate drops aren't visited by the last. Reasons: inject:…, density:…, dup-of:….
    """
    rows = cheap_gates(entries, floor)
    if vectors is None and embed_function is None:
        return rows
    rows = materialize(rows, "gates")
    passed = with_priority(rows.where("reason IS NULL").select("id", "description"), priorities)
    passed = passed.join(vectors.select("id", "vector"), "id") if vectors is not None else embed(passed, "description", embed_function)
    visited = materialize(numbered(passed.select("id", "priority", "vector"), "priority", "id"), "visited")
    found = cosine_dedup(visited, threshold).select(F.col("id").alias("_id"), F.concat(F.lit("dup-of:"), F.col("kept_id")).alias("_dup"))
    return rows.join(found, F.col("id") == F.col("_id"), "left").withColumn("reason", F.coalesce("reason", "_dup")).drop("_id", "_dup")


def gate_stats(verdicts: DataFrame) -> DataFrame:
    """(total, dropped_inject, dropped_density, dropped_dup, kept, visible_injection)"""
    of = lambda p: F.count_if(F.coalesce(F.col("reason").startswith(p), F.lit(False)))
    return verdicts.agg(
        F.count("*").alias("total"),
        of("inject:").alias("dropped_inject"),
        of("density:").alias("dropped_density"),
        of("dup-of:").alias("dropped_dup"),
        F.count_if(F.col("reason").isNull()).alias("kept"),
        F.count_if("flagged").alias("visible_injection"),
    )


def report_by_source(verdicts: DataFrame) -> DataFrame:
    """(source, total, kept, dropped, first): `first` is the source's first id in corpus order."""
    return verdicts.groupBy(tx.source_of(F.col("id")).alias("source")).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("reason").isNull()).alias("kept"),
        F.count_if(F.col("reason").isNotNull()).alias("dropped"),
        F.min(tx.file_order(F.col("id"))).alias("first"),
    )


def as_markdown(columns: list[str], rows: Iterable[Iterable]) -> str:
    """A Markdown table; bars and line breaks in values are escaped."""
    shown = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join("| " + " | ".join(map(shown, r)) + " |" for r in [columns, ["-"] * len(columns), *rows]) + "\n"


def render_report(verdicts: DataFrame, settings: dict[str, object]) -> str:
    """The figures of a gate run as Markdown tables: settings, `gate_stats`, `report_by_source`, and flagged ids.

    What reaches the driver is one row a source and FLAGS_SHOWN ids.
    """
    stats = gate_stats(verdicts).first().asDict()
    sources = report_by_source(verdicts).withColumn("share_kept", F.round(F.col("kept") / F.col("total"), 3)).orderBy(F.desc("total"), "first").drop("first")
    flagged = verdicts.where("flagged").select("id").orderBy("id").limit(FLAGS_SHOWN)
    parts = {
        "Settings": as_markdown(["name", "value"], settings.items()),
        "Figures": as_markdown(["figure", "rows"], stats.items()),
        "Sources": as_markdown(sources.columns, sources.toLocalIterator()),
        f"Kept rows that hold a visible phrase ({stats['visible_injection']}, at most {FLAGS_SHOWN} listed)": as_markdown(["id"], flagged.collect()),
    }
    return "\n".join(f"## {title}\n\n{body}" for title, body in parts.items())
