"""The curation plan: parsed documents through the gates to verdicts and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.gates import DENSITY_FLOOR, render_report, run_gates
from ..operators.vectors import THRESHOLD
from ..sources.documents import parse_entries, read_markdown
from ..sources.writers import write_text, write_verdicts
from ..storage import materialize

PRIORITY = "source string, priority int"


def curate(
    spark: SparkSession,
    folder: str,
    out: str,
    priorities: DataFrame | None = None,
    floor: int = DENSITY_FLOOR,
    threshold: float = THRESHOLD,
    vectors: DataFrame | None = None,
    embed_function=None,
    report: str | None = None,
) -> str:
    """Gate the documents of a folder; writes verdicts to `out`, and the report that it returns to the file `report`."""
    entries = parse_entries(read_markdown(spark, folder))
    priorities = spark.createDataFrame([], PRIORITY) if priorities is None else priorities
    verdicts = materialize(run_gates(entries, priorities, floor, threshold, vectors, embed_function).select("id", "reason", "flagged"), "verdicts")
    dedup = vectors is not None or embed_function is not None
    text = render_report(verdicts, {"density_floor": floor, "cosine_threshold": threshold if dedup else None})
    write_verdicts(verdicts, out)
    if report:
        write_text(text, report)
    return text
