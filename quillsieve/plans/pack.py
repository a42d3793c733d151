"""The packing plan: raw documents to a filtered, merged, re-keyed corpus and its index."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frontmatter import front_matter
from ..operators.filters import corpus_verdicts, verdict_counts, with_attribution
from ..operators.index import build_index, numbered
from ..operators.merge import merge_extras
from ..operators.rekey import flatten_ids, rekey
from ..sources.documents import parse_entries, read_extras, read_markdown, read_verdicts
from ..sources.writers import check_description, write_corpus_and_index
from ..storage import materialize

ATTRIBUTION = "source string, url string"


@dataclass(frozen=True)
class Packed:
    kept: int
    dropped: int
    duplicates: int
    appended: int
    rows: int
    changed: int
    indexed: int
    warning: str | None = None


def pack(
    spark: SparkSession,
    folder: str,
    out: str,
    verdicts: str | None = None,
    extras: str | None = None,
    attributions: DataFrame | None = None,
    prefixes: tuple[str, ...] = (),
    readme: str | None = None,
) -> Packed:
    """Filter and de-duplicate a folder's documents, append extras, shorten ids, write corpus and index.

    Corpus order is that of the files, extras behind them in theirs, whatever the
    new ids are. `readme` is a local file that describes the package: its
    description is checked first, and it goes into a bundle with what is written.
    """
    warning = None
    if readme:
        head = spark.createDataFrame([(Path(readme).read_text(encoding="utf-8"),)], "text string").select(front_matter("text").alias("m")).first()["m"]
        warning = check_description(head.get("description") or "")
    drops = read_verdicts(spark, verdicts) if verdicts else spark.createDataFrame([], "id string, reason string")
    raw = read_markdown(spark, folder)
    judged = materialize(corpus_verdicts(parse_entries(raw), drops, prefixes), "judged")
    counts = verdict_counts(judged).first()
    if not counts["kept"]:
        raise ValueError(f"no document of {folder} is kept")
    attributions = spark.createDataFrame([], ATTRIBUTION) if attributions is None else attributions
    corpus = with_attribution(judged.where("verdict = 'kept'").drop("verdict"), attributions).withColumnRenamed("url", "source")
    corpus = numbered(corpus, "ord").select("id", "name", "description", "body", "source", F.col("visit").alias("ord"))
    appended = 0
    if extras:
        merged = merge_extras(corpus, read_extras(spark, extras))
        appended = merged.counts().first()["appended"]
        corpus = merged.rows if appended else corpus
    corpus = materialize(corpus, "merged")
    renamed, changes = rekey(corpus, flatten_ids(corpus.select("id").distinct()))
    renamed = materialize(renamed, "renamed")
    change = changes.first()
    n = write_corpus_and_index(renamed, build_index(renamed), out, {Path(readme).name: readme} if readme else None)
    return Packed(counts["kept"], counts["dropped"], counts["duplicates"], appended, change["rows"], change["changed"], n, warning)


def lookup_body(spark: SparkSession, out: str, id_: str, folder: str | None = None) -> str | None:
    """The body of an id from the corpus, else from the raw folder; None if neither has it."""
    row = spark.read.parquet(f"{out}/corpus").where(F.col("id") == id_).orderBy("ord").limit(1).select(F.coalesce("body", F.lit("")).alias("body")).first()
    if row is None and folder:
        row = read_markdown(spark, folder).where(F.col("id") == id_).limit(1).select(F.col("text").alias("body")).first()
    return None if row is None else row["body"]
