"""Merging hand-curated rows: append what is new, or replace by id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.invisible import strip_invisible
from .filters import is_valid_extra
from .greedy import first_by_keys
from .index import numbered

FIELDS = ("name", "description", "body")


def sanitize_entries(entries: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Strip invisible characters from the fields; never from `id`."""
    return entries.withColumns({f: strip_invisible(F.col(f)) for f in fields if f in entries.columns})


def _fp() -> Column:
    return F.to_json(tx.fingerprint(F.col("name"), F.col("description")))


@dataclass(frozen=True)
class Merged:
    rows: DataFrame
    verdicts: DataFrame

    def counts(self) -> DataFrame:
        """(appended, duplicates, invalid)"""
        v = F.col("verdict")
        return self.verdicts.agg(F.count_if(v == "appended").alias("appended"), F.count_if(v == "duplicate").alias("duplicates"), F.count_if(v == "invalid").alias("invalid"))


def merge_extras(corpus: DataFrame, extras: DataFrame, order: str = "ord") -> Merged:
    """Append those extras whose id and fingerprint are new, in order.

    An extra that lacks a field is invalid; one whose id or fingerprint is in the
    corpus, or in an extra accepted before it, is a duplicate. If the corpus has a
    numeric `ord`, that of the appended rows goes on where it ends.
    """
    checked = sanitize_entries(extras).withColumn("_ok", is_valid_extra(F.col("id"), F.col("name"), F.col("description")))
    valid = checked.where("_ok").drop("_ok")
    ids = corpus.select(F.col("id").alias("_id")).distinct()
    prints = corpus.select(_fp().alias("_fp")).distinct()
    new = valid.withColumn("_key", _fp()).join(ids, F.col("id") == F.col("_id"), "left_anti").join(prints, F.col("_key") == F.col("_fp"), "left_anti").drop("_key")
    accepted = first_by_keys(new, order, [F.col("id"), _fp()]).where("accepted").drop("accepted")
    taken = accepted.select(F.col(order).alias("_taken"))
    verdict = F.when(~F.col("_ok"), "invalid").when(F.col("_taken").isNotNull(), "appended").otherwise("duplicate")
    verdicts = checked.join(taken, F.col(order) == F.col("_taken"), "left").select(order, "id", verdict.alias("verdict"))
    if "ord" in corpus.columns:
        last = corpus.agg(F.coalesce(F.max("ord"), F.lit(-1)).cast("long").alias("_last"))
        accepted = numbered(accepted, order).crossJoin(F.broadcast(last))  # one row is broadcast
        accepted = accepted.withColumn("ord", F.col("_last") + 1 + F.col("visit")).drop("visit", "_last")
    else:
        accepted = accepted.drop(order)
    return Merged(corpus.unionByName(accepted, allowMissingColumns=True), verdicts)


def upsert(existing: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(result, counts): rows replace those with their id, others are added; counts has (replaced, added)."""
    result = existing.join(rows.select("id").distinct(), "id", "left_anti").unionByName(rows, allowMissingColumns=True)
    known = existing.select(F.col("id").alias("_id")).distinct()
    counts = rows.join(known, F.col("id") == F.col("_id"), "left").agg(F.count("_id").alias("replaced"), F.count_if(F.col("_id").isNull()).alias("added"))
    return result, counts


def local_rows(files: DataFrame, bundle: str, strip_header: bool = False) -> DataFrame:
    """(id, name, description, body) of raw files (path, text) of a bundle; `path` is its folder, '' at the top."""
    from ..functions.frontmatter import front_matter

    id_ = F.when(F.col("path") == "", F.lit(f"local__{bundle}")).otherwise(F.concat(F.lit(f"local__{bundle}__"), F.replace("path", F.lit("/"), F.lit("__"))))
    rows = files.select(id_.alias("id"), front_matter("text").alias("_m"), "text")
    name = F.coalesce(F.nullif(F.try_element_at("_m", F.lit("name")), F.lit("")), F.col("id"))
    body = tx.strip_front_matter(F.col("text")) if strip_header else F.col("text")
    return rows.select("id", name.alias("name"), F.coalesce(F.try_element_at("_m", F.lit("description")), F.lit("")).alias("description"), body.alias("body"))


def upsert_lines(existing: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, counts): `existing` (id, line) with `rows` as JSON in place of the lines of their ids, sorted by id.

    Lines without an id, malformed ones too, stay as they are, behind the others.
    """
    new = rows.select("id", F.to_json(F.struct(*rows.columns)).alias("line"))
    out, counts = upsert(existing, new)
    return out.orderBy(F.col("id").asc_nulls_last(), "line").select(F.col("line").alias("value")), counts
