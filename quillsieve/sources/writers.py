"""Writers: index, corpus, verdicts, bundles. Outputs are staged and then moved into place together."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.invisible import strip_invisible
from ..operators.index import Index
from ..storage import delete, discard, exists, materialize, rename

TABLES = ("postings", "docs", "terms", "stats")
#: Package metadata: longest description, and from where on a warning is due; fixed values.
DESCRIPTION_MOST, DESCRIPTION_WARN = 1024, 950


class IndexMissing(Exception):
    """There is no index at the path."""


class IndexCorrupt(Exception):
    """What is at the path is no index."""


def swap(spark: SparkSession, staged: dict[str, str]) -> None:
    """Move finished paths {from: to} into place, all of them or none.

    What stands at a target is moved aside first and deleted when everything is
    in place; if a move fails, it is moved back.
    """
    for source in staged:
        if not exists(spark, source):
            raise FileNotFoundError(source)
    aside, moved = {}, []
    try:
        for source, target in staged.items():
            if exists(spark, target):
                kept = f"{target.rstrip('/')}.old-{uuid.uuid4().hex}"
                rename(spark, target, kept)
                aside[target] = kept
            rename(spark, source, target)
            moved.append(target)
    except BaseException:
        for target in moved:
            delete(spark, target)
        for target, kept in aside.items():
            rename(spark, kept, target)
        raise
    for kept in aside.values():
        delete(spark, kept)


@contextmanager
def staging(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder beside `path` to write into; what is left of it goes in the end."""
    folder = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        if exists(spark, folder):
            delete(spark, folder)


def replace_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write beside `path` and move there, so that a failed write leaves the old table."""
    with staging(df.sparkSession, path) as staged:
        df.write.format(kind).save(staged)
        swap(df.sparkSession, {staged: path})


def _write_tables(index: Index, path: str) -> int:
    """Postings are sorted by token so that a reader skips what it doesn't ask for."""
    rows = materialize(index.postings, "postings")
    rows.repartitionByRange("token").sortWithinPartitions("token", "id").write.parquet(f"{path}/postings")
    index.terms.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{path}/terms")
    index.docs.write.parquet(f"{path}/docs")
    index.stats.write.parquet(f"{path}/stats")
    discard(rows)
    return index.docs.sparkSession.read.parquet(f"{path}/stats").first()["n"]


def write_index(index: Index, path: str) -> int:
    """Write an index in one step: its four tables are there together, or the old ones stay."""
    spark = index.docs.sparkSession
    with staging(spark, path) as staged:
        count = _write_tables(index, staged)
        swap(spark, {staged: path})
    return count


def read_index(spark: SparkSession, path: str) -> Index:
    """The index at `path`; IndexMissing or IndexCorrupt if there is none to use."""
    found = {}
    for name in TABLES:
        try:
            found[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as error:
            raise (IndexMissing if "PATH_NOT_FOUND" in str(error) and not found else IndexCorrupt)(f"{path}/{name}") from error
    wanted = {"postings": {"token", "id", "tf"}, "docs": {"id", "dl", "ord"}, "terms": {"token", "df"}, "stats": {"n", "avgdl"}}
    for name, columns in wanted.items():
        if not columns <= set(found[name].columns):
            raise IndexCorrupt(f"{path}/{name} lacks {sorted(columns - set(found[name].columns))}")
    return Index(**found)


def _in_order(rows: DataFrame, order: str = "ord") -> DataFrame:
    return rows.repartitionByRange(order).sortWithinPartitions(order)


def write_corpus_and_index(corpus: DataFrame, index: Index, out: str, bundle: dict[str, str] | None = None) -> int:
    """`out`/corpus (Parquet), `out`/corpus.jsonl (a part file for each range) and `out`/index, all of them or none.

    `bundle` maps names to local files; with it, `out`/bundle.zip holds these and
    what was written, which needs a folder that the driver sees.
    """
    spark = corpus.sparkSession
    with staging(spark, f"{out}/build") as staged:
        _in_order(corpus).write.parquet(f"{staged}/corpus")
        _in_order(corpus).drop("ord").write.json(f"{staged}/corpus.jsonl")
        count = _write_tables(index, f"{staged}/index")
        names = ["corpus", "corpus.jsonl", "index"]
        if bundle is not None:
            zip_folder(staged, f"{staged}/bundle.zip", bundle)
            names.append("bundle.zip")
        swap(spark, {f"{staged}/{n}": f"{out}/{n}" for n in names})
    return count


def write_verdicts(verdicts: DataFrame, path: str) -> None:
    """(id, reason) of what is dropped."""
    replace_table(verdicts.where(F.col("reason").isNotNull()).select("id", "reason"), path)


def write_text(text: str, path: str) -> None:
    """A small local file, written beside its place and moved there."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    staged = target.with_name(f"{target.name}.staged-{uuid.uuid4().hex}")
    staged.write_text(text, encoding="utf-8")
    staged.replace(target)


def write_raw(rows: DataFrame, folder: str, clean: bool = False) -> int:
    """A <id>.md for each row (id, text) in a folder that the driver sees, row by row; of one id the last stays."""
    place = Path(folder)
    place.mkdir(parents=True, exist_ok=True)
    if clean:
        for old in place.glob("*.md"):
            old.unlink()
    count = 0
    for row in rows.select("id", "text").toLocalIterator():
        (place / f"{row['id']}.md").write_text(row["text"], encoding="utf-8")
        count += 1
    return count


def check_jsonl(spark: SparkSession, path: str) -> int:
    """Rows of an existing corpus; ValueError if it is missing, empty, or its first row is no object with an id."""
    try:
        rows = spark.read.text(path)
    except AnalysisException as error:
        raise ValueError(f"{path}: missing") from error
    first = rows.where(F.trim("value") != "").limit(1).select(F.get_json_object("value", "$.id").alias("id")).first()
    if first is None:
        raise ValueError(f"{path}: empty")
    if first["id"] is None:
        raise ValueError(f"{path}: the first row has no id")
    return rows.where(F.trim("value") != "").count()


def check_description(text: str) -> str | None:
    """A warning on a long package description; ValueError on one that is too long."""
    if len(text) > DESCRIPTION_MOST:
        raise ValueError(f"description has {len(text)} characters; {DESCRIPTION_MOST} are allowed")
    return f"description has {len(text)} characters, close to {DESCRIPTION_MOST}" if len(text) > DESCRIPTION_WARN else None


def zip_folder(folder: str, target: str, more: dict[str, str] | None = None) -> None:
    """All files of a folder and `more` {name: file}, sorted by name, without leftovers of systems and writers."""
    base = Path(folder)
    files = {p.relative_to(base).as_posix(): p for p in base.rglob("*") if p.is_file() and p.suffix not in (".pyc", ".crc") and p.name not in (".DS_Store", "Thumbs.db", "_SUCCESS") and "__pycache__" not in p.parts}
    files |= {name: Path(path) for name, path in (more or {}).items()}
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for name in sorted(files):
            archive.write(files[name], name)


def shown(row_id: Column, body: Column) -> Column:
    """A body with a line on top that names its id, the latter without invisible characters."""
    return F.concat(F.lit("<!-- id: "), strip_invisible(row_id), F.lit(" -->\n"), F.coalesce(body, F.lit("")))


def hits_as_json(hits: DataFrame) -> DataFrame:
    """One JSON object a hit, non-ASCII characters as they are."""
    return hits.select(F.to_json(F.struct(*hits.columns)).alias("value"))
