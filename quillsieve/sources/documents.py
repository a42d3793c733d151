"""Readers: folders of Markdown files, JSON lines, verdicts, bundles."""

from __future__ import annotations

import logging
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.frontmatter import front_matter
from ..operators.filters import has_description, is_junk
from ..storage import materialize

log = logging.getLogger(__name__)
ENTRY = "id string, name string, description string, body string, source string"
FILE_NAMES = ("SKILL.md", "MODEL.md")


def _decoded(content: Column) -> Column:
    """UTF-8 with bad bytes replaced and all line ends as line feeds; a byte order mark stays."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text, ord) of the folder's *.md files; `ord` sorts as the file names do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return files.select(F.regexp_replace(name, r"\.md$", "").alias("id"), _decoded(F.col("content")).alias("text"), name.alias("ord"))


def parse_entries(raw: DataFrame, drop_junk: bool = True) -> DataFrame:
    """(id, name, description, body, ord) of raw files: name defaults to the id; body is the whole text.

    Junk leaves and files without description are left out.
    """
    rows = raw.where(~is_junk(F.col("id"))) if drop_junk else raw
    rows = rows.withColumn("_m", front_matter("text"))
    name = F.coalesce(F.nullif(F.try_element_at("_m", F.lit("name")), F.lit("")), F.col("id"))
    out = rows.select("id", name.alias("name"), F.try_element_at("_m", F.lit("description")).alias("description"), F.col("text").alias("body"), "ord")
    return out.where(has_description(F.col("description")))


def _line_order() -> Column:
    """Sorts rows of text files by file, split and line: a struct, so any layout of files keeps its order."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, description, body, source, ord) of JSON lines.

    Blank and malformed lines are left out, and so are rows without description;
    a missing name is the id. `ord` sorts as the lines stand in their files.
    """
    rows = spark.read.schema(f"{ENTRY}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.withColumn("ord", _line_order()).where("_bad IS NULL").drop("_bad")
    return rows.where(has_description(F.col("description"))).withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "id"))


def read_extras(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, description, body, ord), malformed lines as rows of nulls so that they can be counted."""
    rows = spark.read.schema("id string, name string, description string, body string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    bad = F.col("_bad").isNotNull()
    rows = rows.withColumn("ord", _line_order()).where(~(bad & (F.trim("_bad") == "")) | ~bad)
    return rows.select(*[F.when(~bad, F.col(c)).alias(c) for c in ("id", "name", "description", "body")], "ord")


def read_extra_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """(id, line) of an extras file, id null where a line is no object with one; None where there is no file.

    A file of which no line is a JSON object is no extras file: ValueError.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    rows = lines.where(F.trim("value") != "").select(F.get_json_object("value", "$.id").alias("id"), F.col("value").alias("line"))
    if not rows.isEmpty() and rows.where("line LIKE '{%' AND get_json_object(line, '$') IS NOT NULL").isEmpty():
        raise ValueError(f"{path} holds no JSON lines")
    return rows


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(id, reason); none, with a warning if there is something unreadable, where the table can't be read."""
    try:
        rows = spark.read.parquet(path)
        return materialize(rows.select(F.col("id").cast("string"), F.col("reason").cast("string")), "verdicts")
    except (PySparkException, Py4JJavaError) as error:
        if not (isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND"):
            log.warning("verdicts at %s can't be read; nothing is gated: %s", path, str(error).splitlines()[0])
        return spark.createDataFrame([], "id string, reason string")


def inside(path: str, root: str) -> bool:
    """Whether a local path, its links followed, is below a root."""
    return Path(path).resolve().is_relative_to(Path(root).resolve())


def discover(spark: SparkSession, root: str, source: str, file_name: str = "SKILL.md") -> DataFrame:
    """(id, text, ord) of all files of a name below `root`; the id is <source>__<folders joined by __>.

    Below a local root, files that a link leads out of it to are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", file_name).load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    place = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"^[a-z0-9]+:/+", "")
    below = F.substring(place, len(base) + 2, 1 << 30)
    folder = F.regexp_replace(below, r"/?[^/]+$", "")
    slug = F.when(folder == "", F.lit(source)).otherwise(F.concat(F.lit(f"{source}__"), F.replace(folder, F.lit("/"), F.lit("__"))))
    rows = files.where(F.startswith(place, F.lit(base + "/")))
    local = root if "://" not in root else root.removeprefix("file://") if root.startswith("file://") else None
    if local is not None and Path(local).is_dir():
        # Names of links only: a checkout has few, and they are seen by the driver alone.
        out = [str(p.relative_to(local)) for p in Path(local).rglob("*") if p.is_symlink() and not inside(str(p), local)]
        for link in out:
            rows = rows.where(~((below == link) | below.startswith(f"{link}/")))
    return rows.select(slug.alias("id"), _decoded(F.col("content")).alias("text")).withColumn("ord", tx.file_order(F.col("id")))


def discover_all(spark: SparkSession, sources: dict[str, str], file_name: str = "SKILL.md") -> tuple[DataFrame, dict[str, int], dict[str, str]]:
    """(rows, found, failed) over {source: folder}: a folder that can't be read costs only its own source."""
    rows, found, failed = spark.createDataFrame([], "id string, text string, ord string"), {}, {}
    for source, folder in sources.items():
        try:
            own = materialize(discover(spark, folder, source, file_name), "discovered")
            found[source] = own.count()
            rows = rows.unionByName(own)
        except (PySparkException, Py4JJavaError, OSError) as error:
            failed[source] = str(error).splitlines()[0]
    return rows, found, failed


def unpack_bundle(source: str, target: str) -> tuple[str, str]:
    """(bundle name, folder) of a file, folder or zip archive; an archive is unpacked below `target`.

    Members that would land outside of `target` are refused. A sole folder at the
    top of an archive is the bundle.
    """
    path, place = Path(source), Path(target).resolve()
    if not path.exists():
        raise FileNotFoundError(source)
    if path.is_file() and zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as archive:
            for member in archive.namelist():
                if not (place / member).resolve().is_relative_to(place):
                    raise ValueError(f"{member} would leave the target folder")
            archive.extractall(place)
        inner = [p for p in place.iterdir() if p.name != "__MACOSX"]
        return (inner[0].name, str(inner[0])) if len(inner) == 1 and inner[0].is_dir() else (path.stem, str(place))
    return (path.stem, str(path.parent)) if path.is_file() else (path.name, str(path))


def read_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the bundle's documents; `path` is the folder below the bundle, '' at the top."""
    files = [p for n in FILE_NAMES for p in Path(folder).rglob(n)]
    rows = [(p.parent.relative_to(folder).as_posix().removeprefix("."), p.read_text(encoding="utf-8", errors="replace")) for p in sorted(set(files))]
    return spark.createDataFrame(rows, "path string, text string")
