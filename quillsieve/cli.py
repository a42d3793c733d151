"""Command line: seed, search, load, build-index, curate, pack, add-local."""

from __future__ import annotations

import argparse
import sys
import tempfile

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .operators.filters import has_description
from .operators.index import build_index, numbered
from .operators.merge import local_rows, sanitize_entries, upsert_lines
from .operators.search import DEFAULT_K, search
from .plans.curate import PRIORITY, curate
from .plans.pack import ATTRIBUTION, lookup_body, pack
from .sources.documents import discover_all, read_bundle, read_extra_lines, read_jsonl, unpack_bundle
from .sources.writers import IndexCorrupt, IndexMissing, check_jsonl, hits_as_json, read_index, replace_table, shown, write_index, write_raw
from .storage import scope


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("quillsieve").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _pair(text: str) -> tuple[str, str]:
    name, found, value = text.partition("=")
    if not (name and found):
        raise argparse.ArgumentTypeError(f"{text!r} is not NAME=VALUE")
    return name, value


def _ranked(text: str) -> tuple[str, int]:
    name, value = _pair(text)
    return name, int(value)


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillsieve")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("seed", help="collect the documents of folders into one")
    p.add_argument("sources", nargs="+", type=_pair, metavar="NAME=FOLDER")
    p.add_argument("--out", required=True)
    p.add_argument("--clean", action="store_true", help="empty the target first")
    p = sub.add_parser("search", help="best documents for a query")
    p.add_argument("query")
    p.add_argument("k", nargs="?", type=int, default=DEFAULT_K)
    p.add_argument("--index", required=True)
    p = sub.add_parser("load", help="the body of an id")
    p.add_argument("id")
    p.add_argument("--packed", required=True)
    p.add_argument("--folder")
    p = sub.add_parser("build-index", help="index a JSON lines corpus")
    p.add_argument("corpus")
    p.add_argument("--index", required=True)
    p = sub.add_parser("curate", help="gate a folder of documents")
    p.add_argument("folder")
    p.add_argument("--out", required=True)
    p.add_argument("--density-floor", type=int, default=200)
    p.add_argument("--dedup-threshold", type=float, default=0.90)
    p.add_argument("--vectors", help="Parquet table (id, vector); without it near-duplicates stay")
    p.add_argument("--no-dedup", action="store_true", help="leave near-duplicates, whatever vectors there are")
    p.add_argument("--priority", action="append", default=[], type=_ranked, metavar="SOURCE=NUMBER", help="smaller numbers are kept first")
    p.add_argument("--report", help="file for the report")
    p = sub.add_parser("pack", help="build a corpus and its index")
    p.add_argument("folder")
    p.add_argument("--out-dir", required=True)
    p.add_argument("--verdicts")
    p.add_argument("--extras")
    p.add_argument("--skip-prefix", action="append", default=[])
    p.add_argument("--attribution", action="append", default=[], type=_pair, metavar="SOURCE=URL")
    p.add_argument("--readme", help="file that describes the package; makes a bundle")
    p = sub.add_parser("add-local", help="add a file, folder or archive to the extras")
    p.add_argument("source")
    p.add_argument("--extras", required=True, help="JSON lines")
    p.add_argument("--strip-frontmatter", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit codes: 0 done, 1 nothing to work on or unusable input, 2 wrong usage."""
    try:
        a = _parser().parse_args(args)
    except SystemExit as stop:
        return int(stop.code or 0)
    spark = spark or _session()
    try:
        with scope():  # nothing that a command returns is read after it
            return {"seed": _seed, "search": _search, "load": _load, "build-index": _build, "curate": _curate, "pack": _pack, "add-local": _add}[a.command](spark, a)
    except (IndexMissing, IndexCorrupt, ValueError, OSError, PySparkException, Py4JJavaError) as error:
        print(f"{type(error).__name__}: {str(error).splitlines()[0]}", file=sys.stderr)
        return 1


def _seed(spark: SparkSession, a: argparse.Namespace) -> int:
    """Sources that can't be read are named and cost only themselves; 1 if nothing at all was found."""
    rows, found, failed = discover_all(spark, dict(a.sources))
    total = write_raw(rows, a.out, a.clean)
    print(found, f"total {total}")
    for name, reason in failed.items():
        print(f"{name}: {reason}", file=sys.stderr)
    return 1 if failed and not total else 0


def _search(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = hits_as_json(search(a.query, read_index(spark, a.index), a.k).drop("rank")).collect()  # k rows
    print("[" + ",\n ".join(r["value"] for r in rows) + "]")
    return 0


def _load(spark: SparkSession, a: argparse.Namespace) -> int:
    body = lookup_body(spark, a.packed, a.id, a.folder)
    if body is None:
        print(f"no such id: {a.id!r}", file=sys.stderr)
        return 1
    row = spark.createDataFrame([(a.id, body)], "id string, body string")
    print(row.select(shown(row["id"], row["body"])).first()[0])
    return 0


def _build(spark: SparkSession, a: argparse.Namespace) -> int:
    check_jsonl(spark, a.corpus)
    entries = numbered(read_jsonl(spark, a.corpus), "ord").drop("ord").withColumnRenamed("visit", "ord")
    print(write_index(build_index(entries), a.index))
    return 0


def _curate(spark: SparkSession, a: argparse.Namespace) -> int:
    vectors = spark.read.parquet(a.vectors) if a.vectors and not a.no_dedup else None
    priorities = spark.createDataFrame(a.priority, PRIORITY)
    print(curate(spark, a.folder, a.out, priorities, a.density_floor, a.dedup_threshold, vectors, report=a.report))
    return 0


def _pack(spark: SparkSession, a: argparse.Namespace) -> int:
    done = pack(spark, a.folder, a.out_dir, a.verdicts, a.extras, spark.createDataFrame(a.attribution, ATTRIBUTION), tuple(a.skip_prefix), a.readme)
    if done.warning:
        print(done.warning, file=sys.stderr)
    print(done)
    return 0


def _add(spark: SparkSession, a: argparse.Namespace) -> int:
    with tempfile.TemporaryDirectory() as place:  # the bundle is read by the driver
        name, folder = unpack_bundle(a.source, place)
        rows = sanitize_entries(local_rows(read_bundle(spark, folder), name, a.strip_frontmatter))
        rows = rows.where(has_description(rows["description"]))
        if rows.isEmpty():
            raise ValueError(f"nothing to add in {a.source}")
        old = read_extra_lines(spark, a.extras)
        if old is None:  # only a path that doesn't exist; one that can't be read is an error and stays
            old = spark.createDataFrame([], "id string, line string")
        lines, counts = upsert_lines(old, rows)
        print(counts.first().asDict())
        if not a.dry_run:
            replace_table(lines, a.extras, "text")
    return 0


if __name__ == "__main__":
    sys.exit(main())
