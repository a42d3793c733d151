"""SimHash near-duplicates by pivot distance tables.

Fingerprints link when they differ in at most `distance` bits. The distances to
many pivots are computed once per different fingerprint and stay with it (see
`pivot`): most pairs are discarded by their largest coordinate difference, and
the rest is verified bit by bit.

To find pairs on many machines, fingerprints meet in cells. The bits are cut
into distance + 2 blocks; a linked pair agrees on two blocks at least, so it
meets in the cell of those. A cell with more than CELL_MOST fingerprints is cut
by the same rule over the bits that its members need not share, again and
again, until it is small; when few bits are left its size is bounded by their
number. Within a cell the search grows components, so copies of one text are
not compared with each other again once they are connected.

With `similarity`, texts link by the exact similarity of their shingle sets
instead; see `shingles`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, join_dealt, map_arrow, materialize, slices
from .components import components, first_rows
from .pivot import PIVOTS, PivotTable, as_column, distances, from_column, pivots
from .shingles import similar

SHINGLE_WORDS = 4
DISTANCE = 4
CELL_MOST = 4096
_SEED = 42
#: Shingles hashed at a time, to bound memory on very long texts.
_STEP = 1 << 17


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of lower-cased (A-Z) word shingles, repeats included; 0 without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    total = max(1, len(parts) - words + 1)
    firsts, lasts = starts[:total], ends[min(words, len(parts)) - 1 :]
    votes = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, _STEP):
        hashes = np.fromiter((digest(joined[a:b], _SEED) for a, b in zip(firsts[at : at + _STEP].tolist(), lasts[at : at + _STEP].tolist(), strict=True)), dtype=np.uint64)
        votes += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > total).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, key, print), a row for each row of `docs`: the fingerprint as a signed 64-bit number, and
    xxhash64 of the text, which with doc_id tells a row again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            texts = as_bytes(batch, "text")
            keys, prints = (np.array([f(t) for t in texts], dtype=np.uint64).view(np.int64) for f in (lambda t: xxhash.xxh64_intdigest(t, _SEED), lambda t: fingerprint(t, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(prints)], names=["doc_id", "key", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, run, "doc_id long, key long, print long")


def cell_edges(table: PivotTable, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges (position, position) that connect the components of one cell: a spanning forest."""
    open_, edges = np.arange(len(table.prints)), []
    while len(open_) > 1:
        queue, open_ = [int(open_[0])], open_[1:]
        while queue and len(open_):
            at = queue.pop()
            found = table.linked(at, open_, distance)
            if len(found):
                edges += [(at, int(x)) for x in found]
                queue += found.tolist()
                open_ = open_[~np.isin(open_, found)]
    return edges


def _masks(distance: int, free: int) -> list[int]:
    """Masks over the `free` bits (a mask too): the pairs of distance + 2 blocks of them."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    count = distance + 2
    blocks = [sum(bits[len(bits) * i // count : len(bits) * (i + 1) // count]) for i in range(count)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def with_pivots(prints: DataFrame) -> DataFrame:
    """(print, far): each print with its distances to the pivots, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = pivots()
        for batch in slices(batches, 1 << 14):
            own = batch.column("print").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("print"), as_column(distances(own, references))], names=["print", "far"])

    return prints.select("print").transform(map_arrow, run, "print long, far binary")


def _cells(rows: DataFrame, distance: int) -> DataFrame:
    """(fixed, cell, print, far) one level down: `fixed` has the bits a cell's members share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for batch in slices(batches, 1 << 14):
            fixed = batch.column("fixed").to_numpy().view(np.uint64)
            for mask in np.unique(fixed).tolist():
                part = batch.filter(pa.array(fixed == mask))
                own = part.column("print").to_numpy().view(np.uint64)
                for more in known.setdefault(mask, _masks(distance, ~mask & (1 << 64) - 1)):
                    both = np.uint64(mask | more)
                    columns = [pa.array(np.full(len(own), both).view(np.int64)), pa.array((own & both).view(np.int64)), part.column("print"), part.column("far")]
                    yield pa.RecordBatch.from_arrays(columns, names=["fixed", "cell", "print", "far"])

    return rows.select("fixed", "print", "far").transform(map_arrow, run, "fixed long, cell long, print long, far binary")


def links(prints: DataFrame, distance: int = DISTANCE, most: int = CELL_MOST) -> DataFrame:
    """(a, b): edges that connect all different prints within `distance`, directly or through others.

    `prints` has a column `print` without repeats.
    """

    def joined(key: tuple, batch: pa.Table) -> pa.Table:
        own = batch["print"].to_numpy().view(np.uint64)
        order = np.argsort(own)
        own = own[order]
        edges = cell_edges(PivotTable(own, from_column(batch["far"], PIVOTS)[order]), distance)
        ends = [own[[e[i] for e in edges]] if edges else np.empty(0, np.uint64) for i in (0, 1)]
        return pa.table({"a": ends[0].view(np.int64), "b": ends[1].view(np.int64)})

    # Written first: the next pass would run a second worker beside this one's in each task.
    level, found = materialize(with_pivots(prints).select(F.lit(0).cast("long").alias("fixed"), "print", "far"), "pivots"), None
    while True:
        cells = materialize(_cells(level, distance), "cells")
        sizes = cells.groupBy("fixed", "cell").agg(F.count("*").alias("n")).where("n > 1")
        last_bits = 64 - F.bit_count("fixed") <= 12  # at most 2**12 different prints
        sizes = materialize(sizes.withColumn("small", (F.col("n") <= most) | last_bits), "cell-sizes")
        large = sizes.where("not small").limit(1).count()
        # Cells of one print are dropped before anything is grouped.
        shared = join_dealt(cells, sizes, ["fixed", "cell"], 48)
        edges = shared.where("small").groupBy("fixed", "cell").applyInArrow(joined, "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        if not large:
            return found
        level = materialize(shared.where("not small").select("fixed", "print", "far").distinct(), "large-cells")


def classed(docs: DataFrame, distance: int = DISTANCE, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, key, print, root, component_id), a row for each row of `docs`; root is a print that names the component."""
    rows = materialize(fingerprints(docs, words), "simhash")
    classes = materialize(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    roots = components(links(classes.select("print"), distance))
    # the component's smallest doc_id: over classes that hang on a root, and the rest by themselves
    merged = classes.join(roots, classes["print"] == roots["node"], "left").select("print", "least", "n", F.coalesce("root", "print").alias("root"))
    least = merged.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(merged.join(least, "root").select("print", "n", "root", "component_id"), "named")
    return join_dealt(rows, named, ["print"], 48).select("doc_id", "key", "print", "root", "component_id")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of `docs`.

    The fingerprint is 16 lower-case hex digits. component_id is the smallest
    doc_id that can be reached over fingerprints at most `distance` bits apart,
    the row's own included. Null texts count as empty; texts without words have
    fingerprint zero and link like others. Null doc_ids are carried along and
    never are the smallest unless all of a component are null. Repeated rows stay
    repeated; other columns are ignored; an empty table gives no rows.
    """
    return classed(docs, distance, words).select("doc_id", hex_of(F.col("print")).alias("fingerprint"), "component_id")


def keepers(docs: DataFrame, distance: int = DISTANCE, words: int = SHINGLE_WORDS, similarity: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, key, rows): of each component the row to keep, with how many rows of `docs` are like it.

    That is the row with the smallest doc_id; of several texts under that id, the
    one with the smallest key. With `similarity` (a fraction), texts whose sets of
    shingles have that Jaccard similarity or more are linked; `distance` is where
    the search among fingerprints ends and that among shingles begins.
    """
    return first_rows(classed(docs, distance, words) if similarity is None else similar(docs, lambda prints: links(prints, distance), words, similarity))


def hex_of(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
