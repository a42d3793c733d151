"""Exact deduplication with composable polynomial fingerprints.

A text's bytes are the digits of a number in base B modulo a prime, under two
bases. The fingerprint of a concatenation follows from its parts,

    h(ab) = h(a) * B**len(b) + h(b)   (mod p),

so chunks of a huge document are hashed by different tasks and put together
with one small aggregation. Texts with equal length and fingerprint are then
compared chunk by chunk with the text of their group's representative; only
proven equality counts. Rows that share a fingerprint without being equal form
a new round among themselves, until every row has a representative.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_size, join_dealt, map_arrow, materialize, slices

PRIME = (1 << 31) - 1
BASES = (1_000_003, 1_664_525_013)
#: Texts over this many bytes are cut into chunks that other tasks may hash.
CHUNK_BYTES = 1 << 20
#: Members of one group that meet one copy of their representative.
MEMBERS_PER_SALT = 512
_STEP = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.empty(_STEP, dtype=np.uint64)
    x = 1
    for i in range(_STEP):
        out[_STEP - 1 - i] = x
        x = x * base % PRIME
    return out


class Fingerprint:
    """Hashes bytes under each base; `combine` joins the hashes of neighbours."""

    def __init__(self, bases: tuple[int, ...] = BASES):
        self.bases = bases
        self._tables = [_powers(b) for b in bases]

    def __call__(self, data: bytes) -> tuple[int, ...]:
        raw = np.frombuffer(data, dtype=np.uint8)
        out = [0] * len(self.bases)
        for start in range(0, len(raw), _STEP):
            part = raw[start : start + _STEP].astype(np.uint64)
            for i, (base, powers) in enumerate(zip(self.bases, self._tables, strict=True)):
                # below 2**8 * 2**31 * 2**16: no overflow before the one reduction
                own = int(np.dot(part, powers[_STEP - len(part) :])) % PRIME
                out[i] = (out[i] * pow(base, len(part), PRIME) + own) % PRIME
        return tuple(out)

    def shifts(self, length: int) -> tuple[int, ...]:
        """What a hash is multiplied by when `length` bytes follow."""
        return tuple(pow(b, length, PRIME) for b in self.bases)

    def combine(self, left: tuple[int, ...], right: tuple[int, ...], right_length: int) -> tuple[int, ...]:
        shift = self.shifts(right_length)
        return tuple((a * s + b) % PRIME for a, b, s in zip(left, right, shift, strict=True))


_PIECE = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("n_bytes", pa.int64()), ("chunk", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("data", pa.binary())])
_PIECE_DDL = "doc_id long, sha binary, n_bytes long, chunk int, h1 long, h2 long, s1 long, s2 long, data binary"


def _cut(chunk_bytes: int, bases: tuple[int, ...]):
    """Short texts leave hashed; long ones leave as chunks still to hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprint(bases)
        for batch in slices(batches, 512):
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), as_bytes(batch, "text"), strict=True):
                sha = hashlib.sha256(data).digest()
                if len(data) <= chunk_bytes:
                    rows.append((doc_id, sha, len(data), 0, *prints(data), *prints.shifts(len(data)), None))
                    continue
                for k, start in enumerate(range(0, len(data), chunk_bytes)):
                    part = data[start : start + chunk_bytes]
                    rows.append((doc_id, sha, len(data), k, 0, 0, *prints.shifts(len(part)), part))
                    if len(rows) >= 16:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)

    return run


def _hash_chunks(bases: tuple[int, ...]):
    """Hash the chunks that `_cut` left open; other rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprint(bases)
        for batch in batches:
            data = batch.column("data")
            if data.null_count < len(data):
                h1, h2 = batch.column("h1").to_pylist(), batch.column("h2").to_pylist()
                for i, part in enumerate(data):
                    if part.is_valid:
                        h1[i], h2[i] = prints(part.as_py())
                batch = batch.set_column(4, "h1", pa.array(h1, pa.int64())).set_column(5, "h2", pa.array(h2, pa.int64()))
            yield batch.set_column(8, "data", pa.nulls(batch.num_rows, pa.binary()))

    return run


def fingerprints(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bases: tuple[int, ...] = BASES) -> DataFrame:
    """(doc_id, sha, n_bytes, h1, h2, copies): a row for each different (doc_id, text).

    `copies` counts the rows that repeat both. Null texts count as empty.
    """
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, _cut(chunk_bytes, bases), _PIECE_DDL)
    # The open chunks of one huge text spread over all tasks here; hashed rows are small.
    pieces = pieces.repartition(F.col("sha"), F.col("chunk")).transform(map_arrow, _hash_chunks(bases), _PIECE_DDL)
    fold = lambda h, s: F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: (a * x[s] + x[h]) % F.lit(PRIME))
    return (
        pieces.groupBy("doc_id", "sha", "n_bytes")
        .agg(F.count_if(F.col("chunk") == 0).alias("copies"), F.array_sort(F.collect_set(F.struct("chunk", "h1", "h2", "s1", "s2"))).alias("parts"))
        .select("doc_id", "sha", "n_bytes", "copies", fold("h1", "s1").alias("h1"), fold("h2", "s2").alias("h2"))
    )


def _stream_chunks(chunk_bytes: int):
    """(…, text) to (…, chunk, data), one chunk at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            at, chunk, data = [], [], []
            size = 0
            for i, text in enumerate(as_bytes(batch, "text")):
                for k, start in enumerate(range(0, max(len(text), 1), chunk_bytes)):
                    at.append(i)
                    chunk.append(k)
                    data.append(text[start : start + chunk_bytes])
                    size += len(data[-1])
                    if size > 16 << 20:
                        yield _chunk_batch(batch, at, chunk, data)
                        at, chunk, data, size = [], [], [], 0
            if at:
                yield _chunk_batch(batch, at, chunk, data)

    return run


def _chunk_batch(batch: pa.RecordBatch, at: list[int], chunk: list[int], data: list[bytes]) -> pa.RecordBatch:
    kept = batch.drop_columns(["text"]).take(pa.array(at, pa.int32()))
    return pa.RecordBatch.from_arrays([*kept.columns, pa.array(chunk, pa.int32()), pa.array(data, pa.binary())], names=[*kept.schema.names, "chunk", "data"])


def _compare(docs: DataFrame, pending: DataFrame, rows: int, chunk_bytes: int) -> DataFrame:
    """pending, each with its group's representative (rep_id, rep_sha) and `same`."""
    prints = ["n_bytes", "h1", "h2"]
    groups = pending.groupBy(*prints).agg(F.max(F.struct("doc_id", "sha")).alias("rep"), F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / MEMBERS_PER_SALT).cast("int")
    groups = materialize(groups.select(*prints, "rep", salts.alias("salts"), "n"), "exact-groups")
    members = join_dealt(pending, groups, prints, 160).select("doc_id", "sha", *prints, "rep", "salts")
    # (doc_id, sha) finds a member's row again; what is compared are the texts themselves.
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("own", F.unhex(F.sha2("text", 256)))
    found = texts.join(by_size(members, rows, 240), texts["id"].eqNullSafe(members["doc_id"]) & (texts["own"] == members["sha"]))
    is_rep = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("sha") == F.col("rep.sha"))
    found = found.select("doc_id", "sha", *prints, "rep", "salts", is_rep.alias("is_rep"), "text")
    ddl = "doc_id long, sha binary, n_bytes long, h1 long, h2 long, rep struct<doc_id: long, sha: binary>, salts int, is_rep boolean, chunk int, data binary"
    chunks = found.transform(map_arrow, _stream_chunks(chunk_bytes), ddl)
    keys = [*prints, "salt", "chunk"]
    mine = F.pmod(F.xxhash64("doc_id", "sha"), F.col("salts")).cast("int")
    left = chunks.where(~F.col("is_rep")).withColumn("salt", mine)
    right = chunks.where("is_rep").select(*prints, "chunk", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("data").alias("rep_data"))
    same = left.join(right, keys).groupBy("doc_id", "sha", *prints).agg(F.min(F.col("data") == F.col("rep_data")).alias("same"))
    same = same.select(F.col("doc_id").alias("s_id"), F.col("sha").alias("s_sha"), "same")
    out = members.join(same, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("sha") == F.col("s_sha")), "left")
    return out.select("doc_id", "sha", *prints, F.col("rep.doc_id").alias("rep_id"), F.col("rep.sha").alias("rep_sha"), F.coalesce("same", is_rep).alias("same"))


def exact_dedup(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bases: tuple[int, ...] = BASES) -> DataFrame:
    """One row for each row of `docs`: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical; of equal texts the row with the largest
    doc_id stays. Null texts count as empty texts and are equal to them. Null
    doc_ids sort below all others. Rows that repeat doc_id and text are members
    like any other, and exactly one row of a group is kept. An empty table gives
    an empty result; columns other than doc_id and text are ignored.
    """
    all_rows = materialize(fingerprints(docs, chunk_bytes, bases), "exact-prints")
    prints = ["n_bytes", "h1", "h2"]
    shared = materialize(all_rows.groupBy(*prints).agg(F.count("*").alias("n")).where("n > 1"), "exact-keys")
    pending = materialize(join_dealt(all_rows, shared, prints, 48).select("doc_id", "sha", *prints), "exact-shared")
    proven = None
    while (rows := pending.count()) > 0:
        compared = materialize(_compare(docs, pending, rows, chunk_bytes), "exact-compared")
        same = compared.where("same").select("doc_id", "sha", "rep_id", "rep_sha")
        proven = same if proven is None else proven.unionByName(same)
        pending = compared.where("not same").select("doc_id", "sha", *prints)
    out = all_rows.select("doc_id", "sha", "copies")
    if proven is None:
        out = out.select("*", F.col("doc_id").alias("rep_id"), F.col("sha").alias("rep_sha"))
    else:
        p = proven.select(F.col("doc_id").alias("p_id"), F.col("sha").alias("p_sha"), "rep_id", "rep_sha")
        out = out.join(p, out["doc_id"].eqNullSafe(p["p_id"]) & (out["sha"] == p["p_sha"]), "left")
        single = F.col("rep_sha").isNull()
        out = out.select("doc_id", "sha", "copies", F.when(single, F.col("doc_id")).otherwise(F.col("rep_id")).alias("rep_id"), F.coalesce("rep_sha", "sha").alias("rep_sha"))
    # A group's text has one sha and one representative; sizes are summed before they are joined back.
    out = materialize(out, "exact-members")
    sizes = materialize(out.groupBy("rep_sha").agg(F.sum("copies").alias("group_size"), F.count("*").alias("n")), "exact-sizes")
    out = join_dealt(out, sizes, ["rep_sha"], 64)
    out = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth"))
    kept = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("sha") == F.col("rep_sha")) & (F.col("nth") == 1)
    return out.select("doc_id", F.col("rep_id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
