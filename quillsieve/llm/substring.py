"""Substring deduplication: seed and extend over winnowed anchors.

Every window of `length` words holds length - gram + 1 grams of `gram` words; the
one with the smallest hash is the window's anchor. Equal windows have equal
anchors at equal places, so two documents with a common passage of `length`
words or more meet at a common anchor, although only about one word in eighteen
starts one. From an anchor that documents with different ids have, a match is
extended to the left and right over the windows that the anchor stands for, and
on through those of the next anchors, as long as the same place of the same
earlier document goes along: that is a maximal repeat, a source's passage that
stands in a document, of `length` words or more.

Extension compares hashes; nothing is removed on their word. The words of every
repeat are then held against those of its source. Windows of a repeat that turns
out different are looked up once more by their words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_size, join_dealt, map_arrow, materialize, slices

LENGTH = 50
GRAM = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEED = 42
#: Windows looked at together, to bound memory on very long texts.
_STEP = 1 << 16


class _Hashes(dict):
    """Word to 64-bit hash; forgets everything when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def word_hashes(words: list[bytes], known: _Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` consecutive words; 64 bits, polynomial, mixed at the end."""
    total = len(words) - size + 1
    if total <= 0:
        return np.empty(0, dtype=np.uint64)
    out, done = np.zeros(total, dtype=np.uint64), 0
    power, span = words.copy(), 1  # power[i]: hash of `span` words from i
    step = _ODD
    while True:
        if size & span:
            out = out * step + power[done : done + total]
            done += span
        if done == size:
            break
        power = power[:-span] * step + power[span:]
        step, span = np.uint64(int(step) ** 2 & (1 << 64) - 1), 2 * span
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    return out ^ (out >> np.uint64(33))


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` grams, the place of its smallest (the first of equal ones)."""
    out = [sliding_window_view(grams[i : i + _STEP + width - 1], width).argmin(axis=1) + i for i in range(0, len(grams) - width + 1, _STEP)]
    places = np.concatenate(out) if out else np.empty(0, dtype=np.int64)
    return places + np.concatenate([np.arange(min(_STEP, len(places) - i)) for i in range(0, len(places), _STEP)]) if len(places) else places


def _windows(words: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the anchor, place of the anchor) for every window."""
    if len(words) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = gram_hashes(words, gram)
    places = anchors(grams, length - gram + 1)
    return grams[places], places


def _lists(rows: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind)))


def _read(length: int, gram: int):
    """Documents to (doc_id, key, n_words, sha, anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in slices(batches, 256):
            keys, sizes, shas, seeds = [], [], [], []
            for text in as_bytes(batch, "text"):
                words = text.split()
                keys.append(xxhash.xxh64_intdigest(text, _SEED))
                sizes.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                seeds.append(np.unique(_windows(word_hashes(words, known), length, gram)[0]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(shas), _lists(seeds, np.int64)], names=["doc_id", "key", "n_words", "sha", "anchors"])

    return run


def _extend(length: int, gram: int, bits: int):
    """(doc_id, key, seeds, text) to the windows that one of `seeds` is the anchor of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in slices(batches, 64):
            starts, hashes = [], []
            seeds = batch.column("seeds")
            for i, text in enumerate(as_bytes(batch, "text")):
                words = word_hashes(text.split(), known)
                own, _ = _windows(words, length, gram)
                shared = seeds[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.flatnonzero(np.isin(own, shared))
                starts.append(at)
                hashes.append((gram_hashes(words, length)[at] >> np.uint64(64 - bits)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), _lists(starts, np.int32), _lists(hashes, np.int64)], names=["doc_id", "key", "starts", "hashes"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans [first, end) that overlap or touch as one; sorted."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((first, end))
    return out


def keep_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for first, end in spans:
        out += words[at:first]
        at = end
    return out + words[at:]


_REPEAT = pa.struct([("src_id", pa.int64()), ("src_key", pa.int64()), ("src_start", pa.int32()), ("n", pa.int32()), ("starts", pa.list_(pa.int32()))])
_REPEAT_DDL = "doc_id long, key long, repeats array<struct<src_id: long, src_key: long, src_start: int, n: int, starts: array<int>>>"


def _repeats(length: int):
    """(doc_id, key, hits) to (doc_id, key, repeats): hits that go on in step with their source become one repeat.

    A hit is a window's start and where its words first stand (src_id, src_key,
    src_start). A repeat is n words of a source, and where they start in the document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = []
            for hits in batch.column("hits"):
                start, src_id, src_key, src_start = (hits.values.field(c).to_numpy() for c in ("start", "src_id", "src_key", "src_start"))
                order = np.argsort(start, kind="stable")
                start, src_id, src_key, src_start = start[order], src_id[order], src_key[order], src_start[order]
                on = (np.diff(start) == 1) & (np.diff(src_start) == 1) & (np.diff(src_id) == 0) & (np.diff(src_key) == 0)
                first = np.concatenate([[0], np.flatnonzero(~on) + 1])
                last = np.concatenate([first[1:], [len(start)]]) - 1
                own: dict[tuple[int, ...], list[int]] = {}
                for a, b in zip(first.tolist(), last.tolist(), strict=True):
                    own.setdefault((int(src_id[a]), int(src_key[a]), int(src_start[a]), b - a + length), []).append(int(start[a]))
                found.append([dict(zip(("src_id", "src_key", "src_start", "n", "starts"), (*k, v), strict=True)) for k, v in own.items()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(found, pa.list_(_REPEAT))], names=["doc_id", "key", "repeats"])

    return run


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src_id, src_key, parts, text) to (src_id, src_key, src_start, n, words): the sources' words of repeats."""
    names = ["src_id", "src_key", "src_start", "n", "words"]
    for batch in slices(batches, 64):
        rows = []
        for src_id, src_key, parts, text in zip(*(batch.column(c).to_pylist() for c in ("src_id", "src_key", "parts")), as_bytes(batch, "text"), strict=True):
            words = text.split()
            rows += [(src_id, src_key, x["src_start"], x["n"], b" ".join(words[x["src_start"] : x["src_start"] + x["n"]])) for x in parts]
        for at in range(0, len(rows), 1024):
            columns = zip(*rows[at : at + 1024], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=names)


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _remove(length: int):
    """(doc_id, key, found, exact, text) to (doc_id, key, spans, kept, unlike).

    `found` has repeats with their source's words, which are compared here; `exact`
    has starts of windows known to be repeats. `unlike` are starts of windows whose
    words are not the source's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            spans, kept, unlike = [], [], []
            for found, exact, text in zip(batch.column("found").to_pylist(), batch.column("exact").to_pylist(), as_bytes(batch, "text"), strict=True):
                words, own, wrong = text.split(), [(a, a + length) for a in exact or ()], []
                for repeat in found or ():
                    n, theirs = repeat["n"], repeat["words"].split(b" ")
                    for start in repeat["starts"]:
                        if words[start : start + n] == theirs:
                            own.append((start, start + n))
                        else:
                            wrong += range(start, start + n - length + 1)
                own = merged(own)
                spans.append([{"first": a, "end": b} for a, b in own])
                kept.append(b" ".join(keep_words(words, own)).decode())
                unlike.append(wrong)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(spans, _SPANS), pa.array(kept, pa.string()), pa.array(unlike, pa.list_(pa.int32()))], names=["doc_id", "key", "spans", "kept", "unlike"])

    return run


_CHANGED_DDL = "doc_id long, key long, spans array<struct<first: long, end: long>>, kept string, unlike array<int>"


def _windows_as_words(length: int):
    """(doc_id, key, starts, text) to (doc_id, key, start, words)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            for doc_id, key, starts, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "starts")), as_bytes(batch, "text"), strict=True):
                words = text.split()
                for at in range(0, len(starts), 1024):
                    part = starts[at : at + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(part), pa.int64()), pa.array([key] * len(part), pa.int64()), pa.array(part, pa.int32()), pa.array([b" ".join(words[a : a + length]) for a in part], pa.binary())], names=["doc_id", "key", "start", "words"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _with_texts(docs: DataFrame, side: DataFrame) -> DataFrame:
    """`side` (doc_id, key, …; a written table) with `text`: only rows that it names are moved."""
    ids = side.select("doc_id", "key")
    found = _texts(docs).join(by_size(ids, ids.count(), 48), ["doc_id", "key"], "left_semi")
    return found.dropDuplicates(["doc_id", "key"]).join(side, ["doc_id", "key"])


def _by_words(docs: DataFrame, windows: DataFrame, unlike: DataFrame, length: int) -> DataFrame:
    """(doc_id, key, exact) for windows that share a hash with one of `unlike`: starts of those that are repeats, by their words."""
    at = unlike.select("doc_id", "key", F.explode("unlike").alias("start"))
    hashes = materialize(at.join(windows, ["doc_id", "key", "start"]).select("window").distinct(), "unlike-windows")
    own = windows.join(by_size(hashes, hashes.count(), 16), "window", "left_semi").groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts"))
    rows = _with_texts(docs, materialize(own, "unlike-starts")).select("doc_id", "key", "starts", "text")
    rows = materialize(rows.transform(map_arrow, _windows_as_words(length), "doc_id long, key long, start int, words binary"), "window-words")
    first = rows.groupBy("words").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("source < last")
    again = join_dealt(rows, materialize(first.drop("last"), "window-sources"), ["words"], 400).where("source < doc_id")
    return materialize(again.groupBy("doc_id", "key").agg(F.collect_set("start").alias("exact")), "exact-windows")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(all, changed): all has (doc_id, key, n_words, sha) for each row of `docs`;
    changed has (doc_id, key, spans, kept) for each different document with a
    repeat, where kept is what is left of its text and spans are word positions.
    `bits` is the width of the hashes that windows meet by; it changes no result.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must be from 1 to length")
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_arrow, _read(length, gram), "doc_id long, key long, n_words long, sha string, anchors array<long>"), "anchors")
    seeds = rows.where(F.col("doc_id").isNotNull()).select("doc_id", "key", F.explode("anchors").alias("anchor"))
    shared = seeds.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    shared = materialize(shared.select("anchor", "n"), "shared-anchors")
    seeded = join_dealt(seeds, shared, ["anchor"], 24).groupBy("doc_id", "key").agg(F.collect_set("anchor").alias("seeds"))
    found = _with_texts(docs, materialize(seeded, "seeded"))
    windows = found.select("doc_id", "key", "seeds", "text").transform(map_arrow, _extend(length, gram, bits), "doc_id long, key long, starts array<int>, hashes array<long>")
    windows = materialize(windows, "windows").select("doc_id", "key", F.explode(F.arrays_zip("starts", "hashes")).alias("w"))
    windows = windows.select("doc_id", "key", F.col("w.starts").alias("start"), F.col("w.hashes").alias("window"))
    source = F.min(F.struct("doc_id", "key", "start")).alias("source")
    sources = windows.groupBy("window").agg(source, F.max("doc_id").alias("last"), F.count("*").alias("n")).where(F.col("source.doc_id") < F.col("last"))
    sources = materialize(sources.select("window", F.col("source.doc_id").alias("src_id"), F.col("source.key").alias("src_key"), F.col("source.start").alias("src_start"), "n"), "window-sources")
    # The windows of a very common passage are in a few hot keys, which don't meet by shuffle.
    hits = join_dealt(windows, sources, ["window"], 56).where(F.col("src_id") < F.col("doc_id"))
    hits = hits.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "src_id", "src_key", "src_start")).alias("hits"))
    own = materialize(hits.transform(map_arrow, _repeats(length), _REPEAT_DDL), "repeats").select("doc_id", "key", F.explode("repeats").alias("r")).select("doc_id", "key", "r.*")
    passages = materialize(own.groupBy("src_id", "src_key", "src_start", "n").agg(F.count("*").alias("rows")), "passages")
    parts = materialize(passages.groupBy(F.col("src_id").alias("doc_id"), F.col("src_key").alias("key")).agg(F.collect_list(F.struct("src_start", "n")).alias("parts")), "sources")
    words = _with_texts(docs, parts).select(F.col("doc_id").alias("src_id"), F.col("key").alias("src_key"), "parts", "text")
    words = words.transform(map_arrow, _passages, "src_id long, src_key long, src_start int, n int, words binary").join(passages, ["src_id", "src_key", "src_start", "n"])
    words = materialize(words, "passage-words")
    total = words.agg(F.coalesce(F.sum(F.octet_length("words") + 64), F.lit(0))).first()[0]
    found = join_dealt(own, words, ["src_id", "src_key", "src_start", "n"], -(-total // max(1, passages.count())), "rows")
    found = found.groupBy("doc_id", "key").agg(F.collect_list(F.struct("n", "starts", "words")).alias("found"))
    found = materialize(found, "found").withColumn("exact", F.lit(None).cast("array<int>"))
    removed = lambda side: _with_texts(docs, side).select("doc_id", "key", "found", "exact", "text").transform(map_arrow, _remove(length), _CHANGED_DDL)
    changed = materialize(removed(found), "changed")
    unlike = changed.where(F.size("unlike") > 0)
    if not unlike.isEmpty():
        exact = _by_words(docs, windows, unlike, length)
        both = found.drop("exact").join(exact, ["doc_id", "key"], "full")
        changed = materialize(removed(materialize(both, "found")), "changed")
    return rows.select("doc_id", "key", "n_words", "sha"), changed.where(F.size("spans") > 0).drop("unlike")


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans), a row for each row of `docs`.

    A word goes if it lies in a window of `length` consecutive words whose
    sequence also starts in a document with a smaller doc_id; windows are judged
    on the input. Null texts have no words. Rows that repeat a doc_id are no
    smaller than each other, so they don't remove from one another. Rows with a
    null doc_id neither lose words nor cost others any. Other columns are ignored.
    """
    rows, changed = repeats(docs, length, gram, bits)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    changed = changed.select("doc_id", "key", removed.alias("n"), F.sha2("kept", 256).alias("kept_sha"), "spans")
    out = rows.join(changed, ["doc_id", "key"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"), "spans")
