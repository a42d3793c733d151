"""Byte-level BPE by dynamic programming over byte prefixes.

For every prefix of a piece there is exactly one token that ends its BPE
encoding. A token fits after a prefix when the pair (last token of what stands
before it, token) is one that merging would leave alone. So each prefix stores
one token; the encoding is read backwards from the end. Appending bytes adds
states and changes none, and an edit re-computes states from the edit on.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: A worker remembers encodings of pieces in two generations, each of so many bytes at most (as `_Known` estimates them).
CACHE_BYTES = 16 << 20
#: Longer pieces are encoded each time.
CACHE_CHARS = 64
#: Pairs of tokens whose fit a worker remembers: about 130 bytes each.
PAIRS_MOST = 400_000
#: Longer texts are split match by match, so that no list of all their pieces is held.
LONG_CHARS = 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Ranks, and for each token the two tokens whose merge makes it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pairs: dict[int, bool] = {}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self.longest = max(map(len, ranks), default=1)
        #: Finds all tokens that end at each byte, the longest first. Tokens that no merge makes are left out.
        self.matcher = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) == 1 or self.parts(rank) is not None:
                self.matcher.add_word(token.decode("latin-1"), (len(token), rank))
        self.matcher.make_automaton()

    def parts(self, rank: int) -> tuple[int, int] | None:
        """The last merge that makes this token; None for a single byte, and for a token no merge makes."""
        if rank in self._parts:
            return self._parts[rank]
        token, ranks = self.tokens[rank], self.ranks
        row = [ranks[token[i : i + 1]] for i in range(len(token))]
        while len(row) > 2:
            best = min((ranks.get(self.tokens[a] + self.tokens[b], rank), i) for i, (a, b) in enumerate(zip(row, row[1:], strict=False)))
            if best[0] >= rank:
                break
            row[best[1] : best[1] + 2] = [best[0]]
        out = (row[0], row[1]) if len(row) == 2 else None
        self._parts[rank] = out
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens together ends with just these two."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS_MOST:
                self.pairs.clear()
            known = self.pairs[key] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        # Undo merges from the latest on. At each moment the tokens that touch at
        # the border must not merge before the border's own neighbours do.
        tokens, ranks = self.tokens, self.ranks
        a, b, next_merge = left, right, len(ranks) + (1 << 30)
        while True:
            across = ranks.get(tokens[a] + tokens[b])
            if across is not None and across < next_merge:
                return False
            pa_, pb = self.parts(a), self.parts(b)
            if pa_ is None and pb is None:
                return True
            # The later of both merges is undone; of one rank on both sides the right one came later.
            if pb is None or (pa_ is not None and a > b):
                a, next_merge = pa_[1], a
            else:
                b, next_merge = pb[0], b + 1


def extend(vocabulary: Vocabulary, data: str, last: list[int], offset: int = 0) -> None:
    """Add to `last` the last token of every further prefix of `data` (bytes as latin-1).

    `last[0]` stands for the empty prefix. `data` starts at byte `offset`, so far
    back that every token ending in a new byte begins in it.
    """
    pairs, fits, add = vocabulary.pairs.get, vocabulary.compatible, last.append
    done, moved = len(last) - 1 - offset, 1 + offset
    for at, (size, token) in vocabulary.matcher.iter(data):
        if at == done:
            before = last[at - size + moved]
            if before >= 0:
                known = pairs(before << 32 | token)
                if known is None:
                    known = fits(before, token)
                if not known:
                    continue
            add(token)
            done += 1
    if done != len(data):
        raise ValueError(f"no token of the vocabulary ends at byte {done + offset}")


class PrefixEncoder:
    """The encoding of a growing byte string, one stored token for each prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self._last: list[int] = [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes; the states of existing prefixes are exact and stay."""
        v, last, start = self.vocabulary, self._last, len(self.data)
        self.data += data
        before = max(0, start - v.longest)
        extend(v, self.data[before:].decode("latin-1"), last, before)

    def truncate(self, length: int) -> None:
        del self.data[length:]
        del self._last[length + 1 :]

    def replace(self, start: int, end: int, data: bytes) -> None:
        """Edit data[start:end]; prefixes before `start` are kept."""
        tail = bytes(self.data[end:])
        self.truncate(start)
        self.append(data + tail)

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self._last[at])
            at -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class _Known(dict):
    """Piece to ids (int32 as bytes): two generations, the older one dropped when the newer is full.

    Pieces that are a token stay whole, and stay here.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.whole, self.older, self.held = vocabulary, {}, {}, 0
        self.sizes = [len(token) for token in vocabulary.tokens]

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            data = piece.encode()
            token = self.vocabulary.ranks.get(data)
            if token is not None:
                out = self[piece] = self.whole[piece] = struct.pack("i", token)
                return out
            last, ids, at, sizes = [-1], [], len(data), self.sizes
            extend(self.vocabulary, data.decode("latin-1"), last)
            while at:
                ids.append(last[at])
                at -= sizes[last[at]]
            ids.reverse()
            out = struct.pack(f"{len(ids)}i", *ids)
        if len(piece) <= CACHE_CHARS:
            # two objects' heads and a place in the table, besides their contents
            self.held += 180 + 2 * len(piece) + len(out)
            if self.held >= CACHE_BYTES:
                self.older, self.held = dict(self), 0
                self.clear()
                self.update(self.whole)
            self[piece] = out
        return out


class Codec:
    """Splits text by the pattern and encodes each match on its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.vocabulary = Vocabulary(ranks)
        self._pattern = regex.compile(pattern)
        self._known = _Known(self.vocabulary)

    def encode(self, text: str) -> np.ndarray:
        known = self._known.__getitem__
        if len(text) <= LONG_CHARS:
            found = b"".join(map(known, self._pattern.findall(text)))
        else:
            found = bytearray()
            for match in self._pattern.finditer(text):
                found += known(match[0])
        return np.frombuffer(found, dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        token = self.vocabulary.tokens.__getitem__
        return b"".join(b"".join(map(token, ids[i : i + (1 << 16)].tolist())) for i in range(0, len(ids), 1 << 16))


@lru_cache(maxsize=1)
def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """One codec a worker process, whatever the number of its tasks."""
    return Codec(load_ranks(path), pattern)


def _free_names(taken: Iterable[str], *names: str) -> None:
    if used := {n.lower() for n in names} & {c.lower() for c in taken}:
        raise ValueError(f"columns {sorted(used)} exist already; choose other output names")


def _fields(df: DataFrame) -> list[str]:
    return [f"`{c}` {t}" for c, t in df.dtypes]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32()))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), pattern: str = public_tokenizers.PATTERN, data: str | None = None, exact: str | None = None) -> DataFrame:
    """`keep` columns and `ids` (array of int), a row for each row of `docs`.

    Where `data` is named, that column has the bytes that the ids decode to; where
    `exact` is named, that one says whether they are the text again. Both come from
    the worker that has just encoded the text, so ids aren't moved to be decoded.

    Null and empty texts give an empty array. No row is dropped or merged, so
    repeated rows stay repeated; other columns are ignored.
    """
    added = [(ids, "array<int>"), *([(data, "binary")] if data else []), *([(exact, "boolean")] if exact else [])]
    _free_names(keep, *(n for n, _ in added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, 64):
            texts = [x or "" for x in batch.column(text).to_pylist()]
            rows = [own.encode(x) for x in texts]
            columns = [*(batch.column(c) for c in keep), _lists(rows)]
            if data or exact:
                back = [own.decode(r) for r in rows]
                if data:
                    columns.append(pa.array(back, pa.binary()))
                if exact:
                    columns.append(pa.array([b == x.encode() for b, x in zip(back, texts, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(n for n, _ in added)])

    ddl = ", ".join([*_fields(docs.select(*keep)), *(f"`{n}` {t}" for n, t in added)])
    return docs.select(*dict.fromkeys([*keep, text])).transform(map_arrow, run, ddl)


def decode(df: DataFrame, path: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """`df` and `data` (binary), the bytes that `ids` stand for; null and empty ids give no bytes."""
    _free_names(df.columns, data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, 64):
            lists = batch.column(ids)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            rows = [own.decode(flat[a:b]) if ok else b"" for a, b, ok in zip(ends, ends[1:], lists.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], names=[*batch.schema.names, data])

    return df.transform(map_arrow, run, ", ".join([*_fields(df), f"`{data}` binary"]))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, from the ids and the bytes that they decode to."""
    both = encode(docs, path or public_tokenizers.path(RANK_FILE), data="data")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
