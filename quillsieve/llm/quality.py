"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into blocks. Each block is compressed with both dictionaries;
text like the good examples gets shorter with the good dictionary. The score
comes from the difference of both sizes over the larger one, over the whole text
and in the block that speaks most for bad text. It is calibrated to a
probability by logistic regression on labelled texts that took no part in the
dictionaries; the calibration also knows what may shift the difference: how
short the text is, and how well it compresses without a dictionary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow, slices

#: Labelled texts of each class that are fitted on, at most: half for the dictionaries, half for calibration.
FIT_PER_CLASS = 2000
#: Longer texts are scored like any other but not fitted on; so the driver gets 125 MiB of them at most.
FIT_MAX_BYTES = 1 << 15
BLOCK = 512
DICTIONARY_BYTES = 112_640
LEVEL = 1
#: A text is predicted good from this score on.
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text; without a fit, the share of label 1."""
        if not self.weights:
            return np.full(len(texts), self.prior)
        measure = _measure(self.good, self.bad)
        logits = _expand(np.array([measure(t) for t in texts]).reshape(len(texts), -1), self.mean, self.scale) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


@lru_cache(maxsize=2)
def _measure(good: bytes, bad: bytes):
    """Text to (difference, that of the worst block, plain size per byte, length term)."""
    sizes = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d)).compress for d in (good, bad)]
    plain = zstandard.ZstdCompressor(level=LEVEL).compress

    def measure(text: bytes) -> tuple[float, ...]:
        a = b = 0
        worst = 1.0
        for start in range(0, max(len(text), 1), BLOCK):
            part = text[start : start + BLOCK]
            u, v = len(sizes[0](part)), len(sizes[1](part))
            a, b = a + u, b + v
            if 2 * len(part) > BLOCK or len(text) < BLOCK:
                worst = min(worst, (v - u) / max(u, v))
        n = max(1, len(text))
        return (b - a) / max(a, b), worst, len(plain(text)) / n, n**-0.5

    return measure


def _expand(x: np.ndarray, mean: tuple[float, ...], scale: tuple[float, ...]) -> np.ndarray:
    x = np.clip((x - np.array(mean)) / np.array(scale), -8, 8)
    return np.hstack([np.ones((len(x), 1)), x, x**2, x[:, :1] * x[:, 1:]])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = p * (1 - p) + 1e-9
        step = np.linalg.solve((x * curve[:, None]).T @ x + ridge * len(x) * np.eye(len(w)), x.T @ (y - p) - ridge * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_texts(good: list[bytes], bad: list[bytes], share: float) -> Model:
    """A model of the texts; `share` is the share of label 1 among all labels.

    With fewer than eight texts of either class nothing is learned but the share.
    """
    share = min(max(share, 1e-3), 1 - 1e-3)
    if min(len(good), len(bad)) < 8:
        return Model(b"", b"", (), (), (), share)
    blocks = lambda texts: [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    dictionaries = []
    for texts in (good[::2], bad[::2]):
        parts = blocks(texts)
        try:
            dictionaries.append(zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, parts)) // 4)), parts).as_bytes())
        except zstandard.ZstdError:  # too little text to choose from: the text itself
            dictionaries.append(b"".join(parts)[:DICTIONARY_BYTES].ljust(8, b" "))
    measure = _measure(*dictionaries)
    x = np.array([measure(t) for t in good[1::2] + bad[1::2]])
    y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = _logistic(_expand(x, tuple(mean), tuple(scale)), y)
    w[0] += np.log(share / (1 - share)) - np.log(y.sum() / (len(y) - y.sum()))  # back from equal classes
    return Model(*dictionaries, tuple(mean), tuple(scale), tuple(w), float(share))


def held_out(doc_id):
    """Rows that no label is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = FIT_PER_CLASS) -> Model:
    """Learn from a bounded sample of the labelled rows that aren't held out.

    Ids are chosen by the hash of doc_id, the same at any partitioning. Rows
    with null or contradictory labels are left out; so are texts over FIT_MAX_BYTES.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    known = known.where("lo = hi").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("lo").alias("quality"))
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    picked = None
    for label in (0, 1):
        some = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    # at most 2 * per_class ids are broadcast, and as many texts reach the driver
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= FIT_MAX_BYTES)
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    sides = [[r["text"].encode() for r in rows if r["quality"] == label] for label in (1, 0)]
    total = sum(counts.values())
    return fit_texts(*sides, counts.get(1, 0) / total if total else 0.5)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """`keep` columns and `name`, a row for each row of `docs`; null texts count as empty."""
    fields = docs.select(*keep).dtypes
    if name.lower() in {c.lower() for c in keep}:
        raise ValueError(f"column {name} exists already; choose another output name")
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            scores = shipped.value.scores(as_bytes(batch, "text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], names=[*keep, name])

    ddl = ", ".join(f"`{c}` {t}" for c, t in fields)
    return docs.select(*dict.fromkeys([*keep, "text"])).transform(map_arrow, run, f"{ddl}, `{name}` double")


def classify(docs: DataFrame, labels: DataFrame, per_class: int = FIT_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of `docs`.

    Whole texts are scored, from nothing but the text; null texts count as empty.
    A null doc_id is not held out. With too few labels every score is the share
    of label 1. Repeated rows stay repeated; an empty table gives no rows.
    """
    out = score(docs, fit(docs, labels, per_class))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
