"""Line deduplication by a segment-partition edit join.

Two lines within `distance` edits have a segment in common when one of them is
cut into distance + 1 segments: edits touch `distance` of them at most. Every
long line is indexed under (its length, segment number, segment). It probes
with those of its substrings that could be a segment of a line of its length or
up to `distance` shorter; from the lengths and the segment's number it follows
which few places are worth a probe. Lines that meet are verified by a banded edit
distance: Spark's own, which stops as soon as the limit is passed, or a
bit-parallel one with a bit for each diagonal of the band and a vector for each
number of errors (VERIFY).

All of it is DataFrame functions. Texts of lines are moved for verification only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_size, materialize

DISTANCE = 2
MIN_CHARS = 20
#: Length from which the query and the pipeline drop exact repeats of lines under MIN_CHARS.
EXACT_CHARS = 1
#: Lines that meet under one key by pairs; more of them meet the key's first line, then block by block.
KEY_MOST = 64
_BLOCK = 256
#: Lines seen more often are cut into segments where they are first seen only.
OFTEN = 100


def _probes(distance: int) -> list[tuple[int, int, int, bool]]:
    """(shorter, segment, move, indexed) of all keys of a line.

    A line of `length` is cut into distance + 1 segments, the shorter ones first.
    For a line `shorter` characters shorter, `move` is how far a segment can have
    moved. Its own segments are those with neither, and they probe as well.
    """
    out = []
    for shorter in range(distance + 1):
        for s in range(distance + 1):
            moves = range(max(-s, shorter - (distance - s)), min(s, shorter + distance - s) + 1)
            out += [(shorter, s, move, (shorter, move) == (0, 0)) for move in moves]
    return out


def _keyed(lines: DataFrame, distance: int, min_chars: int) -> DataFrame:
    """(id, seg, indexed) of lines (id, line): one small expression for each of a line's keys.

    One expression over all keys would be too large a method for the JVM to compile.
    """
    kinds = F.array(*[F.struct(F.lit(d).alias("shorter"), F.lit(s).alias("s"), F.lit(m).alias("move"), F.lit(i).alias("indexed")) for d, s, m, i in _probes(distance)])
    rows = lines.select("id", "line", F.length("line").alias("length"), F.explode(kinds).alias("k")).select("id", "line", "length", "k.*")
    count = distance + 1
    other = F.col("length") - F.col("shorter")
    longer = other % count
    short = F.lit(count) - longer
    base = ((other - longer) / count).cast("int")
    start = base * F.col("s") + F.greatest(F.lit(0), F.col("s") - short) + F.col("move")
    size = base + (F.col("s") >= short).cast("int")
    rows = rows.select("id", "line", "length", "s", "indexed", other.alias("other"), start.alias("at"), size.alias("size"))
    rows = rows.where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("length")) & (F.col("other") >= min_chars))
    return rows.select("id", F.xxhash64("other", "s", F.substring("line", F.col("at") + 1, F.col("size"))).alias("seg"), "indexed")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, key, line_no, line); `key` tells documents apart that share a doc_id."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.split(text, "\n", -1).alias("parts"))
    return rows.select("doc_id", "key", F.posexplode("parts").alias("line_no", "line"))


def _two_hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def near_lines(lines: DataFrame, seen: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS, key_most: int = KEY_MOST) -> DataFrame:
    """(h1, h2) of the lines that have a different line within `distance` that is first seen earlier.

    `lines` has doc_id, key, line_no and line; `seen` has (h1, h2, first, n) for each different one.
    """
    own = lines.withColumn("id", F.xxhash64("line"))
    often = materialize(seen.where(F.col("n") > OFTEN).select(F.col("h1").alias("id"), F.col("first").alias("once")), "often")
    once = own.join(by_size(often, often.count(), 64), "id", "left").where(F.col("once").isNull() | (F.struct("doc_id", "key", "line_no") == F.col("once")))
    # The only large exchange: 16 bytes a row, the id's last bit telling a line's own segments from mere probes.
    keys = _keyed(once.select("id", "line"), distance, min_chars).select("seg", F.col("id").bitwiseAND(-2).bitwiseOR(F.col("indexed").cast("long")).alias("who")).repartition("seg")
    all_of = Window.partitionBy("seg")
    line_of = F.shiftright("who", 1)
    shared = keys.select("seg", "who", F.min(line_of).over(all_of).alias("lo"), F.max(line_of).over(all_of).alias("hi"), F.max(F.col("who").bitwiseAND(1)).over(all_of).alias("any"))
    shared = shared.where("lo < hi AND any = 1").groupBy("seg", line_of.alias("id")).agg(F.max(F.col("who").bitwiseAND(1)).alias("i"))
    shared = materialize(shared.withColumn("n", F.count("*").over(all_of)), "shared-segments")
    hot = shared.where(F.col("n") > key_most)
    cold = shared.where(F.col("n") <= key_most)
    a, b = cold.where("i = 1").select("seg", F.col("id").alias("a")), cold.select("seg", F.col("id").alias("b"))
    pairs = a.join(b, "seg").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(hot.select("id"))
    wanted = materialize(wanted.distinct(), "wanted")
    texts = lines.select("line").withColumn("id", F.shiftright(F.xxhash64("line"), 1)).join(by_size(wanted, wanted.count(), 24), "id", "left_semi").distinct()
    texts = texts.select("id", "line", *_two_hashes(F.col("line"))).join(seen.select("h1", "h2", "first"), ["h1", "h2"])
    texts = materialize(texts.select("id", "line", "h1", "h2", "first"), "texts")
    ends = [texts.select(F.col("id").alias(e), F.struct("line", "h1", "h2", "first").alias(f"{e}_")) for e in ("a", "b")]
    both = pairs.join(ends[0], "a").join(ends[1], "b").where(_within("a_.line", "b_.line", distance))
    later = F.when(F.col("a_.first") > F.col("b_.first"), F.col("a_")).otherwise(F.col("b_"))
    near = both.select(later["h1"].alias("h1"), later["h2"].alias("h2"))
    # Where two lines have one id they are in each other's place here; the text decides.
    twins = texts.groupBy("id").agg(F.count("*").alias("n"), F.collect_list(F.struct("first", "line", "h1", "h2")).alias("l")).where("n > 1")
    twins = twins.select(F.explode("l").alias("x"), "l").select("x", F.explode("l").alias("y")).where((F.col("x.first") > F.col("y.first")) & _within("x.line", "y.line", distance))
    near = near.unionByName(twins.select("x.h1", "x.h2"))
    if not hot.isEmpty():
        near = near.unionByName(_hot(hot, texts, distance))
    return near.distinct()


def _bits(a: str, b: str, distance: int) -> Column:
    """Whether lines are within `distance`, by bits for the 2 * distance + 1 diagonals that can matter.

    Bit d of vector e says that at most e errors lead to the prefixes of i and i + d - distance
    characters. One step takes a character of `a`: the same vector where the characters
    agree, and from the vector of one error less the same diagonal (replaced), the one
    above (left out), and, within the step, the one below (put in).
    """
    width = 2 * distance + 1
    full = (1 << width) - 1

    def put_in(vectors: list[Column]) -> list[Column]:
        out = vectors[:1]
        for v in vectors[1:]:
            out.append(v.bitwiseOR(out[-1]).bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(full)))
        return out

    zero = F.lit(0)
    # `b` between marks that no line holds, so that every diagonal has a character.
    padded = F.concat(F.lit("\n" * distance), F.col(b), F.lit("\n" * (distance + 1)))

    def step(state: Column, i: Column) -> Column:
        mine, theirs = F.substring(F.col(a), i, F.lit(1)), F.substring(padded, i, F.lit(width))
        same = zero
        for d in range(width):
            same = same.bitwiseOR(F.when(F.substring(theirs, d + 1, 1) == mine, F.lit(1 << d)).otherwise(zero))
        out = []
        for e in range(distance + 1):
            v = state[e].bitwiseAND(same)
            if e:
                v = v.bitwiseOR(state[e - 1]).bitwiseOR(F.shiftright(state[e - 1], 1))
            out.append(v)
        return F.array(*put_in(out))

    start = F.array(*put_in([F.lit(1 << distance)] + [zero] * distance))
    ends = F.aggregate(F.sequence(F.lit(1), F.length(a)), start, step)
    at = F.length(b) - F.length(a) + distance
    inside = F.when((at < 0) | (at >= width), F.lit(False)).otherwise(F.getbit(ends[distance], at) == 1)
    return F.when(F.length(a) == 0, F.length(b) <= distance).otherwise(inside)


#: How lines that met are verified: 'bits', or 'levenshtein', Spark's built-in function with a limit, which is banded but
#: not bit-parallel. Both give the same; built-in functions have no loop over characters that the JVM compiles, so bits
#: cost over ten times as much (figures in the README).
VERIFY = "levenshtein"


def _within(a: str, b: str, distance: int) -> Column:
    return _bits(a, b, distance) if VERIFY == "bits" else F.levenshtein(F.col(a), F.col(b), distance) >= 0


def _hot(shared: DataFrame, texts: DataFrame, distance: int) -> DataFrame:
    """The same for keys with very many lines, without a row for each pair.

    The key's first line settles all lines near it. The rest is dealt into blocks
    that meet the key's lines; only what is near leaves the join.
    """
    member = shared.select("seg", "id", "i", "n").join(texts, "id")
    leader = member.groupBy("seg").agg(F.min(F.struct("first", "line")).alias("lead"))
    led = member.join(leader, "seg").withColumn("near", (F.col("first") > F.col("lead.first")) & _within("line", "lead.line", distance))
    led = materialize(led.drop("lead"), "led")
    settled = led.where("near").select("h1", "h2").distinct()
    # Lines settled under any key need no other witness, but may be one.
    open_ = led.join(settled.withColumn("done", F.lit(True)), ["h1", "h2"], "left").where("done IS NULL")
    blocks = F.ceil(F.col("n") / _BLOCK).cast("int")
    left = open_.select("seg", F.pmod(F.xxhash64("id"), blocks).alias("block"), "h1", "h2", "line", "first", "i")
    right = led.select("seg", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.col("line").alias("other"), F.col("first").alias("other_first"), F.col("i").alias("other_i"))
    meets = (F.col("i") == 1) | (F.col("other_i") == 1)
    on = [left["seg"] == right["seg"], left["block"] == right["block"], F.col("other_first") < F.col("first"), meets, _within("line", "other", distance)]
    return settled.unionByName(left.join(right, on, "left_semi").select("h1", "h2"))


def repeated_lines(docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS, key_most: int = KEY_MOST, exact_chars: int | None = None) -> DataFrame:
    """(doc_id, key, removed): for documents that lose lines, the numbers of those, from 0."""
    least = min_chars if exact_chars is None else exact_chars
    lines = lines_of(docs).where((F.length("line") >= min_chars) | ((F.length("line") >= least) & F.col("line").rlike(r"[^\x20\x09-\x0D]")))
    long = F.length("line") >= min_chars
    at = F.struct("doc_id", "key", "line_no")
    seen = lines.select(*_two_hashes(F.col("line")), at.alias("at"), long.alias("long")).groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"), F.max("long").alias("long"))
    seen = materialize(seen, "lines")
    near = near_lines(lines.where(long), seen.where("long").select("h1", "h2", "first", "n"), distance, min_chars, key_most).withColumn("near", F.lit(True))
    touched = seen.join(near, ["h1", "h2"], "left").where((F.col("first") < F.col("last")) | F.col("near"))
    touched = materialize(touched.select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "touched")
    rows = lines.select("doc_id", "key", "line_no", *_two_hashes(F.col("line"))).join(by_size(touched, touched.count(), 80), ["h1", "h2"])
    gone = rows.where(F.col("near") | (F.struct("doc_id", "key", "line_no") > F.col("first")))
    return gone.groupBy("doc_id", "key").agg(F.collect_set("line_no").alias("removed"))


def line_dedup(docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS, key_most: int = KEY_MOST, exact_chars: int | None = None) -> DataFrame:
    """(row, n_lines, n_removed, kept), a row for each row of `docs`; `row` holds all its columns.

    Of lines with at least `min_chars` characters, one goes if the same line, or a
    different one within `distance` edits, is first seen earlier: by doc_id, then
    line number. Of shorter lines with at least `exact_chars` characters, one goes
    if the same line is first seen earlier, but blank ones stay; without
    `exact_chars` all of them stay. Texts are split at line feeds only; `kept` is
    what stays, joined by them. Null texts count as one empty line. Null doc_ids
    come before all others. Documents that share doc_id and text are the same one
    and keep the same lines; documents that only share doc_id are put in order
    by a hash of the text.
    """
    gone = materialize(repeated_lines(docs, distance, min_chars, key_most, exact_chars), "removed")
    n = gone.count()
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    texts = texts.select("row", F.col("row.doc_id").cast("long").alias("d"), F.xxhash64(text).alias("k"))
    own = gone.select(F.col("doc_id").alias("g"), F.col("key").alias("gk"), "removed")
    out = texts.join(by_size(own, n, 160), F.col("d").eqNullSafe(F.col("g")) & (F.col("k") == F.col("gk")), "left").withColumn("parts", F.split(text, "\n", -1))
    kept = F.array_join(F.filter("parts", lambda _, i: ~F.coalesce(F.array_contains("removed", i), F.lit(False))), "\n")
    kept = F.when(F.col("removed").isNull(), text).otherwise(kept)
    removed = F.coalesce(F.array_size("removed"), F.lit(0)).cast("long")
    return out.select("row", F.size("parts").cast("long").alias("n_lines"), removed.alias("n_removed"), kept.alias("kept"))
