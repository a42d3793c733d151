import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quillsieve.llm import common, exact_dedup, line_dedup, pivot, simhash, substring
from quillsieve.llm import components as graph
from quillsieve.llm.components import components
from tests.llm import brute


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("chunk", [1 << 10, 1 << 20])
def test_exact_odd_rows(make, odd, chunk):
    assert got(exact_dedup.exact_dedup(make(odd), chunk), *EXACT) == brute.exact(odd)


def test_exact_many_chunks(make):
    docs = [(i, "".join(chr(97 + j % (5 + i % 3)) for j in range(100))) for i in range(12)]
    assert got(exact_dedup.exact_dedup(make(docs), 7), *EXACT) == brute.exact(docs)


def test_hot_keys_don_t_meet_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "by_size", lambda df, rows, width: F.broadcast(df) if rows <= 2 else df)
    rows = spark.createDataFrame([(k, i) for k in range(20) for i in range(30 if k in (3, 7) else k % 4)], "k int, v int")
    side = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m")).where("k <> 5")
    want = sorted((k, v, n, m) for k, v, n, m in rows.join(side, "k").select("k", "v", "n", "m").collect())
    assert sorted(map(tuple, common.join_dealt(rows, side, ["k"], 1).select("k", "v", "n", "m").collect())) == want
    left = common.join_dealt(rows, side, ["k"], 1, how="left")
    assert left.count() == rows.count() and left.where("m IS NULL").select("k").distinct().collect() == [(5,)]


def test_exact_survives_colliding_fingerprints(make):
    # Bases 1 and 1: the fingerprint is the sum of bytes, so anagrams collide.
    docs = [(i, t) for i, t in enumerate(["abc", "cab", "abc", "bca", "cab", "xyz", "abc"])]
    assert got(exact_dedup.exact_dedup(make(docs), bases=(1, 1)), *EXACT) == brute.exact(docs)


def test_exact_large_group_meets_in_blocks(make, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMBERS_PER_SALT", 3)
    docs = [(i, "same") for i in range(20)] + [(99, "other")]
    assert got(exact_dedup.exact_dedup(make(docs)), *EXACT) == brute.exact(docs)


def test_exact_empty(make):
    assert exact_dedup.exact_dedup(make([])).count() == 0


def test_fingerprints_compose():
    h, data = exact_dedup.Fingerprint(), random.Random(1).randbytes(200_000)
    for cut in (0, 1, 65_536, 65_537, 200_000):
        a, b = data[:cut], data[cut:]
        assert h.combine(h(a), h(b), len(b)) == h(data)


SIM = ("doc_id", "fingerprint", "component_id")


def test_simhash_odd_rows(make, odd):
    assert got(simhash.near_duplicates(make(odd)), *SIM) == brute.near_duplicates(odd)


def _variants(count, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    docs = []
    for i in range(count):
        words = list(base) if i % 3 else [f"v{rng.randrange(500)}" for _ in range(40)]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(500)}"
        docs.append((i, " ".join(words)))
    return docs


def test_simhash_groups(make):
    docs = _variants(90)
    assert got(simhash.near_duplicates(make(docs)), *SIM) == brute.near_duplicates(docs)


@pytest.mark.parametrize("most", [2, 4096])
def test_links_lose_no_pair(spark, most):
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    chain = [prints[0]]
    for _ in range(60):  # a chain and a dense group, so that cells are cut again
        chain.append(chain[-1 if len(chain) < 30 else 0] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))))
    prints = np.unique(np.concatenate([prints, chain]))
    table = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    found = components(simhash.links(table, 4, most)).collect()
    label = {r["node"]: r["root"] for r in found}
    root = brute.roots(len(prints), lambda i, j: int(prints[i] ^ prints[j]).bit_count() <= 4)
    ids = prints.view(np.int64).tolist()
    for i in range(len(ids)):
        for j in range(i):
            same = label.get(ids[i], ids[i]) == label.get(ids[j], ids[j])
            assert same == (root[i] == root[j])


def test_pivots_discard_only_what_is_far():
    rng = np.random.default_rng(3)
    prints = np.unique(np.concatenate([rng.integers(0, 1 << 64, 50, dtype=np.uint64), np.uint64(7) ^ (np.uint64(1) << np.arange(0, 60, 2, dtype=np.uint64))]))
    table = pivot.PivotTable(prints, pivot.distances(prints, pivot.pivots()))
    for i in range(len(prints)):
        want = [j for j in range(len(prints)) if int(prints[i] ^ prints[j]).bit_count() <= 4]
        assert table.linked(i, np.arange(len(prints)), 4).tolist() == want
    assert table.passed < table.met / 2


def test_simhash_long_text_in_steps(monkeypatch):
    text = " ".join(f"w{i % 91}" for i in range(500))
    monkeypatch.setattr(simhash, "_STEP", 64)
    assert simhash.fingerprint(text.encode()) == brute.simhash(text)


def test_simhash_empty(make):
    assert simhash.near_duplicates(make([])).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 1), (3, 2), (9, 8), (8, 7), (5, 5), (7, None), *[(i, i + 1) for i in range(20, 60)], *[(100, i) for i in range(101, 140)]]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: found.get(n, n) for n in (1, 2, 3, 7, 8, 9, 5, 20, 60, 100, 139)} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 5: 5, 20: 20, 60: 20, 100: 100, 139: 100}


def test_a_round_over_few_edges_spares_the_driver(spark, monkeypatch):
    edges = common.materialize(spark.range(1, 99).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")), "edges")
    plan = lambda: graph._star(edges, 98)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan()
    few = sorted(map(tuple, components(edges).collect()))
    monkeypatch.setattr(graph, "ONE_TASK_EDGES", 0)
    assert "Exchange" in plan()
    assert few == sorted(map(tuple, components(edges).collect())) == [(i, 0) for i in range(1, 99)]


SUB = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_substring_odd_rows(make, odd):
    assert got(substring.substring_dedup(make(odd)), *SUB) == brute.substring(odd)


def _passages(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(6)}"
    shared = [[word() for _ in range(rng.randrange(30, 120))] for _ in range(6)]
    docs = []
    for i in range(40):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choice(shared) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(60))]
        docs.append((i // 2 if i % 7 == 0 else i, " ".join(words)))
    return docs + [(50, "a " * 130), (51, "a " * 49), (52, "a " * 50)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("length,gram", [(50, 16), (20, 20), (5, 1)])
def test_substring_passages(make, seed, length, gram):
    docs = _passages(seed)
    assert got(substring.substring_dedup(make(docs), length, gram), *SUB) == brute.substring(docs, length)


def test_substring_survives_colliding_hashes(make):
    """With hashes of two bits, all kinds of windows share one; words decide."""
    docs = _passages(3)
    assert got(substring.substring_dedup(make(docs), bits=2), *SUB) == brute.substring(docs)


def test_substring_repeats_are_maximal(make, monkeypatch):
    """One repeat for a passage, however many windows it has, and one source for a passage that many have."""
    text = " ".join(f"w{i}" for i in range(200))
    seen = []
    real = substring.merged
    monkeypatch.setattr(substring, "merged", lambda spans: seen.append(spans) or real(spans))
    run = substring._remove(50)
    batch = pa.RecordBatch.from_pydict({"doc_id": [2], "key": [0], "found": [[{"n": 200, "starts": [3], "words": text.encode()}, {"n": 50, "starts": [0], "words": b"other"}]], "exact": [None], "text": ["a b c " + text + " d"]})
    out = next(run(iter([batch]))).to_pylist()[0]
    assert seen == [[(3, 203)]] and (out["kept"], out["unlike"]) == ("a b c d", [0])


def test_substring_empty_and_spans(make):
    assert substring.substring_dedup(make([])).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    spans = {r["doc_id"]: r["spans"] for r in substring.substring_dedup(make([(1, text), (2, "x y " + text + " z")])).collect()}
    assert spans[1] is None and [tuple(s) for s in spans[2]] == [(2, 62)]


def lines(df):
    return got(df, "row.doc_id", "n_lines", "n_removed", "kept")


def test_lines_odd_rows(make, odd):
    assert lines(line_dedup.line_dedup(make(odd))) == brute.lines(odd)


def _edited(seed, count=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randrange(20, 32))) for _ in range(4)]
    out = []
    for i in range(count):
        own = []
        for _ in range(rng.randrange(1, 4)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(2)] = rng.choice(["", "x", "yé"])
            own.append("".join(line))
        out.append((i, "\n".join(own)))
    return out


@pytest.mark.parametrize("key_most,verify", [(2, "levenshtein"), (64, "levenshtein"), (64, "bits")])
@pytest.mark.parametrize("distance", [1, 2])
def test_lines_lose_no_near_line(make, monkeypatch, key_most, verify, distance):
    monkeypatch.setattr(line_dedup, "VERIFY", verify)
    docs = _edited(distance)
    assert lines(line_dedup.line_dedup(make(docs), distance, key_most=key_most)) == brute.lines(docs, distance)


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_bits_equal_the_edit_distance(spark, distance):
    rng = random.Random(distance)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("ab\u00e9\U0001f600") for _ in range(rng.randrange(12)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "bb"])
        pairs.append((a, "".join(b)))
    table = spark.createDataFrame(pairs, "a string, b string")
    for r in table.select("a", "b", line_dedup._bits("a", "b", distance).alias("near")).collect():
        assert r["near"] == (brute.edits(r["a"], r["b"]) <= distance)


def test_lines_with_one_common_segment(make):
    """Every line has a part in common with all others; they are not compared with each other for that."""
    rng = random.Random(9)
    part = "a common part of lines "
    docs = [(i, part + "".join(rng.choice("abcd") for _ in range(rng.choice([24, 25])))) for i in range(150)]
    docs += [(200 + i, t[:30] + "x" + t[31 + i % 2 :]) for i, (_, t) in enumerate(docs[:20])] + [(300, part + "12"), (301, part + "345"), (302, part + "3456")]
    assert lines(line_dedup.line_dedup(make(docs), key_most=4)) == brute.lines(docs)


def test_lines_seen_often(make, monkeypatch):
    monkeypatch.setattr(line_dedup, "OFTEN", 3)
    docs = [(i, "one line that everyone has\nand number %d of the others" % (i // 9)) for i in range(30)]
    assert lines(line_dedup.line_dedup(make(docs))) == brute.lines(docs)


def test_lines_empty(make):
    assert line_dedup.line_dedup(make([])).count() == 0


def test_lines_are_native(make, capsys):
    line_dedup.line_dedup(make([(1, "x" * 30), (2, "x" * 30)])).explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Arrow", "Pandas"))
