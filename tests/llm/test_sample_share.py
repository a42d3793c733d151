import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from quillsieve.llm import mixing


def shares(rows, name):
    held = {}
    for r in rows:
        held[r[name]] = held.get(r[name], 0) + r["n_tokens"] * r["probability"]
    return held


@pytest.mark.parametrize("window_most", [0, 1_000_000])
def test_tiny_source_beside_a_hot_one(make, monkeypatch, window_most):
    rng = random.Random(6)
    monkeypatch.setattr(mixing.rake, "__defaults__", (*mixing.rake.__defaults__[:2], window_most, None))
    docs = [(i, " ".join(["w"] * rng.randrange(50, 200))) for i in range(600)] + [(600, " ".join(["w"] * 10))]
    hot = F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5))
    df = make(docs).withColumn("source", F.when(F.col("doc_id") == 600, "tiny").otherwise(hot)).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 4))
    rows = mixing.mix(df, topic=F.lit("t"), sample_share=0.5, rounds=10 if not window_most else 40).collect()
    total = sum(r["n_tokens"] for r in rows)
    assert sum(shares(rows, "source").values()) == pytest.approx(total / 2, rel=1e-4)
    assert [r["probability"] for r in rows if r["source"] == "tiny"] == [1.0]
    assert max(r["probability"] for r in rows) <= 1
    for name in ("source", "lang"):
        goal = {}
        for r in rows:
            if r["source"] != "tiny" or name == "lang":
                goal[r[name]] = goal.get(r[name], 0) + r["n_tokens"]
        goal = {k: v ** mixing.POWERS[name] for k, v in goal.items()}
        held = shares(rows, name)
        whole = sum(held[k] for k in goal)
        for k, v in goal.items():
            assert held[k] / whole == pytest.approx(v / sum(goal.values()), rel=1e-3)


def test_stage_is_not_emptied_by_a_tiny_source(make, tmp_path):
    rng = random.Random(8)
    docs = [(i, " ".join(["w"] * rng.randrange(50, 200))) for i in range(600)] + [(600, "a b c")]
    df = make(docs).withColumn("source", F.when(F.col("doc_id") == 600, "tiny").otherwise("big")).withColumn("lang", F.lit("en"))
    kept = {r[0] for r in p.mixing_stage(None, df, str(tmp_path)).select("doc_id").collect()}
    assert 600 in kept and 230 < len(kept) < 370


def test_whole_share_keeps_all_and_bad_ones_are_errors(make, odd):
    docs = make([(i, "w " * (i + 1)) for i in range(30)])
    assert all(r["probability"] == pytest.approx(1) for r in mixing.mix(docs, sample_share=1.0).collect())
    assert mixing.mix(make([]), sample_share=0.5).count() == 0
    assert mixing.mix(make(odd), sample_share=0.5).count() == len(odd)
    with pytest.raises(ValueError):
        mixing.mix(docs, sample_share=0.0)


def test_few_cells_need_no_shuffle(make, odd, monkeypatch):
    class Seen(Exception):
        pass

    def look(cells, targets, *_, **__):
        raise Seen(targets._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(mixing, "rake", look)
    with pytest.raises(Seen) as seen:
        mixing.mix(make(odd))
    assert "Exchange" not in str(seen.value)
    monkeypatch.setattr(mixing, "ONE_TASK_CELLS", 0)
    with pytest.raises(Seen) as seen:
        mixing.mix(make(odd))
    assert "Exchange" in str(seen.value)
