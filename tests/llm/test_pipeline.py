import os
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as p
from quillsieve.llm import bpe, mixing
from quillsieve.llm import queries as q
from tests.llm import brute
from tests.oracle import DATA, expected, found

here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@here
@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert found(q.queries()[name](spark, DATA)) == expected(q.oracle_sql()[name])


@pytest.fixture(scope="module")
def tables(spark, make, odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    make(odd).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages_keep_columns_and_survive_odd_rows(spark, make, odd, tables):
    docs = make(odd)
    for name, stage in p.STAGES:
        for rows in (docs, make([])):
            out = stage(spark, rows, tables)
            if name != p.STAGES[-1][0]:
                assert out.dtypes == docs.dtypes
            assert out.count() <= rows.count()


def test_run(spark, tables):
    rows = p.run(spark, tables).collect()
    assert rows and all(r["exact"] for r in rows)


def test_line_stage_equals_brute_force(spark, make, odd, tables):
    docs = [(d, t) for d, t in odd if t is None or len(t) < 1000]
    want = sorted((d, k) for d, n, gone, k in brute.lines(docs) if d is not None and (not gone or k.strip()))
    got = p.line_stage(spark, make(docs), tables).where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit(""))).collect()
    assert sorted(map(tuple, got)) == want


def test_one_of_each_group_stays(spark, make, odd, tables):
    kept = p.near_duplicate_stage(spark, make(odd), tables).select("doc_id").collect()
    groups = {c for _, _, c in brute.near_duplicates(odd)}
    assert sorted(str(r[0]) for r in kept) == sorted(map(str, groups))


@here
def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").select("doc_id")
    kept = p.quality_stage(spark, docs, DATA)
    assert kept.join(good, "doc_id").count() >= 0.95 * docs.join(good, "doc_id").count()


def test_run_equals_brute_force(spark, make, tables, tmp_path):
    """All stages on texts with edited lines and near copies; without labels the first keeps all."""
    rng = random.Random(11)
    prose = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    docs, base = [], [[prose(9) for _ in range(12)] for _ in range(5)]
    for i in range(40):
        lines = list(rng.choice(base)) if i % 2 else [prose(9) for _ in range(rng.randrange(1, 9))]
        for _ in range(rng.randrange(4)):
            lines[rng.randrange(len(lines))] = prose(9) + f" {i}"
        docs.append((i, "\n".join(x + f"é {j} {rng.randrange(9)}" * (i % 3 == 0) for j, x in enumerate(lines))))
    folder = str(tmp_path / "t")
    make(docs).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    left = sorted((d, k) for d, n, gone, k in brute.lines(docs) if not gone or k.strip())
    sets = [brute.shingles(t) for _, t in left]
    roots = brute.roots(len(left), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    left = [row for i, row in enumerate(left) if roots[i] == i]
    before = {r["doc_id"]: r for r in make(docs).collect()}
    kept = spark.createDataFrame([before[d].asDict() | {"text": t, "n_chars": len(t)} for d, t in left], make([]).schema)
    chosen = {r["row"]["doc_id"] for r in mixing.mix(kept, sample_share=p.SAMPLE_SHARE).where("sampled").collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANK_FILE)), special_tokens={})
    want = sorted((d, library.encode_ordinary(t)) for d, t in left if d in chosen)
    got = sorted((r["doc_id"], list(r["ids"])) for r in p.run(spark, folder).collect())
    assert got == want and 0 < len(got) < len(left) < len(docs)
