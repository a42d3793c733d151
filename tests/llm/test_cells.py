import random

import numpy as np

import corpus_pipeline as p
from quillsieve.llm import shingles, simhash
from tests.llm import brute
from tests.llm.test_shingles import alike


def family(members, edits, seed=5):
    """Texts with random edits of one base, most of them further apart than links go."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for at in range(members):
        words = list(base)
        for _ in range(rng.choice(edits)):
            words[10 * rng.randrange(15)] = f"x{rng.randrange(2)}"
        docs.append((at, " ".join(words)))
    return docs


def roots_of(docs):
    sets = [brute.shingles(t) for _, t in docs]
    return brute.roots(len(docs), lambda i, j: alike(sets[i], sets[j]))


def test_pairs_of_a_large_group_grow_with_its_members(make, tmp_path, monkeypatch):
    docs, met, verified = family(600, (5, 6, 7, 8)), [], shingles._verified

    def counted(pairs, *rest):
        met.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(shingles, "_verified", counted)
    kept = p.near_duplicate_stage(None, make(docs), str(tmp_path)).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == sorted(set(roots_of(docs)))
    assert sum(met) < 60 * len(docs) < len(docs) ** 2 / 4


def test_stage_starts_with_the_operators_own_search(make, tmp_path, monkeypatch):
    """Finding F1 of round 2: cells of fingerprint bits and pivot tables come first."""
    docs, found, links = family(40, (0, 1)), [], simhash.links

    def spied(*args):
        out = links(*args)
        found.append(out.count())
        return out

    monkeypatch.setattr(simhash, "links", spied)
    kept = p.near_duplicate_stage(None, make(docs), str(tmp_path)).select("doc_id").collect()
    assert found and found[0] > 0
    assert sorted(r[0] for r in kept) == sorted(set(roots_of(docs)))


def test_similar_sets_meet_in_any_order():
    rng = np.random.default_rng(3)
    part, whole = shingles.SIMILARITY
    for _ in range(2000):
        shared = int(rng.integers(1, 80))
        more = rng.multinomial(int(rng.integers(0, shared // 4 + 1)), [0.5, 0.5])
        pool = np.unique(rng.integers(0, 1 << 63, shared + more.sum(), dtype=np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[: shared + more[0]]), np.sort(np.concatenate([pool[:shared], pool[shared + more[0] :]]))
        frequent = np.sort(rng.choice(pool, len(pool) // 2, replace=False))
        counts = rng.integers(2, 9, len(frequent))
        one, two = (shingles.marks(s, frequent, counts, (part, whole)).tolist() for s in (a, b))
        least = shingles._least_shared(len(a), len(b), (part, whole))
        assert any(len(a) - one.index(x) >= least and len(b) - two.index(x) >= least for x in set(one) & set(two))


def test_small_sets_keep_one_mark():
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    sizes = [len(shingles.marks(np.arange(n, dtype=np.uint64), *none, (4, 5))) for n in (1, 2, 4, 5, 6, 10, 11, 100)]
    assert sizes == [1, 1, 1, 2, 2, 3, 3, 21]
    assert len(shingles.marks(np.empty(0, np.uint64), *none, (4, 5))) <= 1
