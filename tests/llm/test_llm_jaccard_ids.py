"""Jaccard links where one id, or none, holds several unlike texts."""

import random

import pyarrow as pa

from tallybook.llm import jaccard

SCHEMA = "doc_id long, text string"
SIZE, PERCENT = 4, 85


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + SIZE]) for i in range(len(words) - SIZE + 1)} or ({tuple(words)} if words else set())


def brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    ids = [jaccard.LAST if k is None else k for k, _ in rows]
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= PERCENT * len(a | b):
                low, high = sorted((find(ids[i]), find(ids[j])))
                root[high] = low
    out = lambda k: None if k == jaccard.LAST else k
    return sorted((str(out(k)), len(s), str(out(find(k)))) for k, s in zip(ids, sets))


def families(seed):
    """Families of near copies, each large enough for a cell, and what else lies near them."""
    made = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]

    def near(base, changes):
        words = list(base)
        for at in made.sample(range(len(words)), changes):
            words[at] = made.choice(vocabulary)
        return words

    bases = [made.choices(vocabulary, k=120) for _ in range(8)]
    rows = []
    for f, base in enumerate(bases):
        rows += [(100 * f + i, near(base, made.randrange(0, 3))) for i in range(12)]
    # ids whose rows lie in several families, or in one and nowhere else
    for n in range(6):
        rows += [(2000 + n, near(bases[n], 1)), (2000 + n, near(lone := made.choices(vocabulary, k=120), 0))]
        rows += [(3000 + n, near(lone, 1))]
    rows += [(None, near(made.choice(bases), 1)) for _ in range(2)]
    rows += [(None, made.choices(vocabulary, k=90)) for _ in range(5)]
    return [(k, " ".join(w)) for k, w in rows] + [(None, None), (None, ""), (2000, "")]


def test_one_id_with_several_unlike_texts(spark):
    rows = families(1)
    found = jaccard.link_documents(spark.createDataFrame(rows, SCHEMA), SIZE, PERCENT).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute_force(rows)


def minima(text):
    found = next(jaccard.shingle_sets(pa.array([text]), 2))
    return [(found * m).min() for m in jaccard.MINIMA]


def test_a_row_in_a_cell_does_not_hide_another_of_its_id(spark):
    made = random.Random(7)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = made.choices(vocabulary, k=80)
    rows = [(i, " ".join([*base[:-1], f"end{i}"])) for i in range(10)]
    pairs = []
    while len(pairs) < 4:
        # alike at 60 %, and no two min-hash values in common: they meet in a region only
        b = made.choices(vocabulary, k=50)
        y = " ".join(b[:40] + made.choices(vocabulary, k=10))
        b = " ".join(b)
        if sum(i == j for i, j in zip(minima(b), minima(y))) < 2:
            pairs.append((b, y))
    for n, (b, y) in enumerate(pairs):
        rows += [(100 + n, " ".join([*base[:-1], f"more{n}"])), (100 + n, b), (200 + n, y)]
    found = jaccard.link_documents(spark.createDataFrame(rows, SCHEMA), 2, 60).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: 0 for k, _ in rows}


def test_class_counts_never_overstate_a_difference():
    """Folded counts bound the symmetric difference; long unrelated sets are told apart."""
    import numpy as np

    rng = np.random.default_rng(5)
    for n, m in ((0, 1), (1, 1), (128, 129), (300, 4000), (5000, 4100), (70000, 69000)):
        one = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        other = np.unique(np.concatenate([one[: n // 2], rng.integers(0, 2**63, m, dtype=np.uint64)]))
        counts = jaccard.class_counts(one), jaccard.class_counts(other)
        number = min(map(len, counts))
        differ = int(np.abs(jaccard.folded(counts[0], number) - jaccard.folded(counts[1], number)).sum())
        assert differ <= len(np.setxor1d(one, other))
        assert [int(c.sum()) for c in counts] == [len(one), len(other)]
    a, b = (jaccard.class_counts(rng.integers(0, 2**63, 4000, dtype=np.uint64)) for _ in range(2))
    differ = int(np.abs(a.astype(int) - b.astype(int)).sum())
    assert 200 * differ > 50 * (8000 + differ)
