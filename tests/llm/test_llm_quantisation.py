"""Near-duplicate vectors against brute force over all pairs of a label."""

import numpy as np
import pytest

from tallybook.llm import quantisation as Q

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n_links string"


def frame(spark, rows, schema=SCHEMA):
    lists = [None if v is None else [None if x is None else float(x) for x in v] for _, v, _ in rows]
    return spark.createDataFrame([(i, v, label, "own", None) for (i, _, label), v in zip(rows, lists)], schema)


def brute(rows, cosine=0.98):
    """Sorted (vec_id, n_links, component_id, kept) by comparing all pairs."""
    units, links = [], {n: set() for n in range(len(rows))}
    for vec_id, vector, label in rows:
        fine = vector is not None and label is not None and vec_id is not None and len(vector) > 0
        fine = fine and all(x is not None and np.isfinite(x) for x in vector) and any(vector)
        v = np.array(vector, np.float32).astype(float) if fine else None
        units.append(None if v is None else v / np.linalg.norm(v))
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is None or units[j] is None or rows[i][2] != rows[j][2]:
                continue
            if len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
                links[i].add(j)
                links[j].add(i)
    out, seen = [], {}
    for start in range(len(rows)):
        if start in seen:
            continue
        group, left = {start}, [start]
        while left:
            for j in links[left.pop()] - group:
                group.add(j)
                left.append(j)
        for n in group:
            seen[n] = min((rows[m][0] for m in group if rows[m][0] is not None), default=None)
    for n, (vec_id, _, _) in enumerate(rows):
        out.append((vec_id, len(links[n]), seen[n], vec_id is None or vec_id == seen[n]))
    return sorted(out, key=str)


def found(spark, rows, **options):
    table = Q.near_vectors(frame(spark, rows).repartition(4), **options)
    assert table.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, table.collect()), key=str)


def planted(made, dim=64, n=500, groups=12, size=9, spread=0.9):
    """Unrelated vectors, and groups whose members lie around the linking cosine."""
    vectors = list(made.standard_normal((n, dim)))
    for _ in range(groups):
        centre = made.standard_normal(dim)
        for _ in range(size):
            vectors.append(centre + made.standard_normal(dim) * 0.14 * made.random() * spread)
    made.shuffle(vectors)
    return [(int(i), v / np.linalg.norm(v), int(made.integers(0, 2))) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("dim,shift", [(64, 0.0), (24, 0.0), (64, 0.2), (200, 0.0)])
def test_links_equal_brute_force(spark, dim, shift):
    made = np.random.default_rng(dim)
    rows = [(i, v + shift, label) for i, v, label in planted(made, dim)]
    wanted, got = brute(rows), found(spark, rows)
    assert sum(r[1] for r in wanted) > 100
    assert sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in wanted)
    assert all(g[1] <= w[1] for g, w in zip(got, wanted))
    assert sum(g == w for g, w in zip(got, wanted)) >= 0.98 * len(rows)


def test_copies_odd_rows_and_repeated_ids(spark):
    made = np.random.default_rng(3)
    base = made.standard_normal((6, 8))
    rows = [(100 + i, v, 1) for i, v in enumerate(base)]
    rows += [(i, base[0], 1) for i in range(90, 60, -1)]  # exact copies
    rows += [(50, base[1] * 3, 1), (51, -base[1], 1), (52, base[1], 2), (53, base[1], None)]
    rows += [(54, [1.0, 2.0], 1), (55, [2.0, 4.0], 1), (54, [5.0, -1.0], 1), (None, base[0], 1)]
    rows += [(56, None, 1), (57, [0.0] * 8, 1), (58, [None] + [1.0] * 7, 1), (59, [float("nan")] * 8, 1), (49, [], 1)]
    rows += [(40, [0.0, 1.0], 3), (41, [-0.0, 1.0], 3), (42, [3.0], 4), (43, [5.0], 4), (44, [-5.0], 4)]
    assert found(spark, rows) == brute(rows)


def test_large_groups_are_dealt_to_chunks(spark, monkeypatch):
    monkeypatch.setattr(Q, "CHUNK", 40)
    monkeypatch.setattr(Q, "GATHER", 100)
    made = np.random.default_rng(4)
    centre = made.standard_normal(16)
    rows = [(i, centre + 0.02 * made.standard_normal(16), 1) for i in range(150)]
    rows += [(200 + i, v, 1) for i, v in enumerate(made.standard_normal((60, 16)))]
    assert found(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 1)]) == [(1, 0, 1, True)]


def test_tables_meet_their_target():
    made = np.random.default_rng(5)
    sample = Q.units(made.standard_normal((2000, 64)))
    for rows in (10, 5_000, 50_000_000):
        code = Q.learn(sample, 0.98, rows)
        assert np.allclose(code.axes.T @ code.axes, np.eye(64), atol=1e-9)
        other = Q.units(Q.tilted(sample, 0.98, seed=99))
        differ = Q.codes_of(Q.bits_of(sample, code.mean, code.axes)) ^ Q.codes_of(Q.bits_of(other, code.mean, code.axes))
        met = np.zeros(len(sample), bool)
        for mask in code.masks:
            met |= (differ & np.uint64(mask)) == 0
        assert met.mean() > 0.99
        assert min(bin(m).count("1") for m in code.masks) >= min(np.log2(rows) - 6, 16)


def test_balanced_codes():
    made = np.random.default_rng(6)
    sample = Q.units(made.standard_normal((3000, 32)) + 0.5)
    mean, axes = Q.learn_rotation(sample)
    bits = Q.bits_of(sample, mean, axes)
    assert np.abs(bits.mean(axis=0) - 0.5).max() < 0.1
