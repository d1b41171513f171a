"""Water-filling against a plain loop; repetitions against their plan."""

import re

import pytest
from pyspark.sql import functions as F

from tallybook.llm import mixing

WEIGHTS = [5.0, 2.0, 1.0]


def fill(sizes, weights, budget, epochs=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, clamped = {}, set()
    while True:
        free = [s for s in names if s not in clamped]
        rest = budget - sum(epochs * sizes[s] for s in clamped)
        level = rest / sum(weight[s] for s in free) if free else 0
        target = {s: epochs * sizes[s] if s in clamped else weight[s] * level for s in names}
        over = {s for s in free if target[s] > epochs * sizes[s]}
        if not over:
            return target
        clamped |= over


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), "abcd"[i % 4] if i % 9 else None, i) for i in range(300)]
    rows += [(1000 + i, "y z", "hot", 0) for i in range(500)]
    rows += [(2000, None, "empty", 0), (2001, "", "empty", 0), (None, "p q r", "a", 0), (5, rows[5][1], "b", 5), (5, rows[5][1], "b", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _size long")


def test_targets_and_taken_words(docs):
    rows = mixing.mix(docs, WEIGHTS).collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    wanted = fill(sizes, WEIGHTS, 1.5 * sum(sizes.values()))
    for r in rows:
        assert r.target == pytest.approx(wanted[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
    for source, size in sizes.items():
        taken = sum(r.taken for r in rows if r.source == source)
        assert wanted[source] - 0.02 * size - 5 <= taken <= wanted[source] + 1e-6
    again = mixing.mix(docs.repartition(7), WEIGHTS)
    assert sorted(map(str, rows)) == sorted(map(str, again.collect()))


def test_documents_are_repeated_as_planned(docs):
    plan = mixing.mix(docs, WEIGHTS).groupBy("doc_id").agg(F.sum("taken").alias("taken"))
    out = mixing.mixed_documents(docs, WEIGHTS)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(mixing.WORD, r.text or ""))
    assert {k: n for k, n in words.items() if n} == {r.doc_id: r.taken for r in plan.collect() if r.taken}


def test_no_words_and_no_rows(docs):
    assert mixing.mix(docs.limit(0), WEIGHTS).count() == 0
    empty = mixing.mix(docs.where("source = 'empty'"), WEIGHTS).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2
