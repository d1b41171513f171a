"""Repeated spans, Jaccard components and licences against brute force."""

import hashlib
import random
import re
import weakref

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybook.llm import components, jaccard, licences, occurrences, repeats
from tallybook.llm.text import words

SCHEMA = "doc_id long, text string, key string, spans int"


def corpus(seed, copies=4):
    made = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    line = lambda n: made.choices(vocabulary, k=n)
    shared = [line(made.randrange(18, 40)) for _ in range(4)]
    docs = []
    for i in range(60):
        words = line(made.randrange(0, 60))
        for part in made.sample(shared, made.randrange(0, 3)):
            at = made.randrange(len(words) + 1)
            words[at:at] = part
        docs.append(words)
    base = line(80)
    for _ in range(25):  # near copies
        copy = list(base)
        for _ in range(made.randrange(0, 3)):
            copy[made.randrange(80)] = "changed"
        docs.append(copy)
    docs += [docs[3]] * copies + [base[:30] + base[:30], line(3), line(3)]
    texts = [" \n".join(d) if i % 5 else "\t ".join(d) + " " for i, d in enumerate(docs)]
    made.shuffle(texts)
    rows = [(i * 3, t, "k", 1) for i, t in enumerate(texts)]
    return rows + [(-1, None, "k", 1), (-2, "", "k", 1), (-5, " \n", "k", 1), (-7, "A  B", "k", 1), (-8, "a b", "k", 1)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_repeats(rows, size):
    first, out = {}, {}
    texts = sorted((LAST if k is None else k, words_of(t), k) for k, t, *_ in rows)
    for key, words, _ in texts:
        for at in range(len(words) - size + 1):
            first.setdefault(tuple(words[at : at + size]), (key, at))
    for key, words, k in texts:
        gone = set()
        for at in range(len(words) - size + 1):
            if first[tuple(words[at : at + size])] != (key, at):
                gone.update(range(at, at + size))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[k] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


LAST = 2**63 - 1


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rows = corpus(seed) + [(None, "z " * 50, "k", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    wanted = brute_repeats(rows, 20)
    found = {r.doc_id: r[1:] for r in repeats.kept_digests(docs).collect()}
    assert found == {k: v[:3] for k, v in wanted.items()}
    texts = {r.doc_id: r.kept for r in repeats.without_repeats(docs).collect()}
    assert texts == {k: v[3] for k, v in wanted.items()}


def test_repeated_rows_do_not_repeat_each_other(spark):
    rows = [(4, "q " * 19 + "end", "k", 1)] * 3 + [(9, "q " * 19 + "end", "k", 1)]
    found = sorted(tuple(r)[:3] for r in repeats.kept_digests(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [(4, 20, 0)] * 3 + [(9, 20, 20)]
    assert repeats.kept_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_components(rows, size, percent):
    sets = {}
    for k, t, *_ in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words_of(t)]
        grams = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        sets[k] = grams or ({tuple(words)} if words else set())
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (2, 60)])
def test_components_equal_brute_force(spark, size, percent):
    rows = corpus(size)
    found = jaccard.link_documents(spark.createDataFrame(rows, SCHEMA), size, percent)
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == brute_components(rows, size, percent)


def test_rows_without_or_with_equal_ids(spark):
    rows = [(8, "a b c d e f", "k", 1), (8, "a b c d e f", "k", 1), (None, "a b c d e f", "k", 1),
            (None, None, "k", 1), (3, "q", "k", 1), (8, "r s", "k", 1), (5, "R s", "k", 1)]
    found = jaccard.link_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, [
        (8, 2, 5), (8, 2, 5), (None, 2, 5), (None, 0, 5), (3, 1, 3), (8, 1, 5), (5, 1, 5)]))
    assert jaccard.link_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = edges.unionByName(spark.createDataFrame([(900, 700), (700, 800), (5, 5)], "a long, b long"))
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert found == {**{i: 0 for i in range(301)}, 700: 700, 800: 700, 900: 700}


def test_licences_are_found_in_lines_and_whole_texts(spark):
    mit = licences.TEMPLATES["MIT-header"]
    rows = [
        (1, "Some words.\nReleased under the MIT license\nmore", "k", 1),
        (2, mit[:60] + "\n" + mit[60:], "k", 1),
        (3, "released under the terms of the village", "k", 1), (4, None, "k", 1), (5, "", "k", 1), (6, "mit", "k", 1),
        (7, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0", "k", 1),
        (7, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0", "k", 1),
        (8, "word " * 20000 + "\nReleased under the MIT License.", "k", 1),
    ]
    found = {r.doc_id: (r.n_passages, r.licences) for r in licences.document_licences(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: (1, "MIT"), 2: (1, "MIT-header"), 3: (0, ""), 4: (0, ""), 5: (0, ""), 6: (0, ""),
                     7: (2, "Apache-2.0,CC-BY-NC"), 8: (1, "MIT")}
    assert licences.document_licences(spark.createDataFrame([], SCHEMA)).count() == 0


class Task:
    """Stands in for a table and keeps the function that its tasks would run."""

    def mapInArrow(self, read, schema):
        self.read = read
        return self

    def select(self, *columns):
        return self

    groupBy = applyInArrow = agg = select

    def first(self):
        return [1000]


@pytest.mark.parametrize("step", ["scan", "compare_windows", "cut_spans", "repeated_values"])
def test_a_task_lets_go_of_its_rows_before_it_gives_memory_back(spark, monkeypatch, step):
    held, left = [], []
    for module in (repeats, occurrences):
        monkeypatch.setattr(module, "release", lambda: left.append([r() for r in held if r() is not None]), raising=False)
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 10, 40, 40)]
    columns = {
        "anchors": pa.array([[1, 2], [], [2, 3], None], pa.list_(pa.int64())),
        "doc_id": [1, 2, 3, 4], "key": [1, 2, 3, 4], "has_id": [True] * 4, "row_id": [5, 6, 7, 8], "text": texts,
        "spans": pa.array([None, [], [{"first": 0, "last": 19}], [{"first": 2, "last": 30}]], span),
    }

    def batches():
        for _ in range(2):
            seeds, _, _ = repeats.anchors(words(pa.array(texts)), 20)
            found = pa.array([seeds.view("int64").tolist()] * 4, pa.list_(pa.int64()))
            batch = pa.RecordBatch.from_pydict(columns | {"seeds": found})
            held.append(weakref.ref(batch))
            yield batch

    task = Task()
    if step == "repeated_values":
        occurrences.repeated_values(task, "anchors")
    else:
        getattr(repeats, step)(task, *([] if step == "cut_spans" else [20]))
    for nothing in (iter([]), iter([pa.RecordBatch.from_pydict(columns | {"seeds": columns["anchors"]}).slice(0, 0)])):
        assert sum(b.num_rows for b in task.read(nothing)) == 0
    left.clear()
    assert sum(b.num_rows for b in task.read(batches())) > 0
    assert left == [[]]
