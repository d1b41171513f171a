"""Collocations against counting every phrase in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tallybook.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "own", None) for i, (t, lang) in enumerate(rows)], SCHEMA)


def folded(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute(rows, limit, least):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang in total:
        best = []
        for key, a in f.items():
            if key[0] != lang or len(key) < 3 or a < least:
                continue
            cuts = []
            for k in range(2, len(key)):
                left, right = f[key[:k]], f[(lang, *key[k:])]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            best.append((min(cuts), key, a))
        longer = Counter()
        for _, key, a in best:
            if len(key) == 4:
                for inner in (key[:3], (lang, *key[2:])):
                    longer[inner] = max(longer[inner], a)
        kept = [(-cut[0], -a, " ".join(key[1:]).encode(), cut) for cut, key, a in best
                if len(key) == 4 or longer[key] == 0 or 100 * longer[key] < 50 * a]
        for rank, (score, a, phrase, cut) in enumerate(sorted(kept)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, cut[2], cut[3], total[lang], -score))
    return sorted(out)


def corpus(seed, n=120):
    made = random.Random(seed)
    vocabulary = [w + s for w in "a b c dé straße ÉA 😀 x1 +% |".split() for s in ("", "o", "T")]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    fixed = ["New York City", "alpha beta", "\tone  two three four", "A a A a a"]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(made.randint(0, 60)):
            words.append(made.choices(vocabulary, weights)[0] if made.random() < 0.8 else made.choice(fixed))
            words.append(made.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! "]))
        rows.append(("".join(words), made.choice(["en", "en", "en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", "fr"), (" ", "it"), ("x" * 300, "en"), (None, None)] + rows[:3]


def found(spark, rows, **options):
    table = C.collocations(frame(spark, rows).repartition(3), **options)
    assert table.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, table.collect()))


@pytest.mark.parametrize("per_round,limit,block", [(120, 3, 64), (1 << 18, 2000, 200)])
def test_phrases_equal_brute_force(spark, per_round, limit, block):
    rows = corpus(limit)
    got = found(spark, rows, limit=limit, least=5, per_round=per_round, block=block)
    assert got == brute(rows, limit, 5)
    assert any(len(r[2].split(" ")) == 3 for r in got) and any(len(r[2].split(" ")) == 2 for r in got)


def test_no_rows_and_no_candidates(spark):
    assert found(spark, []) == []
    assert found(spark, [("a b", "en"), (None, None)]) == []


def test_ties_at_the_last_rank_go_by_count_and_phrase(spark):
    rows = [(f"{a}1 {a}2.", "en") for a in "edcba" for _ in range(10)] + [("z1 z2.", "en")] * 12
    got = found(spark, rows, limit=3, least=10, per_round=2)
    assert [r[2] for r in got] == ["z1 z2", "a1 a2", "b1 b2"]


def test_parts_of_a_long_text_count_everything_once():
    made = random.Random(8)
    for block in (8, 16, 50):
        text = "".join(made.choice(["ab", "c", "long" * 9, " ", " ", "\t", ".", "\n", "é"]) for _ in range(400))
        raw = np.frombuffer(text.encode(), np.uint8)
        seen = Counter()
        for low, at, end in C.parts(raw, block):
            held = C.Block(raw[low:end], np.array([0, end - low]), np.array([at - low]), np.array([0]))
            words = C.words_of(held)
            for i in range(len(words.starts) - 2):
                if words.follows[i] and words.follows[i + 1] and words.new[i + 2]:
                    seen[C.phrases(held, words, np.array([i]), 3)[0].as_py()] += 1
        wanted = Counter()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            wanted.update(" ".join(words[i : i + 3]) for i in range(len(words) - 2))
        assert seen == wanted


def test_equal_first_hashes_are_told_apart():
    first = np.array([5, 5, 7, 5, 7], np.uint64)
    second = np.array([1, 2, 3, 1, 3], np.uint64)
    order, begins = C.grouped(first, second)
    n = np.diff(np.append(begins, 5))
    at = order[begins]
    assert sorted(zip(first[at].tolist(), second[at].tolist(), n.tolist())) == [(5, 1, 2), (5, 2, 1), (7, 3, 2)]
    assert len(C.grouped(first[:0], second[:0])[1]) == 0


def test_exact_beyond_64_bits(spark):
    big = 3 * 10**12
    row = spark.createDataFrame([(big, big, big + 1)], "a long, l long, r long")
    assert row.select(C.quotient(("a", "a"), ("l", "r"))).first()[0] == 10**6 * big * big // (big * (big + 1))
