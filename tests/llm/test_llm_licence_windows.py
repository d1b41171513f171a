"""Licences in windows of any place: wrapped headers, sentences, whole licence files."""

import random
import re
from collections import Counter

import pytest

from tallybook.llm import licences

SCHEMA = "doc_id long, text string"
HEADER = """Copyright 2020 Someone

# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.

import nothing
"""


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r.doc_id: (r.n_passages, r.licences) for r in licences.document_licences(docs).collect()}


def test_notices_inside_lines_and_over_lines(spark):
    prose = "some words of prose that go on for a while and say nothing of note " * 40
    texts = [
        "This library is released under the MIT License and maintained by X.",
        prose + "It is released under\nthe MIT\nLicense. " + prose,
        HEADER + prose,
        prose + licences.TEXTS["MIT-text"].replace("\n", " ") + " " + prose,
        licences.TEXTS["BSD-text"][:160] + prose,
        prose + "released under the terms of the village license MIT",
        "Released under the MIT License.",
    ]
    assert found(spark, texts) == {
        0: (1, "MIT"), 1: (1, "MIT"), 2: (2, "Apache-2.0,Apache-2.0-header"), 3: (1, "MIT-text"),
        4: (1, "BSD"), 5: (0, ""), 6: (1, "MIT"),
    }


def test_whole_licence_files(spark):
    names = sorted(licences.TEXTS)
    alone = found(spark, [licences.TEXTS[n] for n in names])
    inside = found(spark, ["A file of notices.\n" * 400 + licences.TEXTS[n] + "\nend " * 9000 for n in names])
    for i, name in enumerate(names):
        assert name in alone[i][1].split(",") and name in inside[i][1].split(",")


def words_of(text):
    words = re.findall("[a-z0-9]+", text.lower())
    return Counter(zip(words, words[1:])), words


@pytest.mark.parametrize("seed", range(3))
def test_common_at_equals_brute_force(seed):
    made = random.Random(seed)
    grams = [made.randrange(6) for _ in range(300)]
    template = Counter(made.randrange(6) for _ in range(20))
    starts = sorted(made.sample(range(280), 90))
    assert list(licences.common_at(grams, starts, template, 20)) == [
        (Counter(grams[s : s + 20]) & template).total() for s in starts
    ]


def test_a_window_at_every_offset(spark):
    notice = licences.TEMPLATES["GPL-3.0-header"]
    texts = ["w " * i + notice + " x" * (40 - i) for i in range(41)]
    assert set(found(spark, texts).values()) == {(1, "GPL-3.0-header")}
    template, words = words_of(notice)
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    # a whole line comes first if it reaches the threshold itself
    size = len(words) - 1
    assert all(r.score == 1.0 and r.first_word == r.doc_id or r.score == 2 * size / (2 * size + 40) for r in rows)
