"""Licence scan: passages compared with licence templates by Dice over word bigrams.

A text's passages are its lines, the whole text if it has several, and every window of as
many words as a template has, from any word on and across line breaks. Normalised, a
passage is its words of ASCII letters and digits, A-Z lower-cased. For bigram multisets
A and B the Dice coefficient is 2 |A n B| / (|A| + |B|); it cannot reach the threshold
unless 2 min(|A|, |B|) does, so templates of unfitting size are never compared. A line
or whole text carries the template with the highest coefficient at or above the
threshold, the first by name of equals.

Windows are compared with the template of their size, if enough of their bigrams occur
in it. Of those at or above the threshold the largest come first, then the highest
coefficient, the first in the text, the first by name. A window that shares a bigram with
a passage taken before it (lines and whole texts are) is part of that passage if both
carry one template or the passage's template itself holds such a window.

A passage with fewer than two words has no bigrams and carries nothing, and so does a
null or empty text. Repeated rows get the same result. An empty table gives an empty
result. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.text import Words, pieces, text_bytes, windows, words

# Short notices and the standard header of some public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this"
        " file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed"
        " to in writing, software distributed under the License is distributed on an AS IS"
        " BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the"
        " License for the specific language governing permissions and limitations under the"
        " License."
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-header": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the Software), to deal in the Software"
        " without restriction"
    ),
}
# Whole licence texts.
TEXTS = {
    f"{name}-text": (files("tallybook.llm") / "licence_texts" / f"{name}.txt").read_text("utf-8")
    for name in ("Apache-2.0", "BSD", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0")
}
EVERY = TEMPLATES | TEXTS
THRESHOLD = 0.8

GAPS = np.ones(256, bool)
GAPS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def bigram_list(text: str) -> list[int]:
    return windows(words(pa.array([text]), fold=True, gaps=GAPS), 2)[0].tolist()


def bigrams(text: str) -> Counter:
    return Counter(bigram_list(text))


def common_at(grams: list[int], starts: list[int], template: Counter, size: int) -> Iterator[int]:
    """How many bigrams the window of `size` from each of the ascending `starts` has in common."""
    held: Counter = Counter()
    low = high = common = 0
    for start in starts:
        if start >= high:
            held, low, high, common = Counter(), start, start, 0
        for gram in grams[low:start]:
            if gram in template:
                held[gram] -= 1
                common -= held[gram] < template[gram]
        low = start
        for gram in grams[high : start + size]:
            if gram in template:
                common += held[gram] < template[gram]
                held[gram] += 1
        high = start + size
        yield common


def parts_of(templates: dict[str, list[int]], threshold: float) -> dict[str, list[str]]:
    """The templates that have a window at the threshold in each template, itself included."""
    found = {}
    for name, grams in templates.items():
        found[name] = [name]
        for other, part in templates.items():
            size = len(part)
            if other != name and 0 < size <= len(grams):
                starts = list(range(len(grams) - size + 1))
                if max(common_at(grams, starts, Counter(part), size)) / size >= threshold:
                    found[name].append(other)
    return found


def lines_of(found: Words, limits: np.ndarray) -> np.ndarray:
    """The line of each word, counted over all texts."""
    breaks = np.zeros(len(found.data) + 1, np.int64)
    breaks[:-1] = found.data == 10
    begins = limits[:-1][(limits[:-1] < len(found.data)) & (limits[:-1] > 0)]
    breaks[np.unique(begins)] += 1
    return np.cumsum(breaks)[found.starts]


def scan(
    docs: DataFrame, templates: dict[str, str] = EVERY, threshold: float = THRESHOLD
) -> DataFrame:
    """A row per passage that carries a licence: `doc_id, whole, first_word, licence, score`.

    `whole` tells a whole text from other passages; `first_word` numbers its first word in
    the text.
    """
    listed = {name: bigram_list(templates[name]) for name in sorted(templates)}
    known = {name: Counter(grams) for name, grams in listed.items()}
    sizes = {name: len(grams) for name, grams in listed.items()}
    every = np.array(sorted(set().union(*known.values())), np.uint64)
    # which bigrams each template has, by their place in `every`; one more place for none of them
    member = {name: np.append(np.isin(every, np.array([*b], np.uint64)), False) for name, b in known.items()}
    parts = parts_of(listed, threshold)

    def best(passage: np.ndarray) -> tuple[str, float] | None:
        held, found = None, (None, 0.0)
        a = len(passage)
        for name, template in known.items():
            b = sizes[name]
            if 2 * min(a, b) < threshold * (a + b):
                continue
            held = Counter(passage.tolist()) if held is None else held
            score = 2 * (held & template).total() / (a + b)
            if score >= threshold and score > found[1]:
                found = (name, score)
        return found if found[0] else None

    def near_windows(grams: np.ndarray, place: np.ndarray, text: np.ndarray) -> list[tuple[int, float, int, str]]:
        """`size, score, first bigram, name` of all windows at or above the threshold, best first."""
        found, plain = [], None
        for name, size in sizes.items():
            if not 0 < size <= len(grams):
                continue
            hits = np.concatenate([[0], np.cumsum(member[name][place])])
            enough = (hits[size:] - hits[:-size]) / size >= threshold
            starts = np.flatnonzero(enough & (text[size - 1 :] == text[: len(text) - size + 1])).tolist()
            if starts:
                plain = grams.tolist() if plain is None else plain
                for start, common in zip(starts, common_at(plain, starts, known[name], size)):
                    if common / size >= threshold:
                        found.append((size, common / size, start, name))
        return sorted(found, key=lambda w: (-w[0], -w[1], w[2], w[3]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                out = []
                found = words(part.column("text"), fold=True, gaps=GAPS)
                line = lines_of(found, text_bytes(part.column("text"))[1])
                grams, bounds = windows(found, 2)
                text = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                first = np.arange(len(grams)) - bounds[:-1][text]
                at = found.bounds[:-1][text] + first
                same = line[at] == line[at + 1] if len(at) else np.zeros(0, bool)
                place = np.searchsorted(every, grams)
                hit = np.append(every, np.uint64(0))[place] == grams
                hit &= place < len(every)
                place[~hit] = len(every)
                taken = []
                keys = part.column("doc_id").to_pylist()
                for whole, use in ((False, same), (True, np.ones(len(grams), bool))):
                    group = (text if whole else line[at])[use]
                    held, begin, size = np.unique(group, return_index=True, return_counts=True)
                    if not len(held):
                        continue
                    used = np.flatnonzero(use)
                    hits = np.add.reduceat(hit[use].astype(np.int64), begin)
                    # at best all hits are in common with a template no larger than they are
                    for g in np.flatnonzero((hits > 0) & (2 * hits >= threshold * size)):
                        rows = slice(begin[g], begin[g] + size[g])
                        i = int(text[use][begin[g]])
                        if whole and line[at[use][rows][0]] == line[at[use][rows][-1] + 1]:
                            continue
                        match = best(grams[use][rows])
                        if match:
                            out.append((keys[i], whole, int(first[use][begin[g]]), *match))
                            start = int(used[begin[g]])
                            taken.append((start, start + int(size[g]), match[0]))
                near = near_windows(grams, place, text)
                covered = {name: np.zeros(len(grams), bool) for name in {w[3] for w in near}}

                def cover(start: int, stop: int, licence: str) -> None:
                    for name in parts[licence]:
                        if name in covered:
                            covered[name][start:stop] = True

                for passage in taken:
                    cover(*passage)
                for size, score, start, name in near:
                    if not covered[name][start : start + size].any():
                        out.append((keys[text[start]], False, int(first[start]), name, score))
                        cover(start, start + size, name)
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.float64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "whole", "first_word", "licence", "score"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        read, "doc_id long, whole boolean, first_word long, licence string, score double"
    )


def document_licences(
    docs: DataFrame, templates: dict[str, str] = EVERY, threshold: float = THRESHOLD
) -> DataFrame:
    """Per document `doc_id`: `n_passages` with a licence, their `licences`, the `best_score`.

    Rows that share a `doc_id` are one document. Documents without licences have 0, an
    empty list and a null score.
    """
    passages = scan(docs, templates, threshold).distinct()
    found = passages.groupBy("doc_id").agg(
        F.count("*").alias("n_passages"),
        F.concat_ws(",", F.array_sort(F.collect_set("licence"))).alias("licences"),
        F.max("score").alias("best_score"),
    )
    every = docs.select(F.col("doc_id").cast("long")).distinct()
    named = found.withColumnRenamed("doc_id", "_doc")
    return every.join(named, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select(
        "doc_id",
        F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"),
        F.coalesce("licences", F.lit("")).alias("licences"),
        "best_score",
    )
