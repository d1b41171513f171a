"""Token ids of whole texts by a public tokenizer file, with the ids of words remembered."""

from __future__ import annotations

import os
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tallybook.llm.text import FOLD, run_hashes, text_bytes

# Distinct parts whose ids a worker remembers before it forgets those met once, and those
# gathered before they join the others.
REMEMBERED = 500_000
RECENT = 50_000
# Text bytes worked on at once: some dozens of bytes of temporaries for each of them.
SEGMENT = 1 << 17
# Parts encoded in one call.
ROW_PARTS = 2000


class Ids(NamedTuple):
    """Ids of several texts: text i has ids[bounds[i] : bounds[i + 1]]."""

    ids: np.ndarray
    bounds: np.ndarray


def marked(*values: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


# Bytes that end a white-space character, or lead one of two or three bytes.
WHITE = marked(9, 10, 11, 12, 13, 28, 29, 30, 31, 32)
LEADS_TWO, LEADS_THREE = marked(0xC2), marked(0xE1, 0xE2, 0xE3)
MARKS = marked(*b".,!?;:")
LETTERS = marked(*range(65, 91), *range(97, 123))
# What a part follows: a space, nothing (or a line break), or the part before it.
SPACED, FIRST, NEXT = range(3)
KINDS = np.array([0, 0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)

_loaded: dict[str, Encoder] = {}


def safe_cuts(data: np.ndarray, start: int, stop: int) -> list[int]:
    """Places inside a long text where parts begin anyway: at a space between two characters
    that are no white space."""
    found = []
    at = start
    while stop - at > SEGMENT:
        low, high = at + SEGMENT // 2, at + SEGMENT
        while True:
            high = min(high, stop - 1)
            white = WHITE[data[low - 1 : high - 1]] | WHITE[data[low + 1 : high + 1]]
            white |= LEADS_TWO[data[low - 2 : high - 2]] | LEADS_THREE[data[low - 3 : high - 3]]
            places = np.flatnonzero((data[low:high] == 32) & ~white)
            if len(places) or high >= stop - 1:
                break
            # a run without such a space stays whole
            low, high = high, high + SEGMENT
        if not len(places):
            break
        at = low + int(places[-1])
        found.append(at)
    return found


class Memory:
    """Ids of parts by hash: sorted hashes, and where their ids lie in a pool."""

    def __init__(self):
        self.hashes = np.empty(0, np.uint64)
        self.starts = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)
        self.seen = np.empty(0, np.int64)
        self.pool = np.empty(0, "<u4")

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the wanted hashes, and which of them are held."""
        place = np.searchsorted(self.hashes, wanted)
        known = np.zeros(len(wanted), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == wanted[inside]
        return place, known

    def add(self, hashes: np.ndarray, sizes: np.ndarray, pool: np.ndarray, seen: np.ndarray) -> None:
        """Sorted hashes that are not held yet, with their ids end to end."""
        first = len(self.pool) + np.cumsum(sizes) - sizes
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts = np.insert(self.starts, at, first)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.seen = np.insert(self.seen, at, seen)
        self.pool = np.concatenate([self.pool, pool])

    def ids(self, which: np.ndarray) -> np.ndarray:
        """The ids of the parts at some places, end to end."""
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.starts[which] - ends + sizes, sizes) + np.arange(total)]

    def keep(self, some: np.ndarray) -> None:
        which = np.flatnonzero(some)
        pool, sizes = self.ids(which), self.sizes[which]
        self.hashes, self.starts, self.sizes = self.hashes[which], np.cumsum(sizes) - sizes, sizes
        self.seen, self.pool = np.zeros(len(which), np.int64), pool


class Encoder:
    """Ids of whole texts as unsigned 32-bit integers, equal to the library's.

    The tokenizers used here never join characters across the left edge of a space that
    follows a non-space, around a single line break between non-spaces, or between a
    letter and a mark that ends a word. Texts are cut there; each distinct part is encoded
    once and remembered by its hash. A text with a space after what may be other white
    space is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.white = re.compile(r"\s")
        # remembered parts, and the last ones, which join them a batch at a time
        self.old, self.recent = Memory(), Memory()
        self.line = self.plain(["\n"])[0]
        self.lowers = self.plain(["A"]) == self.plain(["a"])

    def plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def rows(self, parts: list[str], gap: str) -> list[bytes]:
        """Ids of distinct parts without white space, each after `gap`, encoded in rows."""
        out = []
        for first in range(0, len(parts), ROW_PARTS):
            row = parts[first : first + ROW_PARTS]
            found = self.tokenizer.encode(gap + gap.join(row), add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            # a token begins at the gap before its part or within the part
            at = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
            if gap == "\n" and self.line:
                own = ids != np.frombuffer(self.line, "<u4")[0]
                ids, at = ids[own], at[own]
            begins = np.cumsum([0] + [len(p) + 1 for p in row])
            cuts = (np.searchsorted(at, begins) * 4).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        return out

    def __call__(self, texts: pa.Array) -> Ids:
        """Ids of all texts; a null text has none.

        Work goes through SEGMENT bytes at a time; a longer text is cut where parts begin.
        """
        data, limits = text_bytes(texts)
        inner = [
            c
            for start, stop in zip(limits[:-1].tolist(), limits[1:].tolist())
            if stop - start > SEGMENT
            for c in safe_cuts(data, start, stop)
        ]
        bounds = np.sort(np.concatenate([limits, np.array(inner, np.int64)]), kind="stable")
        pieces, counts = [np.empty(0, "<u4")], np.zeros(len(bounds) - 1, np.int64)
        first = 0
        while first < len(bounds) - 1:
            last = int(np.searchsorted(bounds, bounds[first] + SEGMENT, "right")) - 1
            last = max(first + 1, last)
            found = self.segment(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
            pieces.append(found.ids)
            counts[first:last] = np.diff(found.bounds)
            first = last
        ends = np.concatenate([[0], np.cumsum(counts)])
        # a text ends where the segment that ends with it does; empty ones add nothing
        at = np.searchsorted(bounds, limits, "right") - 1
        return Ids(np.concatenate(pieces), ends[at])

    def segment(self, data: np.ndarray, limits: np.ndarray) -> Ids:
        """Ids of texts or parts of texts that lie end to end."""
        raw = data
        if not len(data):
            return Ids(np.empty(0, "<u4"), np.zeros(len(limits), np.int64))
        if self.lowers:
            data = FOLD[data]
        starts, ends, kinds, text, odd_texts = cut(data, limits)
        hashes = run_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends)
        hashes ^= KINDS[kinds]
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        pool, sizes = self.recall(distinct, starts[at], ends[at], kinds[at], data)
        first = np.cumsum(sizes) - sizes
        counts = sizes[which]
        total = np.cumsum(counts)
        ids = pool[np.repeat(first[which] - total + counts, counts) + np.arange(total[-1])]
        per_text = np.bincount(text, weights=counts, minlength=len(limits) - 1).astype(np.int64)
        found = Ids(ids, np.concatenate([[0], np.cumsum(per_text)]))
        return self.replaced(found, raw, limits, odd_texts) if len(odd_texts) else found

    def recall(self, distinct, starts, ends, kinds, data) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the distinct parts end to end, and their numbers; new parts are encoded."""
        if len(self.recent.hashes) > RECENT:
            self.join()
        late, is_late = self.recent.find(distinct)
        place, is_old = self.old.find(distinct)
        new = np.flatnonzero(~is_late & ~is_old)
        if len(new):
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            held = self.encoded(texts, kinds[new])
            sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
            pool = np.frombuffer(b"".join(held), "<u4")
            self.recent.add(distinct[new], sizes, pool, np.zeros(len(new), np.int64))
            late, is_late = self.recent.find(distinct)
        self.recent.seen[late[is_late]] += 1
        self.old.seen[place[is_old]] += 1
        sizes = np.empty(len(distinct), np.int64)
        sizes[is_late] = self.recent.sizes[late[is_late]]
        sizes[is_old] = self.old.sizes[place[is_old]]
        out = np.empty(int(sizes.sum()), "<u4")
        from_old = np.repeat(is_old, sizes)
        out[from_old] = self.old.ids(place[is_old])
        out[~from_old] = self.recent.ids(late[is_late])
        return out, sizes

    def join(self) -> None:
        """The last parts join the others; too many, and those met once are forgotten."""
        if len(self.old.hashes) > REMEMBERED:
            often = self.old.seen > 1
            if 2 * often.sum() > REMEMBERED:
                often[:] = False
            self.old.keep(often)
        recent, self.recent = self.recent, Memory()
        self.old.add(recent.hashes, recent.sizes, recent.ids(np.arange(len(recent.hashes))), recent.seen)

    def encoded(self, texts: list[str], kinds: np.ndarray) -> list[bytes]:
        """Ids of distinct parts."""
        held: list[bytes] = [b""] * len(texts)
        odd = np.array([not p or self.white.search(p) is not None for p in texts], bool)
        for kind, gap in ((SPACED, " "), (FIRST, "\n")):
            some = np.flatnonzero((kinds == kind) & ~odd).tolist()
            for j, ids in zip(some, self.rows([texts[j] for j in some], gap)):
                held[j] = ids
        rest = np.flatnonzero((kinds == NEXT) | odd).tolist()
        alone = [(" " if kinds[j] == SPACED else "") + texts[j] for j in rest]
        for j, ids in zip(rest, self.plain(alone)):
            held[j] = ids
        return held

    def replaced(self, found: Ids, data: np.ndarray, limits: np.ndarray, which: np.ndarray) -> Ids:
        """`found` with the ids of some texts encoded whole."""
        chosen = [data[limits[i] : limits[i + 1]].tobytes().decode() for i in which.tolist()]
        whole = dict(zip(which.tolist(), self.plain(chosen)))
        rows = [
            np.frombuffer(whole[i], "<u4") if i in whole else found.ids[a:b]
            for i, (a, b) in enumerate(zip(found.bounds[:-1], found.bounds[1:]))
        ]
        return Ids(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))


def cut(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends, kinds and texts of all parts, and the texts that must stay whole."""
    n = len(data)
    begins, finishes = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    begins[limits[:-1]] = True
    finishes[limits[1:]] = True
    back = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(1, np.uint8)])
    one, two, three, ahead = back[2:-2], back[1:-3], back[:-4], back[4:]
    inner = ~begins[:n]
    space = data == 32
    odd = space & inner & (WHITE[one] | LEADS_TWO[two] | LEADS_THREE[three])
    letter = LETTERS[one] | ((two == 0xC3) & (one != 0x97) & (one != 0xB7) & (one >= 0x80))
    line = (data == 10) & inner & ~finishes[1:] & ~WHITE[one] & ~WHITE[ahead]
    line &= ~LEADS_TWO[two] & ~LEADS_THREE[three] & (ahead < 0x80)
    line_next = np.append(line[1:], False)
    mark = MARKS[data] & inner & letter & (finishes[1:] | (ahead == 32) | line_next)
    firsts = limits[:-1][np.diff(limits) > 0]
    at = [firsts, np.flatnonzero(space) + 1, np.flatnonzero(mark | line), np.flatnonzero(line) + 1]
    kind = np.repeat([FIRST, SPACED, NEXT, FIRST], [len(x) for x in at])
    is_text = np.repeat([True, False, False, False], [len(x) for x in at])
    starts = np.concatenate(at)
    order = np.argsort(2 * starts + is_text, kind="stable")
    starts, kind, is_text = starts[order], kind[order], is_text[order]
    text = np.flatnonzero(np.diff(limits) > 0)[np.cumsum(is_text) - 1]
    ends = limits[1:][text]
    follows = ~is_text[1:]
    ends[:-1][follows] = (starts[1:] - (kind[1:] == SPACED))[follows]
    odd_texts = np.unique(np.searchsorted(limits, np.flatnonzero(odd), "right") - 1)
    return starts, ends, kind, text, odd_texts


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
