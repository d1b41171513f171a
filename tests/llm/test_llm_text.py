"""Words, hashes and token ids against plain Python."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tallybook.llm import text as T
from tallybook.llm import encode as encode_module
from tallybook.llm.encode import encoder

TEXTS = [
    "a b c a b", None, "", " ", "  c  a\tb ", "x", "Öl é  «a» b\n\nc\n", "word. Next, one\nTwo; three",
    "\n x", "a \nb", "a\n", "don't I'LL it's 12 345", "é́ ÀÉ ##", "a  b", "　 x", "W" * 5000,
    ", ,. x.", "a\r\nb c\x0bd\x0ce", "😀 😀a. b", "tail ",
]


def test_words_and_windows_equal_those_of_python():
    found = T.words(pa.array(TEXTS))
    plain = [(t or "").encode().split() for t in TEXTS]
    assert np.diff(found.bounds).tolist() == [len(p) for p in plain]
    of = {}
    for i, p in enumerate(plain):
        for word, h in zip(p, found.hashes[found.bounds[i] : found.bounds[i + 1]].tolist()):
            assert of.setdefault(word, h) == h
    assert len(set(of.values())) == len(of)
    hashes, bounds = T.windows(found, 2)
    pairs = [tuple(p[j : j + 2]) for p in plain for j in range(len(p) - 1)]
    assert bounds[-1] == len(pairs) and len(set(hashes.tolist())) == len(set(pairs))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    encode = encoder(public_tokenizers.path(name))
    made = random.Random(3)
    alphabet = ["ab", "Wo", " ", "  ", "\n", "\t", ".", ",", "é", "ß", "7", "'s", "!", " ", "Q"]
    texts = TEXTS + ["".join(made.choices(alphabet, k=made.randrange(40))) for _ in range(400)]
    for _ in range(2):  # the second time from memory
        found = encode(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            ids = found.ids[found.bounds[i] : found.bounds[i + 1]].tolist()
            assert ids == encode.tokenizer.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_long_texts_are_encoded_in_segments(name, monkeypatch):
    monkeypatch.setattr(encode_module, "SEGMENT", 64)
    monkeypatch.setattr(encode_module, "RECENT", 20)
    monkeypatch.setattr(encode_module, "REMEMBERED", 60)
    encode = encode_module.Encoder(public_tokenizers.path(name))
    made = random.Random(4)
    alphabet = ["ab", "Wo", " ", " ", " ", "  ", "\n", ".", "é", "ж", "世 界", "7", "\u3000", " x", "word"]
    for _ in range(60):
        texts = ["".join(made.choices(alphabet, k=made.choice([0, 5, 80, 600]))) for _ in range(6)] + [None]
        found = encode(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            ids = found.ids[found.bounds[i] : found.bounds[i + 1]].tolist()
            assert ids == encode.tokenizer.encode(text or "", add_special_tokens=False).ids, text
    assert len(encode.old.hashes) and len(encode.old.hashes) <= 60 + 2 * 600


def test_memory_of_a_long_text_is_bounded():
    import tracemalloc

    encode = encoder(public_tokenizers.path("word_bpe_49k.json"))
    made = random.Random(5)
    words = ["".join(made.choices("abcdefgh", k=made.randint(2, 9))) for _ in range(4000)]
    text = " ".join(made.choices(words, k=1_000_000))
    encode(pa.array([text[:100_000]]))
    tracemalloc.start()
    found = encode(pa.array([text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # ids of a text take up to four bytes a character twice, all else a segment's share
    assert len(found.ids) > 1_000_000 and peak < 60 * encode_module.SEGMENT * 2 + 10 * len(text)


def test_pieces_keep_all_rows_and_their_order():
    batch = pa.record_batch([pa.array(["x" * n for n in (5, 3_000_000, 0, 7)])], names=["text"])
    parts = list(T.pieces(batch))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and len(parts) > 1
