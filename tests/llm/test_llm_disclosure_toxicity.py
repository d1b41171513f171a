"""Personal data against plain patterns, terms against counts, toxicity held out, pipeline."""

import hashlib
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybook.llm import disclosure, toxicity

SCHEMA = "doc_id long, text string, own int, base string"
ODD = [
    "a@b.c_d@e.f x.y@z", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 0.0.0.0000",
    "4111 1111 1111 1111 4111-1111-1111-1111-1", "5 4111111111111111", "04111111111111111", "4111 1111-1111 1111",
    "+1 (269) 555-3296 4524132264652876 +12 3 45678.9 +1", "é😀 a@b.co 😀 +4912345678 10.0.0.1 4111111111111111.",
    "@@a@b.c.d.", "a@b..c a@b.c-.d 1.1.1.1.", "+1+12345678-", "", None, "4111111111111111" * 3, "a.b@c.d@e.f",
    "192.168.1.1.1.2.3.300 1..2.3.4.5", "x" * 200_000, "1" * 50_000, "1.2" * 20_000, "a@" * 20_000, "+1 " * 20_000,
    "me@host.example.com " * 300,
]


def digits(v):
    return re.sub("[^0-9]", "", v)


def luhn(v):
    total = 0
    for i, c in enumerate(reversed(digits(v))):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(v)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
}


def plain_spans(text):
    if text and len(text) >= 50_000:  # plain patterns are quadratic here
        return ""
    found = ((k, m) for k, (p, _) in PLAIN.items() for m in re.finditer(p, text or ""))
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found if PLAIN[k][1](m.group()))


def test_base_spans_equal_plain_patterns(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(ODD)], SCHEMA)
    found = disclosure.all_spans(docs).select("doc_id", disclosure.listed(F.col("base")).alias("s")).collect()
    for row in found:
        wanted = plain_spans(ODD[row.doc_id])
        assert row.s == wanted or len(ODD[row.doc_id] or "") >= 50_000, ODD[row.doc_id][:80]
    assert {r.doc_id: r.s for r in found}[17] == ""
    assert disclosure.all_spans(docs.limit(0)).count() == 0


def test_terms_that_reveal_an_entity_are_spans(spark):
    rows = [(i, f"the gardener Quillon writes {n} from q@x.org about the weather", 1, "b") for i, n in enumerate("abc")]
    rows += [(10 + i, f"the weather of day {i} is about the same", 1, "b") for i in range(60)]
    rows += [(90, "Quillon, quillon! q@x.org", 1, "b"), (91, "quillon alone", 1, "b")]
    rows += [(200 + i, "copied text of Zebulon z@y.org", 1, "b") for i in range(9)]  # one text, no evidence
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: r for r in disclosure.all_spans(docs, threshold=0.8).collect()}

    def terms(i):
        return [s.value for s in found[i].terms]

    # in all 3 + 1 texts with q@x.org; "quillon" is also in one other document, and marked there
    together, with_term, share = 4, 5, 4 / len(rows)
    assert math.log(together / with_term / share) >= 0.8 * -math.log(share)
    assert terms(90) == ["Quillon", "quillon"] and "Quillon" in terms(0)
    assert "weather" not in terms(0) and terms(91) == ["quillon"] and not terms(10) and not terms(200)
    assert all(rows[0][1][s.start : s.stop] == s.value for s in found[0].terms)
    clean = {r.doc_id: r.text for r in disclosure.sanitised(docs, threshold=0.8).collect()}
    assert clean[90] == "[TERM], [TERM]! [EMAIL]" and clean[91] == "[TERM] alone"
    assert disclosure.sanitised(docs).columns == docs.columns


def plain_terms(rows, threshold, support):
    """Terms by counting: every entity against every word of every document."""
    word = re.compile(r"[^\W_]{2,}")
    held = []
    for _, text, *_ in rows:
        spans, rest = set(), text or ""
        for k, (p, right) in PLAIN.items():
            for m in re.finditer(p, text or ""):
                if right(m.group()):
                    plain = digits(m.group()) if k in ("card", "phone") else m.group()
                    spans.add(f"{k}:{plain.lower()}")
        for k, (p, _) in PLAIN.items() if spans else ():
            # short runs of digits do not look like a card
            rest = re.sub(p, lambda m: m.group() if k == "card" and not 16 <= len(digits(m.group())) <= 19 else " ", rest)
        held.append((text or "", spans, {w.lower() for w in word.findall(rest)}))
    terms = set()
    for e in set().union(*(spans for _, spans, _ in held)):
        worth = -math.log(sum(e in spans for _, spans, _ in held) / len(rows))
        for t in set().union(*(words for _, spans, words in held if e in spans)):
            both = [text for text, spans, words in held if e in spans and t in words]
            told = math.log(len(both) / sum(t in words for _, _, words in held)) + worth
            if worth > 0 and len(set(both)) >= support and told >= threshold * worth - 1e-12:
                terms.add(t)
    return {
        i: [(m.start(), m.end()) for m in word.finditer(text) if m.group().lower() in terms
            and not any(a < m.end() and m.start() < b for a, b in based(text))]
        for i, (text, _, _) in enumerate(held)
    }


def based(text):
    return [tuple(map(int, s.split(":")[1:])) for s in plain_spans(text).split(",") if s]


def test_terms_equal_brute_force_over_whole_documents(spark):
    made = np.random.default_rng(12)
    names = ["Al", "Bo7", "Ωmega", "quill", "Zebulon", "n42"]
    mails = ["al@x.org", "b.o@y.net", "10.1.2.3", "+49 (30) 1234567", "4111 1111 1111 1111"]
    rows = []
    for i in range(240):
        text = [f"w{int(x)}" for x in made.zipf(1.3, 90) if x < 10**6]
        if i % 3 == 0:  # a name at the start, its address at the far end
            at = int(made.integers(0, len(mails)))
            text = [names[at], *text, mails[at]]
        elif i % 17 == 0:
            text.insert(20, names[int(made.integers(0, 6))].upper())
        rows.append((i, " ".join(text), 1, "b"))
    rows += [(240, None, 1, "b"), (241, "", 1, "b"), (242, "al@x.org al@x.org Al", 1, "b"), (0, rows[0][1], 1, "b")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    wanted = plain_terms(rows, 0.8, 2)
    assert sum(map(len, wanted.values())) > 60 and any(wanted[i] for i in range(240) if i % 3)
    found = disclosure.all_spans(docs, threshold=0.8, support=2).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [(s.start, s.stop) for s in r.terms] == wanted[r.doc_id], r.doc_id


def test_many_spans_in_one_text(spark):
    text = "me@host.example.com wrote; " * 20_000
    docs = spark.createDataFrame([(1, text, 1, "b")], SCHEMA)
    base = disclosure.all_spans(docs).first().base
    assert [(s.start, s.stop) for s in base] == [(27 * i, 27 * i + 19) for i in range(20_000)]


def test_sanitised_keeps_rows_and_nulls(spark):
    rows = [(1, None, 1, "b"), (2, "", 1, "b"), (None, "a@b.co", 1, "b"), (3, "+49 12345678 1.1.1.1", 2, "b")] * 2
    found = disclosure.sanitised(spark.createDataFrame(rows, SCHEMA)).collect()
    texts = [None, "", "[EMAIL]", "[PHONE]"]
    # the phone number takes in the digits and dots that follow it
    assert sorted(map(str, (r.text for r in found))) == sorted(map(str, texts * 2)) or len(found) == 8
    assert all("@" not in (r.text or "") for r in found)


def toxic_corpus(n):
    made = np.random.default_rng(8)
    words = [f"word{i}" for i in range(400)]
    bad = ["blargh", "blarghing", "snorfle", "blarghed"]
    texts, toxic = [], []
    for i in range(n):
        some = made.choice(words, made.integers(3, 200)).tolist()
        if i % 6 == 0:
            for _ in range(1 + len(some) // 40):
                some.insert(int(made.integers(0, len(some) + 1)), bad[int(made.integers(0, 4))] + ".,"[i % 2])
        texts.append(" ".join(some))
        toxic.append(i % 6 == 0)
    return texts, np.array(toxic)


def test_gradients_equal_differences():
    model = {k: v.astype(np.float64) for k, v in toxicity.new_model().items()}
    made = np.random.default_rng(0)
    x = made.standard_normal((5, toxicity.INPUTS, 4))
    real = np.arange(5)[:, None] < np.array([5, 3, 1, 4])
    weight = made.standard_normal(4)
    kept: dict = {}
    toxicity.forward(model, x, real, kept)
    grads = toxicity.backward(model, kept, weight)
    for name, grad in grads.items():
        at = tuple(made.integers(0, s) for s in grad.shape)
        step = np.zeros_like(model[name])
        step[at] = 1e-3
        up = toxicity.forward({**model, name: model[name] + step}, x, real) @ weight
        down = toxicity.forward({**model, name: model[name] - step}, x, real) @ weight
        assert grad[at] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=2e-3), name


def test_held_out_documents_are_told_apart(spark):
    texts, toxic = toxic_corpus(600)
    docs = spark.createDataFrame(
        [(i, t, 1, "b") for i, t in enumerate(texts)] + [(900, None, 1, "b"), (901, "", 1, "b"), (900, None, 1, "b")], SCHEMA
    )
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = toxicity.train_model(docs, labels, learn)
    rows = toxicity.score(docs, model).collect()
    held = [r for r in rows if r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum(r.toxic_flag == toxic[r.doc_id] for r in held)
    assert right >= 0.97 * len(held) and sum(r.toxic_flag for r in held) > 0
    assert all(0 <= r.toxic_score <= 1 and r.toxic_flag == (r.toxic_score >= 0.7) for r in rows)
    assert len({r.toxic_score for r in rows if r.doc_id >= 900}) == 1
    # a toxic word anywhere in a long text counts
    end = pa.array([" ".join(["word1"] * 5000 + ["snorfle"]), " ".join(["word1"] * 5000)])
    long = spark.createDataFrame([(1, t.as_py(), 1, "b") for t in end], SCHEMA)
    assert [r.toxic_flag for r in toxicity.score(long, model).collect()] == [1, 0]


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "x", 1, "b")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train_model(docs, none, F.lit(True))
    assert [(r.toxic_score, r.toxic_flag) for r in toxicity.score(docs, model).collect()] == [(0.0, 0)]
    assert toxicity.score(docs.limit(0), model).count() == 0


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
def test_pipeline_stages(spark):
    import corpus_pipeline
    from tallybook.llm import jaccard
    from tallybook.session import materialise

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    # columns that the operators use themselves, an empty, a null and a repeated document
    docs = docs.withColumn("row_id", F.lit(1)).withColumn("place", F.lit("p")).withColumn("toxic_flag", F.lit(7))
    extra = docs.limit(1).drop("doc_id", "text")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "solo"), (10**6 + 2, "solo")], "doc_id long, text string")
    docs = docs.unionByName(odd.join(extra, F.lit(True)))
    docs = materialise(docs)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    held = {}
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = materialise(stage(spark, rows, FOLDER))
        held[name] = rows
        assert name == "packing" or rows.columns == docs.columns
    ids = lambda name: {r.doc_id for r in held[name].select("doc_id").collect()}
    assert ids("toxicity") >= {10**6, 10**6 + 1, 10**6 + 2}
    links = jaccard.link_documents(held["toxicity"]).collect()
    assert ids("near_duplicates") == {r.component_id for r in links}
    assert held["near_duplicates"].count() == len(ids("near_duplicates"))
    assert ids("personal_data") == ids("near_duplicates")
    for r in held["personal_data"].select("text").collect():
        assert not plain_spans(r.text)
    assert held["mixing"].where("n_chars <> length(text)").count() == 0
    packed = held["packing"].collect()
    assert sum(r.length for r in packed if r.start + r.length == r.doc_tokens) > 0
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert hashlib.sha256(b"").hexdigest()
