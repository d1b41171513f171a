"""Token shards and packing: exact round trips on odd documents."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallybook.llm import packing, shards

DOCS = [
    (5, "five words are in here", 1.0), (2, None, 2.0), (9, "", 3.0), (7, "dup", 4.0), (7, "dup", 4.0),
    (7, "other text of seven", 5.0), (None, "no key", 6.0), (None, "no key", 6.0), (1, "x " * 9000, 7.0),
    (-3, "é ß\n\n z", 8.0),
]
SCHEMA = "doc_id long, text string, shard double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_returns_every_document_by_its_key(spark, docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    store = shards.write_store(docs, path, 2, str(tmp_path / "store"))
    found = shards.get(store, docs).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    wanted = sorted(
        (k is not None, k or 0, crc(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for k, t, _ in DOCS
    )
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.crc) for r in found) == wanted
    # null keys first, then by key; starts follow without gaps
    order = sorted(found, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0] + [r.n_tokens for r in order[:-1]]).tolist()
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in order]
    assert keys == sorted(keys)
    one = shards.get(store, spark.createDataFrame([(5,), (12345,)], "doc_id long")).collect()
    assert [r.doc_id for r in one] == [5]


def test_a_key_may_span_shards(spark, tmp_path):
    rows = spark.range(4000).select(F.lit(3).alias("doc_id"), F.concat(F.lit("t "), F.col("id") % 50).alias("text"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = shards.write_store(rows, path, 2, str(tmp_path / "store"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert store.manifest.count() > 1
    found = shards.get(store, spark.createDataFrame([(3,)], "doc_id long"))
    assert found.count() == 4000 and found.select("start").distinct().count() == 4000


def test_empty_store(spark, docs, tmp_path):
    store = shards.write_store(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"), 2, str(tmp_path / "s"))
    assert shards.get(store, docs).count() == 0


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = np.random.default_rng(1).choice(10**12, 5000, replace=False)
    columns = {n: np.arange(5000) for n in shards.PLACE} | {"doc_id": keys}
    data = b"".join(shards.index_bytes(columns))
    records, known = shards.index_lookup(data, keys)
    assert known.all() and sorted(records["ordinal"].tolist()) == list(range(5000))
    assert (records["ordinal"] == np.arange(5000)).all()
    assert not shards.index_lookup(data, keys + 10**13)[1].any()


def test_packing_places_every_id_once(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    found = [r.asDict() for r in packing.pack(docs, path, 1, size=256).collect()]
    wanted = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t, _ in DOCS)
    by_doc = {}
    for piece in sorted(found, key=lambda r: r["start"]):
        key = (piece["doc_id"], piece["doc_tokens"])
        by_doc.setdefault(key, []).append(piece)
    assert sorted(k[1] for k in by_doc for _ in range(sum(p["start"] == 0 for p in by_doc[k]))) == sorted(map(len, wanted))
    assert sum(len(p["ids"]) for p in found) == 4 * sum(map(len, wanted))
    long = b"".join(p["ids"] for p in by_doc[1, max(map(len, wanted))])
    assert np.frombuffer(long, "<u4").tolist() == max(wanted, key=len)
    sequences = {}
    for piece in found:
        sequences.setdefault(piece["sequence_id"], []).append((piece["offset"], piece["length"]))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0] + [n for _, n in places[:-1]]).tolist()
        assert sum(n for _, n in places) <= 256
    assert sorted(sequences) == list(range(len(sequences)))


def test_packing_plan_is_near_the_bound():
    made = np.random.default_rng(2)
    demand = {n: int(made.integers(1, 400)) for n in [*range(32, 2049, 32), *range(1, 32)]}
    plan = packing.packing_plan(list(demand), list(demand.values()), 2048)
    used = sum(np.array(p) * n for p, n in plan)
    assert used.tolist() == list(demand.values())
    lengths, counts = np.array(list(demand)), np.array(list(demand.values()), float)
    basis, amounts = packing.solve_patterns(lengths, counts, 2048)
    assert (np.abs(basis @ amounts - counts) < 1e-3).all() and (lengths @ basis <= 2048).all()
    assert sum(n for _, n in plan) <= np.ceil(amounts.sum()) + 2
    assert packing.packing_plan([], [], 2048) == []


def test_empty_packing(docs):
    assert packing.pack(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"), 1).count() == 0
