"""The pipeline's near-duplicate stage with null and repeated ids."""

import os
import random

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string"


def test_ids_link_no_texts(spark):
    made = random.Random(4)
    text = lambda: " ".join(f"w{made.randrange(900)}" for _ in range(60))
    five, nine, lone, other, seven = text(), text(), text(), text(), text()
    rows = [
        (5, five), (9, nine),  # unlike, copied by rows without an id
        (None, five), (None, nine + " end"),
        (None, lone), (None, lone), (None, other), (None, None), (None, ""),
        (7, seven), (7, text()), (7, text()), (8, seven + " end"), (4, None), (4, None),
    ]
    docs = spark.createDataFrame([(*r, "en") for r in rows], SCHEMA)
    kept = corpus_pipeline.near_duplicates_out(spark, docs, "")
    assert kept.columns == docs.columns
    wanted = [(5, five), (9, nine), (None, lone), (None, other), (None, None), (None, ""), *rows[9:12], (4, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, wanted))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables absent")
def test_run_leaves_the_last_table_only(spark):
    import corpus_pipeline
    from tallybook.session import made_here

    first = len(made_here())
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(made_here()) == first + 1
    pieces = found.collect()
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces) > 0
