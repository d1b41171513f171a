"""Scratch files: what goes and what stays."""

import os

from tallybook.session import discard, keep_last, made_here, materialise


def test_keep_last_leaves_earlier_tables_and_the_result(spark):
    earlier = materialise(spark.range(3))
    first = len(made_here())
    step = materialise(spark.range(5))
    result = materialise(step.where("id > 1"))
    folders = list(made_here())
    keep_last(spark, first)
    assert earlier.count() == 3 and result.count() == 3
    assert made_here() == [*folders[:first], folders[-1]]
    paths = [f.removeprefix("file:") for f in folders]
    assert [os.path.isdir(p) for p in paths[first:]] == [False, True]
    keep_last(spark, len(made_here()))
    assert result.count() == 3


def test_discard_deletes_only_the_named_tables(spark):
    kept, gone = materialise(spark.range(3)), materialise(spark.range(4))
    first = len(made_here()) - 2
    folders = [f.removeprefix("file:") for f in made_here()[first:]]
    discard(gone)
    assert kept.count() == 3
    assert [os.path.isdir(p) for p in folders] == [True, False]
    assert len(made_here()) == first + 1
