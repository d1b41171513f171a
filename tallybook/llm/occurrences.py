"""Values that occur more than once in the arrays of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.text import release

# Values one bucket holds, about.
BUCKET_VALUES = 250_000


def blocks(held: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Per bucket, the distinct values of a task: those it has once and those it has again."""
    if not held:
        return
    values, counts = np.unique(np.concatenate(held), return_counts=True)
    bucket = ((values >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    numbers, begin = np.unique(bucket[order], return_index=True)
    for number, some in zip(numbers.tolist(), np.split(order, begin[1:])):
        single = counts[some] == 1
        sent = [values[some][single].tobytes(), values[some][~single].tobytes()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *(pa.array([b], pa.binary()) for b in sent)],
            names=["bucket", "once", "often"],
        )


def repeated_values(rows: DataFrame, column: str) -> DataFrame:
    """`value` of every long that occurs at least twice in `column`, arrays of longs.

    Each task sends its distinct values as one block of bytes per bucket, eight bytes a
    value; a value that all rows share arrives once per task.
    """
    total = rows.agg(F.sum(F.size(column))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_VALUES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pc.list_flatten(b.column(0)).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        yield from blocks(held, buckets)
        held = None  # the worker lives on, idle, while others need its memory
        release()

    def meet(table: pa.Table) -> pa.Table:
        once = np.frombuffer(b"".join(table.column("once").to_pylist()), np.uint64)
        often = np.frombuffer(b"".join(table.column("often").to_pylist()), np.uint64)
        often = np.unique(often)
        values, counts = np.unique(np.concatenate([once, often]), return_counts=True)
        found = np.union1d(values[counts > 1], often)
        return pa.table([pa.array(found.view(np.int64))], names=["value"])

    dealt = rows.select(column).mapInArrow(deal, "bucket long, once binary, often binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "value long")
