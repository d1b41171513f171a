"""Shared-folder housekeeping: checkpoints and scratch files."""

from __future__ import annotations

import atexit
import tempfile
import threading
import time
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only below this many measured bytes.
BROADCAST_BYTES = 64 * 1024 * 1024
# Of all tables written: they are a good part of what a job moves.
COMPRESSION = "zstd"
# An input with at least this many splits is never redistributed.
FEW_SPLITS = 32
# Seconds between two requests to collect the driver's garbage.
COLLECT_EVERY = 15.0
_folders: set[str] = set()
_collected = [0.0]
# Folders of the scratch files that each thread has made, in order.
_made = threading.local()
# The folder of every table that `materialise` returned.
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Only a local-mode session without that setting gets a temporary folder: on
    a cluster a machine-local path would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="tallybook-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Used where several steps need the same computed rows. Unlike a checkpoint
    the written table keeps its size and columns readable apart, and like one it
    survives the loss of executors.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path, compression=COMPRESSION)
    drop_shuffles(df.sparkSession)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[table] = path.rsplit("/", 1)[0]
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialise` returned; nothing may read them any more."""
    for table in tables:
        folder = _written.pop(table)
        remove(table.sparkSession, folder)
        if folder in made_here():
            made_here().remove(folder)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that nothing refers to any more.

    It does so when the driver's garbage collector finds them unused, which a driver with
    memory to spare may not do before the disks are full. Asked for now and then, as jobs
    of many steps shuffle several times their input.
    """
    now = time.monotonic()
    if now - _collected[0] >= COLLECT_EVERY:
        _collected[0] = now
        spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal an input of a few splits to all cores; larger inputs stay as read.

    `df` must be a plain scan. A small file arrives as one or two tasks, which
    would then do all the work that follows.
    """
    cores = min(df.sparkSession.sparkContext.defaultParallelism, FEW_SPLITS)
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; never reused, so never overwritten.

    All paths of an application lie in one folder, which goes when the driver exits.
    """
    application = spark.sparkContext.applicationId
    folder = f"{checkpoint_folder(spark).rstrip('/')}/tallybook/{application}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(remove, spark, folder)
    own = f"{folder}/{uuid.uuid4().hex}"
    made_here().append(own)
    return f"{own}/{name}"


def made_here() -> list[str]:
    if not hasattr(_made, "folders"):
        _made.folders = []
    return _made.folders


def keep_last(spark: SparkSession, first: int) -> None:
    """Delete this thread's scratch files made since there were `first`, all but the last.

    For the driver of several steps that has just written a step's whole result: nothing
    but that result may be read any more.
    """
    made = made_here()
    for folder in made[first:-1]:
        remove(spark, folder)
    del made[first:-1]


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store, if its session still lives."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the values of `df` were measured to fit a broadcast of `limit` bytes.

    `df` should be materialised: it is measured here and read again by its user.
    """
    size = F.lit(0).cast("bigint")
    for name, kind in df.dtypes:
        by_value = kind in ("string", "binary") or not kind.isidentifier()
        text = F.col(name) if kind in ("string", "binary") else F.to_json(F.struct(name))
        size = size + (F.coalesce(F.octet_length(text), F.lit(0)) + 16 if by_value else F.lit(16))
    total = df.agg(F.sum(size)).first()[0] or 0
    return total <= limit


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, broadcast: bool = False
) -> DataFrame:
    """Equi-join under which two NULL keys match; the left key columns stay."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    # the alias keeps both sides apart where one derives from the other
    renamed = renamed.select(*(F.col(c).alias(c) for c in renamed.columns))
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_right_{key}"))
    joined = left.join(F.broadcast(renamed) if broadcast else renamed, condition, how)
    return joined.drop(*(f"_right_{k}" for k in keys))
