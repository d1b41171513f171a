"""Content digests of source files and their check against a manifest."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.sources.csv import RawDataError

# Bytes of a file that a task holds at once.
BLOCK_BYTES = 8 * 1024 * 1024
SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:/*")
GLOB = re.compile(r"[*?\[{]")


class HashMismatchError(RawDataError):
    """A file's digest is not the expected one, or the file is absent."""


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path within it."""
    if uri.startswith("file:"):
        uri = "file:///" + SCHEME.sub("", uri)
    return fs.FileSystem.from_uri(uri)


def _root(path: str) -> str:
    """The folder that relative names start from, without scheme or pattern."""
    plain = "/" + SCHEME.sub("", path).strip("/")
    parts = plain.split("/")
    fixed = next((i for i, part in enumerate(parts) if GLOB.search(part)), len(parts))
    return "/".join(parts[:fixed]) + "/"


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """`file, n_bytes, digest` of every file under `path`: the SHA-256 of its content.

    `file` is the name relative to `path`, or the base name if that is the file. Files of
    any size are streamed in blocks, each by one task.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.split("path", re.escape(_root(path)), 2)
    name = F.coalesce(F.get(below, F.lit(1)), F.regexp_extract("path", "([^/]+)$", 1))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri in batch.column("path").to_pylist():
                system, place = opened(uri)
                total = hashlib.sha256()
                with system.open_input_stream(place) as source:
                    while block := source.read(BLOCK_BYTES):
                        total.update(block)
                found.append(total.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("length"), pa.array(found, pa.string())],
                names=["file", "n_bytes", "digest"],
            )

    return listed.select("path", name.alias("file"), "length").mapInArrow(
        digest, "file string, n_bytes long, digest string"
    )


def compare_manifest(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each manifest line (`file, digest`) with what was found and its status."""
    found = digests.select("file", "n_bytes", F.col("digest").alias("found"))
    status = (
        F.when(F.col("found").isNull(), "absent")
        .when(F.col("found") == F.col("digest"), "ok")
        .otherwise("mismatch")
    )
    return (
        manifest.select("file", F.col("digest"))
        .join(found, "file", "left")
        .withColumn("status", status)
    )


def validate_manifest(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Raise unless every file of the manifest is there with its digest."""
    compared = compare_manifest(digests, manifest)
    wrong = compared.where(F.col("status") != "ok").limit(5).collect()
    if wrong:
        raise HashMismatchError(
            "; ".join(f"{r.file}: {r.status}, expected {r.digest}, found {r.found}" for r in wrong)
        )
    return compared
