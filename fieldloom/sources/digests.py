"""Digests of files of any size: a file is read as a stream of 1 MiB pieces, never as one value.

Names and lengths come from Spark's file listing, whose content column isn't read. Each task opens its files in the
store that their path names and feeds pieces to the hash. A store that only Spark opens has its files as values instead, so of 2 GB
at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 20
#: Schemes that Arrow opens as Spark does.
STREAMED = ("file", "hdfs", "s3", "s3a", "gs")
FIELDS = "path string, length long, pieces long, sha256 string, error string"


def stream_digest(path: str, most: int | None = None) -> tuple[int, int, str | None, str | None]:
    """Length, pieces, SHA-256 and error of a file; it isn't read beyond ``most`` bytes."""
    files, name = fs.FileSystem.from_uri(quote(path.replace("s3a://", "s3://", 1), safe="/:@"))
    state, length, pieces = hashlib.sha256(), 0, 0
    with files.open_input_stream(name, compression=None, buffer_size=0) as f:
        while piece := f.read(PIECE):
            state.update(piece)
            length, pieces = length + len(piece), pieces + 1
            if most is not None and length > most:
                return length, pieces, None, "TOO_LARGE"
    return length, pieces, state.hexdigest(), None


def _digests(most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row = (length, 0, None, "TOO_LARGE") if most is not None and length > most else None
                try:
                    row = row or stream_digest(path, most)
                except OSError:
                    row = (length, 0, None, "UNREADABLE")
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((path, *row), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["path", "length", "pieces", "sha256", "error"])

    return run


def file_digests(spark: SparkSession, path: str, glob: str = "*", most: int | None = None, tasks: int | None = None) -> DataFrame:
    """``(path, length, pieces, sha256, error)`` of the files below a folder, in the order of folder and name.

    A file of over ``most`` bytes isn't opened: TOO_LARGE. One that can't be read, say because it went meanwhile: UNREADABLE.
    Spark's listing passes over empty files, so these give no row. ``tasks`` deals the files by name to so many tasks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    named = files.select("path", "length")
    scheme = F.regexp_extract("path", "^([a-zA-Z0-9]+):", 1)
    streamed = named.where(scheme.isin(*STREAMED))
    dealt = streamed.repartition(tasks, "path") if tasks else streamed.repartition("path")
    out = dealt.mapInArrow(_digests(most), FIELDS)
    others = files.where(~scheme.isin(*STREAMED))
    fine = F.lit(True) if most is None else F.col("length") <= most
    value = F.when(fine, F.sha2("content", 256)).alias("sha256")
    others = others.select("path", "length", F.when(fine, F.ceil(F.col("length") / PIECE)).otherwise(0).cast("long").alias("pieces"), value, F.when(~fine, "TOO_LARGE").alias("error"))
    return out.unionByName(others).orderBy(F.regexp_replace("path", "/[^/]*$", ""), "path")
