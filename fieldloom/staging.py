"""Intermediate tables in the folder that the whole cluster shares.

A staged table cuts the lineage of an iterative job: it is plain Parquet below ``spark.checkpoint.dir``,
so a lost executor costs a re-read and never a recomputation of earlier rounds.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Rows of whole texts, or of sets made from them, that a reader or a Python worker holds at once.
TEXT_ROWS = 1024
_BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")

_own: dict[str, str] = {}
_staged: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The shared work folder: ``spark.checkpoint.dir``, or a temporary one where it is unset on a local master.

    On a cluster a folder of the driver's machine would be another one on every executor, so there it must be set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="fieldloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/fieldloom/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder, a folder for each value of ``by``, and return a DataFrame that reads it back."""
    path = new_path(df.sparkSession, label)
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _staged[out] = path
    return out


@contextmanager
def long_rows(spark: SparkSession) -> Iterator[None]:
    """What runs inside reads, and hands to Python, TEXT_ROWS rows at once at most: a batch lies in Spark and in the worker."""
    before = {k: spark.conf.get(k) for k in _BATCHES}
    try:
        for k, n in before.items():
            spark.conf.set(k, str(min(int(n), TEXT_ROWS) if int(n) > 0 else TEXT_ROWS))
        yield
    finally:
        for k, n in before.items():
            spark.conf.set(k, n)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(df: DataFrame) -> None:
    """Delete the table that ``stage`` wrote for ``df``, which nothing must read any more."""
    path = _staged.pop(df, None)
    if path:
        _delete(df.sparkSession, path)


def discard(spark: SparkSession) -> None:
    """Delete everything staged under the shared folder; results that still read it become invalid."""
    _delete(spark, f"{shared_dir(spark)}/fieldloom")
