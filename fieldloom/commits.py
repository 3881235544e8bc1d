"""Commits: small numbered files that make what they name take effect, all at once."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """Another writer has committed the number."""


def files(spark: SparkSession, path: str):
    """The file system of a path, in whichever store it is, and the maker of its paths."""
    sc = spark.sparkContext
    make = sc._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(sc._jsc.hadoopConfiguration()), make


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = files(spark, folder)
    if not fs.exists(path(folder)):
        return []
    return sorted(n for s in fs.listStatus(path(folder)) if (n := s.getPath().getName()).endswith(".json") and n[0] != ".")


def last(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """Number and content of the last commit of a folder."""
    names = _names(spark, folder)
    if not names:
        return None
    text = spark.read.text(f"{folder}/{names[-1]}", wholetext=True).first()[0]
    return int(names[-1].removesuffix(".json")), json.loads(text)


def put(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Commit ``content`` under a number by a rename, so that nobody sees a part of it; ``Taken`` if the number is gone."""
    fs, path = files(spark, folder)
    fs.mkdirs(path(folder))
    name = f"{number:012d}.json"
    aside, there = path(f"{folder}/.{name}"), path(f"{folder}/{name}")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    if fs.exists(there) or not fs.rename(aside, there):
        raise Taken(there.toString())


def trim(spark: SparkSession, folder: str) -> None:
    """Delete all commits but the last."""
    fs, path = files(spark, folder)
    for name in _names(spark, folder)[:-1]:
        fs.delete(path(f"{folder}/{name}"), False)
