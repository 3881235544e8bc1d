"""Sinks: appends, conditional inserts, patches, manifests and once-only reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def once(df: DataFrame, path: str) -> None:
    """Write, unless something is there already."""
    df.write.mode("errorifexists").parquet(path)


def exists(df: DataFrame, path: str) -> bool:
    """Whether something is at a path, in whichever file system it names."""
    sc = df.sparkSession.sparkContext
    there = sc._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(sc._jsc.hadoopConfiguration()).exists(there)


def once_or_stamped(df: DataFrame, path: str, stamp: str) -> str:
    """Write to the path, or beside it under the stamp if something is there; returns where."""
    to = f"{path}-{stamp}" if exists(df, path) else path
    once(df, to)
    return to


def new_by_key(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key isn't in ``old``; of rows that share a new key the first by all columns stays."""
    first = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("row"))
    return first.join(old.select(key), key, "left_anti").select(key, "row.*").select(*new.columns)


def truthy(c: Column, kind: str) -> Column:
    """Whether a value counts as given: not null, not empty, not zero."""
    if kind == "string":
        return c.isNotNull() & (c != "")
    if kind in ("int", "bigint", "double", "float"):
        return c.isNotNull() & (c != 0)
    return c.isNotNull()


def patched(users: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Users with the given fields of a patch put in; a nested value is replaced as a whole."""
    kinds = dict(patches.dtypes)
    new = patches.select(key, *[F.col(f).alias(f"new_{f}") for f in fields])
    joined = users.join(new, key, "left")
    put = {f: F.when(truthy(F.col(f"new_{f}"), kinds[f]), F.col(f"new_{f}")).otherwise(F.col(f)) for f in fields}
    return joined.select(*[put[c].alias(c) if c in put else F.col(c) for c in users.columns])


def manifest_csv(df: DataFrame, path: str) -> None:
    """A manifest in its total order as one file, cells quoted only where they need it: a small sink, for a reader
    that takes a single CSV. ``manifest_ranges`` is the one for large manifests."""
    df.orderBy("class_name", "group_key", "path").coalesce(1).write.csv(path, header=True, emptyValue="", escape='"')


def manifest_ranges(df: DataFrame, path: str) -> None:
    """The same order over many files: ranges by class, group and path, each sorted, so that file names keep it."""
    df.orderBy("class_name", "group_key", "path").write.csv(path, header=True, emptyValue="", escape='"')


def predictions_csv(df: DataFrame, path: str) -> None:
    """Predictions with the probabilities as a JSON cell."""
    df.withColumn("probabilities", F.to_json("probabilities")).write.csv(path, header=True, emptyValue="", escape='"')


def sorted_keys(c: Column, kind: T.DataType) -> Column:
    """A value whose objects, at any depth, have their keys in order."""
    if isinstance(kind, T.StructType):
        fields = [sorted_keys(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: sorted_keys(x, kind.elementType))
    return c


def report_json(df: DataFrame, path: str) -> None:
    """A report as JSON lines whose keys are sorted at every depth."""
    rows = [sorted_keys(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    df.select(*rows).write.json(path, ignoreNullFields=False)


def pretty_json(df: DataFrame, path: str) -> None:
    """A report of few rows as indented documents with sorted keys, one after the other in one file."""
    rows = F.struct(*[sorted_keys(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)])
    df.select(F.to_json(rows, {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1).write.text(path)
