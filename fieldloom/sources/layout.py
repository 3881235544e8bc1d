"""A table layout for lookups: clustered by one key, with Bloom filters for others.

``lay_out`` ranges rows by the cluster key, so that each file and row group holds few of its values and the footer's ranges
rule out all others; page indexes narrow a row group further. A key that the rows aren't clustered by has Parquet Bloom
filters, so a point lookup skips every row group that doesn't hold it. A cluster key with many rows is split over
files by the order columns. Reads are plain Parquet reads with an equality; no index table has to be kept in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group, and rows of a page: what a lookup reads at least.
ROW_GROUP_BYTES, PAGE_ROWS = 4 << 20, 2_000


def lay_out(df: DataFrame, path: str, cluster: str, order: list[str] | None = None, points: list[str] | None = None, files: int = 32, row_group_bytes: int = ROW_GROUP_BYTES, distinct: int = 1_000_000, mode: str = "errorifexists") -> None:
    """Write ``df`` for lookups: ranged and sorted by ``cluster`` and then ``order``, with Bloom filters on ``points``.

    ``files`` is the number of ranges, and ``distinct`` how many different values of a point key a row group may hold
    (it sizes the filters; more only make them coarser). Null keys come first and are found by ``IS NULL``.
    """
    keys = [cluster, *(order or [])]
    out = df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode(mode)
    out = out.option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", PAGE_ROWS)
    out = out.option("parquet.block.size.row.check.min", 1).option("parquet.block.size.row.check.max", PAGE_ROWS)
    for p in points or []:
        out = out.option(f"parquet.bloom.filter.enabled#{p}", "true").option(f"parquet.bloom.filter.expected.ndv#{p}", distinct)
        # a dictionary would rule values out by itself, but only while the column fits one
        out = out.option(f"parquet.enable.dictionary#{p}", "false")
    out.parquet(path)


def lookup(spark: SparkSession, path: str, key: str, *values) -> DataFrame:
    """The rows of a laid-out table with one of the few given values of a key; the equality reaches the Parquet scan."""
    t = spark.read.parquet(path)
    kind = t.schema[key].dataType
    return t.where(F.col(key).isin([F.lit(v).cast(kind) for v in values]) if len(values) != 1 else F.col(key) == F.lit(values[0]).cast(kind))


def ranges(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``(file, rows, least, most)`` of a laid-out table: how far each file's values of a key reach."""
    t = spark.read.parquet(path).select(F.input_file_name().alias("file"), key)
    return t.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("least"), F.max(key).alias("most"))


def batch_lookup(spark: SparkSession, path: str, key: str, wanted: DataFrame, most: int = 10_000) -> DataFrame:
    """The rows whose key is in ``wanted(key)``: up to ``most`` different keys as a pushed-down list, more of them by a join."""
    keys = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    few = [r[0] for r in keys.limit(most + 1).collect()]
    if len(few) <= most:
        return lookup(spark, path, key, *few) if few else spark.read.parquet(path).limit(0)
    return spark.read.parquet(path).join(keys, key, "left_semi")
