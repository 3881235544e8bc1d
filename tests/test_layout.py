"""Lookups in laid-out tables read few rows."""

import pytest
from pyspark.sql import functions as F

from fieldloom.sources import layout


def scanned(df):
    """Rows that the Parquet reader handed on when ``df`` ran, after row groups and pages that can't match were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "AdaptiveSparkPlan" in plan.toString() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """400,000 rows; user 5 has a third of them."""
    path = f"file://{tmp_path_factory.mktemp('layout')}/t"
    user = F.when(F.col("id") % 3 == 0, 5).otherwise(F.pmod(F.xxhash64("id"), F.lit(4000)).cast("int"))
    rows = spark.range(400_000).select(F.concat(F.lit("a"), F.xxhash64("id").cast("string")).alias("key"), user.alias("userId"), F.col("id").alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("body"))
    layout.lay_out(rows, path, "userId", ["at"], points=["key"], files=8, row_group_bytes=1 << 20, distinct=20_000)
    return path, rows


def test_a_user_reads_few_pages(spark, table):
    path, rows = table
    got = layout.lookup(spark, path, "userId", 1234)
    want = rows.where("userId = 1234").count()
    assert got.count() == want > 0
    assert scanned(layout.lookup(spark, path, "userId", 1234)) <= want + 4 * layout.PAGE_ROWS


def test_a_point_reads_few_row_groups(spark, table):
    path, rows = table
    key = rows.where("id = 77 or at = 77").first()["key"] if "id" in rows.columns else rows.where("at = 77").first()["key"]
    assert layout.lookup(spark, path, "key", key).count() == 1
    assert scanned(layout.lookup(spark, path, "key", key)) < 40_000
    assert layout.lookup(spark, path, "key", "absent").count() == 0


def test_a_user_with_a_third_of_all_rows_is_split_over_files(spark, table):
    path, _ = table
    reach = layout.ranges(spark, path, "userId").collect()
    assert len(reach) == 8 and max(r["rows"] for r in reach) < 1.6 * 400_000 / 8
    assert sum(r["least"] == r["most"] == 5 for r in reach) >= 1


def test_batches_of_keys(spark, table):
    path, rows = table
    few, many = (spark.range(n).select((F.col("id") * 7).cast("int").alias("userId")) for n in (3, 60))
    for wanted in (few, many):
        got = layout.batch_lookup(spark, path, "userId", wanted, most=10)
        assert got.count() == rows.join(wanted, "userId", "left_semi").count()
    assert scanned(layout.batch_lookup(spark, path, "userId", few)) < 40_000
    assert layout.batch_lookup(spark, path, "userId", few.limit(0)).count() == 0
