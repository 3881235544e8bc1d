"""Connected components: hubs are split, and results equal a plain union-find."""

import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import graph
from fieldloom.staging import stage

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.files.maxPartitionBytes": "64k",
    "spark.sql.files.openCostInBytes": "1k",
}


@pytest.fixture
def skewed(spark):
    was = {k: spark.conf.get(k) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hub_is_split_in_the_final_plan(skewed):
    edges = skewed.range(1, 100_000, numPartitions=16).select(F.xxhash64("id").alias("u"), F.lit(-(1 << 63)).alias("v"))
    both = stage(edges.union(edges.select("v", "u")).repartition(16), "hub")
    least = graph._least(both, others=False)
    assert "skew=true" in final_plan(graph._large_star(both, least))
    hub = stage(both.where("u < v"), "one-way")
    assert "skew=true" in final_plan(graph._small_star(hub, graph._least(hub, others=True)))


def test_components_equal_union_find(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 6000 + k) for k in range(200)] + [(7, 7), (None, 3)]
    name = {}
    for a, b in edges:
        if a is not None and a != b:
            name.setdefault(a, a), name.setdefault(b, b)
            x, y = sorted((name[a], name[b]))
            name = {k: x if v == y else v for k, v in name.items()}
    got = graph.connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {x.node: x.component for x in got.collect()} == name and got.count() == len(name)
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
