"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.staging import release, stage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
    return row["n"], row["h"]


def _least(edges: DataFrame, others: bool) -> DataFrame:
    """Staged ``(u, m)``: the smallest neighbour of each node; or of the node itself and its neighbours."""
    m = F.min("v").alias("m")
    least = edges.groupBy("u").agg(m)
    return stage(least if others else least.select("u", F.least("u", "m").alias("m")), "least")


def _large_star(both: DataFrame, least: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the smallest one; ``both`` has every edge in both directions."""
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(large: DataFrame, least: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    tied = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u")
    return large.join(least, "u").select(tied, F.col("m").alias("v")).where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node on an edge; ``component`` is the smallest node reachable.

    Alternating large-star / small-star contraction over at most as many rows as there are edges. A hub's smallest
    neighbour is pre-aggregated map-side and staged, so that both sides of each join are plain exchanges, and AQE
    splits the hub's side. Tables of the round before are deleted; only an edge table's row count and checksum reach
    the driver.

    Nulls: an edge with a null end is ignored. Self-loops and repeated edges change nothing. No edges: no rows.
    """
    a, b = F.col(src), F.col(dst)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct()
    e = stage(e, "edges")
    was = _state(e)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, others=False)
        large = stage(_large_star(both, least), "large-star")
        low = _least(large, others=True)
        earlier, e = e, stage(_small_star(large, low), "edges")
        for t in (earlier, least, large, low):
            release(t)
        now = _state(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
