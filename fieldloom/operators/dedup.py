"""Exact and near duplicates of images, and their clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import scalars
from fieldloom.operators.graph import connected_components
from fieldloom.staging import stage


def _mask(width: int) -> int:
    """The lowest bits of a long."""
    return (1 << width) - 1 if width < 64 else -1


def exact_groups(images: DataFrame) -> DataFrame:
    """Content hashes that several images share: representative (smallest path), members, classes among them."""
    g = images.groupBy("sha256").agg(F.min("path").alias("representative"), F.count(F.lit(1)).alias("members"), F.count_distinct("class_name").alias("classes"))
    return g.where(F.col("members") > 1).withColumn("cross_class", F.col("classes") > 1)


def exact_duplicates(images: DataFrame) -> DataFrame:
    """Images that are not the representative of their hash, with it. A group's members are never gathered, and as its
    representative is staged, AQE splits a group that many images share."""
    rep = stage(exact_groups(images).select("sha256", "representative", "cross_class"), "representatives")
    return images.join(rep, "sha256").where(F.col("path") != F.col("representative")).select("path", "representative", "cross_class")


def duplicate_summary(images: DataFrame) -> DataFrame:
    """Counters over all images and their duplicate groups."""
    per = images.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("class_name").alias("classes"))
    count_if = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("images"),
        F.count(F.lit(1)).alias("unique_hashes"),
        count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant_images"),
        count_if((F.col("n") > 1) & (F.col("classes") == 1)).alias("within_class_groups"),
        count_if(F.col("classes") > 1).alias("cross_class_groups"),
    )


def perceptual_hashes(images: DataFrame, size: int = 32, low: int = 8) -> DataFrame:
    """``(id, hash)`` of grey images (id, pixels): 64 bits, the lowest frequencies of their cosine transform above the median, first highest.

    ``pixels`` are ``size`` by ``size`` values row by row; null for null and for another number of values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.cos(np.pi * np.outer(np.arange(low), 2 * np.arange(size) + 1) / (2 * size))
        for b in batches:
            out = []
            for p in b.column("pixels"):
                p = p.values.to_numpy(zero_copy_only=False) if p.is_valid else ()
                f = c @ p.reshape(size, size) @ c.T if len(p) == size * size else None
                out.append(None if f is None else int(np.packbits((f > np.median(f)).ravel()).view(">i8")[0]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.int64())], ["id", "hash"])

    rows = images.select(F.col("id").cast("long").alias("id"), F.col("pixels").cast("array<double>").alias("pixels"))
    return rows.mapInArrow(run, "id long, hash long")


def near_hashes(hashes: DataFrame, most: int) -> DataFrame:
    """``(hash, hash2, distance)`` of distinct hashes ``hash < hash2`` within ``most`` bits.

    ``most + 1`` bands of the 64 bits give the keys of an exact equi-join: hashes within ``most`` bits share a band.
    A pair is reported by the first band it shares.
    """
    bands = most + 1
    cuts = [64 * k // bands for k in range(bands + 1)]
    key = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("hash", a).bitwiseAND(F.lit(_mask(b - a))).alias("bits")) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))])
    uniq = hashes.select("hash").distinct()
    keyed = uniq.select("hash", F.explode(key).alias("k")).select("hash", "k.band", "k.bits")
    other = keyed.withColumnRenamed("hash", "hash2")
    near = keyed.join(other, ["band", "bits"]).where(F.col("hash") < F.col("hash2"))
    diff = F.col("hash").bitwiseXOR(F.col("hash2"))
    first = F.lit(bands)
    for k in reversed(range(bands)):
        a, b = cuts[k], cuts[k + 1]
        first = F.when(F.shiftrightunsigned(diff, a).bitwiseAND(F.lit(_mask(b - a))) == 0, F.lit(k)).otherwise(first)
    return near.where((F.col("band") == first) & (F.bit_count(diff) <= most)).select("hash", "hash2", scalars.hamming(F.col("hash"), F.col("hash2")).alias("distance"))


def hamming_pairs(hashes: DataFrame, most: int) -> DataFrame:
    """Pairs ``a < b`` of images whose hashes are within ``most`` bits.

    Members of equal hashes are joined back at the end, as the pair table itself is asked for; clusters don't need it.
    """
    near = near_hashes(hashes, most)
    own = hashes.select(F.col("id").alias("a"), F.col("class_index").alias("a_class"), "hash")
    its = hashes.select(F.col("id").alias("b"), F.col("class_index").alias("b_class"), F.col("hash").alias("hash2"))
    apart = near.join(own, "hash").join(its, "hash2")
    same = own.join(its, F.col("hash") == F.col("hash2")).where(F.col("a") < F.col("b")).withColumn("distance", F.lit(0))
    cols = ["a", "a_class", "b", "b_class", "distance"]
    pairs = apart.select(*cols).unionByName(same.select(*cols))
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(pick("a", "b").alias("a"), pick("a_class", "b_class").alias("a_class"), pick("b", "a").alias("b"), pick("b_class", "a_class").alias("b_class"), "distance", (F.col("a_class") != F.col("b_class")).alias("cross_class"))


def hamming_classes(hashes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The same pairs without writing out copies: classes of equal hashes, and pairs of classes within ``most`` bits.

    Classes are ``(hash, first, n, classes)``: smallest member, members, and how many class indexes they have. Pairs are
    ``(first, first2, distance, n, n2)``. With the images' hashes as membership they say as much as all pairs of images, in
    rows that grow with images and pairs of different hashes instead of with the square of a group of copies.
    """
    classes = stage(hashes.groupBy("hash").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.count_distinct("class_index").alias("classes")), "hash-classes")
    own, its = classes.select("hash", "first", "n"), classes.select(F.col("hash").alias("hash2"), F.col("first").alias("first2"), F.col("n").alias("n2"))
    pairs = near_hashes(classes, most).join(own, "hash").join(its, "hash2")
    swap = F.col("first") > F.col("first2")
    turned = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return classes, pairs.select(turned("first", "first2").alias("first"), turned("first2", "first").alias("first2"), "distance", turned("n", "n2").alias("n"), turned("n2", "n").alias("n2"))


def clusters(hashes: DataFrame, most: int) -> DataFrame:
    """``(id, cluster_id)``: images linked by hashes within ``most`` bits, named by their smallest member.

    Distinct hashes are linked, so a group of equal ones is one node; images alone in their component give no row.
    """
    reps = hashes.groupBy("hash").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    found = connected_components(near_hashes(hashes, most), "hash", "hash2").withColumnRenamed("node", "hash")
    of = reps.join(found, "hash", "left").select("hash", "first", "n", F.coalesce("component", "hash").alias("component"))
    named = of.groupBy("component").agg(F.min("first").alias("cluster_id"), F.sum("n").alias("members")).where("members > 1")
    of = stage(of.join(named, "component").select("hash", "cluster_id"), "clusters")
    return hashes.select("id", "hash").join(of, "hash").select("id", "cluster_id")


#: Distinct hashes of a cluster that are compared with as many others in one task.
BLOCK = 2048
#: Members of a large cluster, besides its centre, that bound its distances.
PIVOTS = 3
#: Distances to the centre, and to the first pivot, that share a cell.
_CELL = (2, 4)


def _xor_bits(c: str, other: str) -> Column:
    return F.bit_count(F.col(c).bitwiseXOR(F.col(other)))


def pivoted(large: DataFrame) -> DataFrame:
    """Staged ``(cluster_id, hash, d, least)``: distances ``d`` of each hash to pivots of its cluster, and a length that some pair has.

    The first pivot is the cluster's centre, each bit as most members have it; the second is the member farthest from it,
    and each other one the member farthest from all pivots so far. Distances to members are such lengths.
    """
    on = lambda k: 2 * F.sum(F.shiftrightunsigned("hash", k).bitwiseAND(F.lit(1))) > F.count(F.lit(1))
    centre = F.lit(0).cast("long")
    for k in range(64):
        centre = centre.bitwiseOR(F.when(on(k), F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    centre = large.groupBy("cluster_id").agg(centre.alias("pivot"))
    rows = large.select("cluster_id", "hash", F.array().cast("array<int>").alias("d"), F.lit(0).alias("least"))
    for k in range(PIVOTS + 1):
        # one row of a large cluster, which has BLOCK hashes at least: staged, so that AQE may split the cluster's side
        pivots = stage(centre if k == 0 else rows.groupBy("cluster_id").agg(F.max_by("hash", F.struct(F.array_min("d"), "hash")).alias("pivot")), "pivots")
        at = rows.join(pivots, "cluster_id").withColumn("x", _xor_bits("hash", "pivot").cast("int"))
        rows = at.select("cluster_id", "hash", F.concat("d", F.array("x")).alias("d"), F.greatest("least", F.when(F.lit(k > 0), F.col("x")).otherwise(0)).alias("least"))
        rows = stage(rows, "pivoted")
    return rows


def block_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks ``(cluster_id, hash, block)``, what is known of each, and ``(cluster_id, a, b, na, nb)``: the pairs of blocks
    of pivoted hashes that may hold a distance above what is known.

    A block is a cell of like distances to the first two pivots, cut by a hash into blocks of BLOCK on average. By the triangle
    inequality no pair of two blocks is farther apart than the least sum of their greatest distances to one pivot.
    """
    cells = [F.floor(F.get("d", F.lit(k)) / w).cast("long") for k, w in enumerate(_CELL)]
    cell = (cells[0] * 64 + cells[1]).alias("cell")
    keyed = rows.select("cluster_id", "hash", "d", "least", cell)
    size = keyed.groupBy("cluster_id", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("g"))
    blocks = stage(keyed.join(stage(size, "cells"), ["cluster_id", "cell"]).select("cluster_id", "hash", "d", "least", (F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("hash"), "g")).alias("block")), "blocks")
    top = [F.max(F.get("d", F.lit(k))).alias(f"d{k}") for k in range(PIVOTS + 1)]
    known = blocks.groupBy("cluster_id").agg(F.max("least").alias("known"))
    per = stage(blocks.groupBy("cluster_id", "block").agg(F.count(F.lit(1)).alias("n"), *top).join(known, "cluster_id"), "block-bounds")
    side = lambda x: per.select("cluster_id", "known", F.col("block").alias(x), F.col("n").alias(f"n{x}"), *[F.col(f"d{k}").alias(f"{x}{k}") for k in range(PIVOTS + 1)])
    both = side("a").join(side("b"), ["cluster_id", "known"]).where("a <= b")
    bound = F.least(*[F.col(f"a{k}") + F.col(f"b{k}") for k in range(PIVOTS + 1)])
    return blocks, per, both.where(bound > F.col("known")).select("cluster_id", "a", "b", "na", "nb")


def diameters(uniq: DataFrame) -> DataFrame:
    """``(cluster_id, max_distance)`` of the distinct hashes ``(cluster_id, hash)``, staged, of each cluster.

    A cluster of up to BLOCK hashes is one task's. A larger one is compared in pairs of blocks, of which those go that
    can't hold more than a distance that is known; only maxima leave a task.
    """

    def farthest(key: tuple, t: pa.Table) -> pa.Table:
        h, side = t["hash"].to_numpy(), t["side"].to_numpy()
        own, other = h[side == 0], h[side == 1]
        other = other if len(other) else own
        most = max(int(np.bitwise_count((x ^ other).view(np.uint64)).max()) for x in own)
        return pa.table({"cluster_id": [key[0].as_py()], "max_distance": pa.array([most], pa.int32())})

    sizes = stage(uniq.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")), "cluster-sizes")
    small = uniq.join(sizes.where(F.col("n") <= BLOCK).select("cluster_id"), "cluster_id")
    schema = "cluster_id long, max_distance int"
    far = small.withColumn("side", F.lit(0)).groupBy("cluster_id").applyInArrow(farthest, schema)
    large = sizes.where(F.col("n") > BLOCK).select("cluster_id")
    if large.isEmpty():
        return far
    blocks, per, pairs = block_pairs(pivoted(uniq.join(large, "cluster_id")))
    pairs = stage(pairs, "block-pairs")
    ends = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b").alias("block"), F.lit(1).alias("side"))))
    asked = pairs.select("cluster_id", "a", "b", F.explode(ends).alias("e")).select("cluster_id", "a", "b", "e.block", "e.side")
    dealt = blocks.select("cluster_id", "block", "hash").join(asked, ["cluster_id", "block"])
    compared = dealt.groupBy("cluster_id", "a", "b").applyInArrow(farthest, schema)
    known = per.groupBy("cluster_id").agg(F.max("known").cast("int").alias("max_distance"))
    return far.unionByName(compared).unionByName(known)


def cluster_stats(members: DataFrame, hashes: DataFrame) -> DataFrame:
    """Size, greatest distance over all pairs of members, and whether classes mix, of each cluster."""
    m = members.join(hashes, "id")
    sizes = m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("class_index").alias("classes"))
    uniq = stage(m.select("cluster_id", "hash").distinct(), "cluster-hashes")
    far = diameters(uniq).groupBy("cluster_id").agg(F.max("max_distance").alias("max_distance"))
    return sizes.join(far, "cluster_id").select("cluster_id", "members", "max_distance", (F.col("classes") > 1).alias("cross_class"))


def consistency(members: DataFrame) -> DataFrame:
    """Whether all members of a cluster (cluster_id, group_key, split) share group and split; an unknown one fails."""
    same = lambda c: (F.count_distinct(c) == 1) & (F.count(c) == F.count(F.lit(1)))
    return members.groupBy("cluster_id").agg(same("group_key").alias("same_group"), same("split").alias("same_split"))
