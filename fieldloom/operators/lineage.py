"""Joins that give images their leaf ids, groups and quarantine reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions import scalars


def leaf_join(images: DataFrame, leaf_map: DataFrame) -> DataFrame:
    """Images (path, class_name, key) with the first leaf id of their key that belongs to their class.

    ``leaf_map``: (key, leaf_id), ids of the form ``class:::n``. The least id of a key and class is found before the
    join, so no key's ids are gathered.
    """
    own = leaf_map.groupBy("key", F.substring_index("leaf_id", ":::", 1).alias("class_name")).agg(F.min("leaf_id").alias("leaf_id"))
    return images.join(own, ["key", "class_name"], "left").select("path", "class_name", "leaf_id")


def match_summary(joined: DataFrame) -> DataFrame:
    """Matched and unmatched images of each class."""
    g = joined.groupBy("class_name").agg(F.count(F.lit(1)).alias("images"), F.count("leaf_id").alias("matched"))
    return g.select("class_name", "images", "matched", (F.col("images") - F.col("matched")).alias("unmatched"), scalars.ratio0(F.col("matched") * 100, F.col("images")).alias("matched_pct"))


def recovery(images: DataFrame, candidates: DataFrame) -> DataFrame:
    """Status of each image (id, class_name, key) by how many distinct leaf ids its key has: none, one or several."""
    n = candidates.groupBy("key").agg(F.count_distinct("leaf_id").alias("n"), F.min("leaf_id").alias("leaf_id"))
    status = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "matched").otherwise("ambiguous")
    return images.join(n, "key", "left").select("id", "class_name", status.alias("status"), F.when(F.col("n") == 1, F.col("leaf_id")).alias("leaf_id"))


def recovery_counts(statuses: DataFrame) -> DataFrame:
    """Images of each class by status, one column each."""
    return statuses.groupBy("class_name").pivot("status", ["matched", "ambiguous", "unresolved"]).count().na.fill(0)


def quarantine(images: DataFrame, matched: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Reasons that keep an image (doc_id, path, class_name, sha256) out: no matched id, or a content hash in conflict."""
    m = matched.select("doc_id", F.lit(True).alias("has_id")).distinct()
    c = conflicts.select("sha256", F.lit(True).alias("conflict")).distinct()
    flags = images.join(m, "doc_id", "left").join(c, "sha256", "left")
    reasons = F.array_compact(F.array(F.when(F.col("has_id").isNull(), "unmatched"), F.when(F.col("conflict"), "cross_class_conflict")))
    return flags.select("path", "class_name", reasons.alias("reasons")).where(F.size("reasons") > 0)


def quarantine_counts(quarantined: DataFrame) -> DataFrame:
    """Quarantined images of each class."""
    return quarantined.groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))


def source_breakdown(groups: DataFrame, sources: list[str]) -> DataFrame:
    """Groups of each class by where their key comes from, one column each."""
    return groups.groupBy("class_name").pivot("group_source", sources).count().na.fill(0)


def judgments(*reviews: DataFrame) -> DataFrame:
    """Histogram of the judgments (group_key, judgment) of several reviews; a later review of a key replaces an earlier one."""
    tagged = reduce(DataFrame.unionByName, [r.select("group_key", "judgment", F.lit(k).alias("order")) for k, r in enumerate(reviews)])
    last = tagged.groupBy("group_key").agg(F.max(F.struct("order", "judgment"))["judgment"].alias("judgment"))
    return last.groupBy("judgment").agg(F.count(F.lit(1)).alias("n"))


def recovery_list(statuses: DataFrame) -> DataFrame:
    """Matched, ambiguous and unresolved images as one list with its place in the order of status and id."""
    parts = [statuses.where(F.col("status") == s).withColumn("part", F.lit(k)) for k, s in enumerate(("matched", "ambiguous", "unresolved"))]
    return reduce(DataFrame.unionByName, parts)


def examples(rows: DataFrame, key: str, order: list[str], n: int = 10) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def group_sizes(groups: DataFrame) -> DataFrame:
    """How many groups have each size, from rows with a group key."""
    return groups.groupBy("group_key").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def size_buckets(groups: DataFrame) -> DataFrame:
    """Groups of one, two, three, and four or more images, and the largest."""
    g = groups.groupBy("group_key").agg(F.count(F.lit(1)).alias("size"))
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    s = F.col("size")
    return g.agg(n(s == 1).alias("singletons"), n(s == 2).alias("pairs"), n(s == 3).alias("triples"), n(s >= 4).alias("larger"), F.max(s).alias("largest"))


def shared_numbers(parsed: DataFrame) -> DataFrame:
    """Leaf numbers that occur under more than one session prefix."""
    g = parsed.groupBy("leaf_number").agg(F.sort_array(F.collect_set("session_prefix")).alias("prefixes"))
    return g.where(F.size("prefixes") > 1).select("leaf_number", F.array_join("prefixes", ",").alias("prefixes"))


def stratified_sample(groups: DataFrame, n: int) -> DataFrame:
    """n groups (group_key, size) in rounds over the sizes: the first of each size by key, then the second, ..."""
    ranked = groups.withColumn("round", F.row_number().over(W.partitionBy("size").orderBy("group_key"))).where(F.col("round") <= n)  # n rows of a size leave a task
    return ranked.orderBy("round", "size").limit(n)


def quota_sample(groups: DataFrame, n: int, quota: int = 2) -> DataFrame:
    """As above, but first ``quota`` groups of each session prefix (group_key, size, session_prefix) are taken."""
    first = groups.withColumn("r", F.row_number().over(W.partitionBy("session_prefix").orderBy("size", "group_key"))).where(F.col("r") <= quota).drop("r")
    rest = stratified_sample(groups.join(first, "group_key", "left_anti"), n).select(*groups.columns)
    left = first.withColumn("pass", F.lit(1)).unionByName(rest.withColumn("pass", F.lit(2)))
    return left.orderBy("pass", "size", "group_key").limit(n)


def group_lineage(images: DataFrame, leaf_ids: DataFrame, filename_groups: DataFrame, duplicates: DataFrame) -> DataFrame:
    """``(path, class_name, group_key, group_source, fate)`` of images: the leaf id of a path goes before its file-name group.

    ``leaf_ids`` (path, leaf_id) and ``filename_groups`` (path, filename_group) have a row for a path at most; empty ids are
    none. ``fate`` is ``duplicate`` for the ``duplicates`` (path), ``eligible`` with a group, else ``quarantined``.
    """
    d = duplicates.select("path").distinct().withColumn("duplicate", F.lit(True))
    rows = images.select("path", "class_name").join(d, "path", "left").join(leaf_ids.select("path", "leaf_id"), "path", "left").join(filename_groups.select("path", "filename_group"), "path", "left")
    leaf, name = F.nullif("leaf_id", F.lit("")), F.nullif("filename_group", F.lit(""))
    own = F.col("duplicate").isNull()
    source = F.when(leaf.isNotNull(), "leaf_id").when(name.isNotNull(), "tomato_filename_group")
    fate = F.when(~own, "duplicate").when(source.isNotNull(), "eligible").otherwise("quarantined")
    return rows.select("path", "class_name", F.when(own, F.coalesce(leaf, name)).alias("group_key"), F.when(own, source).alias("group_source"), fate.alias("fate"))


def cluster_quarantine(images: DataFrame, leaf_ids: DataFrame, members: DataFrame, approved: DataFrame, exact_conflicts: DataFrame, cluster_conflicts: DataFrame) -> DataFrame:
    """``(path, class_name, group_source, reasons)``: an image without a leaf id needs a reviewed cluster.

    ``members`` (path, cluster_id) are those of clusters within a class, ``approved`` the reviewed cluster_ids. Images of a
    conflict between classes (path), by content or by cluster, are kept out whatever their group.
    """
    mark = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    reviewed = members.join(approved.select("cluster_id").distinct(), "cluster_id", "left_semi")
    rows = images.select("path", "class_name").join(mark(leaf_ids.where("leaf_id <> ''"), "path", "leaf"), "path", "left").join(mark(reviewed, "path", "reviewed"), "path", "left")
    rows = rows.join(mark(exact_conflicts, "path", "exact"), "path", "left").join(mark(cluster_conflicts, "path", "cluster"), "path", "left")
    source = F.when(F.col("leaf"), "leaf_id").when(F.col("reviewed"), "reviewed_phash_cluster")
    reasons = F.array_compact(F.array(F.when(F.col("exact"), "cross_class_exact_hash_conflict"), F.when(F.col("cluster"), "cross_class_phash_conflict"), F.when(source.isNull(), "no_leaf_id_match_and_no_approved_cluster")))
    return rows.select("path", "class_name", source.alias("group_source"), reasons.alias("reasons"))


def class_collisions(values: DataFrame, column: str) -> DataFrame:
    """``(value, classes)``: values of a column that occur in several classes (class_name), with these."""
    held = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.sort_array(F.collect_set("class_name")).alias("classes"))  # a model's classes at most
    return held.where(F.size("classes") > 1)
