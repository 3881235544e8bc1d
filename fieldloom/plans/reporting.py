"""The report sets of a run, built from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import checks, dedup, lineage, splits
from fieldloom.sources import reports
from fieldloom.staging import stage


def split_build(groups: DataFrame, guards: DataFrame, images: DataFrame) -> dict[str, DataFrame]:
    """The reports of a split build: of ``groups(class_name, group_key, images)``, ``guards`` and their ``images(path, class_name, group_key, sha256)``."""
    comps = stage(splits.components(groups, guards), "components")
    allocated = stage(splits.allocate(comps), "allocated")
    members = stage(splits.component_members(allocated, groups, guards, images).join(images.select("path", "class_name", "group_key", "sha256"), "path"), "members")
    return {
        "integrity": checks.leakage(members, ["sha256", "group_key"]),
        "components": comps,
        "allocation": allocated,
        "summary": splits.summary(allocated),
        "deviation": splits.deviation(allocated),
        **{s: members.where(F.col("split") == s).drop("split") for s in splits.SPLITS},
    }


def preparation(images: DataFrame, hashes: DataFrame, approved: DataFrame, radius: int) -> dict[str, DataFrame]:
    """The reports of a preparation run: of ``images(path, class_name, sha256, doc_id, group_key)``, perceptual ``hashes(id, class_index, hash)``, and the ``approved`` ids (doc_id)."""
    groups = stage(dedup.exact_groups(images), "exact-groups")
    clusters = stage(dedup.clusters(hashes, radius), "clusters")
    quarantined = stage(lineage.quarantine(images, approved, groups.where("cross_class")), "quarantined")
    joined = images.join(approved.select("doc_id").distinct().withColumn("matched", F.lit(True)), "doc_id", "left").select("path", "class_name", F.coalesce("matched", F.lit(False)).alias("matched"))
    by = joined.groupBy("class_name").agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"))
    return {
        "class_counts": images.groupBy("class_name").agg(F.count(F.lit(1)).alias("n")),
        "file_inventory": images.select("path", "class_name", "sha256"),
        "id_join": joined,
        "id_join_summary": by,
        "exact_duplicates": dedup.exact_duplicates(images),
        "duplicate_summary": dedup.duplicate_summary(images),
        "cross_class_conflicts": groups.where("cross_class"),
        "near_pairs": dedup.near_hashes(hashes, radius),
        "clusters": clusters,
        "quarantine": quarantined,
        "quarantine_by_class": lineage.quarantine_counts(quarantined),
    }


def recovery_run(images: DataFrame, candidates: DataFrame) -> dict[str, DataFrame]:
    """The reports of a recovery of leaf ids: of ``images(id, class_name, key)`` by ``candidates(key, leaf_id)``."""
    statuses = stage(lineage.recovery(images, candidates), "statuses")
    inventory = candidates.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("leaf_id").alias("leaf_ids"))
    return {
        "metadata_inventory": inventory,
        **{s: statuses.where(F.col("status") == s).drop("status") for s in ("matched", "ambiguous", "unresolved")},
        "recovery_status": lineage.recovery_counts(statuses),
        "shared_keys": inventory.where("leaf_ids > 1"),
        "examples": lineage.examples(statuses.where("status = 'ambiguous'"), "class_name", ["id"], 10),
    }


def review_run(named: DataFrame, judged: list[DataFrame], large: int, sample: int) -> dict[str, DataFrame]:
    """The reports of a review of file-name groups: of ``named(id, group_key, session_prefix, leaf_number)`` and the
    judgments (group_key, judgment) of one review after another; a group of ``large`` images is a large chain."""
    groups = stage(named.where("group_key IS NOT NULL").groupBy("group_key").agg(F.count(F.lit(1)).alias("size"), F.min("session_prefix").alias("session_prefix")), "groups")
    return {
        "groups": groups,
        "group_sizes": groups.groupBy("size").agg(F.count(F.lit(1)).alias("groups")),
        "sample": lineage.quota_sample(groups, sample),
        "shared_prefixes": lineage.shared_numbers(named.where("leaf_number IS NOT NULL AND session_prefix IS NOT NULL")),
        "judgments": lineage.judgments(*judged),
        "large_chains": groups.where(F.col("size") >= large),
    }


def validation_run(found: DataFrame, rows: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """The reports of a validation: the checks ``found``, overlaps of ``rows(path, sha256, group_key, split)``, and the
    clusters' ``members(cluster_id, group_key, split)``."""
    return {"checks": found, "overlaps": splits.overlaps(rows, ["path", "sha256", "group_key"]), "cluster_consistency": dedup.consistency(members)}


def committed_counts(spark, kind: str, built: dict[str, DataFrame], folder: str) -> DataFrame:
    """``(report, rows, read)``: commits the set and reads every report of it back."""
    rows = reports.commit(kind, built, folder)
    table = spark.createDataFrame(sorted(rows.items()), "report string, rows long")
    read = [reports.open_report(spark, folder, name).agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("read")) for name in rows]
    out = read[0]
    for more in read[1:]:
        out = out.unionByName(more)
    return table.join(F.broadcast(stage(out, "read-back")), "report")  # a row for each report


