"""Integrity checks as rows: check, status, detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import provenance, splits
from fieldloom.staging import stage


def check(name: str, violations: DataFrame) -> DataFrame:
    """One row: PASS if there are no violations, else FAIL, with their number."""
    n = violations.agg(F.count(F.lit(1)).alias("violations"))
    return n.select(F.lit(name).alias("check"), F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status"), "violations")


def report(checks: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [check(k, v) for k, v in checks.items()])


def leakage(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """A check for each kind of value that must not cross splits."""
    found = splits.overlaps(rows, kinds)
    return report({f"no_shared_{k}": found.where(F.col("kind") == k) for k in kinds})


def guard_checks(groups: DataFrame, guards: DataFrame) -> DataFrame:
    """Guards (guard_id, group_key) over groups (class_name, group_key): keys exist, one class each, no key in two."""
    joined = guards.join(groups.select("group_key", "class_name").distinct(), "group_key")
    return report(
        {
            "guard_keys_exist": guards.join(groups, "group_key", "left_anti"),
            "guard_in_one_class": joined.groupBy("guard_id").agg(F.count_distinct("class_name").alias("n")).where("n > 1"),
            "key_in_one_guard": guards.groupBy("group_key").agg(F.count_distinct("guard_id").alias("n")).where("n > 1"),
        }
    )


def manifest_checks(manifest: DataFrame, classes: DataFrame) -> DataFrame:
    """Duplicate paths, unknown classes and wrong indexes of a manifest."""
    known = manifest.join(F.broadcast(classes.select("class_name", F.col("class_index").alias("want"))), "class_name", "left")
    return report(
        {
            "unique_path": manifest.groupBy("path").count().where("count > 1"),
            "class_in_scope": known.where("want is null"),
            "class_index": known.where("want <> class_index"),
            "sha256_present": manifest.where("sha256 is null or sha256 = ''"),
        }
    )


def reconciled(predictions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Whether predictions and manifest match one to one on path."""
    p, m = predictions.select("path"), manifest.select("path")
    return report(
        {
            "unique_prediction": p.groupBy("path").count().where("count > 1"),
            "prediction_in_manifest": p.join(m, "path", "left_anti"),
            "manifest_has_prediction": m.join(p, "path", "left_anti"),
        }
    )


def accepted_column(predictions: DataFrame, threshold: float) -> DataFrame:
    """Rows whose recorded acceptance isn't that of the threshold."""
    return predictions.where((F.col("maximum_probability") >= threshold) != F.col("accepted"))


# Minimum images and groups of a class in each split, and the exception.
GENERAL_MINIMUMS = {"val": (30, 15), "test": (30, 15)}
EXCEPTION_CLASS, EXCEPTION_MINIMUMS = "Potato Healthy", {"train": (100, 15), "val": (20, 6), "test": (20, 6)}


def minimums(classes: DataFrame, exception: str = EXCEPTION_CLASS) -> DataFrame:
    """``(class_name, split, min_images, min_groups)`` of every class; one class has an exception."""
    row = lambda m: F.array(*[F.struct(F.lit(s).alias("split"), F.lit(i).alias("min_images"), F.lit(g).alias("min_groups")) for s, (i, g) in m.items()])
    each = F.explode(F.when(F.col("class_name") == exception, row(EXCEPTION_MINIMUMS)).otherwise(row(GENERAL_MINIMUMS)))
    return classes.select("class_name", each.alias("m")).select("class_name", "m.*")


def preview_leakage(manifest: DataFrame, files: DataFrame, quarantined: DataFrame, guards: DataFrame, classes: DataFrame, least: DataFrame) -> DataFrame:
    """All checks of split manifests before sign-off, as ``(check, status, violations)``.

    ``manifest`` has path, class_name, group_key, similarity_guard_group, sha256 and split; rows without a hash are
    left out. ``files`` and ``quarantined`` have paths, ``guards`` (guard_id, group_key), ``classes`` class_name, and
    ``least`` what ``minimums`` gives. The manifest is read once and staged narrow, as are its overlaps; every side is
    grouped before it is joined.
    """
    m = stage(manifest.where("sha256 is not null and sha256 <> ''").select("path", "class_name", "group_key", "similarity_guard_group", "sha256", "split"), "checked-rows")
    over = stage(splits.overlaps(m, ["sha256", "group_key", "similarity_guard_group"]), "overlaps")
    tagged = m.where("similarity_guard_group <> ''")
    keys = m.groupBy("group_key").agg(F.collect_set("split").alias("held"), F.max("similarity_guard_group").alias("tag"))  # three splits at most
    absent = guards.join(keys, "group_key", "left_anti")
    whole = guards.join(absent.select("guard_id").distinct(), "guard_id", "left_anti").join(keys, "group_key")
    touched = whole.select("guard_id", F.explode("held").alias("split")).groupBy("guard_id").agg(F.count_distinct("split").alias("n"))
    seen = m.select("class_name", "split").distinct()
    wanted = classes.select("class_name", F.explode(F.array(*map(F.lit, splits.SPLITS))).alias("split"))
    counts = m.groupBy("class_name", "split").agg(F.count(F.lit(1)).alias("images"), F.count_distinct("group_key").alias("groups"))
    short = least.join(counts, ["class_name", "split"], "left").na.fill(0, ["images", "groups"])
    return report(
        {
            "sha256_overlap": over.where("kind = 'sha256'"),
            "group_key_overlap": over.where("kind = 'group_key'"),
            "guard_overlap": over.where("kind = 'similarity_guard_group'"),
            "group_key_overwritten": tagged.where("similarity_guard_group = group_key"),
            "inconsistent_guard_tags": tagged.groupBy("group_key").agg(F.count_distinct("similarity_guard_group").alias("n")).where("n > 1"),
            "class_out_of_scope": m.join(classes, "class_name", "left_anti"),
            "quarantined_present": m.join(quarantined, "path", "left_semi"),
            "path_missing": m.join(files, "path", "left_anti"),
            "guard_keys_missing": absent,
            "guard_key_untagged": whole.where("not tag <=> guard_id"),
            "guard_not_in_one_split": touched.where("n <> 1"),
            "active_class_missing": wanted.join(seen, ["class_name", "split"], "left_anti"),
            "too_few_images": short.where("images < min_images"),
            "too_few_groups": short.where("groups < min_groups"),
        }
    )


def recorded(checks: DataFrame, advisory: list[str]) -> DataFrame:
    """Checks with whether they block, and whether any blocking one failed: one window over the few rows of a report."""
    out = checks.withColumn("blocking", ~F.col("check").isin(*advisory))
    failed = out.where("blocking and status = 'FAIL'").agg((F.count(F.lit(1)) > 0).alias("blocking_failed"))
    return out.crossJoin(F.broadcast(failed))  # one row


def overlap_sources(rows: DataFrame) -> DataFrame:
    """Group keys in several splits by where the key comes from (group_key, group_source, split)."""
    g = rows.groupBy("group_key").agg(F.count_distinct("split").alias("n"), F.min("group_source").alias("group_source")).where("n > 1")
    return g.groupBy("group_source").agg(F.count(F.lit(1)).alias("overlaps"))


def frozen_policy_violations(policies: DataFrame, manifest_sha256: str, architecture: str, methods: list[str]) -> DataFrame:
    """``(id, rule)`` for each condition that a recorded policy must meet before it is applied to the test split.

    Columns: id, status, selection_dataset, model_architecture, confidence_method, selected_threshold,
    test_labels_used, validation_manifest_sha256. A null meets no condition.
    """
    unless = lambda c: ~F.coalesce(c, F.lit(False))
    rules = {
        "status": unless(F.col("status") == "approved_for_test_application"),
        "selection_dataset": unless(F.col("selection_dataset") == "validation"),
        "model_architecture": unless(F.col("model_architecture") == architecture),
        "confidence_method": unless(F.col("confidence_method").isin(*methods)),
        "selected_threshold": F.col("selected_threshold").isNull(),
        "test_labels_used": unless(~F.col("test_labels_used")),
        "validation_manifest_sha256": unless(F.col("validation_manifest_sha256") == manifest_sha256),
    }
    return provenance.broken(policies, rules)


def prediction_provenance_violations(records: DataFrame, actual: DataFrame, checkpoint_sha256: str, manifest_sha256: str) -> DataFrame:
    """``(id, rule)`` for each claim of a predictions record that doesn't hold.

    ``records``: id, evaluation_mode, test_output, checkpoint_sha256, manifest_sha256, predictions_sha256, row_count,
    class_names (in index order). ``actual``: the same id with predictions_sha256, row_count and class_names as found.
    """
    found = actual.select("id", *[F.col(c).alias(f"found_{c}") for c in ("predictions_sha256", "row_count", "class_names")])
    unless = lambda c: ~F.coalesce(c, F.lit(False))
    rules = {
        "evaluation_mode": unless(F.col("evaluation_mode") == "validation"),
        "test_output": unless(~F.col("test_output")),
        "checkpoint_sha256": unless(F.col("checkpoint_sha256") == checkpoint_sha256),
        "manifest_sha256": unless(F.col("manifest_sha256") == manifest_sha256),
        "predictions_sha256": unless(F.col("predictions_sha256") == F.col("found_predictions_sha256")),
        "row_count": unless(F.col("row_count") == F.col("found_row_count")),
        "class_names": unless(F.col("class_names") == F.col("found_class_names")),
    }
    return provenance.broken(records.join(found, "id", "left"), rules)


def summary_agreement(recorded_rows: DataFrame, recomputed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Recorded against recomputed figures of each key, PASS where all agree; a missing side fails."""
    r = recorded_rows.select(key, *[F.col(c).alias(f"recorded_{c}") for c in columns])
    n = recomputed.select(key, *[F.col(c).alias(f"recomputed_{c}") for c in columns])
    same = reduce(lambda a, c: a & F.coalesce(F.col(f"recorded_{c}") == F.col(f"recomputed_{c}"), F.lit(False)), columns, F.lit(True))
    return r.join(n, key, "full_outer").withColumn("status", F.when(same, "PASS").otherwise("FAIL"))


def input_gates(documents: DataFrame, classes: DataFrame, active: DataFrame, excluded: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Gates before splits are built: policies (name, status) approved, classes in order, scope apart from what is excluded, no conflict."""
    return report(
        {
            "policies_approved": documents.where("not status <=> 'approved'"),
            "classes_in_order": classes.where("class_index <> expected_index or expected_index is null"),
            "active_known": active.join(classes, "class_name", "left_anti"),
            "active_apart_from_excluded": active.join(excluded, "class_name", "left_semi"),
            "no_cross_class_conflict": conflicts,
        }
    )


def approved_counts(groups: DataFrame, approved: DataFrame) -> DataFrame:
    """Groups and images of each class (class_name, group_key, images) against the approved numbers."""
    found = groups.groupBy("class_name").agg(F.count(F.lit(1)).alias("groups"), F.sum("images").alias("images"))
    return summary_agreement(approved, found, "class_name", ["groups", "images"])


def large_groups(groups: DataFrame, approved: DataFrame, least: int) -> DataFrame:
    """``(group_key, images, finding)`` where large groups (group_key, images) and the approved ones (group_key) differ.

    A group of ``least`` images or more must be approved, and an approved one must be among the groups.
    """
    a = approved.select("group_key").distinct().withColumn("approved", F.lit(True))
    both = groups.select("group_key", "images").join(a, "group_key", "full_outer")
    finding = F.when(F.col("images").isNull(), "approved_but_absent").when((F.col("images") >= least) & F.col("approved").isNull(), "large_but_not_approved")
    return both.select("group_key", F.coalesce("images", F.lit(0)).alias("images"), finding.alias("finding")).where("finding IS NOT NULL")


def set_difference(expected: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """What one set has and the other lacks: ``(value, side)``; no rows if they are equal."""
    e, f = expected.select(F.col(column).alias("value")).distinct(), found.select(F.col(column).alias("value")).distinct()
    return e.join(f, "value", "left_anti").withColumn("side", F.lit("missing")).unionByName(f.join(e, "value", "left_anti").withColumn("side", F.lit("unexpected")))


def inventory(texts: DataFrame) -> DataFrame:
    """What a folder of text files holds (path, content): bytes, hash, byte order mark, encoding and lines of each."""
    c = F.col("content")
    bom = F.hex(F.substring("content", 1, 3)) == "EFBBBF"
    plain = F.is_valid_utf8(c.cast("string"))
    return texts.select("path", F.octet_length("content").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), bom.alias("utf8_bom_present"), F.when(plain, F.when(bom, "utf-8-sig").otherwise("utf-8")).otherwise("latin-1").alias("encoding"))


def blank_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows have each column blank, and any of them."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return rows.agg(*[n(blank(c)).alias(f"blank_{c}") for c in columns], n(reduce(lambda a, c: a | blank(c), columns, F.lit(False))).alias("malformed"))
