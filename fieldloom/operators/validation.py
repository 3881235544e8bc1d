"""Final validation of split manifests, derived anew from what they should have been built from.

The manifest is joined once with what is expected of each path and staged narrow: every row-level rule is a flag there,
all of them counted in one aggregate. What must not cross splits is counted from the same table in one pass, as sets of
splits in three bits for each value; the guards' splits and the allocation's are read off the group keys of that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import splits
from fieldloom.operators.checks import recorded
from fieldloom.staging import release, stage

#: Values that must not cross splits, by the manifest's column.
KINDS = {"path": "path", "sha256": "sha256", "group_key": "group_key", "similarity_guard_group": "similarity_guard_group"}
_COLUMNS = ["path", "class_name", "class_index", "group_key", "group_source", "similarity_guard_group", "sha256"]


def digests(manifest: DataFrame) -> DataFrame:
    """``(split, rows, digest)``: the number of a split's rows and the sum of the first 60 bits of their SHA-256, in any order."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _COLUMNS])
    bits = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return manifest.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum(bits).cast("string").alias("digest"))


def _bit(split: Column) -> Column:
    return reduce(lambda out, k: F.when(split == splits.SPLITS[k], 1 << k).otherwise(out), range(len(splits.SPLITS)), F.lit(0))


def _row(name: str, violations: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), F.coalesce(violations, F.lit(0)).cast("long").alias("violations"))


def _rows(one: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """A row for each check out of aggregates over ``one``."""
    return one.agg(F.array(*[_row(k, v) for k, v in checks.items()]).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def described(manifest: DataFrame, expected: DataFrame, quarantined: DataFrame, duplicates: DataFrame, guards: DataFrame, classes: DataFrame, active: DataFrame, excluded: DataFrame) -> DataFrame:
    """Staged rows of the manifest with a flag for each rule that one breaks; rules but the first are not asked of absent files."""
    of = expected.select("path", F.col("group_key").alias("e_key"), F.col("group_source").alias("e_source"), F.col("sha256").alias("e_sha"), F.lit(True).alias("there"), F.coalesce("resolved", F.lit(False)).alias("resolved"))
    mark = lambda df, name: df.select("path").distinct().withColumn(name, F.lit(True))
    rows = manifest.join(of, "path", "left").join(mark(quarantined, "quarantined"), "path", "left").join(mark(duplicates, "duplicate"), "path", "left")
    rows = rows.join(guards.groupBy("group_key").agg(F.min("guard_id").alias("e_guard")), "group_key", "left")
    small = lambda df, name, *cols: F.broadcast(df.select("class_name", *cols).distinct().withColumn(name, F.lit(True)))  # noqa: E731  classes of one model
    rows = rows.join(small(classes.withColumnRenamed("class_index", "e_index"), "known", "e_index"), "class_name", "left").join(small(active, "active"), "class_name", "left").join(small(excluded, "excluded"), "class_name", "left")
    there, resolved, guard = F.col("there").isNotNull(), F.coalesce("resolved", F.lit(False)), F.coalesce("similarity_guard_group", F.lit(""))
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    flags = {
        "missing_path": ~there,
        "sha256_mismatch": there & differs("sha256", "e_sha"),
        "class_index_mismatch": there & differs("class_index", "e_index"),
        "class_out_of_scope": there & F.col("active").isNull(),
        "excluded_class": there & F.col("excluded").isNotNull(),
        "quarantined_row": there & F.col("quarantined").isNotNull(),
        "duplicate_content": there & F.col("duplicate").isNotNull(),
        "unresolved_path": there & ~resolved,
        "group_key_mismatch": there & resolved & differs("group_key", "e_key"),
        "group_source_mismatch": there & resolved & differs("group_source", "e_source"),
        "guard_mismatch": there & resolved & (guard != F.coalesce("e_guard", F.lit(""))),
        "guard_overwrote_key": there & resolved & (guard != "") & (guard == F.col("group_key")),
    }
    kept = [*KINDS.values(), "class_name", "split"]
    source = F.when(resolved, F.col("e_source")).alias("e_source")
    return stage(rows.select(*kept, source, *[F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()]), "validated-rows")


FLAGS = ["missing_path", "sha256_mismatch", "class_index_mismatch", "class_out_of_scope", "excluded_class", "quarantined_row", "duplicate_content", "unresolved_path", "group_key_mismatch", "group_source_mismatch", "guard_mismatch", "guard_overwrote_key"]


def held_values(rows: DataFrame) -> DataFrame:
    """Staged ``(kind, value, held, rows, twice, e_source)``: the splits of each value as bits, and whether one split has it twice."""
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in KINDS.items()]))
    each = rows.select("split", "e_source", pair.alias("p")).select(_bit(F.col("split")).alias("bit"), "e_source", "p.kind", "p.value").where("value IS NOT NULL AND value <> ''")
    per = each.groupBy("kind", "value", "bit").agg(F.count(F.lit(1)).alias("n"), F.max("e_source").alias("e_source"))
    whole = per.groupBy("kind", "value").agg(F.bit_or("bit").alias("held"), F.sum(F.when(F.col("kind") == "path", F.col("n") - 1).otherwise(0)).alias("again"), F.max("e_source").alias("e_source"))
    return stage(whole, "held-values")


def _shared(held: Column) -> Column:
    """Pairs of splits that share a value."""
    n = F.bit_count(held)
    return n * (n - 1) / 2


def final_validation(manifest: DataFrame, expected: DataFrame, quarantined: DataFrame, duplicates: DataFrame, guards: DataFrame, classes: DataFrame, active: DataFrame, excluded: DataFrame, least: DataFrame, approved: DataFrame, advisory: tuple[str, ...] = ()) -> DataFrame:
    """``(check, violations, status, blocking, blocking_failed)`` of split manifests against an independent derivation.

    ``manifest``: path, class_name, class_index, group_key, group_source, similarity_guard_group, sha256, split.
    ``expected``: path, class_name, group_key, group_source, sha256 of every file that is there, and whether it is
    ``resolved``, that is in no quarantine, no duplicate, and of a known group. ``guards`` (guard_id, group_key), ``classes``
    (class_name, class_index), ``active`` and ``excluded`` class_name, ``least`` what ``checks.minimums`` gives, ``approved`` (split, rows, digest)
    the committed manifests. The allocation is made anew from the resolved files and guards and compared group by group.
    """
    rows = described(manifest, expected, quarantined, duplicates, guards, classes, active, excluded)
    held = held_values(rows)
    parts = [_rows(rows, {k: F.count_if(k) for k in FLAGS})]
    of = lambda k: F.col("kind") == k
    crossing = {f"{k}_overlap": F.sum(F.when(of(k), _shared(F.col("held")))) for k in KINDS}
    sources = {"leaf_id_group_crosses": "leaf_id", "tomato_filename_group_crosses": "tomato_filename_group"}
    crossing |= {k: F.sum(F.when(of("group_key") & (F.col("e_source") == s), _shared(F.col("held")))) for k, s in sources.items()}
    parts.append(_rows(held, {"duplicate_row": F.sum("again"), **crossing}))
    keys = held.where(of("group_key")).select(F.col("value").alias("group_key"), "held")
    seen = guards.select("guard_id", "group_key").distinct().join(keys, "group_key", "left").groupBy("guard_id").agg(F.bit_or(F.coalesce("held", F.lit(0))).alias("held"))
    parts.append(_rows(seen, {"guard_not_in_one_split": F.count_if(F.bit_count("held") != 1)}))
    counts = rows.groupBy("class_name", "split", "group_key").agg(F.count(F.lit(1)).alias("n")).groupBy("class_name", "split").agg(F.sum("n").alias("images"), F.count("group_key").alias("groups"))
    short = least.join(counts, ["class_name", "split"], "left").na.fill(0, ["images", "groups"])
    parts.append(_rows(short, {"too_few_images": F.count_if(F.col("images") < F.col("min_images")), "too_few_groups": F.count_if(F.col("groups") < F.col("min_groups"))}))
    now = digests(manifest).select("split", F.col("rows").alias("n"), F.col("digest").alias("d"))
    committed = approved.join(now, "split", "full_outer")
    parts.append(_rows(committed, {"manifest_rows": F.count_if(~F.col("rows").eqNullSafe(F.col("n"))), "manifest_digest": F.count_if(~F.col("digest").eqNullSafe(F.col("d")))}))
    groups = expected.where("resolved").groupBy("class_name", "group_key").agg(F.count(F.lit(1)).alias("images"))
    guarded = guards.groupBy("group_key").agg(F.min("guard_id").alias("guard_id"))
    dealt = splits.allocate(splits.components(groups, guarded)).select("class_name", "component_id", _bit(F.col("split")).alias("want"))
    placed = groups.join(guarded, "group_key", "left").select("class_name", "group_key", F.coalesce("guard_id", "group_key").alias("component_id")).join(dealt, ["class_name", "component_id"])
    moved = placed.join(keys, "group_key", "left")
    parts.append(_rows(moved, {"allocation_differs": F.count_if(~F.col("want").eqNullSafe(F.col("held")))}))
    found = stage(reduce(DataFrame.unionByName, parts), "final-validation")
    release(rows)
    release(held)
    status = F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status")
    return recorded(found.select("check", status, "violations"), list(advisory))
