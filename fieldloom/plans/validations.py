"""The final validation of split manifests that are built from the tables, with some rows spoilt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import checks, splits, validation
from fieldloom.plans.registry import query
from fieldloom.sources import bindings as b

_LANGS = ["de", "en", "es", "fr", "it"]
_INDEX = {c: k for k, c in enumerate(_LANGS)}


def _number() -> F.Column:
    return F.element_at(F.split("group_key", "src"), -1).cast("int")


def _source() -> F.Column:
    return F.when(_number() % 2 == 0, "leaf_id").otherwise("tomato_filename_group")


def _expected(spark, d) -> DataFrame:
    """Every image; those of labels' toxic documents are in quarantine, later copies of a content are duplicates."""
    images = b.images(spark, d)
    first = images.groupBy("sha256").agg(F.min("doc_id").alias("first"))
    bad = b.table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("bad", F.lit(True))
    rows = images.join(first, "sha256").join(bad, "doc_id", "left")
    dup, quarantined = F.col("doc_id") != F.col("first"), F.col("bad").isNotNull()
    return rows.select("path", "class_name", "group_key", _source().alias("group_source"), "sha256", "doc_id", dup.alias("duplicate"), quarantined.alias("quarantined"), (~dup & ~quarantined).alias("resolved"))


def _guards(expected: DataFrame) -> DataFrame:
    guarded = expected.select("class_name", "group_key").distinct().where(_number() % 5 == 0)
    return guarded.select(F.concat(F.lit("guard:"), "class_name", F.lit(":"), F.floor(_number() / 10).cast("string")).alias("guard_id"), "group_key")


def _manifest(expected: DataFrame, guards: DataFrame) -> DataFrame:
    """The resolved images in the splits of their components, some rows spoilt and some that shouldn't be there."""
    groups = expected.where("resolved").groupBy("class_name", "group_key").agg(F.count(F.lit(1)).alias("images"))
    comps = splits.allocate(splits.components(groups, guards)).select("class_name", "component_id", "split")
    placed = groups.join(guards, "group_key", "left").select("class_name", "group_key", F.coalesce("guard_id", F.lit("")).alias("guard"), F.coalesce("guard_id", "group_key").alias("component_id"))
    split_of = placed.join(comps, ["class_name", "component_id"]).select("class_name", "group_key", "guard", "split")
    i = F.col("doc_id")
    rows = expected.where(F.col("resolved") | (i % 53 == 2)).join(split_of, ["class_name", "group_key"], "left")
    index = F.element_at(F.create_map(*[F.lit(x) for kv in _INDEX.items() for x in kv]), F.col("class_name"))
    return rows.select(
        F.when(i % 97 == 4, F.concat("path", F.lit("-gone"))).otherwise(F.col("path")).alias("path"),
        "class_name",
        F.when(i % 61 == 3, index + 1).otherwise(index).cast("int").alias("class_index"),
        F.when(i % 71 == 5, "en:::src0").otherwise(F.col("group_key")).alias("group_key"),
        F.when(i % 59 == 6, "other").otherwise(F.col("group_source")).alias("group_source"),
        F.when(i % 67 == 7, F.col("group_key")).when(i % 73 == 8, "guard:x").otherwise(F.coalesce("guard", F.lit(""))).alias("similarity_guard_group"),
        F.when(i % 79 == 9, "0").otherwise(F.col("sha256")).alias("sha256"),
        F.when(i % 43 == 1, "test").otherwise(F.coalesce("split", F.lit("val"))).alias("split"),
    )


def register(allocated_sql: str, components_sql: str) -> None:
    """The query, whose SQL takes the recursive allocation from the catalogue, over the components given here."""
    case = " ".join(f"WHEN '{c}' THEN {k}" for c, k in _INDEX.items())
    expected = f"""(SELECT i.*, CASE WHEN k % 2 = 0 THEN 'leaf_id' ELSE 'tomato_filename_group' END AS group_source, i.doc_id <> first AS duplicate, bad IS NOT NULL AS quarantined, i.doc_id = first AND bad IS NULL AS resolved,
        CASE WHEN k % 5 = 0 THEN 'guard:' || class_name || ':' || (k // 10) END AS guard_id
        FROM (SELECT *, CAST(string_split(group_key, 'src')[-1] AS INTEGER) AS k FROM {b.IMAGES}) i JOIN (SELECT sha256, min(doc_id) AS first FROM {b.IMAGES} GROUP BY sha256) USING (sha256)
        LEFT JOIN (SELECT DISTINCT doc_id, true AS bad FROM labels WHERE toxic = 1) l ON l.doc_id = i.doc_id)"""
    comps = """(SELECT class_name, coalesce(guard_id, group_key) AS component_id, CAST(sum(n) AS BIGINT) AS size, count(*) AS group_count FROM (
        SELECT class_name, group_key, guard_id, count(*) AS n FROM x WHERE resolved GROUP BY ALL) GROUP BY ALL)"""
    allocated = allocated_sql.replace(components_sql, comps).removeprefix("RECURSIVE ")
    assert comps in allocated
    text = " || chr(31) || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in ("path", "class_name", "class_index", "group_key", "group_source", "similarity_guard_group", "sha256"))
    digest = f"(SELECT split, count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(sha256({text}), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM m GROUP BY split)"
    shared = lambda c: f"(SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(DISTINCT split) AS n FROM m WHERE {c} <> '' GROUP BY {c}))"
    crossing = lambda s: f"(SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(DISTINCT split) AS n, max(CASE WHEN e_resolved THEN e_source END) AS s FROM r WHERE group_key <> '' GROUP BY group_key) WHERE s = '{s}')"
    count = lambda c: f"(SELECT count(*) FROM r WHERE {c})"
    there = "e_key IS NOT NULL"
    violations = {
        "missing_path": count("e_key IS NULL"),
        "sha256_mismatch": count(f"{there} AND sha256 <> e_sha"),
        "class_index_mismatch": count(f"{there} AND class_index <> CASE class_name {case} END"),
        "class_out_of_scope": count(f"{there} AND class_name NOT IN ('de', 'en', 'fr')"),
        "excluded_class": count(f"{there} AND class_name = 'it'"),
        "quarantined_row": count("e_quarantined"),
        "duplicate_content": count("e_duplicate"),
        "unresolved_path": count(f"{there} AND NOT e_resolved"),
        "group_key_mismatch": count("e_resolved AND group_key <> e_key"),
        "group_source_mismatch": count("e_resolved AND group_source <> e_source"),
        "guard_mismatch": count("e_resolved AND similarity_guard_group <> coalesce((SELECT min(guard_id) FROM x WHERE x.group_key = r.group_key), '')"),
        "guard_overwrote_key": count("e_resolved AND similarity_guard_group <> '' AND similarity_guard_group = group_key"),
        "duplicate_row": "(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM m GROUP BY path, split))",
        **{f"{c}_overlap": shared(c) for c in ("path", "sha256", "group_key", "similarity_guard_group")},
        "leaf_id_group_crosses": crossing("leaf_id"),
        "tomato_filename_group_crosses": crossing("tomato_filename_group"),
        "guard_not_in_one_split": "(SELECT count(*) FROM (SELECT guard_id FROM (SELECT DISTINCT guard_id, group_key FROM x WHERE guard_id IS NOT NULL) LEFT JOIN m USING (group_key) GROUP BY guard_id HAVING count(DISTINCT split) <> 1))",
        "too_few_images": "(SELECT count(*) FROM short WHERE images < min_images)",
        "too_few_groups": "(SELECT count(*) FROM short WHERE groups < min_groups)",
        "manifest_rows": "(SELECT count(*) FROM approved p FULL JOIN now n USING (split) WHERE p.rows IS DISTINCT FROM n.rows)",
        "manifest_digest": "(SELECT count(*) FROM approved p FULL JOIN now n USING (split) WHERE p.digest IS DISTINCT FROM n.digest)",
        "allocation_differs": "(SELECT count(*) FROM (SELECT DISTINCT class_name, group_key, coalesce(guard_id, group_key) AS component_id FROM x WHERE resolved) JOIN a USING (class_name, component_id) LEFT JOIN (SELECT group_key, list_sort(list(DISTINCT split)) AS held FROM m GROUP BY group_key) h USING (group_key) WHERE held IS DISTINCT FROM [a.split])",
    }
    checked = " UNION ALL ".join(f"""SELECT '{k}' AS "check", CAST({v} AS BIGINT) AS violations""" for k, v in violations.items())
    sql = f"""WITH RECURSIVE x AS {expected}, {allocated},
    of AS (SELECT DISTINCT x.class_name, group_key, guard_id, split FROM x JOIN a ON a.class_name = x.class_name AND a.component_id = coalesce(guard_id, group_key) WHERE resolved),
    m AS (SELECT path || CASE WHEN doc_id % 97 = 4 THEN '-gone' ELSE '' END AS path, x.class_name, CASE x.class_name {case} END + CASE WHEN doc_id % 61 = 3 THEN 1 ELSE 0 END AS class_index, CASE WHEN doc_id % 71 = 5 THEN 'en:::src0' ELSE x.group_key END AS group_key,
        CASE WHEN doc_id % 59 = 6 THEN 'other' ELSE group_source END AS group_source, CASE WHEN doc_id % 67 = 7 THEN x.group_key WHEN doc_id % 73 = 8 THEN 'guard:x' ELSE coalesce(of.guard_id, '') END AS similarity_guard_group,
        CASE WHEN doc_id % 79 = 9 THEN '0' ELSE sha256 END AS sha256, CASE WHEN doc_id % 43 = 1 THEN 'test' ELSE coalesce(split, 'val') END AS split
        FROM x LEFT JOIN of ON of.class_name = x.class_name AND of.group_key = x.group_key WHERE resolved OR doc_id % 53 = 2),
    r AS (SELECT m.*, x.group_key AS e_key, x.group_source AS e_source, x.sha256 AS e_sha, x.quarantined AS e_quarantined, x.duplicate AS e_duplicate, x.resolved AS e_resolved FROM m LEFT JOIN x USING (path)),
    now AS {digest}, approved AS (SELECT split, rows, CASE WHEN split = 'val' THEN '0' ELSE digest END AS digest FROM now),
    least AS (SELECT c AS class_name, s AS split, CASE WHEN c = 'es' THEN CASE s WHEN 'train' THEN 100 ELSE 20 END ELSE 30 END AS min_images, CASE WHEN c = 'es' THEN CASE s WHEN 'train' THEN 15 ELSE 6 END ELSE 15 END AS min_groups
        FROM (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS c), (SELECT unnest(['train', 'val', 'test']) AS s) WHERE c = 'es' OR s <> 'train'),
    c AS (SELECT class_name, split, count(*) AS images, count(DISTINCT group_key) AS groups FROM m GROUP BY ALL),
    short AS (SELECT min_images, min_groups, coalesce(images, 0) AS images, coalesce(groups, 0) AS groups FROM least LEFT JOIN c USING (class_name, split)),
    v AS (SELECT *, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status, "check" NOT IN ('too_few_images', 'too_few_groups') AS blocking FROM ({checked}))
    SELECT *, (SELECT count(*) > 0 FROM v WHERE blocking AND status = 'FAIL') AS blocking_failed FROM v"""

    @query(sql)
    def final_split_validation(spark, d):
        """Manifests with spoilt rows against the derivation from the tables; the committed digest of ``val`` is another one."""
        expected = _expected(spark, d)
        guards = _guards(expected)
        manifest = _manifest(expected, guards)
        names = lambda *c: spark.createDataFrame([(x,) for x in c], "class_name string")
        approved = validation.digests(manifest).withColumn("digest", F.when(F.col("split") == "val", "0").otherwise(F.col("digest")))
        return validation.final_validation(
            manifest, expected.drop("doc_id"), expected.where("quarantined").select("path"), expected.where("duplicate").select("path"), guards,
            spark.createDataFrame(list(_INDEX.items()), "class_name string, class_index int"), names("de", "en", "fr"), names("it"), checks.minimums(names(*_LANGS), "es"), approved, ("too_few_images", "too_few_groups"),
        )
