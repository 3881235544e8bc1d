"""Queries for single rules of lineage, naming and projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.operators import checks, dedup, lineage, provenance
from fieldloom.plans.registry import query as _query
from fieldloom.sources import bindings as b

_LEAF = "CASE WHEN toxic = 0 THEN 'leaf-' || (doc_id % 7) WHEN toxic = 1 THEN '' END"


def _leaf_ids(spark, d):
    """A leaf id for documents of good labels, an empty one for toxic ones."""
    leaf = F.when(F.col("toxic") == 0, F.concat(F.lit("leaf-"), (F.col("doc_id") % 7).cast("string"))).when(F.col("toxic") == 1, "")
    return b.table(spark, d, "labels").groupBy("doc_id").agg(F.min("toxic").alias("toxic")).select(F.concat(F.lit("doc/"), "doc_id").alias("path"), leaf.alias("leaf_id"))


def _named(spark, d):
    """File-name groups of documents with an even source."""
    k = F.element_at(F.split("group_key", "src"), -1).cast("int")
    return b.images(spark, d).where(k % 2 == 0).select("path", F.concat(F.lit("name-"), k.cast("string")).alias("filename_group"))


_LEAVES = f"(SELECT 'doc/' || doc_id AS path, {_LEAF} AS leaf_id FROM (SELECT doc_id, min(toxic) AS toxic FROM labels GROUP BY doc_id))"


@_query(
    f"""WITH i AS (SELECT *, CAST(string_split(group_key, 'src')[-1] AS INTEGER) AS k, path <> min(path) OVER (PARTITION BY sha256) AS duplicate FROM {b.IMAGES}), l AS {_LEAVES},
    j AS (SELECT i.path, class_name, duplicate, nullif(leaf_id, '') AS leaf, CASE WHEN k % 2 = 0 THEN 'name-' || k END AS name FROM i LEFT JOIN l USING (path))
    SELECT path, class_name, CASE WHEN NOT duplicate THEN coalesce(leaf, name) END AS group_key, CASE WHEN duplicate THEN NULL WHEN leaf IS NOT NULL THEN 'leaf_id' WHEN name IS NOT NULL THEN 'tomato_filename_group' END AS group_source,
        CASE WHEN duplicate THEN 'duplicate' WHEN leaf IS NOT NULL OR name IS NOT NULL THEN 'eligible' ELSE 'quarantined' END AS fate FROM j"""
)
def group_lineage(spark, d):
    images = b.images(spark, d)
    return lineage.group_lineage(images, _leaf_ids(spark, d), _named(spark, d), dedup.exact_duplicates(images))


_CONTENT = f"(SELECT path, class_name, min(doc_id) OVER (PARTITION BY sha256) AS cluster_id, count(*) OVER (PARTITION BY sha256) AS n, min(class_name) OVER (PARTITION BY sha256) <> max(class_name) OVER (PARTITION BY sha256) AS mixed FROM {b.IMAGES})"


@_query(
    f"""WITH c AS {_CONTENT}, l AS {_LEAVES}, s AS (SELECT c.*, CASE WHEN leaf_id <> '' THEN 'leaf_id' WHEN n > 1 AND NOT mixed AND cluster_id % 2 = 0 THEN 'reviewed_phash_cluster' END AS group_source FROM c LEFT JOIN l USING (path))
    SELECT path, class_name, group_source, array_to_string(list_filter([CASE WHEN mixed THEN 'cross_class_exact_hash_conflict' END, CASE WHEN n > 1 AND mixed THEN 'cross_class_phash_conflict' END,
        CASE WHEN group_source IS NULL THEN 'no_leaf_id_match_and_no_approved_cluster' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s"""
)
def cluster_quarantine(spark, d):
    """Clusters are groups of equal content; those whose first document has an even id are reviewed."""
    images = b.images(spark, d)
    per = images.groupBy("sha256").agg(F.min("doc_id").alias("cluster_id"), F.count(F.lit(1)).alias("n"), F.count_distinct("class_name").alias("classes")).where("n > 1")
    members = images.join(per, "sha256").select("path", "cluster_id", "classes")
    mixed = members.where("classes > 1")
    out = lineage.cluster_quarantine(images, _leaf_ids(spark, d), members.where("classes = 1"), per.where("cluster_id % 2 = 0"), mixed, mixed)
    return out.withColumn("reasons", F.array_join("reasons", ","))


@_query(
    f"""SELECT value, array_to_string(list_sort(list(DISTINCT class_name)), ',') AS classes FROM (SELECT class_name, substr(sha256, 1, 2) AS value FROM {b.IMAGES}) GROUP BY value HAVING count(DISTINCT class_name) > 1"""
)
def class_collisions(spark, d):
    """Stems, here the first two digits of the content's hash, that several classes share."""
    stems = b.images(spark, d).select("class_name", F.substring("sha256", 1, 2).alias("stem"))
    return lineage.class_collisions(stems, "stem").withColumn("classes", F.array_join("classes", ","))


@_query(
    f"""WITH g AS (SELECT class_name || ':' || group_key AS group_key, count(*) AS images FROM {b.IMAGES} GROUP BY ALL), a AS (SELECT DISTINCT lang || ':' || lang || ':::src1' AS group_key FROM documents UNION SELECT 'none:none:::src0')
    SELECT group_key, coalesce(images, 0) AS images, CASE WHEN images IS NULL THEN 'approved_but_absent' ELSE 'large_but_not_approved' END AS finding FROM g FULL JOIN a USING (group_key)
    WHERE images IS NULL OR (images >= 12 AND group_key NOT IN (SELECT group_key FROM a))"""
)
def large_groups(spark, d):
    """Groups of twelve images or more that nobody approved, and approved ones that aren't there."""
    groups = b.images(spark, d).groupBy(F.concat_ws(":", "class_name", "group_key").alias("group_key")).agg(F.count(F.lit(1)).alias("images"))
    approved = b.table(spark, d, "documents").select(F.concat("lang", F.lit(":"), "lang", F.lit(":::src1")).alias("group_key")).distinct()
    return checks.large_groups(groups, approved.unionByName(spark.createDataFrame([("none:none:::src0",)], "group_key string")), 12)


@_query(
    rf"""WITH f AS (SELECT *, regexp_replace(string_split(path, '/')[-1], '\.(jpg|jpeg)$', '', 'i') AS bare FROM {b.LEAF_FILES}), p AS (SELECT *, regexp_replace(bare, '{text.UUID_PREFIX.removeprefix("(?i)")}', '', 'i') AS plain FROM f)
    SELECT id, regexp_matches(plain, '\d\.\d+(\s|$)') AS decimal_suffix, regexp_matches(plain, '\sDay\s*\d+\s*$', 'i') AS dated, regexp_matches(path, '\.[A-Z]+$') AS upper_extension,
        regexp_matches(bare, '{text.UUID_PREFIX}') AS uuid_prefixed, NOT regexp_matches(plain, '{text.HEALTHY_NAME}') AND NOT regexp_matches(plain, '{text.BLIGHT_NAME}') AS unparsed FROM p"""
)
def filename_flags(spark, d):
    return b.leaf_files(spark, d).select("id", *[c.alias(k) for k, c in text.name_flags(F.col("path")).items()])


@_query(
    f"""SELECT string_split(class_name, ' ')[1] AS crop, regexp_replace(class_name, '^\\S+ ', '') AS condition, class_name LIKE '%Healthy' AS healthy, count(*) AS n, count(*) FILTER (correct) AS correct
    FROM {b.PREDICTIONS} JOIN {b.CLASSES} ON class_index = predicted_class_index GROUP BY ALL"""
)
def prediction_breakdown(spark, d):
    """Predictions by the crop, condition and health that their class names."""
    crop, condition, healthy = provenance.class_parts(F.col("class_name"))
    rows = b.predictions(spark, d).join(F.broadcast(b.class_dim(spark)), F.col("predicted_class_index") == F.col("class_index"))
    return rows.groupBy(crop.alias("crop"), condition.alias("condition"), healthy.alias("healthy")).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"))


@_query(
    """SELECT id, '{"provider":"' || persisted_provider || '"' || CASE WHEN fallback_reason IS NOT NULL THEN ',"fallback":{"reason":"' || fallback_reason || '"}' ELSE '' END || CASE WHEN custom_ml THEN ',"class":"' || class_name || '"' ELSE '' END || '}' AS document
    FROM (SELECT id, class_name, custom_ml, CASE WHEN second_opinion THEN 'combined' WHEN custom_ml THEN 'custom-ml' ELSE 'gemini' END AS persisted_provider,
        CASE error_code WHEN 'ML_SERVICE_TIMEOUT' THEN 'timeout' WHEN 'ML_SERVICE_NOT_READY' THEN 'service_not_ready' WHEN 'ML_UPSTREAM_INVALID_RESPONSE' THEN 'malformed_upstream' WHEN 'ML_SERVICE_UNAVAILABLE' THEN 'service_unavailable' END AS fallback_reason
        FROM """
    + b.OUTCOMES
    + ")"
)
def stored_documents(spark, d):
    """Documents as they are stored: a field that isn't given is absent, and so is an object without any."""
    reason = provenance.fallback_reason(F.col("error_code"))
    fallback = F.when(reason.isNotNull(), F.struct(reason.alias("reason")))
    name = F.when(F.col("custom_ml"), F.col("class_name"))
    document = F.struct(provenance.persisted_provider(F.col("second_opinion"), F.col("custom_ml")).alias("provider"), fallback.alias("fallback"), name.alias("class"))
    return b.outcomes(spark, d).select("id", F.to_json(document).alias("document"))
