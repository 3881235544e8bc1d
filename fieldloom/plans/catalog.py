"""Every query of the library by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import scalars, text
from fieldloom.operators import analytics, checks, dedup, evaluation, lineage, provenance, splits
from fieldloom.plans import audits, details, reporting, round_trips, stores, validations  # noqa: F401
from fieldloom.plans.registry import oracle_sql, queries  # noqa: F401
from fieldloom.plans.registry import query as _query
from fieldloom.sources import bindings as b
from fieldloom.sources import pull, writers
from fieldloom.staging import new_path
from fieldloom.streaming import counters


# ------------------------------------------------------------------------------------------------ analytics


@_query(
    f"""SELECT "userId", count(*) AS total_analyses, count(*) FILTER (severity IN ('critical', 'high')) AS critical_issues,
    count(*) FILTER (helpful) AS resolved_issues FROM {b.ANALYSES} GROUP BY "userId" """
)
def dashboard_stats(spark, d):
    return analytics.stats(b.analyses(spark, d))


@_query(f"""SELECT "userId", regexp_replace(type, '^([^_]*)_', '\\1 ') AS name, count(*) AS value FROM {b.ANALYSES} GROUP BY ALL""")
def dashboard_by_type(spark, d):
    return analytics.by_type(b.analyses(spark, d))


@_query(f"""SELECT "userId", coalesce(nullif(severity, ''), 'unknown') AS name, count(*) AS value FROM {b.ANALYSES} GROUP BY ALL""")
def dashboard_severity(spark, d):
    return analytics.by_severity(b.analyses(spark, d))


@_query(
    """WITH n AS (SELECT max(o_orderdate) AS now FROM orders),
    s AS (SELECT date_trunc('month', now) - INTERVAL 6 MONTH + to_days(CAST(day(now) - 1 AS INTEGER)) + (now - date_trunc('day', now)) AS since FROM n)
    SELECT o_orderstatus AS status, strftime(o_orderdate, '%b') AS month, count(*) AS count, min(o_orderdate) AS first_at FROM orders, s WHERE o_orderdate > since GROUP BY ALL"""
)
def dashboard_monthly(spark, d):
    orders = b.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderdate")
    now = orders.agg(F.max("o_orderdate").alias("now"))
    return analytics.monthly(orders, now, "status", "o_orderdate")


@_query(
    f"""SELECT "userId", CAST(rank AS INTEGER) AS rank, id, type, severity, confidence, "cropName", "createdAt" FROM (
    SELECT *, row_number() OVER (PARTITION BY "userId" ORDER BY "createdAt" DESC, id DESC) AS rank FROM {b.ANALYSES}) WHERE rank <= 10"""
)
def dashboard_recent(spark, d):
    return analytics.recent(b.analyses(spark, d))


@_query(
    f"""SELECT "userId", type, severity, count(*) AS n, CAST(grouping("userId", type, severity) AS BIGINT) AS level FROM {b.ANALYSES}
    GROUP BY GROUPING SETS (("userId", type), ("userId", severity), ("userId"))"""
)
def dashboard_one_pass(spark, d):
    return analytics.rollup_counts(b.analyses(spark, d))


@_query(
    f"""SELECT id, type, severity, confidence, "cropName", "createdAt" FROM {b.ANALYSES} WHERE "userId" = 7 AND severity = 'high'
    ORDER BY "createdAt" DESC, id DESC LIMIT 5 OFFSET 5"""
)
def history_page(spark, d):
    return analytics.history_page(b.analyses(spark, d), 7, "all", "high", page=2, limit=5)


@_query(f"""SELECT "userId", count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM {b.ANALYSES} GROUP BY "userId" """)
def history_pagination(spark, d):
    return analytics.pagination(b.analyses(spark, d))


@_query("SELECT user_id, count(*) AS analysis_count FROM events GROUP BY user_id")
def user_analysis_count(spark, d):
    return b.table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("analysis_count"))


@_query(
    """SELECT c_custkey, CASE WHEN s_name IS NOT NULL AND s_name <> '' THEN s_name ELSE c_name END AS c_name,
    CASE WHEN s_acctbal IS NOT NULL AND s_acctbal <> 0 THEN s_acctbal ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey"""
)
def profile_patch(spark, d):
    users = b.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    patches = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return writers.patched(users, patches, "c_custkey", ["c_name", "c_acctbal"])


@_query(
    """SELECT email, min(name) AS name FROM (SELECT c_nationkey AS email, c_name AS name FROM customer WHERE c_nationkey IS NOT NULL) WHERE email NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) GROUP BY email"""
)
def register_new_users(spark, d):
    new = b.table(spark, d, "customer").select(F.col("c_nationkey").alias("email"), F.col("c_name").alias("name"))
    old = b.table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("email"))
    return writers.new_by_key(new, old, "email")


@_query(
    """SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS context FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 5 GROUP BY conv_id"""
)
def chat_context_last5(spark, d):
    return analytics.chat_context(b.table(spark, d, "conversations"))


@_query(
    f"""WITH a AS (SELECT "createdAt" AS t, floor(epoch_us(TIMESTAMP '2024-01-31 00:00:00') / 1000000.0 - epoch_us("createdAt") / 1000000.0) AS s FROM {b.ANALYSES})
    SELECT CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago'
        WHEN s < 604800 THEN CAST(floor(s / 86400) AS BIGINT) || 'd ago' ELSE strftime(t, '%Y-%m-%d') END AS age, count(*) AS n FROM a GROUP BY age"""
)
def time_ago_buckets(spark, d):
    return analytics.ages(b.analyses(spark, d), F.lit("2024-01-31 00:00:00").cast("timestamp"))


# ----------------------------------------------------------------------------------------- text, provenance

_TAG_LIST = ", ".join(f"'{w}'" for w in text.TAG_WORDS)


@_query(
    f"""SELECT p_partkey AS id, array_to_string(list_distinct_kept, ',') AS tags FROM (
    SELECT p_partkey, list_concat(list_concat([kind], CASE WHEN crop <> '' THEN [lower(crop)] ELSE [] END), list_filter([{_TAG_LIST}], lambda w: contains(lower(query), w) AND w <> kind AND w <> lower(crop))) AS list_distinct_kept
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'pest' ELSE 'soil' END AS kind, p_brand AS crop, p_name || CASE p_partkey % 3 WHEN 0 THEN ' Fungal pest' WHEN 1 THEN ' drought, Irrigation' ELSE '' END AS query FROM part))"""
)
def tags(spark, d):
    k = F.col("p_partkey")
    query = F.concat("p_name", F.when(k % 3 == 0, " Fungal pest").when(k % 3 == 1, " drought, Irrigation").otherwise(""))
    kind = F.when(k % 2 == 0, "pest").otherwise("soil")
    return b.table(spark, d, "part").select(k.alias("id"), F.array_join(text.tags(query, F.col("p_brand"), kind), ",").alias("tags"))


_MARK = text.SECTION.replace("(?i)", "").replace("'", "''")


@_query(
    rf"""WITH p AS (SELECT id, text, string_split(regexp_replace(text, '{_MARK}', chr(1) || '\1' || chr(2), 'gi'), chr(1))[2:] AS parts FROM {b.RESPONSES}),
    s AS (SELECT id, text, list_transform(parts, lambda x: upper(string_split(x, chr(2))[1])) AS names, list_transform(parts, lambda x: regexp_replace(string_split(x, chr(2))[2], '^\s+|\s+$', '', 'g')) AS bodies FROM p),
    f AS (SELECT id, text, bodies[list_position(names, 'DIAGNOSIS')] AS dg, bodies[list_position(names, 'SEVERITY')] AS sv, bodies[list_position(names, 'CONFIDENCE')] AS cf,
        bodies[list_position(names, 'TREATMENT')] AS tr, bodies[list_position(names, 'PREVENTION')] AS pv,
        list_filter(list_zip(names, bodies), lambda z: z[1] IN ('EXPERT ADVICE', 'EXPERT', 'CONSULT'))[1][2] AS ex FROM s)
    SELECT id, coalesce(nullif(dg, ''), list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')) > 20)[1], left(text, 200)) AS diagnosis,
        coalesce(nullif(lower(regexp_extract(sv, '(critical|high|medium|low|healthy)', 1, 'i')), ''), 'medium') AS severity,
        coalesce(TRY_CAST(nullif(regexp_extract(cf, '(\d+)', 1), '') AS BIGINT), 75) AS confidence,
        coalesce(nullif(tr, ''), '{text.DEFAULT_TREATMENT}') AS treatment, coalesce(nullif(pv, ''), '{text.DEFAULT_PREVENTION}') AS prevention, nullif(ex, '') AS expert_advice FROM f"""
)
def section_parse(spark, d):
    return b.responses(spark, d).select("id", text.parsed_response(F.col("text")).alias("r")).select("id", "r.*")


@_query(f"""SELECT class_index, string_split(class_name, ' ')[1] AS crop, regexp_replace(class_name, '^\\S+ ', '') AS condition, class_name LIKE '%Healthy' AS healthy FROM {b.CLASSES}""")
def class_breakdown(spark, d):
    crop, condition, healthy = provenance.class_parts(F.col("class_name"))
    return b.class_dim(spark).select("class_index", crop.alias("crop"), condition.alias("condition"), healthy.alias("healthy"))


_METADATA = f"""(SELECT id, CASE WHEN second_opinion THEN 'combined' WHEN custom_ml THEN 'custom-ml' ELSE 'gemini' END AS persisted_provider, error_code IS NOT NULL AS fallback_used,
    CASE WHEN error_code IS NOT NULL THEN 'gemini' END AS fallback_provider,
    CASE error_code WHEN 'ML_SERVICE_TIMEOUT' THEN 'timeout' WHEN 'ML_SERVICE_NOT_READY' THEN 'service_not_ready' WHEN 'ML_UPSTREAM_INVALID_RESPONSE' THEN 'malformed_upstream'
        WHEN 'ML_SERVICE_UNAVAILABLE' THEN 'service_unavailable' END AS fallback_reason, second_opinion AS second_opinion_used FROM {b.OUTCOMES})"""


@_query(f"SELECT * FROM {_METADATA}")
def provider_metadata(spark, d):
    return provenance.provider_metadata(b.outcomes(spark, d))


@_query(f"SELECT fallback_reason, count(*) AS n FROM {_METADATA} GROUP BY fallback_reason")
def fallback_reasons(spark, d):
    return provenance.provider_metadata(b.outcomes(spark, d)).groupBy("fallback_reason").agg(F.count(F.lit(1)).alias("n"))


@_query(
    f"""WITH m AS (SELECT id, persisted_provider, CASE WHEN id % 7 = 0 THEN NOT second_opinion_used ELSE second_opinion_used END AS second FROM {_METADATA})
    SELECT id, 'combined_without_second_opinion' AS rule FROM m WHERE persisted_provider = 'combined' AND NOT second
    UNION ALL SELECT id, 'second_opinion_not_combined' FROM m WHERE second AND persisted_provider <> 'combined'"""
)
def provenance_conflicts(spark, d):
    second = F.col("second_opinion_used")
    metadata = provenance.provider_metadata(b.outcomes(spark, d)).withColumn("second_opinion_used", F.when(F.col("id") % 7 == 0, ~second).otherwise(second))
    return provenance.metadata_conflicts(metadata)


@_query(
    f"""WITH o AS (SELECT o.*, c.class_index AS want FROM {b.OUTCOMES} o LEFT JOIN {b.CLASSES} c USING (class_name))
    SELECT id, 'class_name' AS rule FROM o WHERE want IS NULL UNION ALL SELECT id, 'class_index' FROM o WHERE want IS DISTINCT FROM class_index
    UNION ALL SELECT id, 'model_confidence' FROM o WHERE NOT model_confidence BETWEEN 0 AND 1 UNION ALL SELECT id, 'accepted_uncertain' FROM o WHERE accepted = uncertain
    UNION ALL SELECT id, 'confidence_threshold' FROM o WHERE confidence_threshold <> 0.5 UNION ALL SELECT id, 'production_calibrated' FROM o WHERE production_calibrated"""
)
def custom_ml_violations(spark, d):
    return provenance.custom_ml_violations(b.outcomes(spark, d))


@_query(
    f"""SELECT id, class_name AS diagnosis, CASE WHEN class_name LIKE '%Healthy' THEN 'healthy' ELSE 'medium' END AS severity, CAST(floor(model_confidence * 100 + 0.5) AS BIGINT) AS confidence,
    'Custom ML model prediction: ' || class_name || ' (model confidence ' || CAST(floor(model_confidence * 100 + 0.5) AS BIGINT) || '%, ' || CASE WHEN accepted THEN 'accepted' ELSE 'uncertain' END || ').' AS summary FROM {b.OUTCOMES}"""
)
def legacy_mapping(spark, d):
    return provenance.legacy(b.outcomes(spark, d))


@_query(
    f"""WITH u AS (SELECT *, lower(regexp_extract(coalesce(filename, ''), '(\\.[^.]*)$', 1)) AS ext FROM {b.UPLOADS}),
    e AS (SELECT id, CASE WHEN filename IS NULL OR trim(filename) = '' OR n_bytes = 0 THEN 'invalid_file' WHEN n_bytes > 10485760 THEN 'file_too_large'
        WHEN ext NOT IN ('.jpg', '.jpeg', '.png') OR content_type NOT IN ('image/jpeg', 'image/png') THEN 'unsupported_media_type' WHEN NOT decodable THEN 'malformed_image'
        WHEN actual_format <> CASE content_type WHEN 'image/jpeg' THEN 'JPEG' ELSE 'PNG' END THEN 'mime_mismatch' WHEN n_frames > 1 THEN 'animated_image_not_supported'
        WHEN width <= 0 OR height <= 0 THEN 'malformed_image' WHEN width * height > 25000000 THEN 'image_too_large' END AS error FROM u)
    SELECT id, error, CASE error WHEN 'file_too_large' THEN 413 WHEN 'unsupported_media_type' THEN 415 ELSE CASE WHEN error IS NULL THEN 200 ELSE 400 END END AS status FROM e"""
)
def upload_first_error(spark, d):
    return b.uploads(spark, d).select("id", provenance.upload_error().alias("error")).withColumn("status", provenance.upload_status(F.col("error")))


# ------------------------------------------------------------------------------------------ dedup, lineage

_BY_SOURCE = b.IMAGES.replace("lang AS class_name, source,", "source AS class_name,")


@_query(
    f"""SELECT path, representative, classes > 1 AS cross_class FROM {_BY_SOURCE} i JOIN (
    SELECT sha256, min(path) AS representative, count(DISTINCT class_name) AS classes FROM {_BY_SOURCE} GROUP BY sha256 HAVING count(*) > 1) USING (sha256) WHERE path <> representative"""
)
def exact_duplicates(spark, d):
    return dedup.exact_duplicates(b.images(spark, d, "source"))


@_query(f"""SELECT sha256, min(path) AS representative, count(*) AS members, count(DISTINCT class_name) AS classes, true AS cross_class FROM {_BY_SOURCE} GROUP BY sha256 HAVING count(*) > 1 AND count(DISTINCT class_name) > 1""")
def cross_class_conflicts(spark, d):
    return dedup.exact_groups(b.images(spark, d, "source")).where("cross_class")


@_query(
    f"""SELECT CAST(sum(n) AS BIGINT) AS images, count(*) AS unique_hashes, count(*) FILTER (n > 1) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS redundant_images,
    count(*) FILTER (n > 1 AND c = 1) AS within_class_groups, count(*) FILTER (c > 1) AS cross_class_groups FROM (SELECT count(*) AS n, count(DISTINCT class_name) AS c FROM {_BY_SOURCE} GROUP BY sha256)"""
)
def duplicate_summary(spark, d):
    return dedup.duplicate_summary(b.images(spark, d, "source"))


def _leaf_join(spark, d):
    """Images by the normalised key of their file name, leaf ids of the labelled ones by the same key."""
    prefix = F.when(F.col("doc_id") % 2 == 0, "0A1B2C3D-0000-4000-8000-0123456789ab___").otherwise("")
    named = b.images(spark, d).select("path", "class_name", "doc_id", text.leaf_key(F.concat(prefix, F.lit("K"), F.pmod("doc_id", F.lit(97)), F.lit(" "))).alias("key"))
    leaf_ids = named.join(b.table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("key", F.concat("class_name", F.lit(":::"), F.col("doc_id").cast("string")).alias("leaf_id"))
    return lineage.leaf_join(named, leaf_ids)


_LEAF = f"""(SELECT i.path, i.class_name, m.leaf_id FROM {b.IMAGES} i LEFT JOIN (SELECT doc_id % 97 AS key, class_name, min(class_name || ':::' || doc_id) AS leaf_id FROM {b.IMAGES}
    WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY ALL) m ON m.key = i.doc_id % 97 AND m.class_name = i.class_name)"""


@_query(f"SELECT * FROM {_LEAF}")
def id_join(spark, d):
    return _leaf_join(spark, d)


@_query(f"""SELECT class_name, count(*) AS images, count(leaf_id) AS matched, count(*) - count(leaf_id) AS unmatched, count(leaf_id) * 100 / count(*) AS matched_pct FROM {_LEAF} GROUP BY class_name""")
def id_join_summary(spark, d):
    return lineage.match_summary(_leaf_join(spark, d))


@_query(
    """WITH c AS (SELECT o_custkey AS key, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey),
    s AS (SELECT c_mktsegment AS class_name, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM customer LEFT JOIN c ON c_custkey = key)
    SELECT class_name, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unresolved') AS unresolved FROM s GROUP BY class_name"""
)
def recovery_status(spark, d):
    images = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("class_name"), F.col("c_custkey").alias("key"))
    candidates = b.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("leaf_id"))
    return lineage.recovery_counts(lineage.recovery(images, candidates))


_CONFLICT = f"(SELECT sha256 FROM {_BY_SOURCE} GROUP BY sha256 HAVING count(DISTINCT class_name) > 1)"


@_query(
    f"""SELECT path, class_name, concat_ws(',', CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'unmatched' END, CASE WHEN sha256 IN {_CONFLICT} THEN 'cross_class_conflict' END) AS reasons
    FROM {_BY_SOURCE} WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR sha256 IN {_CONFLICT}"""
)
def quarantine(spark, d):
    images = b.images(spark, d, "source")
    conflicts = dedup.exact_groups(images).where("cross_class")
    return lineage.quarantine(images, b.table(spark, d, "labels"), conflicts).withColumn("reasons", F.array_join("reasons", ","))


_NAMES = f"""(SELECT id, kind, regexp_replace(regexp_replace(string_split(path, '/')[-1], '\\.(jpg|jpeg)$', '', 'i'), '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}___', '', 'i') AS s FROM {b.LEAF_FILES})"""
_HN, _BN = (p.replace("(?i)", "") for p in (text.HEALTHY_NAME, text.BLIGHT_NAME))
_GROUPS = f"""(SELECT id, kind, CASE WHEN kind = 'healthy' THEN 'th::Leaf' || CAST(nullif(regexp_extract(s, '{_HN}', 1, 'i'), '') AS INTEGER)
    ELSE 'tlb::' || upper(nullif(regexp_extract(s, '{_BN}', 1, 'i'), '')) || '::Leaf' || CAST(nullif(regexp_extract(s, '{_BN}', 2, 'i'), '') AS INTEGER) END AS group_key,
    upper(nullif(regexp_extract(s, '{_BN}', 1, 'i'), '')) AS session_prefix, CAST(nullif(regexp_extract(s, '{_BN}', 2, 'i'), '') AS INTEGER) AS leaf_number FROM {_NAMES})"""


def _named(spark, d):
    h, l = text.healthy_name(F.col("path")), text.blight_name(F.col("path"))
    files = b.leaf_files(spark, d).select("id", "kind", h.alias("h"), l.alias("l"))
    return files.select("id", "kind", F.when(F.col("kind") == "healthy", F.col("h.group_key")).otherwise(F.col("l.group_key")).alias("group_key"), "l.session_prefix", "l.leaf_number")


@_query(f"SELECT id, kind, group_key FROM {_GROUPS}")
def filename_groups(spark, d):
    return _named(spark, d).select("id", "kind", "group_key")


@_query(f"SELECT size, count(*) AS groups FROM (SELECT group_key, count(*) AS size FROM {_GROUPS} WHERE group_key IS NOT NULL GROUP BY group_key) GROUP BY size")
def group_size_distribution(spark, d):
    return lineage.group_sizes(_named(spark, d).where("group_key is not null"))


@_query(
    f"""SELECT count(*) FILTER (size = 1) AS singletons, count(*) FILTER (size = 2) AS pairs, count(*) FILTER (size = 3) AS triples, count(*) FILTER (size >= 4) AS larger, max(size) AS largest
    FROM (SELECT group_key, count(*) AS size FROM {_GROUPS} WHERE group_key IS NOT NULL GROUP BY group_key)"""
)
def group_size_buckets(spark, d):
    return lineage.size_buckets(_named(spark, d).where("group_key is not null"))


@_query(f"SELECT leaf_number, string_agg(DISTINCT session_prefix, ',' ORDER BY session_prefix) AS prefixes FROM {_GROUPS} WHERE kind = 'blight' AND leaf_number IS NOT NULL GROUP BY leaf_number HAVING count(DISTINCT session_prefix) > 1")
def shared_leaf_prefix(spark, d):
    return lineage.shared_numbers(_named(spark, d).where("kind = 'blight' and leaf_number is not null"))


@_query(
    f"""SELECT group_key, size, CAST(round AS INTEGER) AS round FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY group_key) AS round FROM (
    SELECT group_key, count(*) AS size FROM {_GROUPS} WHERE group_key IS NOT NULL GROUP BY group_key)) ORDER BY round, size LIMIT 30"""
)
def stratified_sample(spark, d):
    groups = _named(spark, d).where("group_key is not null").groupBy("group_key").agg(F.count(F.lit(1)).alias("size"))
    return lineage.stratified_sample(groups, 30)


#: Fixed value: hashes within so many bits are near.
RADIUS = 5
_PAIRS = f"""(SELECT x.id AS a, x.class_index AS a_class, y.id AS b, y.class_index AS b_class, CAST(bit_count(xor(x.hash, y.hash)) AS INTEGER) AS distance, x.class_index <> y.class_index AS cross_class
    FROM h x JOIN h y ON x.id < y.id AND bit_count(xor(x.hash, y.hash)) <= {RADIUS})"""


_CLASSES = "(SELECT hash, min(id) AS first, count(*) AS n, count(DISTINCT class_index) AS classes FROM h GROUP BY hash)"


@_query(
    f"""WITH h AS {b.HASHES}, c AS {_CLASSES} SELECT x.first, y.first AS first2, CAST(bit_count(xor(x.hash, y.hash)) AS INTEGER) AS distance, x.n, y.n AS n2
    FROM c x JOIN c y ON x.first < y.first AND bit_count(xor(x.hash, y.hash)) <= {RADIUS}"""
)
def hamming_class_pairs(spark, d):
    """Pairs of classes of equal hashes, for which copies aren't written out."""
    return dedup.hamming_classes(b.hashes(spark, d), RADIUS)[1]


@_query(f"WITH h AS {b.HASHES}, c AS {_CLASSES} SELECT first, n, classes > 1 AS cross_class FROM c")
def hamming_classes(spark, d):
    classes = dedup.hamming_classes(b.hashes(spark, d), RADIUS)[0]
    return classes.select("first", "n", (F.col("classes") > 1).alias("cross_class"))


@_query(f"WITH h AS {b.HASHES} SELECT * FROM {_PAIRS}")
def hamming_pairs(spark, d):
    return dedup.hamming_pairs(b.hashes(spark, d), RADIUS)


_CLUSTERS = f"""RECURSIVE h AS {b.HASHES}, p AS {_PAIRS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a), c AS (SELECT id, min(root) AS cluster_id FROM r GROUP BY id)"""


@_query(f"WITH {_CLUSTERS} SELECT * FROM c")
def components(spark, d):
    return dedup.clusters(b.hashes(spark, d), RADIUS)


@_query(
    f"""WITH {_CLUSTERS}, m AS (SELECT * FROM c JOIN h USING (id))
    SELECT cluster_id, members, max_distance, classes > 1 AS cross_class FROM (SELECT cluster_id, count(*) AS members, count(DISTINCT class_index) AS classes FROM m GROUP BY cluster_id)
    JOIN (SELECT x.cluster_id, CAST(max(bit_count(xor(x.hash, y.hash))) AS INTEGER) AS max_distance FROM m x JOIN m y ON x.cluster_id = y.cluster_id AND x.id < y.id GROUP BY x.cluster_id) USING (cluster_id)"""
)
def cluster_stats(spark, d):
    hashes = b.hashes(spark, d)
    return dedup.cluster_stats(dedup.clusters(hashes, RADIUS), hashes)


# ---------------------------------------------------------------------------------------------------- splits


def _guards(spark, d):
    keys = b.images(spark, d).select("group_key", F.element_at(F.split("group_key", "src"), -1).cast("int").alias("k")).distinct().where("k % 5 = 0")
    return keys.select("group_key", F.concat(F.lit("guard:"), F.substring_index("group_key", ":::", 1), F.lit(":"), F.floor(F.col("k") / 10).cast("string")).alias("guard_id"))


def _components(spark, d):
    groups = b.images(spark, d).groupBy("class_name", "group_key").agg(F.count(F.lit(1)).alias("images"))
    return splits.components(groups, _guards(spark, d))


_COMPONENTS = f"""(SELECT class_name, coalesce(guard_id, group_key) AS component_id, CAST(sum(images) AS BIGINT) AS size, count(*) AS group_count FROM (
    SELECT *, CASE WHEN k % 5 = 0 THEN 'guard:' || class_name || ':' || (k // 10) END AS guard_id FROM (
        SELECT class_name, group_key, CAST(string_split(group_key, 'src')[-1] AS INTEGER) AS k, count(*) AS images FROM {b.IMAGES} GROUP BY class_name, group_key)) GROUP BY ALL)"""
_ALLOCATED = f"""RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY size DESC, component_id) AS i FROM {_COMPONENTS}),
    t AS (SELECT class_name, CAST(round_even(sum(size) * 0.7, 0) AS BIGINT) AS t0, CAST(round_even(sum(size) * 0.15, 0) AS BIGINT) AS t1, CAST(sum(size) AS BIGINT) AS total FROM o GROUP BY class_name),
    f AS (SELECT class_name, CAST(0 AS BIGINT) AS i, t0 AS l0, t1 AS l1, total - t0 - t1 AS l2, CAST(0 AS BIGINT) AS g0, CAST(0 AS BIGINT) AS g1, CAST(0 AS BIGINT) AS g2, -1 AS pick FROM t
        UNION ALL SELECT class_name, i, l0 - CASE WHEN k = 0 THEN size ELSE 0 END, l1 - CASE WHEN k = 1 THEN size ELSE 0 END, l2 - CASE WHEN k = 2 THEN size ELSE 0 END,
            g0 + CASE WHEN k = 0 THEN group_count ELSE 0 END, g1 + CASE WHEN k = 1 THEN group_count ELSE 0 END, g2 + CASE WHEN k = 2 THEN group_count ELSE 0 END, k
        FROM (SELECT o.class_name, o.i, o.size, o.group_count, l0, l1, l2, g0, g1, g2,
            CASE WHEN (-l0, g0, 0) <= (-l1, g1, 1) AND (-l0, g0, 0) <= (-l2, g2, 2) THEN 0 WHEN (-l1, g1, 1) <= (-l2, g2, 2) THEN 1 ELSE 2 END AS k FROM f JOIN o ON o.class_name = f.class_name AND o.i = f.i + 1)),
    a AS (SELECT class_name, component_id, size, group_count, ['train', 'val', 'test'][pick + 1] AS split FROM o JOIN f USING (class_name, i))"""


audits.register_allocation(_ALLOCATED, b.IMAGES)
validations.register(_ALLOCATED, _COMPONENTS)


_MEMBERS = f"""i AS (SELECT path, class_name, group_key, CASE WHEN k % 5 = 0 THEN 'guard:' || class_name || ':' || (k // 10) ELSE group_key END AS component_id FROM (SELECT *, CAST(string_split(group_key, 'src')[-1] AS INTEGER) AS k FROM {b.IMAGES})),
    m AS (SELECT path, split FROM i JOIN a USING (class_name, component_id))"""


@_query(
    f"""WITH {_ALLOCATED}, {_MEMBERS}, c AS (SELECT 'integrity' AS report, 2 AS rows UNION ALL SELECT unnest(['components', 'allocation']), count(*) FROM a
        UNION ALL SELECT unnest(['summary', 'deviation']), count(*) FROM (SELECT DISTINCT class_name, split FROM a) UNION ALL SELECT s, count(path) FROM (SELECT unnest(['train', 'val', 'test']) AS s) LEFT JOIN m ON s = split GROUP BY s)
    SELECT report, rows, rows AS read FROM c"""
)
def split_build_reports(spark, d):
    """The eight reports of a split build as one committed set, and how many rows of each are read back."""
    images = b.images(spark, d)
    groups = images.groupBy("class_name", "group_key").agg(F.count(F.lit(1)).alias("images"))
    return reporting.committed_counts(spark, "splits", reporting.split_build(groups, _guards(spark, d), images), new_path(spark, "split-reports"))


@_query(
    f"""WITH h AS {b.HASHES}, i AS {b.IMAGES}, p AS {_PAIRS}, x AS (SELECT sha256, count(*) AS n, count(DISTINCT class_name) AS classes FROM i GROUP BY sha256), q AS (SELECT class_name FROM i JOIN x USING (sha256) WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR classes > 1),
    c AS (SELECT unnest(['class_counts', 'id_join_summary']) AS report, count(DISTINCT class_name) AS rows FROM i UNION ALL SELECT unnest(['file_inventory', 'id_join']), count(*) FROM i
        UNION ALL SELECT 'exact_duplicates', CAST(sum(n - 1) AS BIGINT) FROM x UNION ALL SELECT 'duplicate_summary', 1 UNION ALL SELECT 'cross_class_conflicts', count(*) FROM x WHERE classes > 1
        UNION ALL SELECT 'near_pairs', count(*) FROM (SELECT DISTINCT hash FROM h) y JOIN (SELECT DISTINCT hash FROM h) z ON y.hash < z.hash AND bit_count(xor(y.hash, z.hash)) <= {RADIUS}
        UNION ALL SELECT 'clusters', count(*) FROM (SELECT a FROM p UNION SELECT b FROM p) UNION ALL SELECT 'quarantine', count(*) FROM q UNION ALL SELECT 'quarantine_by_class', count(DISTINCT class_name) FROM q)
    SELECT report, rows, rows AS read FROM c"""
)
def preparation_reports(spark, d):
    """The eleven reports of a preparation run as one committed set."""
    built = reporting.preparation(b.images(spark, d), b.hashes(spark, d), b.table(spark, d, "labels"), RADIUS)
    return reporting.committed_counts(spark, "prepare", built, new_path(spark, "prepare-reports"))


@_query(
    """WITH k AS (SELECT o_custkey AS key, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey), s AS (SELECT c_custkey AS id, c_mktsegment AS g, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM customer LEFT JOIN k ON key = c_custkey),
    c AS (SELECT 'metadata_inventory' AS report, count(*) AS rows FROM k UNION ALL SELECT x, count(id) FROM (SELECT unnest(['matched', 'ambiguous', 'unresolved']) AS x) LEFT JOIN s ON status = x GROUP BY x UNION ALL SELECT 'recovery_status', count(DISTINCT g) FROM s
        UNION ALL SELECT 'shared_keys', count(*) FROM k WHERE n > 1 UNION ALL SELECT 'examples', coalesce(sum(least(n, 10)), 0) FROM (SELECT count(*) AS n FROM s WHERE status = 'ambiguous' GROUP BY g))
    SELECT report, CAST(rows AS BIGINT) AS rows, CAST(rows AS BIGINT) AS read FROM c"""
)
def recovery_reports(spark, d):
    """The seven reports of a recovery run as one committed set."""
    images = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("class_name"), F.col("c_custkey").alias("key"))
    candidates = b.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("leaf_id"))
    return reporting.committed_counts(spark, "recovery", reporting.recovery_run(images, candidates), new_path(spark, "recovery-reports"))


@_query(
    f"""WITH n AS (SELECT * FROM {_GROUPS}), g AS (SELECT group_key, count(*) AS size, min(session_prefix) AS p FROM n WHERE group_key IS NOT NULL GROUP BY group_key),
    j AS (SELECT DISTINCT coalesce(s_acctbal > 5000, c_acctbal > 5000) AS yes FROM customer FULL JOIN supplier ON c_custkey = s_suppkey),
    c AS (SELECT 'groups' AS report, count(*) AS rows FROM g UNION ALL SELECT 'group_sizes', count(DISTINCT size) FROM g UNION ALL SELECT 'sample', least(count(*), 20) FROM g
        UNION ALL SELECT 'shared_prefixes', count(*) FROM (SELECT leaf_number FROM n WHERE leaf_number IS NOT NULL AND session_prefix IS NOT NULL GROUP BY leaf_number HAVING count(DISTINCT session_prefix) > 1)
        UNION ALL SELECT 'judgments', count(*) FROM j UNION ALL SELECT 'large_chains', count(*) FROM g WHERE size >= 15)
    SELECT report, rows, rows AS read FROM c"""
)
def review_reports(spark, d):
    """The six reports of a review run as one committed set."""
    judged = lambda t, k, v: b.table(spark, d, t).select(F.col(k).alias("group_key"), F.when(F.col(v) > 5000, "supported").otherwise("ambiguous").alias("judgment"))
    reviews = [judged("customer", "c_custkey", "c_acctbal"), judged("supplier", "s_suppkey", "s_acctbal")]
    return reporting.committed_counts(spark, "review", reporting.review_run(_named(spark, d), reviews, 15, 20), new_path(spark, "review-reports"))


@_query(
    f"""WITH {_CLUSTERS}, s AS (SELECT path, sha256, group_key, ['train', 'val', 'test'][doc_id % 3 + 1] AS split FROM {b.IMAGES}),
    v AS (SELECT 'path' AS k, path AS x, split FROM s UNION ALL SELECT 'sha256', sha256, split FROM s UNION ALL SELECT 'group_key', group_key, split FROM s),
    o AS (SELECT 'checks' AS report, 2 AS rows UNION ALL SELECT 'overlaps', count(*) FROM (SELECT k, x FROM v WHERE x <> '' GROUP BY k, x HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'cluster_consistency', count(DISTINCT cluster_id) FROM c)
    SELECT report, CAST(rows AS BIGINT) AS rows, CAST(rows AS BIGINT) AS read FROM o"""
)
def validation_reports(spark, d):
    """The three reports of a validation run as one committed set."""
    split = F.get(F.array(*map(F.lit, splits.SPLITS)), (F.col("doc_id") % 3).cast("int"))
    rows = b.images(spark, d).select("path", "sha256", "group_key", split.alias("split"))
    members = dedup.clusters(b.hashes(spark, d), RADIUS).select("cluster_id", (F.col("id") % 7).alias("group_key"), (F.col("id") % 3).alias("split"))
    built = reporting.validation_run(checks.leakage(rows, ["sha256", "group_key"]), rows, members)
    return reporting.committed_counts(spark, "validation", built, new_path(spark, "validation-reports"))


@_query(f"SELECT * FROM {_COMPONENTS}")
def guard_components(spark, d):
    return _components(spark, d)


@_query(f"WITH {_ALLOCATED} SELECT * FROM a")
def split_allocation(spark, d):
    return splits.allocate(_components(spark, d))


@_query(
    f"""WITH {_ALLOCATED} SELECT class_name, split, images, groups, images * 100.0::DOUBLE / total AS pct, CASE WHEN images >= 30 AND groups >= 15 THEN 'PASS' ELSE 'FAIL' END AS status
    FROM (SELECT class_name, split, CAST(sum(size) AS BIGINT) AS images, CAST(sum(group_count) AS BIGINT) AS groups FROM a GROUP BY ALL) JOIN t USING (class_name)"""
)
def split_summary(spark, d):
    return splits.summary(splits.allocate(_components(spark, d)))


def _split_rows(spark, d):
    return b.images(spark, d, "source").withColumn("split", F.get(F.array(*map(F.lit, splits.SPLITS)), F.pmod("doc_id", F.lit(3)).cast("int")))


@_query(
    f"""WITH s AS (SELECT *, doc_id % 3 AS split FROM {_BY_SOURCE}), v AS (SELECT split, 'path' AS kind, path AS value FROM s UNION ALL SELECT split, 'sha256', sha256 FROM s UNION ALL SELECT split, 'group_key', group_key FROM s)
    SELECT kind, value, count(DISTINCT split) AS splits FROM v GROUP BY kind, value HAVING count(DISTINCT split) > 1"""
)
def leakage_overlaps(spark, d):
    return splits.overlaps(_split_rows(spark, d), ["path", "sha256", "group_key"])


@_query(
    f"""WITH s AS (SELECT *, doc_id % 3 AS split FROM {_BY_SOURCE}), v AS (SELECT split, 'path' AS kind, path AS value FROM s UNION ALL SELECT split, 'sha256', sha256 FROM s UNION ALL SELECT split, 'group_key', group_key FROM s),
    x AS (SELECT kind, value FROM v GROUP BY kind, value HAVING count(DISTINCT split) > 1)
    SELECT 'no_shared_' || k AS "check", CASE WHEN count(x.kind) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(x.kind) AS violations FROM (VALUES ('path'), ('sha256'), ('group_key')) AS n(k) LEFT JOIN x ON x.kind = n.k GROUP BY k"""
)
def leakage_checks(spark, d):
    return checks.leakage(_split_rows(spark, d), ["path", "sha256", "group_key"])


@_query(
    """WITH e AS (SELECT doc_id, lang, source FROM documents WHERE doc_id % 10 <> 3), a AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS lang, source FROM documents WHERE doc_id % 10 <> 4)
    SELECT count(*) FILTER (a.doc_id IS NULL) AS missing, count(*) FILTER (e.doc_id IS NULL) AS unexpected, count(*) FILTER (e.doc_id IS NOT NULL AND a.doc_id IS NOT NULL AND e.lang IS DISTINCT FROM a.lang) AS wrong_lang,
        count(*) FILTER (e.doc_id IS NOT NULL AND a.doc_id IS NOT NULL AND e.source IS DISTINCT FROM a.source) AS wrong_source FROM e FULL JOIN a ON e.doc_id = a.doc_id"""
)
def split_validation(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", "lang", "source")
    actual = docs.where("doc_id % 10 <> 4").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")))
    return splits.mismatches(docs.where("doc_id % 10 <> 3"), actual, "doc_id", ["lang", "source"])


@_query(
    f"""WITH i AS {_BY_SOURCE}, r AS (SELECT sha256, min(path) AS rep, count(DISTINCT class_name) AS c FROM i GROUP BY sha256), j AS (SELECT * FROM i JOIN r USING (sha256))
    SELECT count(*) AS considered, count(*) FILTER (path <> rep AND c = 1) AS duplicates, count(*) FILTER (c > 1) AS quarantined, count(*) FILTER (path = rep AND c = 1) AS rows, true AS balanced FROM j"""
)
def reconciliation(spark, d):
    images = b.images(spark, d, "source")
    dup = dedup.exact_duplicates(images).where("not cross_class")
    conflict = images.join(dedup.exact_groups(images).where("cross_class"), "sha256", "left_semi")
    rows = images.join(dup, "path", "left_anti").join(conflict, "path", "left_anti")
    return splits.reconciliation(images, dup, conflict, rows)


# ------------------------------------------------------------------------------------------------ evaluation

_P = b.PREDICTIONS
_CELLS = f"""p AS {_P}, c AS {b.CLASSES}, k AS (SELECT class_index, class_name, (SELECT count(*) FROM p WHERE true_class_index = class_index) AS support,
    (SELECT count(*) FROM p WHERE predicted_class_index = class_index) AS predicted, (SELECT count(*) FROM p WHERE true_class_index = class_index AND correct) AS tp FROM c)"""
_METRICS = f"""{_CELLS}, m AS (SELECT class_index, class_name, support, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
    coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1, predicted FROM k)"""


@_query(f"WITH {_CELLS} SELECT class_index, class_name, support AS n, (SELECT count(*) FROM p) / nullif(6 * support, 0) AS weight FROM k")
def class_weights(spark, d):
    return evaluation.class_weights(b.predictions(spark, d), b.class_dim(spark))


@_query(
    f"""WITH p AS {_P}, c AS {b.CLASSES} SELECT t.class_index AS true_class_index, q.class_index AS predicted_class_index, count(p.path) AS n
    FROM c t CROSS JOIN c q LEFT JOIN p ON p.true_class_index = t.class_index AND p.predicted_class_index = q.class_index GROUP BY ALL"""
)
def confusion_matrix(spark, d):
    return evaluation.confusion(b.predictions(spark, d), b.class_dim(spark))


@_query(f"WITH {_METRICS} SELECT * FROM m")
def per_class_metrics(spark, d):
    return evaluation.per_class(b.predictions(spark, d), b.class_dim(spark))


@_query(
    f"""WITH {_METRICS} SELECT (SELECT count(*) FILTER (correct) / count(*) FROM p) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
    round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM m WHERE support > 0 OR predicted > 0"""
)
def macro_metrics_present(spark, d):
    return evaluation.macro(evaluation.per_class(b.predictions(spark, d), b.class_dim(spark)))


_SWEEP = f"""p AS {_P}, c AS {b.CLASSES}, g AS (SELECT x / 100.0::DOUBLE AS threshold FROM range(50, 100) r(x)),
    cells AS (SELECT threshold, true_class_index AS t, predicted_class_index AS q, count(*) FILTER (maximum_probability >= threshold) AS accepted, count(*) AS total FROM p, g GROUP BY ALL),
    tr AS (SELECT threshold, t AS class_index, CAST(sum(total) AS BIGINT) AS total, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(accepted) FILTER (t = q) AS BIGINT) AS tp FROM cells GROUP BY ALL),
    pr AS (SELECT threshold, q AS class_index, CAST(sum(accepted) AS BIGINT) AS predicted FROM cells GROUP BY ALL),
    k AS (SELECT g.threshold, c.class_index, coalesce(total, 0) AS total, coalesce(accepted, 0) AS accepted, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted
        FROM g CROSS JOIN c LEFT JOIN tr ON tr.threshold = g.threshold AND tr.class_index = c.class_index LEFT JOIN pr ON pr.threshold = g.threshold AND pr.class_index = c.class_index),
    kc AS (SELECT *, accepted / nullif(total, 0) AS coverage, tp / nullif(accepted, 0) AS accuracy, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(accepted, 0), 0) AS recall, coalesce(2 * tp / nullif(predicted + accepted, 0), 0) AS f1 FROM k),
    s AS (SELECT threshold, CAST(sum(total) AS BIGINT) AS total_samples, CAST(sum(accepted) AS BIGINT) AS accepted_count, CAST(sum(total) - sum(accepted) AS BIGINT) AS rejected_count, sum(accepted) / sum(total) AS coverage, sum(tp) / nullif(sum(accepted), 0) AS selective_accuracy,
        CASE WHEN sum(accepted) > 0 THEN round(avg(precision), 6) END AS selective_macro_precision, CASE WHEN sum(accepted) > 0 THEN round(avg(recall), 6) END AS selective_macro_recall, CASE WHEN sum(accepted) > 0 THEN round(avg(f1), 6) END AS selective_macro_f1,
        CAST(sum(accepted) - sum(tp) AS BIGINT) AS accepted_errors, ((SELECT count(*) FROM p WHERE NOT correct) - (sum(accepted) - sum(tp))) / nullif((SELECT count(*) FROM p WHERE NOT correct), 0) AS error_rejection_rate,
        ((SELECT count(*) FROM p WHERE correct) - sum(tp)) / nullif((SELECT count(*) FROM p WHERE correct), 0) AS correct_rejection_rate, count(*) FILTER (accepted = 0) AS classes_without_support,
        coalesce(sum(tp) / nullif(sum(accepted), 0) >= 0.99, false) AND sum(accepted) / sum(total) >= 0.9 AND count(*) FILTER (accepted = 0) = 0 AND min(coalesce(coverage, -1)) >= 0.8 AND min(accepted) >= 15 AS passes FROM kc GROUP BY threshold)"""


@_query(f"WITH {_SWEEP} SELECT * FROM s")
def threshold_sweep(spark, d):
    return evaluation.threshold_sweep(b.predictions(spark, d), b.class_dim(spark))


@_query(f"WITH {_SWEEP} SELECT threshold, class_index, total, accepted, coverage, accuracy, precision, recall, f1, tp FROM kc")
def threshold_classes(spark, d):
    return evaluation.threshold_classes(b.predictions(spark, d), b.class_dim(spark))


@_query(f"WITH {_SWEEP} SELECT threshold, coverage, selective_accuracy FROM s WHERE passes ORDER BY coverage DESC, coalesce(selective_macro_f1, -1) DESC, threshold LIMIT 1")
def threshold_selected(spark, d):
    return evaluation.selected(evaluation.threshold_sweep(b.predictions(spark, d), b.class_dim(spark))).select("threshold", "coverage", "selective_accuracy")


@_query(
    f"""WITH {_SWEEP} SELECT threshold, coverage, selective_accuracy, selective_macro_f1 FROM s x WHERE selective_accuracy IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.selective_accuracy IS NOT NULL
    AND o.coverage >= x.coverage AND o.selective_accuracy >= x.selective_accuracy AND (o.coverage > x.coverage OR o.selective_accuracy > x.selective_accuracy))"""
)
def pareto_frontier(spark, d):
    return evaluation.pareto(evaluation.threshold_sweep(b.predictions(spark, d), b.class_dim(spark)))


_BINS = f"""p AS {_P}, n AS (SELECT *, (SELECT count(*) FROM range(1, 10) e(x) WHERE maximum_probability > x / 10.0::DOUBLE) AS bin FROM p),
    r AS (SELECT CAST(x AS INTEGER) AS bin, count(n.path) AS count, round(avg(maximum_probability), 9) AS avg_confidence, avg(CAST(correct AS INTEGER)) AS avg_accuracy FROM range(0, 10) e(x) LEFT JOIN n ON n.bin = x GROUP BY x),
    z AS (SELECT *, round(abs(avg_confidence - avg_accuracy), 9) AS gap FROM r)"""


@_query(f"WITH {_BINS} SELECT * FROM z")
def reliability_bins(spark, d):
    return evaluation.reliability(b.predictions(spark, d))


@_query(f"WITH {_BINS} SELECT round(sum(count * gap) / sum(count), 6) AS ece, round(max(gap), 6) AS mce, (SELECT round(avg((maximum_probability - CAST(correct AS INTEGER)) ** 2), 6) FROM p) AS brier FROM z")
def calibration_summary(spark, d):
    return evaluation.calibration(b.predictions(spark, d))


@_query(f"SELECT correct, count(*) AS count, round(avg(maximum_probability), 9) AS mean, min(maximum_probability) AS min, max(maximum_probability) AS max, median(maximum_probability) AS median FROM {_P} GROUP BY correct")
def confidence_distribution(spark, d):
    return evaluation.confidence_distribution(b.predictions(spark, d))


@_query(f"""SELECT t.class_name || ' -> ' || q.class_name AS pair, count(*) AS count FROM {_P} p JOIN {b.CLASSES} t ON t.class_index = true_class_index JOIN {b.CLASSES} q ON q.class_index = predicted_class_index WHERE NOT correct GROUP BY pair""")
def error_pairs(spark, d):
    return evaluation.error_pairs(b.predictions(spark, d), b.class_dim(spark))


@_query(
    f"""WITH p AS {_P} SELECT * FROM (SELECT 'lowest_correct' AS kind, path, true_class_index, predicted_class_index, maximum_probability, group_key FROM p WHERE correct ORDER BY maximum_probability, path LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'highest_wrong', path, true_class_index, predicted_class_index, maximum_probability, group_key FROM p WHERE NOT correct ORDER BY maximum_probability DESC, path LIMIT 10)"""
)
def extreme_errors(spark, d):
    return evaluation.extremes(b.predictions(spark, d))


@_query(f"SELECT group_key, count(*) AS errors FROM {_P} WHERE NOT correct GROUP BY group_key HAVING count(*) > 1")
def group_error_concentration(spark, d):
    return evaluation.error_groups(b.predictions(spark, d))


@_query(f"""SELECT similarity_guard_group, count(*) FILTER (correct) AS "right", count(*) FILTER (NOT correct) AS wrong FROM {_P} WHERE similarity_guard_group <> '' GROUP BY similarity_guard_group HAVING bool_or(correct) AND NOT bool_and(correct)""")
def guard_inconsistency(spark, d):
    return evaluation.inconsistent_guards(b.predictions(spark, d))


@_query(f"SELECT maximum_probability >= 0.53 AS accepted, correct, count(*) AS n FROM {_P} GROUP BY ALL")
def accepted_by_correct(spark, d):
    return evaluation.accepted_correct(b.predictions(spark, d), 0.53)


@_query(
    """WITH e AS (SELECT c_nationkey AS run, c_custkey AS epoch, (c_custkey * 7 % 13) / 13.0::DOUBLE AS f1, (c_custkey % 5) / 5.0::DOUBLE AS loss FROM customer),
    x AS (SELECT run, epoch, (SELECT y.epoch FROM e y WHERE y.run = e.run AND y.epoch <= e.epoch ORDER BY y.f1 DESC, y.loss, y.epoch LIMIT 1) AS best_epoch FROM e) SELECT *, epoch - best_epoch AS waited FROM x"""
)
def best_epoch(spark, d):
    k = F.col("c_custkey")
    epochs = b.table(spark, d, "customer").select(F.col("c_nationkey").alias("run"), k.alias("epoch"), (k * 7 % 13 / F.lit(13.0)).alias("f1"), (k % 5 / F.lit(5.0)).alias("loss"))
    return evaluation.best_epoch(epochs)


@_query(
    """WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, len(embedding))) AS index FROM embeddings),
    m AS (SELECT *, max(x) OVER (PARTITION BY vec_id) AS top FROM e), s AS (SELECT *, sum(exp(x - top)) OVER (PARTITION BY vec_id) AS total, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, index) AS place FROM m)
    SELECT vec_id, CAST(index AS INTEGER) AS index, round(exp(x - top) / total, 6) AS probability FROM s WHERE place <= 3"""
)
def top_k_predictions(spark, d):
    """Softmax of all dimensions and its three greatest places, for every vector."""
    probs = scalars.softmax(F.col("embedding").cast("array<double>"))
    return b.table(spark, d, "embeddings").select("vec_id", probs.alias("p")).select("vec_id", F.explode(scalars.top_k(F.col("p"), 3)).alias("t")).select("vec_id", "t.index", F.round("t.value", 6).alias("probability"))


def _bootstrap_sql(unit: str) -> str:
    cuts = " + ".join(f"CAST(h >= {c} AS BIGINT)" for c in evaluation.poisson_cuts())
    low = "4294967295"
    a, m, z = (f"CAST({x} AS UBIGINT)" for x in evaluation.MIX)
    return f"""WITH p AS {_P}, u AS (SELECT CAST('0x' || substr(md5(CAST({unit} AS VARCHAR)), 1, 8) AS UBIGINT) AS unit, true_class_index AS t, predicted_class_index AS q, count(*) AS n,
        count(*) FILTER (maximum_probability >= 0.53) AS acc FROM p GROUP BY ALL),
    h0 AS (SELECT t, q, n, acc, draw, ((unit * {a} & {low}) + (CAST(draw AS UBIGINT) * {m} & {low}) + 42) & {low} AS h FROM u, range(1, 2001) r(draw)),
    h1 AS (SELECT * REPLACE (xor(h, h >> 15) * {m} & {low} AS h) FROM h0), h2 AS (SELECT * REPLACE (xor(h, h >> 13) * {z} & {low} AS h) FROM h1), h3 AS (SELECT * REPLACE (xor(h, h >> 16) AS h) FROM h2),
    c AS (SELECT draw, t, q, CAST(sum(n * ({cuts})) AS BIGINT) AS n, CAST(sum(acc * ({cuts})) AS BIGINT) AS acc FROM h3 GROUP BY ALL),
    f AS (SELECT draw, sum(f1) / (SELECT count(*) FROM {b.CLASSES}) AS raw_macro_f1 FROM (SELECT draw, k, coalesce(2.0::DOUBLE * sum(tp) / nullif(sum(n), 0), 0) AS f1
        FROM (SELECT draw, t AS k, n, CASE WHEN t = q THEN n ELSE 0 END AS tp FROM c UNION ALL SELECT draw, q, n, 0 FROM c) GROUP BY draw, k) GROUP BY draw),
    g AS (SELECT draw, sum(n) FILTER (t = q) / sum(n) AS raw_accuracy, sum(acc) FILTER (t = q) / sum(acc) AS thresholded_selective_accuracy, sum(acc) / sum(n) AS thresholded_coverage FROM c GROUP BY draw),
    l AS (UNPIVOT (SELECT * EXCLUDE (draw) FROM g JOIN f USING (draw)) ON COLUMNS(*) INTO NAME metric VALUE value)
    SELECT metric, round(avg(value), 9) AS mean_of_resamples, round(quantile_cont(value, 0.025), 9) AS ci_lower_95, round(quantile_cont(value, 0.975), 9) AS ci_upper_95 FROM l GROUP BY metric"""


@_query(_bootstrap_sql("group_key"))
def bootstrap_ci(spark, d):
    return evaluation.bootstrap(b.predictions(spark, d), 0.53, classes=b.class_dim(spark))


@_query(_bootstrap_sql("path"))
def bootstrap_ci_rows(spark, d):
    return evaluation.bootstrap(b.predictions(spark, d), 0.53, by_group=False, classes=b.class_dim(spark))


# --------------------------------------------------------------------------- set operations, checks, labels


@_query(
    f"""WITH s AS (SELECT group_key AS value, ['train', 'val', 'test'][doc_id % 3 + 1] AS split FROM {b.IMAGES}), d AS (SELECT DISTINCT * FROM s)
    SELECT x.split || '_' || y.split AS pair, x.value FROM d x JOIN d y ON x.value = y.value AND list_position(['train', 'val', 'test'], x.split) < list_position(['train', 'val', 'test'], y.split)"""
)
def shared_group_keys(spark, d):
    return splits.shared_values(_split_rows(spark, d), "group_key")


@_query(
    f"""SELECT 'train_val' AS pair, count(*) AS shared FROM (SELECT sha256 FROM {b.IMAGES} WHERE doc_id % 3 = 0 INTERSECT SELECT sha256 FROM {b.IMAGES} WHERE doc_id % 3 = 1)
    UNION ALL SELECT 'train_test', count(*) FROM (SELECT sha256 FROM {b.IMAGES} WHERE doc_id % 3 = 0 INTERSECT SELECT sha256 FROM {b.IMAGES} WHERE doc_id % 3 = 2)
    UNION ALL SELECT 'val_test', count(*) FROM (SELECT sha256 FROM {b.IMAGES} WHERE doc_id % 3 = 1 INTERSECT SELECT sha256 FROM {b.IMAGES} WHERE doc_id % 3 = 2)"""
)
def split_intersections(spark, d):
    return splits.pairwise(_split_rows(spark, d), "sha256")


@_query(
    """SELECT c_custkey AS value, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)
    UNION ALL SELECT DISTINCT user_id, 'unexpected' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)"""
)
def key_differences(spark, d):
    expected, found = b.table(spark, d, "customer").select(F.col("c_custkey").alias("key")), b.table(spark, d, "events").select(F.col("user_id").alias("key"))
    return checks.set_difference(expected, found, "key")


@_query(f"""SELECT c.class_index, c.class_name, count(p.path) AS n FROM {b.CLASSES} c LEFT JOIN (SELECT * FROM {b.PREDICTIONS} WHERE true_class_index <> 4) p ON p.true_class_index = c.class_index GROUP BY ALL""")
def class_counts(spark, d):
    return evaluation.class_weights(b.predictions(spark, d).where("true_class_index <> 4"), b.class_dim(spark)).select("class_index", "class_name", "n")


@_query(
    f"""WITH g AS (SELECT group_key, count(*) AS size, min(session_prefix) AS session_prefix FROM {_GROUPS} WHERE group_key IS NOT NULL AND kind = 'blight' GROUP BY group_key),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_prefix ORDER BY size, group_key) AS r FROM g) WHERE r <= 2),
    rest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY group_key) AS round FROM g ANTI JOIN f USING (group_key)) ORDER BY round, size LIMIT 20)
    SELECT * FROM (SELECT group_key, size, session_prefix, 1 AS pass FROM f UNION ALL SELECT group_key, size, session_prefix, 2 FROM rest) ORDER BY pass, size, group_key LIMIT 20"""
)
def quota_sample(spark, d):
    named = _named(spark, d).where("group_key is not null and kind = 'blight'")
    groups = named.groupBy("group_key").agg(F.count(F.lit(1)).alias("size"), F.min("session_prefix").alias("session_prefix"))
    return lineage.quota_sample(groups, 20)


@_query(
    f"""WITH m AS (SELECT path, CASE WHEN doc_id % 50 = 0 THEN 'zz' ELSE class_name END AS class_name, CASE WHEN doc_id % 60 = 1 THEN '' ELSE sha256 END AS sha256, doc_id % 2 AS class_index FROM {b.IMAGES})
    SELECT 'unique_path' AS "check", CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS violations FROM (SELECT path FROM m GROUP BY path HAVING count(*) > 1) UNION ALL
    SELECT 'class_in_scope', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FROM m WHERE class_name NOT IN ('en', 'de', 'fr', 'es') UNION ALL
    SELECT 'class_index', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FROM m WHERE class_name IN ('en', 'de', 'fr', 'es') AND class_index <> CASE class_name WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END UNION ALL
    SELECT 'sha256_present', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FROM m WHERE sha256 = ''"""
)
def manifest_checks(spark, d):
    k = F.col("doc_id")
    m = b.images(spark, d).select("path", F.when(k % 50 == 0, "zz").otherwise(F.col("class_name")).alias("class_name"), F.when(k % 60 == 1, "").otherwise(F.col("sha256")).alias("sha256"), (k % 2).alias("class_index"))
    return checks.manifest_checks(m, spark.createDataFrame([(0, "en"), (1, "de"), (2, "fr"), (3, "es")], "class_index int, class_name string"))


@_query(
    """WITH g AS (SELECT lang AS class_name, source AS group_key FROM documents GROUP BY ALL), u AS (SELECT 'u' || (c_custkey % 3) AS guard_id, 'src' || (c_custkey % 24) AS group_key FROM customer GROUP BY ALL)
    SELECT 'guard_keys_exist' AS "check", CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS violations FROM u WHERE group_key NOT IN (SELECT group_key FROM g) UNION ALL
    SELECT 'guard_in_one_class', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FROM (SELECT guard_id FROM u JOIN g USING (group_key) GROUP BY guard_id HAVING count(DISTINCT class_name) > 1) UNION ALL
    SELECT 'key_in_one_guard', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FROM (SELECT group_key FROM u GROUP BY group_key HAVING count(DISTINCT guard_id) > 1)"""
)
def guard_checks(spark, d):
    groups = b.table(spark, d, "documents").select(F.col("lang").alias("class_name"), F.col("source").alias("group_key")).distinct()
    k = F.col("c_custkey")
    guards = b.table(spark, d, "customer").select(F.concat(F.lit("u"), k % 3).alias("guard_id"), F.concat(F.lit("src"), k % 24).alias("group_key")).distinct()
    return checks.guard_checks(groups, guards)


@_query(
    f"""WITH p AS (SELECT path FROM {b.IMAGES} WHERE doc_id % 10 <> 1), m AS (SELECT path FROM {b.IMAGES} WHERE doc_id % 10 <> 2)
    SELECT 'unique_prediction' AS "check", CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS violations FROM (SELECT path FROM p GROUP BY path HAVING count(*) > 1)
    UNION ALL SELECT 'prediction_in_manifest', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FROM p ANTI JOIN m USING (path)
    UNION ALL SELECT 'manifest_has_prediction', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FROM m ANTI JOIN p USING (path)"""
)
def prediction_reconciliation(spark, d):
    images = b.images(spark, d)
    return checks.reconciled(images.where("doc_id % 10 <> 1"), images.where("doc_id % 10 <> 2"))


@_query(
    f"""WITH {_CLUSTERS}, m AS (SELECT cluster_id, id % 7 AS group_key, id % 3 AS split FROM c WHERE id % 11 <> 0 UNION ALL SELECT cluster_id, NULL, NULL FROM c WHERE id % 11 = 0)
    SELECT cluster_id, count(DISTINCT group_key) = 1 AND count(group_key) = count(*) AS same_group, count(DISTINCT split) = 1 AND count(split) = count(*) AS same_split FROM m GROUP BY cluster_id"""
)
def cluster_split_consistency(spark, d):
    members = dedup.clusters(b.hashes(spark, d), RADIUS)
    known = F.col("id") % 11 != 0
    return dedup.consistency(members.select("cluster_id", F.when(known, F.col("id") % 7).alias("group_key"), F.when(known, F.col("id") % 3).alias("split")))


@_query(
    f"""SELECT error_code, count(*) AS n, CASE error_code WHEN 'ML_SERVICE_TIMEOUT' THEN 'Custom model timed out' WHEN 'ML_SERVICE_NOT_READY' THEN 'Custom model not ready' ELSE error_code END AS label
    FROM {b.OUTCOMES} WHERE error_code IS NOT NULL GROUP BY ALL"""
)
def display_labels(spark, d):
    codes = b.outcomes(spark, d).where("error_code is not null").groupBy("error_code").agg(F.count(F.lit(1)).alias("n"))
    return codes.withColumn("label", provenance.labelled(F.col("error_code"), {"ML_SERVICE_TIMEOUT": "Custom model timed out", "ML_SERVICE_NOT_READY": "Custom model not ready"}))


_BODY = """(SELECT o_orderkey AS id, o_orderkey % 6 AS k, o_orderkey % 120 AS c, o_orderkey % 7 = 0 AS torn FROM orders)"""


def _bodies(spark, d):
    k = F.col("o_orderkey")
    name = F.get(F.array(*map(F.lit, b.CLASS_NAMES)), (k % 6).cast("int"))
    p = F.format_string('{"class_name":"%s","class_index":%d,"model_confidence":%s,"accepted":%s,"uncertain":%s}', name, k % 6, ((k % 120) / F.lit(100.0)).cast("string"), F.when(k % 120 >= 50, "true").otherwise("false"), F.when(k % 120 >= 50, "false").otherwise("true"))
    body = F.concat(F.lit('{"status":"success","prediction":'), p, F.lit(',"top_predictions":['), p, F.lit('],"confidence_policy":{"label":"model confidence","threshold":0.5,"production_calibrated":false}}'))
    return b.table(spark, d, "orders").select(k.alias("id"), F.when(k % 7 == 0, F.substring(body, 1, 20)).otherwise(body).alias("body"))


def _normalised(bodies):
    return provenance.normalised_upstream(bodies).select("id", "valid", "disease", "modelConfidence", F.size("topPredictions").alias("n_top"))


_UPSTREAM = f"""SELECT id, NOT torn AND c <= 100 AS valid, CASE WHEN NOT torn THEN class_name END AS disease, CASE WHEN NOT torn THEN c / 100.0::DOUBLE END AS "modelConfidence", CASE WHEN NOT torn AND c <= 100 THEN 1 ELSE 0 END AS n_top
    FROM {_BODY} JOIN {b.CLASSES} ON class_index = k"""


@_query(_UPSTREAM)
def upstream_bodies(spark, d):
    return _normalised(_bodies(spark, d))


@_query(_UPSTREAM)
def pulled_bodies(spark, d):
    """The same bodies recorded as pages of 500, which the pull source asks for one by one."""
    bodies, path = _bodies(spark, d), new_path(spark, "recorded")
    page = F.floor(F.col("id") / 500).cast("int")
    last = bodies.agg(F.coalesce(F.max(page), F.lit(-1)).alias("last")).first()["last"]
    lines = bodies.select(F.to_json(F.struct("id", "body")).alias("value"), page.alias("page"))
    spark.range(last + 1).select(F.lit("").alias("value"), F.col("id").cast("int").alias("page")).union(lines).repartition("page").write.partitionBy("page").text(path)
    pulled = pull.pull(spark, f"{path}/page={{page}}/", last + 1)
    line = F.explode(F.split(F.coalesce("body", F.raise_error(F.concat("url", F.lit(": "), "error"))), "\n"))
    rows = pulled.select(line.alias("line")).where("line <> ''").select(F.from_json("line", "id long, body string").alias("x")).select("x.*")
    return _normalised(rows)


# ------------------------------------------------------------------------------------------------- streaming


def _event_stream(spark, d):
    schema = b.table(spark, d, "events").schema  # a glob, as the table may be a file or a folder
    return spark.readStream.schema(schema).parquet(f"{d}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@_query("SELECT user_id, count(*) AS analysis_count FROM events GROUP BY user_id")
def streaming_user_counts(spark, d):
    return counters.settled(counters.user_counts(_event_stream(spark, d)), "user-counts", "analysis_count")


@_query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def streaming_daily_counts(spark, d):
    counts = counters.settled(counters.windowed_counts(_event_stream(spark, d)), "daily-counts", "n")
    return counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
