"""Queries for persistence rules, audits of splits and policies, and the smaller projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom import schemas
from fieldloom.functions import scalars, text
from fieldloom.operators import analytics, checks, dedup, evaluation, lineage, provenance, splits
from fieldloom.plans.registry import query
from fieldloom.sources import bindings as b


def _names_sql(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_NAMES = _names_sql(schemas.CLASS_NAMES)

# ----------------------------------------------------------------------------------------------- projections

_NESTED = """(SELECT event_id AS id, user_id AS "userId", event_type AS type, 'q' || (event_id % 9) AS query, event_id % 6 <> 0 AS has_result, event_id % 4 = 0 AS has_ml, value, event_id % 101 AS confidence,
    json_extract_string(props, '$.k') AS "cropName", CASE WHEN event_id % 3 = 0 THEN 'groq' ELSE 'gemini' END AS "aiProvider", ts AS "createdAt" FROM events)"""


def _nested(spark, d):
    """``events`` as whole analysis documents; some lack a result, most lack the nested documents."""
    k = F.col("event_id")
    result = F.struct(F.concat(F.lit("d"), k % 7).alias("diagnosis"), F.when(F.col("value") >= 50, "high").otherwise("low").alias("severity"), (k % 101).alias("confidence"), F.lit("t").alias("treatment"), F.lit("p").alias("prevention"), F.lit(None).cast("string").alias("expertAdvice"))
    index = (k % 6).cast("int")
    ml = F.struct(F.get(F.array(*map(F.lit, schemas.CLASS_NAMES)), index).alias("className"), index.alias("classIndex"), (k % 2 == 0).alias("accepted"))
    return b.table(spark, d, "events").select(
        k.alias("id"), F.col("user_id").alias("userId"), F.col("event_type").alias("type"), F.concat(F.lit("q"), k % 9).alias("query"), F.when(k % 6 != 0, result).alias("result"),
        F.get_json_object("props", "$.k").alias("cropName"), F.when(k % 3 == 0, "groq").otherwise("gemini").alias("aiProvider"), F.when(k % 4 == 0, ml).alias("customMl"),
        F.when(k % 4 == 0, F.struct(F.lit("custom-ml").alias("persistedProvider"), F.lit(False).alias("fallbackUsed"))).alias("providerMetadata"),
        F.when(k % 8 == 0, F.struct(F.lit("gemini").alias("provider"), F.lit("low").alias("severity"))).alias("secondaryOpinion"), F.when(k % 4 == 0, 2).alias("resultVersion"), F.col("ts").alias("createdAt"),
    )


@query(
    f"""SELECT id, type, query, CASE WHEN has_result THEN 'd' || (id % 7) END AS diagnosis, CASE WHEN has_result THEN CASE WHEN value >= 50 THEN 'high' ELSE 'low' END END AS severity, CASE WHEN has_result THEN confidence END AS confidence,
    CASE WHEN has_result THEN 't' END AS treatment, CASE WHEN has_result THEN 'p' END AS prevention, CAST(NULL AS VARCHAR) AS "expertAdvice", "cropName", "aiProvider",
    CASE WHEN has_ml THEN '{{"className":"' || {_NAMES}[id % 6 + 1] || '","classIndex":' || (id % 6) || ',"accepted":' || CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END || '}}' END AS "customMl",
    CASE WHEN has_ml THEN '{{"persistedProvider":"custom-ml","fallbackUsed":false}}' END AS "providerMetadata", CASE WHEN id % 8 = 0 THEN '{{"provider":"gemini","severity":"low"}}' END AS "secondaryOpinion",
    CAST(CASE WHEN has_ml THEN 2 END AS INTEGER) AS "resultVersion", "createdAt" FROM {_NESTED}"""
)
def history_projection(spark, d):
    out = analytics.history_projection(_nested(spark, d))
    return out.select(*[F.to_json(c).alias(c) if c in ("customMl", "providerMetadata", "secondaryOpinion") else c for c in out.columns])


@query(
    """SELECT c_custkey AS id, string_split(c_name, '#')[1] AS first_name, lower(trim(c_name)) || '@x' AS email, c_custkey % 9 AS "analysisCount", coalesce(n, 0) AS analyses
    FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON user_id = c_custkey"""
)
def user_dashboard(spark, d):
    users = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.regexp_replace("c_name", "#", " ").alias("name"), F.concat(text.normalised_email(F.col("c_name")), F.lit("@x")).alias("email"), F.lit("secret").alias("password"), (F.col("c_custkey") % 9).alias("analysisCount"))
    return analytics.with_user(b.analyses(spark, d).select("userId"), users)


@query(
    f"""SELECT "userId", id, type, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "userId" ORDER BY "createdAt" DESC, id DESC) AS rank FROM {b.ANALYSES}) WHERE rank <= 5"""
)
def dashboard_top5(spark, d):
    return analytics.recent(b.analyses(spark, d), 5).select("userId", "id", "type", "rank")


def _label_sql(column: str, labels: dict[str, str], default: str | None = None) -> str:
    quoted = {k: v.replace("'", "''") for k, v in labels.items()}
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in quoted.items())
    shown = f"CASE {column} {cases} ELSE {column} END"
    return f"CASE WHEN {column} IS NULL OR {column} = '' THEN '{default}' ELSE {shown} END" if default else shown


_PROVIDERS = provenance.provider_labels("Fieldloom")
_LABELLED = """(SELECT p_partkey AS id, ['gemini', 'groq', 'custom-ml', 'combined', 'other', '', NULL][p_partkey % 7 + 1] AS provider,
    ['service_unavailable', 'timeout', 'malformed_upstream', 'service_not_ready', 'uncertain_prediction', 'new_reason', '', NULL][p_partkey % 8 + 1] AS reason, ['critical', 'high', 'medium', 'low', 'healthy', 'odd'][p_partkey % 6 + 1] AS severity FROM part)"""


@query(
    f"""SELECT id, {_label_sql("provider", _PROVIDERS, provenance.NO_PROVIDER)} AS provider_label, {_label_sql("reason", provenance.REASON_LABELS, provenance.NO_REASON)} AS reason_label,
    {_label_sql("severity", provenance.SEVERITY_LABELS)} AS severity_label FROM {_LABELLED}"""
)
def status_labels(spark, d):
    k = F.col("p_partkey")
    pick = lambda values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (k % len(values)).cast("int"))
    provider = pick([*_PROVIDERS, "other", "", None])
    reason = pick([*provenance.REASON_LABELS, "new_reason", "", None])
    severity = pick([*provenance.SEVERITY_LABELS, "odd"])
    return b.table(spark, d, "part").select(
        k.alias("id"), provenance.display_label(provider, _PROVIDERS, provenance.NO_PROVIDER).alias("provider_label"),
        provenance.display_label(reason, provenance.REASON_LABELS, provenance.NO_REASON).alias("reason_label"), provenance.display_label(severity, provenance.SEVERITY_LABELS).alias("severity_label"),
    )


@query(
    """SELECT flow, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 THEN 'custom-ml' WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 THEN 'gemini-vision'
    WHEN o_orderkey % 5 = 0 THEN 'groq' ELSE 'gemini-text' END AS flow FROM orders) GROUP BY flow"""
)
def request_routes(spark, d):
    k = F.col("o_orderkey")
    flow = provenance.route(k % 2 == 0, F.when(k % 5 == 0, "groq").otherwise("gemini"), F.when(k % 3 == 0, "crop_disease").otherwise("pest"), F.when(k % 7 == 0, "gemini").otherwise("custom-ml"))
    return b.table(spark, d, "orders").groupBy(flow.alias("flow")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""SELECT p_partkey AS id, left(repeat(p_name, 40), 300) AS error_text, left(repeat(p_name, 600), 4000) AS capped, lower(trim('  ' || p_brand || ' ')) AS email, string_split(p_name, ' ')[1] AS first_name,
    CAST(floor(p_size / 7.0::DOUBLE * 100 + 0.5) AS BIGINT) || '%' AS percent, printf('%.2f%%', p_size / 7.0::DOUBLE * 100) AS percent2, lower(p_name) AS leaf_key, lower(p_name) AS stem,
    'Analyze this soil:' || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'pH: ' || p_size ELSE '' END || CASE WHEN p_size % 3 = 0 THEN chr(10) || 'Notes: ' || p_type ELSE '' END AS soil_query,
    CASE p_partkey % 4 WHEN 0 THEN 'http://localhost:8000' WHEN 1 THEN 'https://ml.example/x' WHEN 2 THEN NULL ELSE 'http://a' END AS url, CASE p_partkey % 4 WHEN 0 THEN 30000.0::DOUBLE WHEN 1 THEN 1000.0::DOUBLE WHEN 2 THEN NULL ELSE 5000.0::DOUBLE END AS timeout,
    strftime(TIMESTAMP '2024-01-31 10:00:00' + to_seconds(CAST(p_partkey AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS stamp, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS half_up,
    sha256('{"a": "' || p_name || '", "b": "' || p_brand || '"}') AS canonical FROM part"""
)
def small_functions(spark, d):
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    pick = lambda *values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (k % 4).cast("int"))
    uuid = F.concat(F.lit("0a1b2c3d-0000-4000-8000-0123456789ab___"), F.upper(name), F.lit(" "))
    stamp = (F.unix_seconds(F.lit("2024-01-31 10:00:00").cast("timestamp")) + k).cast("timestamp")
    return b.table(spark, d, "part").select(
        k.alias("id"), text.error_text(F.repeat(name, F.lit(40))).alias("error_text"), provenance.capped(F.repeat(name, F.lit(600))).alias("capped"), text.normalised_email(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("email"),
        text.first_name(name).alias("first_name"), text.percent(size / 7).alias("percent"), text.percent2(size / 7).alias("percent2"), text.leaf_key(uuid).alias("leaf_key"), text.stem(F.concat(name, F.lit(".JPG"))).alias("stem"),
        text.soil_query(F.when(size % 2 == 0, size), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.when(size % 3 == 0, F.col("p_type"))).alias("soil_query"),
        scalars.service_url(pick("", "https://ml.example/x//", "ftp://a", " http://a/ "), "http://localhost:8000").alias("url"), scalars.timeout_ms(pick(None, "1000", "999", " 5000 "), 30_000).alias("timeout"),
        scalars.iso_utc(stamp).alias("stamp"), scalars.half_up(F.col("p_retailprice")).alias("half_up"), text.canonical_sha256(b=F.col("p_brand"), a=name).alias("canonical"),
    )


@query("""SELECT status, CASE WHEN status = 200 THEN NULL WHEN status = 413 THEN 'IMAGE_TOO_LARGE' WHEN status = 415 THEN 'UNSUPPORTED_IMAGE_TYPE' WHEN status = 503 THEN 'ML_SERVICE_NOT_READY' WHEN status >= 500 THEN 'ML_SERVICE_UNAVAILABLE'
    ELSE 'ML_UPSTREAM_INVALID_RESPONSE' END AS code, count(*) AS n FROM (SELECT CAST([200, 400, 413, 415, 500, 503, 504][p_partkey % 7 + 1] AS INTEGER) AS status FROM part) GROUP BY ALL""")
def upstream_statuses(spark, d):
    status = F.get(F.array(*map(F.lit, [200, 400, 413, 415, 500, 503, 504])), (F.col("p_partkey") % 7).cast("int"))
    rows = b.table(spark, d, "part").select(status.alias("status"))
    return rows.groupBy("status", provenance.upstream_error(F.col("status")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------------------------------------- persistence

_RESULTS = f"""(SELECT o_orderkey AS id, CASE WHEN o_orderkey % 41 = 0 THEN 'Maize Rust' WHEN o_orderkey % 61 = 0 THEN NULL ELSE {_NAMES}[o_orderkey % 6 + 1] END AS disease, CAST(o_orderkey % 6 + CASE WHEN o_orderkey % 43 = 0 THEN 1 ELSE 0 END AS INTEGER) AS class_index,
    CAST(o_orderkey % 6 AS INTEGER) AS want, (o_orderkey % 105) / 100.0::DOUBLE AS p, o_orderkey % 47 <> 0 AS opposite, CASE WHEN o_orderkey % 53 = 0 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS threshold, o_orderkey % 59 = 0 AS calibrated,
    CASE WHEN o_orderkey % 37 = 0 THEN 'confidence' ELSE 'model confidence' END AS label, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderkey % 29 <> 0 END AS supported, o_orderkey % 23 <> 0 AS method, o_orderkey % 19 AS tops, o_orderkey % 17 = 0 AS other_crop FROM orders)"""


def _results(spark, d):
    k = F.col("o_orderkey")
    index = (k % 6).cast("int")
    name = F.get(F.array(*map(F.lit, schemas.CLASS_NAMES)), index)
    p = (k % 105) / F.lit(100.0)
    crop, condition, healthy = provenance.class_parts(name)
    one = lambda n, i, c: F.struct(n.alias("className"), i.cast("int").alias("classIndex"), c.cast("double").alias("modelConfidence"))
    top = F.when(k % 19 == 0, F.array().cast("array<struct<className:string,classIndex:int,modelConfidence:double>>")).when(k % 19 == 1, F.array(one(name, index + 1, F.lit(0.5)), one(name, index, F.lit(1.5)))).otherwise(F.array(one(F.lit("Maize Rust"), index, F.lit(0.1)), one(name, index, F.lit(0.5))))
    return b.table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 41 == 0, "Maize Rust").when(k % 61 == 0, F.lit(None).cast("string")).otherwise(name).alias("disease"), F.when(k % 43 == 0, index + 1).otherwise(index).alias("classIndex"), p.alias("modelConfidence"),
        (p >= 0.5).alias("accepted"), F.when(k % 47 == 0, p >= 0.5).otherwise(p < 0.5).alias("uncertain"), F.when(k % 53 == 0, 0.6).otherwise(0.5).alias("confidenceThreshold"), F.when(k % 37 == 0, "confidence").otherwise("model confidence").alias("confidenceLabel"),
        (k % 59 == 0).alias("productionCalibrated"), F.when(k % 31 == 0, F.lit(None).cast("boolean")).otherwise(k % 29 != 0).alias("supportedClass"), F.when(k % 23 == 0, "entropy").otherwise(schemas.CONFIDENCE_METHODS[0]).alias("confidenceMethod"),
        top.alias("topPredictions"), F.when(k % 17 == 0, "Maize").otherwise(crop).alias("crop"), condition.alias("condition"), healthy.alias("healthy"),
    )


@query(
    f"""WITH r AS {_RESULTS}, known AS (SELECT *, disease IS NOT NULL AND list_contains({_NAMES}, disease) AS fine FROM r)
    SELECT id, 'class_name' AS rule FROM known WHERE NOT fine UNION ALL SELECT id, 'class_index' FROM known WHERE NOT fine OR class_index <> want UNION ALL SELECT id, 'model_confidence' FROM r WHERE p > 1
    UNION ALL SELECT id, 'accepted_uncertain' FROM r WHERE NOT opposite UNION ALL SELECT id, 'confidence_threshold' FROM r WHERE threshold <> 0.5 UNION ALL SELECT id, 'confidence_label' FROM r WHERE label <> 'model confidence'
    UNION ALL SELECT id, 'production_calibrated' FROM r WHERE calibrated UNION ALL SELECT id, 'supported_class' FROM r WHERE NOT coalesce(supported, false) UNION ALL SELECT id, 'confidence_method' FROM r WHERE NOT method
    UNION ALL SELECT id, 'top_predictions' FROM r WHERE tops IN (0, 1) UNION ALL SELECT id, 'class_breakdown' FROM known WHERE NOT fine OR other_crop"""
)
def persistence_violations(spark, d):
    return provenance.persistence_violations(_results(spark, d))


@query(
    """SELECT c_custkey AS id, 'gemini' AS provider, left(repeat(c_name, 40), 500) AS diagnosis, CASE WHEN c_custkey % 5 = 0 THEN 'odd' ELSE 'low' END AS severity, (c_custkey % 110)::DOUBLE AS confidence, left(repeat(c_name, 300), 4000) AS treatment,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'p' END AS prevention, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS "expertAdvice",
    CASE WHEN c_custkey % 5 = 0 THEN 'severity' WHEN c_custkey % 110 > 100 THEN 'confidence' WHEN c_custkey % 7 = 0 THEN 'texts' END AS error FROM customer"""
)
def secondary_opinions(spark, d):
    k, name = F.col("c_custkey"), F.col("c_name")
    return provenance.secondary_opinions(
        b.table(spark, d, "customer").select(
            k.alias("id"), F.repeat(name, F.lit(40)).alias("diagnosis"), F.when(k % 5 == 0, "odd").otherwise("low").alias("severity"), (k % 110).cast("double").alias("confidence"), F.repeat(name, F.lit(300)).alias("treatment"),
            F.when(k % 7 != 0, "p").alias("prevention"), F.when(k % 2 == 0, name).otherwise("").alias("expertAdvice"),
        )
    )


@query(
    """WITH m AS (SELECT o_orderkey AS id, ['combined', 'custom-ml', 'gemini'][o_orderkey % 3 + 1] AS p, o_orderkey % 5 = 0 AS second, o_orderkey % 7 = 0 AS used, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 = 0 OR o_orderkey % 13 = 0 THEN 'gemini' END AS fp,
        CASE WHEN o_orderkey % 7 = 0 THEN 'timeout' END AS fr, o_orderkey % 2 = 0 AS ml, o_orderkey % 10 = 0 AS has_second FROM orders)
    SELECT id, 'combined_without_second_opinion' AS rule FROM m WHERE p = 'combined' AND NOT second UNION ALL SELECT id, 'second_opinion_not_combined' FROM m WHERE second AND p <> 'combined'
    UNION ALL SELECT id, 'fallback_without_provider_or_reason' FROM m WHERE used AND (fp IS NULL OR fr IS NULL) UNION ALL SELECT id, 'provider_or_reason_without_fallback' FROM m WHERE NOT used AND (fp IS NOT NULL OR fr IS NOT NULL)
    UNION ALL SELECT id, 'provider_disagrees_with_custom_ml' FROM m WHERE ml <> (p IN ('custom-ml', 'combined')) UNION ALL SELECT id, 'second_opinion_disagrees_with_presence' FROM m WHERE second <> has_second"""
)
def provenance_agreement(spark, d):
    k = F.col("o_orderkey")
    return provenance.agreement_conflicts(
        b.table(spark, d, "orders").select(
            k.alias("id"), F.get(F.array(*map(F.lit, ["combined", "custom-ml", "gemini"])), (k % 3).cast("int")).alias("persisted_provider"), (k % 5 == 0).alias("second_opinion_used"), (k % 7 == 0).alias("fallback_used"),
            F.when((k % 11 != 0) & (k % 7 == 0) | (k % 13 == 0), "gemini").alias("fallback_provider"), F.when(k % 7 == 0, "timeout").alias("fallback_reason"), (k % 2 == 0).alias("has_custom_ml"), (k % 10 == 0).alias("has_secondary"),
        )
    )


_ITEMS = """(SELECT p_partkey AS id, '{"limitations": [' || array_to_string(list_transform(range(0, p_partkey % 14), lambda i: CASE i % 4 WHEN 0 THEN '"t' || i || '"' WHEN 1 THEN CAST(i AS VARCHAR) WHEN 2 THEN '"u"' ELSE 'null' END), ',') || ']}' AS body FROM part)"""


@query(f"""SELECT id, array_to_string(list_transform(list_filter(CAST(json_extract(body, '$.limitations') AS JSON[]), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$')[:10], ',') AS limitations FROM {_ITEMS}""")
def limitations(spark, d):
    k = F.col("p_partkey")
    item = lambda i: F.when(i % 4 == 0, F.concat(F.lit('"t'), i, F.lit('"'))).when(i % 4 == 1, i.cast("string")).when(i % 4 == 2, '"u"').otherwise("null")
    items = F.when(k % 14 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(k % 14 - 1, F.lit(0))), item))
    body = F.concat(F.lit('{"limitations": ['), F.array_join(items, ","), F.lit("]}"))
    return b.table(spark, d, "part").select(k.alias("id"), F.array_join(provenance.string_items(body, "$.limitations"), ",").alias("limitations"))


@query(
    f"""SELECT id, class_name AS name, class_index AS place, CAST(round(model_confidence * 100) AS BIGINT) AS pct, accepted, uncertain, NOT accepted AS has_message, 1 AS n_top, confidence_threshold AS threshold, production_calibrated AS calibrated FROM {b.OUTCOMES}"""
)
def prediction_responses(spark, d):
    r = provenance.prediction_response(b.outcomes(spark, d))
    p, c = F.col("response.prediction"), F.col("response.confidence_policy")
    return r.select(
        "id", p["class_name"].alias("name"), p["class_index"].alias("place"), F.round(p["model_confidence"] * 100).cast("long").alias("pct"), p["accepted"].alias("accepted"), p["uncertain"].alias("uncertain"), p["message"].isNotNull().alias("has_message"),
        F.size("response.top_predictions").alias("n_top"), c["threshold"].alias("threshold"), c["production_calibrated"].alias("calibrated"),
    )


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'missing_fields' WHEN c_custkey % 5 = 0 THEN 'password_too_short' WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN 'email_taken' END AS error FROM customer"""
)
def registration_errors(spark, d):
    k = F.col("c_custkey")
    requests = b.table(spark, d, "customer").select(k.alias("id"), F.when(k % 7 != 0, F.col("c_name")).otherwise("").alias("name"), F.concat(F.lit(" User"), k, F.lit("@X ")).alias("email"), F.when(k % 5 == 0, "12345").otherwise("123456").alias("password"))
    return provenance.registration_errors(requests, b.table(spark, d, "supplier").select(F.concat(F.lit("user"), "s_suppkey", F.lit("@x")).alias("email")))


# ---------------------------------------------------------------------------------------------- split audits

_MANIFEST = f"""(SELECT path, CASE WHEN doc_id % 50 = 3 THEN 'zz' ELSE class_name END AS class_name, group_key, CASE WHEN k % 2 = 0 THEN 'leaf_id' ELSE 'tomato_filename_group' END AS group_source,
    CASE WHEN doc_id % 97 = 5 THEN group_key WHEN doc_id % 89 = 7 THEN 'other' WHEN k % 5 = 0 THEN 'guard:' || class_name || ':' || (k // 10) ELSE '' END AS similarity_guard_group,
    CASE WHEN doc_id % 60 = 1 THEN '' ELSE sha256 END AS sha256, ['train', 'val', 'test'][CASE WHEN k % 4 = 1 THEN doc_id % 3 ELSE k % 3 END + 1] AS split, doc_id
    FROM (SELECT *, CAST(string_split(group_key, 'src')[-1] AS INTEGER) AS k FROM {b.IMAGES}))"""


def _manifest(spark, d):
    """``documents`` as split manifests with some rows that break each rule."""
    k, i = F.element_at(F.split("group_key", "src"), -1).cast("int"), F.col("doc_id")
    guard = F.when(i % 97 == 5, F.col("group_key")).when(i % 89 == 7, "other").when(k % 5 == 0, F.concat(F.lit("guard:"), F.col("class_name"), F.lit(":"), F.floor(k / 10).cast("string"))).otherwise("")
    split = F.get(F.array(*map(F.lit, splits.SPLITS)), F.when(k % 4 == 1, i % 3).otherwise(k % 3).cast("int"))
    source = F.when(k % 2 == 0, "leaf_id").otherwise("tomato_filename_group")
    return b.images(spark, d).select("path", F.when(i % 50 == 3, "zz").otherwise(F.col("class_name")).alias("class_name"), "group_key", source.alias("group_source"), guard.alias("similarity_guard_group"), F.when(i % 60 == 1, "").otherwise(F.col("sha256")).alias("sha256"), split.alias("split"), "doc_id")


def _guards(spark, d):
    k = F.element_at(F.split("group_key", "src"), -1).cast("int")
    own = b.images(spark, d).select("class_name", "group_key").distinct().where(k % 5 == 0)
    known = own.select(F.concat(F.lit("guard:"), F.col("class_name"), F.lit(":"), F.floor(k / 10).cast("string")).alias("guard_id"), "group_key")
    return known.unionByName(spark.createDataFrame([("guard:gone:0", "xx:::src0"), ("guard:gone:0", "en:::src0")], "guard_id string, group_key string"))


_LANGS = ["en", "de", "fr", "es", "it"]


def _scope(spark):
    return spark.createDataFrame([(c,) for c in _LANGS], "class_name string")


def _check_sql(name: str, rows: str) -> str:
    return f"""SELECT '{name}' AS "check", CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS violations FROM ({rows})"""


_PREVIEW = {
    "sha256_overlap": "SELECT sha256 FROM m GROUP BY sha256 HAVING count(DISTINCT split) > 1",
    "group_key_overlap": "SELECT group_key FROM m GROUP BY group_key HAVING count(DISTINCT split) > 1",
    "guard_overlap": "SELECT g FROM m WHERE g <> '' GROUP BY g HAVING count(DISTINCT split) > 1",
    "group_key_overwritten": "SELECT * FROM m WHERE g <> '' AND g = group_key",
    "inconsistent_guard_tags": "SELECT group_key FROM m WHERE g <> '' GROUP BY group_key HAVING count(DISTINCT g) > 1",
    "class_out_of_scope": f"SELECT * FROM m WHERE class_name NOT IN ({', '.join(f"'{c}'" for c in _LANGS)})",
    "quarantined_present": "SELECT * FROM m WHERE doc_id % 40 = 2",
    "path_missing": "SELECT * FROM m WHERE doc_id % 45 = 4",
    "guard_keys_missing": "SELECT * FROM u WHERE group_key NOT IN (SELECT group_key FROM k)",
    "guard_key_untagged": "SELECT * FROM w WHERE tag IS DISTINCT FROM guard_id",
    "guard_not_in_one_split": "SELECT guard_id FROM w JOIN m USING (group_key) GROUP BY guard_id HAVING count(DISTINCT split) <> 1",
    "active_class_missing": "SELECT c, s FROM scope, sp WHERE (c, s) NOT IN (SELECT class_name, split FROM m)",
    "too_few_images": "SELECT * FROM short WHERE images < min_images",
    "too_few_groups": "SELECT * FROM short WHERE groups < min_groups",
}
_PREVIEW_SQL = f"""WITH m AS (SELECT *, similarity_guard_group AS g FROM {_MANIFEST} WHERE sha256 <> ''), scope AS (SELECT unnest({_names_sql(_LANGS)}) AS c), sp AS (SELECT unnest(['train', 'val', 'test']) AS s),
    u AS (SELECT 'guard:' || class_name || ':' || (k // 10) AS guard_id, group_key FROM (SELECT DISTINCT class_name, group_key, CAST(string_split(group_key, 'src')[-1] AS INTEGER) AS k FROM {b.IMAGES}) WHERE k % 5 = 0
        UNION ALL VALUES ('guard:gone:0', 'xx:::src0'), ('guard:gone:0', 'en:::src0')),
    k AS (SELECT group_key, max(g) AS tag FROM m GROUP BY group_key), w AS (SELECT * FROM u JOIN k USING (group_key) WHERE guard_id NOT IN (SELECT guard_id FROM u WHERE group_key NOT IN (SELECT group_key FROM k))),
    least AS (SELECT c AS class_name, s AS split, CASE WHEN c = 'es' THEN CASE s WHEN 'train' THEN 100 ELSE 20 END ELSE 30 END AS min_images, CASE WHEN c = 'es' THEN CASE s WHEN 'train' THEN 15 ELSE 6 END ELSE 15 END AS min_groups
        FROM scope, sp WHERE c = 'es' OR s <> 'train'),
    n AS (SELECT class_name, split, count(*) AS images, count(DISTINCT group_key) AS groups FROM m GROUP BY ALL), short AS (SELECT class_name, split, min_images, min_groups, coalesce(images, 0) AS images, coalesce(groups, 0) AS groups FROM least LEFT JOIN n USING (class_name, split))
    """


def _preview(spark, d):
    m = _manifest(spark, d)
    i = F.col("doc_id")
    return checks.preview_leakage(m, m.where(i % 45 != 4).select("path"), m.where(i % 40 == 2).select("path"), _guards(spark, d), _scope(spark), checks.minimums(_scope(spark), "es"))


@query(_PREVIEW_SQL + " UNION ALL ".join(_check_sql(k, v) for k, v in _PREVIEW.items()))
def preview_leakage(spark, d):
    return _preview(spark, d)


@query(
    _PREVIEW_SQL + f""", r AS ({" UNION ALL ".join(_check_sql(k, v) for k, v in _PREVIEW.items())}), a AS (SELECT *, "check" NOT IN ('too_few_images', 'too_few_groups') AS blocking FROM r)
    SELECT *, (SELECT count(*) > 0 FROM a WHERE blocking AND status = 'FAIL') AS blocking_failed FROM a"""
)
def split_report(spark, d):
    return checks.recorded(_preview(spark, d), ["too_few_images", "too_few_groups"])


@query(f"SELECT group_source, count(*) AS overlaps FROM (SELECT group_key, min(group_source) AS group_source FROM {_MANIFEST} GROUP BY group_key HAVING count(DISTINCT split) > 1) GROUP BY group_source")
def overlap_sources(spark, d):
    return checks.overlap_sources(_manifest(spark, d))


@query(
    f"""SELECT class_name, count(*) FILTER (group_source = 'leaf_id') AS leaf_id, count(*) FILTER (group_source = 'tomato_filename_group') AS tomato_filename_group
    FROM (SELECT DISTINCT class_name, group_key, group_source FROM {_MANIFEST}) GROUP BY class_name"""
)
def group_source_breakdown(spark, d):
    return lineage.source_breakdown(_manifest(spark, d).select("class_name", "group_key", "group_source").distinct(), ["leaf_id", "tomato_filename_group"])


@query(
    f"""SELECT class_name, count(*) AS n FROM (SELECT class_name, sha256, doc_id FROM {b.IMAGES}) WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    OR sha256 IN (SELECT sha256 FROM {b.IMAGES} GROUP BY sha256 HAVING count(DISTINCT class_name) > 1) GROUP BY class_name"""
)
def quarantine_by_class(spark, d):
    images = b.images(spark, d)
    return lineage.quarantine_counts(lineage.quarantine(images, b.table(spark, d, "labels"), dedup.exact_groups(images).where("cross_class")))


@query(
    """SELECT judgment, count(*) AS n FROM (SELECT coalesce(s_acctbal > 5000, c_acctbal > 5000) AS yes FROM customer FULL JOIN supplier ON c_custkey = s_suppkey), LATERAL (SELECT CASE WHEN yes THEN 'supported' ELSE 'ambiguous' END AS judgment) GROUP BY judgment"""
)
def judgment_histogram(spark, d):
    judged = lambda t, k, v: b.table(spark, d, t).select(F.col(k).alias("group_key"), F.when(F.col(v) > 5000, "supported").otherwise("ambiguous").alias("judgment"))
    return lineage.judgments(judged("customer", "c_custkey", "c_acctbal"), judged("supplier", "s_suppkey", "s_acctbal"))


@query(
    """WITH n AS (SELECT o_orderstatus AS status, count(*) AS total, count(*) FILTER (o_totalprice > 1000) AS matched FROM orders GROUP BY o_orderstatus),
    r AS (SELECT status, total + CASE WHEN status = 'F' THEN 1 ELSE 0 END AS total, matched FROM n WHERE status <> 'P')
    SELECT n.status AS "class", r.total AS recorded_total, r.matched AS recorded_matched, n.total AS recomputed_total, n.matched AS recomputed_matched,
        CASE WHEN r.total = n.total AND r.matched = n.matched THEN 'PASS' ELSE 'FAIL' END AS status FROM n LEFT JOIN r ON n.status = r.status"""
)
def summary_agreement(spark, d):
    found = b.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("class")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_totalprice") > 1000).alias("matched"))
    told = found.where("class <> 'P'").withColumn("total", F.col("total") + F.when(F.col("class") == "F", 1).otherwise(0))
    return checks.summary_agreement(told, found, "class", ["total", "matched"])


@query(
    """SELECT o_orderkey AS id, rule FROM orders, (VALUES ('status'), ('selection_dataset'), ('model_architecture'), ('confidence_method'), ('selected_threshold'), ('test_labels_used'), ('validation_manifest_sha256')) AS v(rule)
    WHERE CASE rule WHEN 'status' THEN o_orderkey % 11 = 0 WHEN 'selection_dataset' THEN o_orderkey % 13 = 0 WHEN 'model_architecture' THEN o_orderkey % 17 = 0 WHEN 'confidence_method' THEN o_orderkey % 19 = 0
        WHEN 'selected_threshold' THEN o_orderkey % 23 = 0 WHEN 'test_labels_used' THEN o_orderkey % 29 = 0 OR o_orderkey % 31 = 0 ELSE o_orderkey % 37 = 0 END"""
)
def frozen_policy_gate(spark, d):
    k = F.col("o_orderkey")
    bad = lambda m, wrong, right: F.when(k % m == 0, wrong).otherwise(right)
    policies = b.table(spark, d, "orders").select(
        k.alias("id"), bad(11, "draft", "approved_for_test_application").alias("status"), bad(13, "test", "validation").alias("selection_dataset"), bad(17, "other", "mobilenet").alias("model_architecture"),
        bad(19, "entropy", schemas.CONFIDENCE_METHODS[0]).alias("confidence_method"), F.when(k % 23 != 0, 0.5).alias("selected_threshold"), F.when(k % 31 != 0, k % 29 == 0).alias("test_labels_used"), bad(37, "0", "f00d").alias("validation_manifest_sha256"),
    )
    return checks.frozen_policy_violations(policies, "f00d", "mobilenet", schemas.CONFIDENCE_METHODS)


@query(
    """WITH a AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey AS id, rule FROM orders LEFT JOIN a ON id = o_orderkey,
        (VALUES ('evaluation_mode'), ('test_output'), ('checkpoint_sha256'), ('manifest_sha256'), ('predictions_sha256'), ('row_count'), ('class_names')) AS v(rule)
    WHERE CASE rule WHEN 'evaluation_mode' THEN o_orderkey % 11 = 0 WHEN 'test_output' THEN o_orderkey % 13 = 0 WHEN 'checkpoint_sha256' THEN o_orderkey % 17 = 0 WHEN 'manifest_sha256' THEN o_orderkey % 19 = 0
        WHEN 'predictions_sha256' THEN n IS NULL OR o_orderkey % 23 = 0 WHEN 'row_count' THEN n IS DISTINCT FROM o_orderkey % 7 + 1 ELSE n IS NULL OR o_orderkey % 29 = 0 END"""
)
def prediction_provenance(spark, d):
    k = F.col("o_orderkey")
    names = F.array(*map(F.lit, schemas.CLASS_NAMES))
    records = b.table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 11 == 0, "test").otherwise("validation").alias("evaluation_mode"), (k % 13 == 0).alias("test_output"), F.when(k % 17 == 0, "x").otherwise("c").alias("checkpoint_sha256"), F.when(k % 19 == 0, "x").otherwise("m").alias("manifest_sha256"),
        F.when(k % 23 == 0, "x").otherwise("p").alias("predictions_sha256"), (k % 7 + 1).alias("row_count"), F.when(k % 29 == 0, F.reverse(names)).otherwise(names).alias("class_names"),
    )
    actual = b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("row_count")).select("id", "row_count", F.lit("p").alias("predictions_sha256"), names.alias("class_names"))
    return checks.prediction_provenance_violations(records, actual, "c", "m")


@query(
    f"""WITH g AS (SELECT class_name, group_key FROM {b.IMAGES} GROUP BY ALL), x AS (SELECT class_name FROM {b.IMAGES} GROUP BY class_name)
    {_check_sql("policies_approved", "SELECT 1 FROM (VALUES ('approved'), ('draft'), (NULL)) AS p(s) WHERE s IS DISTINCT FROM 'approved'")} UNION ALL {_check_sql("classes_in_order", "SELECT class_name FROM x WHERE class_name <> 'en'")}
    UNION ALL {_check_sql("active_known", "SELECT 1 FROM (VALUES ('en'), ('it')) AS a(c) WHERE c NOT IN (SELECT class_name FROM x)")} UNION ALL {_check_sql("active_apart_from_excluded", "SELECT 1 FROM (VALUES ('en'), ('it')) AS a(c) WHERE c = 'en'")}
    UNION ALL {_check_sql("no_cross_class_conflict", f"SELECT sha256 FROM {b.IMAGES} GROUP BY sha256 HAVING count(DISTINCT class_name) > 1")}"""
)
def input_gates(spark, d):
    images = b.images(spark, d)
    classes = images.select("class_name").distinct().withColumn("class_index", F.lit(0)).withColumn("expected_index", F.when(F.col("class_name") == "en", 0).when(F.col("class_name") == "de", 1))
    names = lambda *c: spark.createDataFrame([(x,) for x in c], "class_name string")
    policies = spark.createDataFrame([("a", "approved"), ("b", "draft"), ("c", None)], "name string, status string")
    return checks.input_gates(policies, classes, names("en", "it"), names("en"), dedup.exact_groups(images).where("cross_class"))


@query(
    f"""WITH f AS (SELECT class_name, count(*) AS groups, CAST(sum(n) AS BIGINT) AS images FROM (SELECT class_name, group_key, count(*) AS n FROM {b.IMAGES} GROUP BY ALL) GROUP BY class_name),
    a AS (SELECT * FROM (VALUES ('en', 20, 620), ('de', 20, 129), ('it', 1, 1)) AS v(class_name, groups, images))
    SELECT class_name, CAST(a.groups AS BIGINT) AS recorded_groups, CAST(a.images AS BIGINT) AS recorded_images, f.groups AS recomputed_groups, f.images AS recomputed_images, CASE WHEN a.groups = f.groups AND a.images = f.images THEN 'PASS' ELSE 'FAIL' END AS status
    FROM f FULL JOIN a USING (class_name)"""
)
def approved_counts(spark, d):
    groups = b.images(spark, d).groupBy("class_name", "group_key").agg(F.count(F.lit(1)).alias("images"))
    approved = spark.createDataFrame([("en", 20, 620), ("de", 20, 129), ("it", 1, 1)], "class_name string, groups long, images long")
    return checks.approved_counts(groups, approved)


@query("SELECT count(*) FILTER (coalesce(trim(t), '') = '') AS blank_file, count(*) FILTER (coalesce(trim(l), '') = '') AS blank_leaf, count(*) FILTER (coalesce(trim(t), '') = '' OR coalesce(trim(l), '') = '') AS malformed FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE lang END AS t, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS l FROM documents)")
def blank_rows(spark, d):
    i = F.col("doc_id")
    rows = b.table(spark, d, "documents").select(F.when(i % 9 == 0, "  ").otherwise(F.col("lang")).alias("file"), F.when(i % 7 != 0, F.col("source")).alias("leaf"))
    return checks.blank_rows(rows, ["file", "leaf"])


@query("SELECT * FROM (SELECT o_orderstatus AS status, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS INTEGER) AS place FROM orders) WHERE place <= 20")
def first_examples(spark, d):
    return lineage.examples(b.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("id")), "status", ["id"], 20)


@query(
    """WITH c AS (SELECT o_custkey AS key, count(DISTINCT o_orderpriority) AS n, min(o_orderpriority) AS leaf_id FROM orders GROUP BY o_custkey)
    SELECT c_custkey AS id, c_mktsegment AS class_name, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN leaf_id END AS leaf_id,
        CAST(CASE WHEN n IS NULL THEN 2 WHEN n = 1 THEN 0 ELSE 1 END AS INTEGER) AS part FROM customer LEFT JOIN c ON c_custkey = key"""
)
def recovery_list(spark, d):
    images = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("class_name"), F.col("c_custkey").alias("key"))
    return lineage.recovery_list(lineage.recovery(images, b.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("leaf_id"))))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), k AS (SELECT CAST(u AS BIGINT) AS u, CAST(i AS BIGINT) AS i, cos(pi() * u * (2 * i + 1) / 64.0::DOUBLE) AS c FROM range(0, 8) a(u), range(0, 32) b(i)),
    p AS (SELECT vec_id, i, j, 10 * v[i + 1] * v[j + 33] + (i * 5 + j * 3) % 11 AS x FROM e, range(0, 32) a(i), range(0, 32) b(j)), t AS (SELECT vec_id, u, j, sum(x * c) AS x FROM p JOIN k USING (i) GROUP BY ALL),
    f AS (SELECT vec_id, t.u, k.u AS w, sum(x * c) AS x FROM t JOIN k ON k.i = t.j GROUP BY ALL), m AS (SELECT vec_id, median(x) AS m FROM f GROUP BY vec_id)
    SELECT vec_id AS id, CAST(bit_xor(CASE WHEN x > m THEN CAST(1 AS UBIGINT) << CAST(63 - u * 8 - w AS BIGINT) ELSE CAST(0 AS UBIGINT) END) >> 1 AS BIGINT) AS hash63, bool_or(u = 7 AND w = 7 AND x > m) AS last_bit FROM f JOIN m USING (vec_id) GROUP BY vec_id"""
)
def perceptual_hashes(spark, d):
    v = F.col("embedding").cast("array<double>")
    at = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    row = lambda i: F.transform(at(32), lambda j: 10 * F.get(v, i) * F.get(v, j + 32) + (i * 5 + j * 3) % 11)
    pixels = F.flatten(F.transform(at(32), row))
    hashed = dedup.perceptual_hashes(b.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), pixels.alias("pixels")))
    return hashed.select("id", F.shiftrightunsigned("hash", 1).alias("hash63"), (F.col("hash").bitwiseAND(F.lit(1).cast("long")) == 1).alias("last_bit"))


# ------------------------------------------------------------------------------------------------ evaluation


@query(
    f"""SELECT path, true_class_index, predicted_class_index, maximum_probability, correct, 'o' || l_orderkey AS group_key, CASE WHEN l_linenumber = 1 THEN 'first' ELSE '' END AS similarity_guard_group, maximum_probability >= 0.53 AS accepted
    FROM (SELECT * EXCLUDE (group_key, similarity_guard_group) FROM {b.PREDICTIONS}) JOIN (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS path, l_orderkey, l_linenumber FROM lineitem) USING (path)"""
)
def predictions_enriched(spark, d):
    manifest = b.table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("path"), F.concat(F.lit("o"), "l_orderkey").alias("group_key"), F.when(F.col("l_linenumber") == 1, "first").otherwise("").alias("similarity_guard_group"))
    return evaluation.enriched(b.predictions(spark, d), manifest, 0.53)


@query(f"SELECT class_name, count(p.path) AS errors FROM {b.CLASSES} c LEFT JOIN (SELECT * FROM {b.PREDICTIONS} WHERE NOT correct AND true_class_index <> 3) p ON p.true_class_index = c.class_index GROUP BY class_name")
def class_errors(spark, d):
    return evaluation.class_errors(b.predictions(spark, d).where("true_class_index <> 3"), b.class_dim(spark))


@query("SELECT l_orderkey AS run, sum(l_discount * l_quantity) / sum(l_quantity) AS loss, CAST(sum(l_quantity) AS BIGINT) AS n FROM (SELECT l_orderkey, CAST(l_discount * 128 AS INTEGER) / 128.0::DOUBLE AS l_discount, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem) GROUP BY l_orderkey")
def batch_loss(spark, d):
    batches = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), (F.rint(F.col("l_discount") * 128).cast("int") / F.lit(128.0)).alias("loss"), F.rint("l_quantity").cast("long").alias("n"))
    return evaluation.weighted_loss(batches)


@query(f"SELECT path, maximum_probability, accepted FROM (SELECT *, CASE WHEN group_key % 10 = 0 THEN maximum_probability < 0.6 ELSE maximum_probability >= 0.6 END AS accepted FROM {b.PREDICTIONS}) WHERE (maximum_probability >= 0.6) <> accepted")
def accepted_recomputed(spark, d):
    p = F.col("maximum_probability")
    rows = b.predictions(spark, d).withColumn("accepted", F.when(F.col("group_key") % 10 == 0, p < 0.6).otherwise(p >= 0.6))
    return checks.accepted_column(rows, 0.6).select("path", "maximum_probability", "accepted")


# ---------------------------------------------------------------------------------------- allocated components


def _allocated(spark, d):
    from fieldloom.plans import catalog

    return splits.allocate(catalog._components(spark, d))


def register_allocation(allocated_sql: str, images_sql: str) -> None:
    """The queries over allocated components, whose SQL the catalogue states."""

    @query(
        f"""WITH {allocated_sql}, g AS (SELECT class_name, split, CAST(sum(size) AS BIGINT) AS images FROM a GROUP BY ALL)
        SELECT class_name, split, images, round(images * 100.0::DOUBLE / total, 2) AS pct, round(images * 100.0::DOUBLE / total - CASE split WHEN 'train' THEN 0.7::DOUBLE WHEN 'val' THEN 0.15::DOUBLE ELSE 1 - (0.7::DOUBLE + 0.15::DOUBLE) END * 100, 2) AS deviation_pct FROM g JOIN t USING (class_name)"""
    )
    def allocation_deviation(spark, d):
        return splits.deviation(_allocated(spark, d))

    @query(
        f"""WITH {allocated_sql}, i AS (SELECT path, class_name, group_key, CASE WHEN k % 5 = 0 THEN 'guard:' || class_name || ':' || (k // 10) ELSE group_key END AS component_id FROM (SELECT *, CAST(string_split(group_key, 'src')[-1] AS INTEGER) AS k FROM {images_sql}))
        SELECT path, component_id, split FROM i JOIN a USING (class_name, component_id)"""
    )
    def component_members(spark, d):
        images = b.images(spark, d)
        k = F.element_at(F.split("group_key", "src"), -1).cast("int")
        guards = images.select("class_name", "group_key").distinct().where(k % 5 == 0).select("group_key", F.concat(F.lit("guard:"), "class_name", F.lit(":"), F.floor(k / 10).cast("string")).alias("guard_id"))
        return splits.component_members(_allocated(spark, d), images.select("class_name", "group_key"), guards, images)
