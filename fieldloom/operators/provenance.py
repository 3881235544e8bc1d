"""Where a result came from, and the constraints that it must meet before it is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import schemas
from fieldloom.functions import text

# Labels and codes of the domain.
FALLBACK_REASONS = {"ML_SERVICE_TIMEOUT": "timeout", "ML_SERVICE_NOT_READY": "service_not_ready", "ML_UPSTREAM_INVALID_RESPONSE": "malformed_upstream"}
INFRASTRUCTURE_CODES = ["ML_SERVICE_UNAVAILABLE", "ML_SERVICE_TIMEOUT", "ML_SERVICE_NOT_READY", "ML_UPSTREAM_INVALID_RESPONSE"]
UPLOAD_STATUS = {"file_too_large": 413, "unsupported_media_type": 415}
EXTENSIONS = [".jpg", ".jpeg", ".png"]
FORMATS = {"image/jpeg": "JPEG", "image/png": "PNG"}
PROVIDER_LABELS = {"gemini": "Gemini Vision", "groq": "Groq Llama 3", "custom-ml": "{product} Custom Model", "combined": "{product} Custom Model + Gemini"}
REASON_LABELS = {
    "service_unavailable": "the custom model service was unavailable",
    "timeout": "the custom model took too long to respond",
    "malformed_upstream": "the custom model returned an unexpected response",
    "service_not_ready": "the custom model was not ready",
    "uncertain_prediction": "the custom model's result was low-confidence",
}
SEVERITY_LABELS = {"critical": "Critical", "high": "High Risk", "medium": "Medium Risk", "low": "Low Risk", "healthy": "Healthy"}
NO_PROVIDER, NO_REASON = "Unknown", "an infrastructure issue"
MAX_DIAGNOSIS, MAX_TEXT = 500, 4000
HTTP_CODES = {413: "IMAGE_TOO_LARGE", 415: "UNSUPPORTED_IMAGE_TYPE", 503: "ML_SERVICE_NOT_READY"}


def class_parts(name: Column) -> tuple[Column, Column, Column]:
    """Crop, condition and whether it is healthy, from an approved class name."""
    condition = F.regexp_replace(name, r"^\S+ ", "")
    known = name.isin(*schemas.CLASS_NAMES)
    only = lambda c: F.when(known, c)
    return only(F.substring_index(name, " ", 1)), only(condition), only(condition == "Healthy")


def persisted_provider(second_opinion: Column, custom_ml: Column) -> Column:
    return F.when(second_opinion, "combined").when(custom_ml, "custom-ml").otherwise("gemini")


def fallback_reason(code: Column) -> Column:
    """Reason for a fallback; anything else than the named codes is an unavailable service, no code no fallback."""
    found = F.lit("service_unavailable")
    for k, v in FALLBACK_REASONS.items():
        found = F.when(code == k, v).otherwise(found)
    return F.when(code.isNotNull(), found)


def provider_metadata(outcomes: DataFrame) -> DataFrame:
    """Provenance of outcomes with columns custom_ml, second_opinion and error_code."""
    fallback = F.col("error_code").isin(*INFRASTRUCTURE_CODES) & F.col("error_code").isNotNull()
    fallback = F.coalesce(fallback, F.lit(False))
    return outcomes.select(
        "id",
        persisted_provider(F.col("second_opinion"), F.col("custom_ml")).alias("persisted_provider"),
        fallback.alias("fallback_used"),
        F.when(fallback, "gemini").alias("fallback_provider"),
        fallback_reason(F.when(fallback, F.col("error_code"))).alias("fallback_reason"),
        F.col("second_opinion").alias("second_opinion_used"),
    )


def labelled(value: Column, labels: dict[str, str]) -> Column:
    """Display label of a value; the value itself where it has none."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(names, value), value)


def metadata_conflicts(metadata: DataFrame) -> DataFrame:
    """Rows of provenance that contradict themselves, one per rule broken."""
    combined, second, used = F.col("persisted_provider") == "combined", F.col("second_opinion_used"), F.col("fallback_used")
    named = F.col("fallback_provider").isNotNull() & F.col("fallback_reason").isNotNull()
    rules = {
        "combined_without_second_opinion": combined & ~second,
        "second_opinion_not_combined": second & ~combined,
        "fallback_without_provider_or_reason": used & ~named,
        "provider_or_reason_without_fallback": ~used & (F.col("fallback_provider").isNotNull() | F.col("fallback_reason").isNotNull()),
    }
    return broken(metadata, rules)


def broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(id, rule)`` for each rule that a row breaks; an unknown truth value breaks no rule."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return df.select("id", F.explode(names).alias("rule"))


def custom_ml_violations(outcomes: DataFrame) -> DataFrame:
    """Constraint violations of model results, one row per rule."""
    name, index, p = F.col("class_name"), F.col("class_index"), F.col("model_confidence")
    want = F.array_position(F.array(*map(F.lit, schemas.CLASS_NAMES)), name) - 1
    rules = {
        "class_name": ~F.coalesce(name.isin(*schemas.CLASS_NAMES), F.lit(False)),
        "class_index": ~F.coalesce(index == want, F.lit(False)),
        "model_confidence": ~F.coalesce(p.between(0, 1), F.lit(False)),
        "accepted_uncertain": F.coalesce(F.col("accepted") == F.col("uncertain"), F.lit(True)),
        "confidence_threshold": ~F.col("confidence_threshold").eqNullSafe(F.lit(schemas.CONFIDENCE_THRESHOLD)),
        "production_calibrated": ~F.col("production_calibrated").eqNullSafe(F.lit(False)),
    }
    return broken(outcomes, rules)


def legacy(outcomes: DataFrame) -> DataFrame:
    """Model results in the older shape: severity from health, confidence in whole percent, a summary text."""
    _, _, healthy = class_parts(F.col("class_name"))
    p = F.col("model_confidence")
    said = F.when(F.col("accepted"), "accepted").otherwise("uncertain")
    summary = F.concat(F.lit("Custom ML model prediction: "), F.col("class_name"), F.lit(" (model confidence "), F.floor(p * 100 + 0.5).cast("string"), F.lit("%, "), said, F.lit(")."))
    return outcomes.select("id", F.col("class_name").alias("diagnosis"), F.when(healthy, "healthy").otherwise("medium").alias("severity"), F.floor(p * 100 + 0.5).alias("confidence"), summary.alias("summary"))


def display_label(value: Column, labels: dict[str, str], default: str | None = None) -> Column:
    """Label of a value, the value itself where it has none, ``default`` where nothing is given."""
    shown = labelled(value, labels)
    return shown if default is None else F.coalesce(F.when(text.given(value).isNotNull(), shown), F.lit(default))


def provider_labels(product: str) -> dict[str, str]:
    """The labels of providers; the own model's bear the product's name."""
    return {k: v.format(product=product) for k, v in PROVIDER_LABELS.items()}


def kept_predictions(predictions: Column, most: int = schemas.MAX_TOP_PREDICTIONS) -> Column:
    """The first entries ``(className, classIndex, modelConfidence)`` that name a class by its own index, with a confidence in [0, 1]."""
    index = lambda n: F.array_position(F.array(*map(F.lit, schemas.CLASS_NAMES)), n) - 1
    fine = lambda p: F.coalesce((p["classIndex"] == index(p["className"])) & p["modelConfidence"].between(0, 1), F.lit(False))
    return F.slice(F.filter(predictions, fine), 1, most)


def persistence_violations(results: DataFrame) -> DataFrame:
    """``(id, rule)`` for each of the rules that a model result breaks before it is kept.

    Columns: id, disease, classIndex, modelConfidence, accepted, uncertain, confidenceThreshold, confidenceLabel,
    productionCalibrated, supportedClass, confidenceMethod, topPredictions, crop, condition, healthy. A null breaks
    the rule of its column.
    """
    name = F.col("disease")
    want = F.array_position(F.array(*map(F.lit, schemas.CLASS_NAMES)), name) - 1
    unless = lambda c: ~F.coalesce(c, F.lit(False))
    crop, condition, healthy = class_parts(name)
    rules = {
        "class_name": unless(name.isin(*schemas.CLASS_NAMES)),
        "class_index": unless(F.col("classIndex") == want),
        "model_confidence": unless(F.col("modelConfidence").between(0, 1)),
        "accepted_uncertain": unless(F.col("accepted") != F.col("uncertain")),
        "confidence_threshold": unless(F.col("confidenceThreshold") == schemas.CONFIDENCE_THRESHOLD),
        "confidence_label": unless(F.col("confidenceLabel") == schemas.CONFIDENCE_LABEL),
        "production_calibrated": unless(~F.col("productionCalibrated")),
        "supported_class": unless(F.col("supportedClass")),
        "confidence_method": unless(F.col("confidenceMethod").isin(*schemas.CONFIDENCE_METHODS)),
        "top_predictions": unless(F.size(kept_predictions(F.col("topPredictions"))) > 0),
        "class_breakdown": unless((F.col("crop") == crop) & (F.col("condition") == condition) & (F.col("healthy") == healthy)),
    }
    return broken(results, rules)


def capped(x: Column, most: int = MAX_TEXT) -> Column:
    """The first ``most`` characters."""
    return F.left(x, F.lit(most))


def secondary_opinions(opinions: DataFrame) -> DataFrame:
    """Second opinions with their texts capped, and the first bound that each breaks (null if none).

    Columns: id, diagnosis, severity, confidence, treatment, prevention, expertAdvice.
    """
    texts = F.col("diagnosis").isNotNull() & F.col("treatment").isNotNull() & F.col("prevention").isNotNull()
    error = (
        F.when(~F.coalesce(F.col("severity").isin(*schemas.SEVERITIES), F.lit(False)), "severity")
        .when(~F.coalesce(F.col("confidence").between(0, 100), F.lit(False)), "confidence")
        .when(~texts, "texts")
    )
    return opinions.select(
        "id", F.lit("gemini").alias("provider"), capped(F.col("diagnosis"), MAX_DIAGNOSIS).alias("diagnosis"), "severity", "confidence",
        capped(F.col("treatment")).alias("treatment"), capped(F.col("prevention")).alias("prevention"), capped(text.given(F.col("expertAdvice"))).alias("expertAdvice"), error.alias("error"),
    )


def agreement_conflicts(metadata: DataFrame) -> DataFrame:
    """The rules of ``metadata_conflicts``, and whether provenance agrees with what is present (has_custom_ml, has_secondary)."""
    implied = F.col("persisted_provider").isin("custom-ml", "combined")
    rules = {
        "provider_disagrees_with_custom_ml": implied != F.col("has_custom_ml"),
        "second_opinion_disagrees_with_presence": F.col("second_opinion_used") != F.col("has_secondary"),
    }
    return metadata_conflicts(metadata).unionByName(broken(metadata, rules))


def route(image: Column, provider: Column, kind: Column, configured: Column) -> Column:
    """Which flow answers a request: the custom model only for crop images where it is configured, then by provider."""
    own = image & (provider != "groq") & (kind == "crop_disease") & (configured == "custom-ml")
    return F.when(F.coalesce(own, F.lit(False)), "custom-ml").when(F.coalesce(image & (provider != "groq"), F.lit(False)), "gemini-vision").when(provider == "groq", "groq").otherwise("gemini-text")


def upload_error(max_bytes: int = 10_485_760, max_pixels: int = 25_000_000) -> Column:
    """The first rule that an upload breaks, null if none; columns as in the uploads table."""
    name, kind = F.col("filename"), F.col("content_type")
    formats = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    size = F.col("width").cast("long") * F.col("height")
    rules = [
        (name.isNull() | (text.strip(name) == ""), "invalid_file"),
        (F.col("n_bytes") == 0, "invalid_file"),
        (F.col("n_bytes") > max_bytes, "file_too_large"),
        (~text.extension(text.safe_filename(name)).isin(*EXTENSIONS), "unsupported_media_type"),
        (~kind.isin(*FORMATS), "unsupported_media_type"),
        (~F.col("decodable"), "malformed_image"),
        (F.col("actual_format") != formats[kind], "mime_mismatch"),
        (F.col("n_frames") > 1, "animated_image_not_supported"),
        ((F.col("width") <= 0) | (F.col("height") <= 0), "malformed_image"),
        (size > max_pixels, "image_too_large"),
    ]
    found = F.lit(None).cast("string")
    for broken_rule, code in reversed(rules):
        found = F.when(broken_rule, code).otherwise(found)
    return found


def upload_status(code: Column) -> Column:
    """HTTP status of an upload error; 200 for none."""
    status = F.lit(400)
    for k, v in UPLOAD_STATUS.items():
        status = F.when(code == k, v).otherwise(status)
    return F.when(code.isNull(), 200).otherwise(status)


def upstream_error(status: Column) -> Column:
    """Error code of an upstream status; null for success."""
    found = F.when(status >= 500, "ML_SERVICE_UNAVAILABLE").otherwise("ML_UPSTREAM_INVALID_RESPONSE")
    for k, v in HTTP_CODES.items():
        found = F.when(status == k, v).otherwise(found)
    return F.when(status != 200, found)


def normalised_upstream(bodies: DataFrame) -> DataFrame:
    """Recorded JSON responses (id, body) as results; ``valid`` says whether every rule holds."""
    b = bodies.select("id", F.from_json("body", schemas.UPSTREAM).alias("b"))
    p = F.col("b.prediction")
    index = lambda n: F.array_position(F.array(*map(F.lit, schemas.CLASS_NAMES)), n) - 1
    fine = lambda x: x["class_name"].isin(*schemas.CLASS_NAMES) & (x["class_index"] == index(x["class_name"])) & x["model_confidence"].between(0, 1)
    top = F.filter(F.coalesce("b.top_predictions", F.array().cast(b.select("b.top_predictions").schema[0].dataType)), lambda x: F.coalesce(fine(x), F.lit(False)))
    top = F.transform(top, lambda x: F.struct((-x["model_confidence"]).alias("o"), x["class_index"].alias("classIndex"), x["class_name"].alias("className"), x["model_confidence"].alias("modelConfidence")))
    top = F.transform(F.slice(F.array_sort(top), 1, schemas.MAX_TOP_PREDICTIONS), lambda x: F.struct(x["className"].alias("className"), x["classIndex"].alias("classIndex"), x["modelConfidence"].alias("modelConfidence")))
    policy = F.col("b.confidence_policy")
    holds = (F.col("b.status") == "success") & fine(p) & (p["accepted"] != p["uncertain"]) & (policy["label"] == schemas.CONFIDENCE_LABEL) & (policy["threshold"] == schemas.CONFIDENCE_THRESHOLD) & (~policy["production_calibrated"])
    crop, condition, healthy = class_parts(p["class_name"])
    return b.select(
        "id", F.coalesce(holds & (F.size(top) > 0), F.lit(False)).alias("valid"), p["class_name"].alias("disease"), p["class_index"].alias("classIndex"), p["model_confidence"].alias("modelConfidence"),
        crop.alias("crop"), condition.alias("condition"), healthy.alias("healthy"), top.alias("topPredictions"), F.slice("b.limitations", 1, schemas.MAX_LIMITATIONS).alias("limitations"),
    )


def string_items(body: Column, path: str, most: int = schemas.MAX_LIMITATIONS) -> Column:
    """The first texts of a JSON array at a path; items of other types are left out, and so is all where there is no array."""
    items = F.try_variant_get(F.try_parse_json(body), path, "array<variant>")
    texts = F.filter(items, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    return F.slice(F.coalesce(F.transform(texts, lambda x: F.variant_get(x, "$", "string")), F.array().cast("array<string>")), 1, most)


def prediction_response(outcomes: DataFrame) -> DataFrame:
    """``(id, response)``: a model result as the nested document that the service answers with."""
    p = F.col("model_confidence")
    message = F.when(F.col("accepted"), F.lit(None).cast("string")).otherwise("The model is not confident about this image.")
    prediction = F.struct("class_name", "class_index", p.alias("model_confidence"), "accepted", "uncertain", message.alias("message"))
    top = F.array(F.struct("class_name", "class_index", p.alias("model_confidence")))
    policy = F.struct(F.lit(schemas.CONFIDENCE_METHODS[0]).alias("method"), F.col("confidence_threshold").alias("threshold"), F.lit(schemas.CONFIDENCE_LABEL).alias("label"), F.col("production_calibrated"))
    return outcomes.select("id", F.struct(F.lit("success").alias("status"), prediction.alias("prediction"), top.alias("top_predictions"), policy.alias("confidence_policy"), F.array().cast("array<string>").alias("limitations")).alias("response"))


def registration_errors(requests: DataFrame, users: DataFrame) -> DataFrame:
    """``(id, error)`` of each registration (id, name, email, password): the first rule it breaks, null if none.

    All three must be given, the password must have six characters, and the email, as it is stored, must be new.
    """
    blank = lambda c: text.given(F.col(c)).isNull()
    email = text.normalised_email(F.col("email"))
    known = users.select(text.normalised_email(F.col("email")).alias("stored"), F.lit(True).alias("taken")).distinct()
    joined = requests.withColumn("stored", email).join(known, "stored", "left")
    error = F.when(blank("name") | blank("email") | blank("password"), "missing_fields").when(F.char_length("password") < 6, "password_too_short").when(F.col("taken"), "email_taken")
    return joined.select("id", error.alias("error"))
