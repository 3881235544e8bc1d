"""Declared schemas of the domain tables, and the fixed values that their constraints refer to."""

from __future__ import annotations

from pyspark.sql import types as T

# Class names in index order, enumerations, thresholds and limits of the domain.
CLASS_NAMES = ["Tomato Healthy", "Tomato Early Blight", "Tomato Late Blight", "Potato Healthy", "Potato Early Blight", "Potato Late Blight"]
ANALYSIS_TYPES = ["crop_disease", "pest", "soil", "weather", "waste", "general"]
SEVERITIES = ["critical", "high", "medium", "low", "healthy"]
CONFIDENCE_METHODS = ["maximum_softmax_probability"]
CONFIDENCE_THRESHOLD = 0.5
CONFIDENCE_LABEL = "model confidence"
MAX_TOP_PREDICTIONS = 3
MAX_LIMITATIONS = 10

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TOP_PREDICTION = _struct(className=_S, classIndex=_I, modelConfidence=_D)
RESULT = _struct(diagnosis=_S, severity=_S, confidence=_D, treatment=_S, prevention=_S, expertAdvice=_S, rawResponse=_S)
CUSTOM_ML = _struct(
    className=_S, classIndex=_I, crop=_S, condition=_S, healthy=_B, modelConfidence=_D, accepted=_B, uncertain=_B, confidenceLabel=_S, productionCalibrated=_B, supportedClass=_B,
    confidenceThreshold=_D, confidenceMethod=_S, topPredictions=T.ArrayType(TOP_PREDICTION), model=_struct(architecture=_S, classCount=_I), limitations=T.ArrayType(_S),
)
PROVIDER_METADATA = _struct(primaryProvider=_S, persistedProvider=_S, fallbackUsed=_B, fallbackProvider=_S, fallbackReason=_S, secondaryOpinionUsed=_B)
SECONDARY_OPINION = _struct(provider=_S, diagnosis=_S, severity=_S, confidence=_D, treatment=_S, prevention=_S, expertAdvice=_S)
ANALYSES = _struct(
    id=_S, userId=_S, type=_S, imageUrl=_S, query=_S, aiProvider=_S, result=RESULT, customMl=CUSTOM_ML, providerMetadata=PROVIDER_METADATA, secondaryOpinion=SECONDARY_OPINION,
    resultVersion=_I, cropName=_S, location=_S, weather=_struct(temperature=_D, humidity=_D, rainfall=_D), tags=T.ArrayType(_S), helpful=_B, createdAt=T.TimestampType(), updatedAt=T.TimestampType(),
)
USERS = _struct(
    id=_S, name=_S, email=_S, password=_S, role=_S, location=_struct(state=_S, district=_S, coordinates=_struct(lat=_D, lng=_D)),
    farmDetails=_struct(size=_D, cropTypes=T.ArrayType(_S), soilType=_S, irrigationType=_S), language=_S, analysisCount=T.LongType(), subscription=_S, createdAt=T.TimestampType(),
)
MANIFEST = _struct(path=_S, class_name=_S, class_index=_I, group_key=_S, group_source=_S, similarity_guard_group=_S, sha256=_S)
PREDICTIONS = _struct(path=_S, true_class_name=_S, true_class_index=_I, predicted_class_name=_S, predicted_class_index=_I, maximum_probability=_D, probabilities=_S, correct=_S, group_key=_S, similarity_guard_group=_S)
#: A recorded response of the image model, one JSON document per row.
UPSTREAM = _struct(
    status=_S, prediction=_struct(class_name=_S, class_index=_I, model_confidence=_D, accepted=_B, uncertain=_B, message=_S),
    top_predictions=T.ArrayType(_struct(class_name=_S, class_index=_I, model_confidence=_D)),
    confidence_policy=_struct(method=_S, threshold=_D, label=_S, production_calibrated=_B), limitations=T.ArrayType(_S),
)
