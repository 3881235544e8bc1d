"""Domain views over the driver's test tables, in Spark and, for the oracles, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import scalars
from fieldloom.schemas import CLASS_NAMES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as analysis documents: id, userId, type, createdAt, cropName, severity, confidence, helpful."""
    v = F.col("value")
    severity = F.when(v >= 100, "critical").when(v >= 50, "high").when(v >= 20, "medium").when(v >= 5, "low").otherwise("healthy")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("userId"),
        F.col("event_type").alias("type"),
        F.col("ts").alias("createdAt"),
        F.get_json_object("props", "$.k").alias("cropName"),
        severity.alias("severity"),
        F.pmod("event_id", F.lit(101)).alias("confidence"),
        (F.pmod("event_id", F.lit(5)) == 0).alias("helpful"),
    )


ANALYSES = """(SELECT event_id AS id, user_id AS "userId", event_type AS type, ts AS "createdAt", json_extract_string(props, '$.k') AS "cropName",
    CASE WHEN value >= 100 THEN 'critical' WHEN value >= 50 THEN 'high' WHEN value >= 20 THEN 'medium' WHEN value >= 5 THEN 'low' ELSE 'healthy' END AS severity,
    event_id % 101 AS confidence, event_id % 5 = 0 AS helpful FROM events)"""


def images(spark: SparkSession, sf_dir: str, by: str = "lang") -> DataFrame:
    """``documents`` as images: path, class_name, sha256, group_key."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"),
        F.col(by).alias("class_name"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.concat_ws(":::", "lang", "source").alias("group_key"),
        "doc_id",
    )


IMAGES = """(SELECT 'doc/' || doc_id AS path, lang AS class_name, source, sha256(text) AS sha256, lang || ':::' || source AS group_key, doc_id FROM documents)"""


#: Bits of a copy that differ from the first of its four: none, one, three (at most), or eight (at most).
_FLIPS = {1: [7], 2: [11, 17, 23], 3: [3, 5, 13, 19, 29, 31, 37, 41]}


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as perceptual hashes: of each four, the first has its 64 sign bits, the others near copies of them."""
    v, k = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    first = v.where(k % 4 == 0).select(k.alias("of"), scalars.sign_bits(F.col("embedding").cast("array<double>")).alias("base"))
    rows = v.select(k.alias("id"), F.col("label").alias("class_index"), (k - k % 4).alias("of"), F.when(k % 8 == 0, 0).otherwise(k % 4).alias("kind")).join(first, "of")
    flip = lambda m: F.expr(f"shiftleft(1L, cast(id * {m} % 64 as int))")
    mask = F.lit(0).cast("long")
    for kind, ms in _FLIPS.items():
        own = flip(ms[0])
        for m in ms[1:]:
            own = own.bitwiseXOR(flip(m))
        mask = F.when(F.col("kind") == kind, own).otherwise(mask)
    return rows.select("id", "class_index", F.col("base").bitwiseXOR(mask).alias("hash"))


def _flipped(m: int) -> str:
    return f"(CAST(1 AS UBIGINT) << (id * {m} % 64))"


def _mask_sql(ms: list[int]) -> str:
    out = _flipped(ms[0])
    for m in ms[1:]:
        out = f"xor({out}, {_flipped(m)})"
    return out


HASHES = f"""(SELECT id, class_index, xor(base, CASE kind WHEN 1 THEN {_mask_sql(_FLIPS[1])} WHEN 2 THEN {_mask_sql(_FLIPS[2])} WHEN 3 THEN {_mask_sql(_FLIPS[3])} ELSE CAST(0 AS UBIGINT) END) AS hash
    FROM (SELECT vec_id AS id, label AS class_index, vec_id - vec_id % 4 AS of, CASE WHEN vec_id % 8 = 0 THEN 0 ELSE vec_id % 4 END AS kind FROM embeddings)
    JOIN (SELECT of, bit_xor(CASE WHEN x > 0 THEN CAST(1 AS UBIGINT) << (64 - i) ELSE CAST(0 AS UBIGINT) END) AS base
        FROM (SELECT vec_id AS of, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings WHERE vec_id % 4 = 0) GROUP BY of) USING (of))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as classifier predictions, by closed forms over its integers."""
    t = F.pmod("l_partkey", F.lit(6)).cast("int")
    h = F.pmod(F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7, F.lit(50))
    turn = F.floor(F.col("l_partkey") / 6)
    wrong = ((h < 3) & (F.pmod(turn, F.lit(2)) == 0)) | ((h == 49) & (F.pmod(turn, F.lit(31)) == 0))
    p = F.when(wrong, F.pmod(t + 1, F.lit(6))).otherwise(t).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("path"),
        t.alias("true_class_index"),
        p.alias("predicted_class_index"),
        ((50 + h) / F.lit(100.0)).alias("maximum_probability"),
        (t == p).alias("correct"),
        F.col("l_orderkey").alias("group_key"),
        F.when(F.pmod("l_suppkey", F.lit(10)) == 0, F.concat(F.lit("g"), F.col("l_suppkey"))).otherwise("").alias("similarity_guard_group"),
    )


PREDICTIONS = """(SELECT *, true_class_index = predicted_class_index AS correct FROM (
    SELECT path, true_class_index, CASE WHEN (h < 3 AND turn % 2 = 0) OR (h = 49 AND turn % 31 = 0) THEN (true_class_index + 1) % 6 ELSE true_class_index END AS predicted_class_index,
        (50 + h) / 100.0::DOUBLE AS maximum_probability, group_key, similarity_guard_group
    FROM (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS path, CAST(l_partkey % 6 AS INTEGER) AS true_class_index, l_partkey // 6 AS turn,
        (l_orderkey * 31 + l_linenumber * 7) % 50 AS h, l_orderkey AS group_key, CASE WHEN l_suppkey % 10 = 0 THEN 'g' || l_suppkey ELSE '' END AS similarity_guard_group FROM lineitem)))"""


def class_dim(spark: SparkSession) -> DataFrame:
    """The six classes by index."""
    return spark.createDataFrame(list(enumerate(CLASS_NAMES)), "class_index int, class_name string")


CLASSES = "(SELECT * FROM (VALUES " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(CLASS_NAMES)) + ") AS c(class_index, class_name))"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text responses made from ``part``: some sections missing, some empty."""
    k, name = F.col("p_partkey"), F.col("p_name")
    piece = lambda mod, at, text: F.when(F.pmod(k, F.lit(mod)) == at, F.lit("")).otherwise(text)
    text = F.concat(
        piece(7, 0, F.concat(F.lit("## DIAGNOSIS: "), name, F.lit("\n"))),
        piece(5, 0, F.concat(F.lit("**Severity**: "), F.when(k % 3 == 0, "High risk").when(k % 3 == 1, "low").otherwise("unclear"), F.lit("\n"))),
        piece(4, 0, F.concat(F.lit("Confidence - about "), (k % 100).cast("string"), F.lit("%\n"))),
        piece(3, 0, F.concat(F.lit("1. TREATMENT:\nspray "), F.col("p_brand"), F.lit("\n"))),
        piece(6, 0, F.lit("PREVENTION:\n\n")),
        piece(2, 0, F.concat(F.lit("Expert advice: ask about "), F.col("p_type"), F.lit("\n"))),
    )
    return table(spark, sf_dir, "part").select(k.alias("id"), text.alias("text"))


RESPONSES = r"""(SELECT p_partkey AS id,
    CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '## DIAGNOSIS: ' || p_name || chr(10) END ||
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '**Severity**: ' || CASE p_partkey % 3 WHEN 0 THEN 'High risk' WHEN 1 THEN 'low' ELSE 'unclear' END || chr(10) END ||
    CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'Confidence - about ' || (p_partkey % 100) || '%' || chr(10) END ||
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '1. TREATMENT:' || chr(10) || 'spray ' || p_brand || chr(10) END ||
    CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'PREVENTION:' || chr(10) || chr(10) END ||
    CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'Expert advice: ask about ' || p_type || chr(10) END AS text FROM part)"""


def leaf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names after the two capture conventions, made from ``part``; some follow neither."""
    k = F.col("p_partkey")
    day = F.when(k % 4 == 0, F.concat(F.lit(" Day "), (k % 9).cast("string"))).otherwise("")
    sub = F.when(k % 3 == 0, F.concat(F.lit("."), (k % 5).cast("string"))).otherwise("")
    prefix = F.get(F.array(*map(F.lit, ["GHLB2ES", "ghlb2", "GHLB_PS", "GHLB"])), (k % 4).cast("int"))
    healthy = F.concat(F.lit("GH_HL Leaf "), (k % 50).cast("string"), sub)
    blight = F.concat(prefix, F.lit(" Leaf "), (k % 39).cast("string"), sub, day)
    name = F.when(k % 11 == 0, F.concat(F.lit("IMG_"), k.cast("string"))).when(k % 2 == 0, healthy).otherwise(blight)
    uuid = F.when(k % 5 == 0, "0a1b2c3d-0000-4000-8000-0123456789ab___").otherwise("")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 2 == 0, "healthy").otherwise("blight").alias("kind"), F.concat(F.lit("raw/"), uuid, name, F.lit(".JPG")).alias("path"))


LEAF_FILES = """(SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'healthy' ELSE 'blight' END AS kind,
    'raw/' || CASE WHEN p_partkey % 5 = 0 THEN '0a1b2c3d-0000-4000-8000-0123456789ab___' ELSE '' END ||
    CASE WHEN p_partkey % 11 = 0 THEN 'IMG_' || p_partkey
        WHEN p_partkey % 2 = 0 THEN 'GH_HL Leaf ' || (p_partkey % 50) || sub
        ELSE ['GHLB2ES', 'ghlb2', 'GHLB_PS', 'GHLB'][p_partkey % 4 + 1] || ' Leaf ' || (p_partkey % 39) || sub || CASE WHEN p_partkey % 4 = 0 THEN ' Day ' || (p_partkey % 9) ELSE '' END END || '.JPG' AS path
    FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN '.' || (p_partkey % 5) ELSE '' END AS sub FROM part))"""


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads made from ``orders``: name, content type, bytes, decodable, actual format, frames and size."""
    k = F.col("o_orderkey")
    name = F.when(k % 37 == 0, F.lit(None).cast("string")).when(k % 31 == 0, "  ").when(k % 29 == 0, "leaf.gif").when(k % 7 == 0, "dir/Leaf.PNG").otherwise("leaf.jpg")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"),
        name.alias("filename"),
        F.when(k % 23 == 0, "text/plain").when(k % 7 == 0, "image/png").otherwise("image/jpeg").alias("content_type"),
        F.when(k % 19 == 0, 0).when(k % 17 == 0, 20_000_000).otherwise(k % 5_000_000).cast("long").alias("n_bytes"),
        (k % 13 != 0).alias("decodable"),
        F.when(k % 11 == 0, "WEBP").when(k % 7 == 0, "PNG").otherwise("JPEG").alias("actual_format"),
        F.when(k % 9 == 0, 3).otherwise(1).cast("int").alias("n_frames"),
        (k % 9000).cast("int").alias("width"),
        (k % 7000).cast("int").alias("height"),
    )


UPLOADS = """(SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN '  ' WHEN o_orderkey % 29 = 0 THEN 'leaf.gif' WHEN o_orderkey % 7 = 0 THEN 'dir/Leaf.PNG' ELSE 'leaf.jpg' END AS filename,
    CASE WHEN o_orderkey % 23 = 0 THEN 'text/plain' WHEN o_orderkey % 7 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS content_type,
    CASE WHEN o_orderkey % 19 = 0 THEN 0 WHEN o_orderkey % 17 = 0 THEN 20000000 ELSE o_orderkey % 5000000 END AS n_bytes, o_orderkey % 13 <> 0 AS decodable,
    CASE WHEN o_orderkey % 11 = 0 THEN 'WEBP' WHEN o_orderkey % 7 = 0 THEN 'PNG' ELSE 'JPEG' END AS actual_format,
    CASE WHEN o_orderkey % 9 = 0 THEN 3 ELSE 1 END AS n_frames, o_orderkey % 9000 AS width, o_orderkey % 7000 AS height FROM orders)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model results made from ``orders``: claims about a class that the constraints accept or refuse."""
    k = F.col("o_orderkey")
    index = (k % 6).cast("int")
    confidence = (k % 120) / F.lit(100.0)
    name = F.when(k % 41 == 0, "Maize Rust").otherwise(F.get(F.array(*map(F.lit, CLASS_NAMES)), index))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"),
        name.alias("class_name"),
        F.when(k % 43 == 0, index + 1).otherwise(index).cast("int").alias("class_index"),
        confidence.alias("model_confidence"),
        (confidence >= 0.5).alias("accepted"),
        F.when(k % 47 == 0, confidence >= 0.5).otherwise(confidence < 0.5).alias("uncertain"),
        F.when(k % 53 == 0, 0.6).otherwise(0.5).alias("confidence_threshold"),
        (k % 59 == 0).alias("production_calibrated"),
        (k % 4 == 0).alias("second_opinion"),
        (k % 3 != 0).alias("custom_ml"),
        F.when(k % 5 == 0, F.get(F.array(*map(F.lit, ["ML_SERVICE_TIMEOUT", "ML_SERVICE_NOT_READY", "ML_UPSTREAM_INVALID_RESPONSE", "ML_SERVICE_UNAVAILABLE"])), (k % 4).cast("int"))).alias("error_code"),
    )


OUTCOMES = (
    """(SELECT id, class_name, class_index, confidence AS model_confidence, confidence >= 0.5 AS accepted, CASE WHEN id % 47 = 0 THEN confidence >= 0.5 ELSE confidence < 0.5 END AS uncertain,
    CASE WHEN id % 53 = 0 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS confidence_threshold, id % 59 = 0 AS production_calibrated, id % 4 = 0 AS second_opinion, id % 3 <> 0 AS custom_ml,
    CASE WHEN id % 5 = 0 THEN ['ML_SERVICE_TIMEOUT', 'ML_SERVICE_NOT_READY', 'ML_UPSTREAM_INVALID_RESPONSE', 'ML_SERVICE_UNAVAILABLE'][id % 4 + 1] END AS error_code
    FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 41 = 0 THEN 'Maize Rust' ELSE ["""
    + ", ".join(f"'{c}'" for c in CLASS_NAMES)
    + """][o_orderkey % 6 + 1] END AS class_name, CAST(o_orderkey % 6 + CASE WHEN o_orderkey % 43 = 0 THEN 1 ELSE 0 END AS INTEGER) AS class_index, (o_orderkey % 120) / 100.0::DOUBLE AS confidence FROM orders))"""
)
