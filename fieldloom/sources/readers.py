"""Readers: declared schemas, strict headers, bounded binaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom import schemas


class HeaderMismatch(ValueError):
    """A CSV header that isn't the declared one."""


def _check_header(spark: SparkSession, path: str, want: list[str]) -> None:
    found = spark.read.csv(path, header=True).columns
    if found != want:
        raise HeaderMismatch(f"{path}: header {found}; {want} is declared")


def strict_csv(spark: SparkSession, path: str, schema: T.StructType, allow_empty: bool = False) -> DataFrame:
    """A CSV whose header equals the schema's names; a malformed row fails the read, and so does a
    table without rows. Empty text cells are empty texts."""
    _check_header(spark, path, schema.names)
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST", escape='"').na.fill("")
    if not allow_empty and df.isEmpty():
        raise ValueError(f"{path}: no rows")
    return df


def text_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSVs with every column as text, and the file each row came from."""
    return spark.read.csv(paths, header=True).withColumn("source_file", F.input_file_name())


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A split's manifest."""
    return strict_csv(spark, path, schemas.MANIFEST)


def predictions(spark: SparkSession, path: str, with_accepted: bool = False) -> DataFrame:
    """Predictions with booleans from the tokens true, True and 1, and the probabilities' JSON cell as an array."""
    fields = list(schemas.PREDICTIONS.fields)
    if with_accepted:
        fields.insert(6, T.StructField("accepted", T.StringType()))
    df = strict_csv(spark, path, T.StructType(fields))
    flag = lambda c: F.col(c).isin("True", "true", "1")
    df = df.withColumn("correct", flag("correct")).withColumn("probabilities", F.from_json("probabilities", "array<double>"))
    return df.withColumn("accepted", flag("accepted")) if with_accepted else df


def json_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON document that spans lines; ``schema`` makes the read strict."""
    reader = spark.read.option("multiLine", True)
    return reader.schema(schema).option("mode", "FAILFAST").json(path) if schema else reader.json(path)


def binaries(spark: SparkSession, path: str, glob: str = "*", most: int | None = None) -> DataFrame:
    """Files below a folder: path, class folder, length, SHA-256 and content. The length bound prunes before reading."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    if most is not None:
        files = files.where(F.col("length") <= most)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("class_folder"), "length", F.sha2("content", 256).alias("sha256"), "content")


def by_user(analyses: DataFrame, user_id) -> DataFrame:
    """One user's analyses; the equality reaches the Parquet scan."""
    return analyses.where(F.col("userId") == F.lit(user_id))


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The row with a unique key."""
    return df.where(F.col(key) == F.lit(value)).limit(1)
