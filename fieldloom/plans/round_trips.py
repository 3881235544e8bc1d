"""Queries that write a table through a sink and read it back through the reader of the same format, and small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import scalars
from fieldloom.operators import checks
from fieldloom.plans.registry import query as _query
from fieldloom.sources import bindings as b
from fieldloom.sources import readers, writers
from fieldloom.staging import new_path

_MANIFEST = f"""(SELECT path, class_name, CAST(doc_id % 8 AS INTEGER) AS class_index, group_key, 'leaf_id' AS group_source, CASE WHEN doc_id % 3 = 0 THEN 'a "quoted", ' || doc_id ELSE '' END AS similarity_guard_group, sha256 FROM {b.IMAGES})"""


def _manifest(spark, d):
    guard = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('a "quoted", '), "doc_id")).otherwise("")
    return b.images(spark, d).select("path", "class_name", (F.col("doc_id") % 8).cast("int").alias("class_index"), "group_key", F.lit("leaf_id").alias("group_source"), guard.alias("similarity_guard_group"), "sha256")


@_query(f"SELECT * FROM {_MANIFEST}")
def manifest_round_trip(spark, d):
    """A manifest as ordered CSV files, read back under its declared schema."""
    path = new_path(spark, "manifest-csv")
    writers.manifest_ranges(_manifest(spark, d), path)
    return readers.manifest(spark, path)


_ROWS = f"(SELECT *, maximum_probability >= 0.6 AS accepted FROM {b.PREDICTIONS})"


@_query(
    f"""SELECT path, true_class_index, predicted_class_index, maximum_probability, accepted, correct, round(1 - maximum_probability, 6) AS rest, CAST(group_key AS VARCHAR) AS group_key, similarity_guard_group
    FROM {_ROWS}"""
)
def predictions_round_trip(spark, d):
    """Predictions as CSV with probabilities as a JSON cell and their acceptance, read back by the typed reader."""
    rows, path = b.predictions(spark, d), new_path(spark, "predictions-csv")
    name = F.get(F.array(*map(F.lit, b.CLASS_NAMES)), F.col("true_class_index")), F.get(F.array(*map(F.lit, b.CLASS_NAMES)), F.col("predicted_class_index"))
    p = F.col("maximum_probability")
    out = rows.select("path", name[0].alias("true_class_name"), "true_class_index", name[1].alias("predicted_class_name"), "predicted_class_index", p, (p >= 0.6).alias("accepted"), F.array(p, F.round(1 - p, 6)).alias("probabilities"), "correct", F.col("group_key").cast("string").alias("group_key"), "similarity_guard_group")
    writers.predictions_csv(out, path)
    back = readers.predictions(spark, path, with_accepted=True)
    return back.select("path", "true_class_index", "predicted_class_index", "maximum_probability", "accepted", "correct", F.get("probabilities", F.lit(1)).alias("rest"), "group_key", "similarity_guard_group")


@_query("SELECT lang AS leaf, count(*) AS n, count(*) FILTER (source = 'src1') AS ones FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def leaf_file_counts(spark, d):
    """Rows of several CSV files as text, counted by the file they came from."""
    path = new_path(spark, "leaf-files")
    rows = b.table(spark, d, "documents").where("lang IS NOT NULL").select("lang", "doc_id", "source")
    rows.write.partitionBy("lang").csv(path, header=True)
    back = readers.text_csv(spark, f"{path}/*/*.csv")
    return back.groupBy(F.regexp_extract("source_file", "lang=([^/]*)/", 1).alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "src1").alias("ones"))


@_query("SELECT user_id, count(*) AS n FROM (SELECT user_id FROM events UNION ALL SELECT user_id FROM events WHERE value > 50) GROUP BY user_id")
def appended_events(spark, d):
    """A table that two inserts have written, the second of some rows again."""
    events, path = b.table(spark, d, "events"), new_path(spark, "appended")
    writers.once(events.select("user_id", "event_id"), path)
    writers.append(events.where("value > 50").select("user_id", "event_id"), path)
    return spark.read.parquet(path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT n_nationkey AS key, '{\"a\":{\"m\":' || n_regionkey || ',\"z\":\"' || n_name || '\"},\"key\":' || n_nationkey || ',\"none\":null}' AS line FROM nation")
def report_lines(spark, d):
    """Reports as JSON lines with sorted keys at every depth, as they stand in the files."""
    path = new_path(spark, "report")
    rows = b.table(spark, d, "nation").select(F.lit(None).cast("string").alias("none"), F.col("n_nationkey").alias("key"), F.struct(F.col("n_name").alias("z"), F.col("n_regionkey").alias("m")).alias("a"))
    writers.report_json(rows, path)
    return spark.read.text(path).select(F.get_json_object("value", "$.key").cast("int").alias("key"), F.col("value").alias("line"))


@_query("SELECT CAST(count(*) AS BIGINT) AS n, sum(r_regionkey) AS total, string_agg(r_name, ',' ORDER BY r_regionkey) AS names FROM region")
def json_config(spark, d):
    """A configuration as one pretty document, read back strictly."""
    path = new_path(spark, "config")
    rows = b.table(spark, d, "region").select(F.struct(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name")).alias("x"))
    writers.pretty_json(rows.agg(F.sort_array(F.collect_list("x")).alias("regions")), path)  # five regions
    back = readers.json_document(spark, path, "regions array<struct<key: bigint, name: string>>")
    keys = F.transform("regions", lambda x: x["key"])
    return back.select(F.size("regions").cast("long").alias("n"), F.aggregate(keys, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_join(F.transform("regions", lambda x: x["name"]), ",").alias("names"))


@_query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS place FROM embeddings WHERE embedding IS NOT NULL")
def argmax_places(spark, d):
    """The class of greatest probability of every vector."""
    return b.table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", scalars.argmax(F.col("embedding")).alias("place"))


@_query(
    """WITH t AS (SELECT o_custkey AS id, list(o_orderstatus ORDER BY o_orderkey) AS s FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)
    SELECT id, array_to_string(s[greatest(len(s) - 2, 1):], '') AS last3, array_to_string(CASE WHEN list_contains(s, 'P') THEN list_filter(s, lambda x: x <> 'P') ELSE list_append(s, 'P') END, '') AS toggled FROM t"""
)
def array_edits(spark, d):
    """The last three order states of each customer, and the states with P switched."""
    orders = b.table(spark, d, "orders").where("o_custkey IS NOT NULL")
    s = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]).alias("s"))  # orders of one customer
    return s.select("id", F.array_join(scalars.last_n(F.col("s"), 3), "").alias("last3"), F.array_join(scalars.toggled(F.col("s"), F.lit("P")), "").alias("toggled"))


@_query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def inverted_map(spark, d):
    """A map from names to keys, turned over."""
    whole = b.table(spark, d, "nation").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))  # one row for each nation
    return whole.select(F.explode(scalars.inverted(F.col("m"))).alias("key", "name"))


@_query(
    """WITH v AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' yes ' WHEN 2 THEN '' WHEN 3 THEN 'off' WHEN 4 THEN '1' END AS f, CASE p_partkey % 4 WHEN 0 THEN p_size || 'abc' WHEN 1 THEN 'x' || p_size WHEN 2 THEN ' -' || p_size ELSE '' END AS n,
        CASE p_partkey % 3 WHEN 0 THEN p_brand || ', ,' || p_type WHEN 1 THEN '["' || p_brand || '"]' ELSE ' , ' END AS l FROM part)
    SELECT id, CASE WHEN trim(coalesce(f, '')) = '' THEN true ELSE lower(trim(f)) IN ('true', '1', 'yes') END AS flag, TRY_CAST(nullif(regexp_extract(n, '^\\s*([+-]?\\d+)', 1), '') AS INTEGER) AS number,
        CASE WHEN l LIKE '[%' THEN json_extract_string(l, '$[0]') ELSE array_to_string(list_filter(list_transform(string_split(l, ','), lambda x: trim(x)), lambda x: x <> ''), '|') END AS items FROM v"""
)
def config_values(spark, d):
    """Tolerant booleans, leading numbers and lists, as settings are read."""
    k = F.col("p_partkey")
    f = F.when(k % 6 == 0, "TRUE").when(k % 6 == 1, " yes ").when(k % 6 == 2, "").when(k % 6 == 3, "off").when(k % 6 == 4, "1")
    size = F.col("p_size").cast("string")
    n = F.when(k % 4 == 0, F.concat(size, F.lit("abc"))).when(k % 4 == 1, F.concat(F.lit("x"), size)).when(k % 4 == 2, F.concat(F.lit(" -"), size)).otherwise("")
    items = F.when(k % 3 == 0, F.concat("p_brand", F.lit(", ,"), "p_type")).when(k % 3 == 1, F.concat(F.lit('["'), "p_brand", F.lit('"]'))).otherwise(" , ")
    return b.table(spark, d, "part").select(k.alias("id"), scalars.flag(f, True).alias("flag"), scalars.leading_int(n).alias("number"), F.array_join(scalars.listed(items), "|").alias("items"))


@_query(
    """SELECT lang AS name, CAST(sum(strlen(coalesce(source, '')) + 1) AS BIGINT) AS size_bytes, sha256(string_agg(coalesce(source, '') || chr(10), '' ORDER BY doc_id)) AS sha256, false AS utf8_bom_present, 'utf-8' AS encoding
    FROM documents WHERE lang IS NOT NULL GROUP BY lang"""
)
def text_inventory(spark, d):
    """Bytes, hash, byte order mark and encoding of text files, one for each language."""
    path = new_path(spark, "texts")
    rows = b.table(spark, d, "documents").where("lang IS NOT NULL").select("lang", "doc_id", F.coalesce("source", F.lit("")).alias("value"))
    rows.repartition("lang").sortWithinPartitions("lang", "doc_id").drop("doc_id").write.partitionBy("lang").text(path)
    found = checks.inventory(readers.binaries(spark, path, "*.txt"))
    return found.select(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("name"), "size_bytes", "sha256", "utf8_bom_present", "encoding")
