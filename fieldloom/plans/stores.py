"""Queries over what the library stores: laid-out tables, stored counters, committed report sets, pulled bodies."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions import sql, text
from fieldloom.operators import analytics, resampling
from fieldloom.plans.registry import query as _query
from fieldloom.sources import bindings as b
from fieldloom.sources import digests, layout, numbered
from fieldloom.staging import new_path
from fieldloom.streaming import stored

# ---------------------------------------------------------------------------------------------------- lookups


def _laid_out(spark, d):
    """Analyses clustered by user, with Bloom filters on their id."""
    path = new_path(spark, "analyses")
    layout.lay_out(b.analyses(spark, d), path, "userId", ["createdAt", "id"], points=["id"], files=16)
    return path


@_query(f"""SELECT id, type, severity, confidence, "cropName", "createdAt" FROM {b.ANALYSES} WHERE "userId" = 7 ORDER BY "createdAt" DESC, id DESC LIMIT 20""")
def indexed_history_page(spark, d):
    """A user's newest page out of a table laid out for it."""
    return analytics.history_page(layout.lookup(spark, _laid_out(spark, d), "userId", 7), 7)


@_query(f"""SELECT "userId", count(*) AS total, max("createdAt") AS last_at FROM {b.ANALYSES} WHERE "userId" IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY "userId" """)
def indexed_user_totals(spark, d):
    """The totals of the users of one nation: a batch of keys against the laid-out table."""
    users = b.table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("userId"))
    found = layout.batch_lookup(spark, _laid_out(spark, d), "userId", users)
    return found.groupBy("userId").agg(F.count(F.lit(1)).alias("total"), F.max("createdAt").alias("last_at"))


@_query(f"""SELECT id, "userId", type, severity FROM {b.ANALYSES} WHERE id IN (SELECT max(event_id) FROM events UNION ALL SELECT min(event_id) FROM events)""")
def indexed_points(spark, d):
    """The first and the last analysis by their unique id, which the table isn't clustered by."""
    ends = b.table(spark, d, "events").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).select(F.explode(F.array("a", "b")).alias("id"))
    return layout.batch_lookup(spark, _laid_out(spark, d), "id", ends).select("id", "userId", "type", "severity")


# --------------------------------------------------------------------------------------------- stored counters


def _event_files(spark, d, files: int = 6):
    """``events`` as a folder of files, which a stream takes two at a time."""
    path = new_path(spark, "event-files")
    b.table(spark, d, "events").repartitionByRange(files, "event_id").write.parquet(path)
    return spark.readStream.schema(b.table(spark, d, "events").schema).option("maxFilesPerTrigger", 2).parquet(path)


@_query("SELECT user_id, count(*) AS value FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def stored_analysis_counts(spark, d):
    """Each user's stored count after a stream of analyses has incremented it batch by batch; every batch is given twice."""
    store = stored.Counters(spark, new_path(spark, "counters"), "user_id", buckets=16)
    log, events = new_path(spark, "counters-log"), _event_files(spark, d)

    def put(batch, k):
        store.merge(batch, k)
        store.merge(batch, k)

    events.writeStream.foreachBatch(put).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return store.values()


@_query(
    """SELECT o_custkey, CAST(sum(p) AS BIGINT) AS value FROM (SELECT o_custkey, 1 AS p FROM orders UNION ALL
    SELECT o_custkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE o_custkey IS NOT NULL GROUP BY o_custkey"""
)
def stored_customer_points(spark, d):
    """Two sources increment one store: an order is a point, each of its lines as many as its number."""
    store = stored.Counters(spark, new_path(spark, "points"), "o_custkey", buckets=8)
    orders = b.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    store.merge(orders, 0, "orders")
    lines = b.table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    store.merge(lines, 0, "lines", by=F.col("l_linenumber"))
    return store.values()


# ------------------------------------------------------------------------------------------------- resampling


@_query()
def bootstrap_exact(spark, d):
    """Intervals over resamples of exactly as many groups as there are; numpy draws the binomials, so there is no SQL."""
    return resampling.bootstrap(b.predictions(spark, d), 0.53, classes=b.class_dim(spark))


@_query()
def bootstrap_exact_rows(spark, d):
    return resampling.bootstrap(b.predictions(spark, d), 0.53, by_group=False, classes=b.class_dim(spark))


@_query(f"SELECT draw, (SELECT count(DISTINCT group_key) FROM {b.PREDICTIONS}) AS units FROM range(1, 2001) r(draw)")
def bootstrap_exact_units(spark, d):
    """Every resample has as many groups as the table."""
    return resampling.units_drawn(b.predictions(spark, d))


# --------------------------------------------------------------------------------------- numbered validation

_LANGS = "(SELECT lang AS class_name, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS class_index FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))"


@_query(
    f"""WITH m AS (SELECT 'doc/' || CASE WHEN doc_id % 29 = 1 THEN doc_id - 1 ELSE doc_id END AS path, CASE WHEN doc_id % 50 = 3 THEN 'zz' ELSE lang END AS class_name, CASE WHEN doc_id % 41 = 0 THEN 'x' ELSE CAST(class_index + CASE WHEN doc_id % 37 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS class_index, doc_id
        FROM documents JOIN {_LANGS} ON class_name = lang),
    n AS (SELECT *, row_number() OVER (ORDER BY class_name, path, doc_id) AS number FROM m),
    r AS (SELECT number, path, n.class_name, n.class_index, min(number) OVER (PARTITION BY path) < number AS again, l.class_index AS want, n.class_name = (SELECT max(class_name) FROM {_LANGS}) AS excluded,
        path IN (SELECT 'doc/' || doc_id FROM labels) AS there FROM n LEFT JOIN {_LANGS} l USING (class_name)),
    e AS (SELECT *, CASE WHEN again THEN 'duplicate_path' WHEN excluded THEN 'excluded_class' WHEN want IS NULL THEN 'class_out_of_scope' WHEN class_index = 'x' THEN 'index_not_integer'
        WHEN CAST(class_index AS INTEGER) <> want THEN 'index_mismatch' WHEN NOT there THEN 'file_missing' END AS rule FROM r)
    SELECT number, path, rule, CASE rule WHEN 'duplicate_path' THEN path WHEN 'excluded_class' THEN class_name WHEN 'class_out_of_scope' THEN class_name WHEN 'index_not_integer' THEN class_index
        WHEN 'index_mismatch' THEN class_index || ' for ' || want ELSE path END AS detail FROM e WHERE rule IS NOT NULL"""
)
def manifest_row_errors(spark, d):
    """What is wrong with each row of a manifest that was written as several CSV files, by its number over all of them."""
    docs, i, path = b.table(spark, d, "documents"), F.col("doc_id"), new_path(spark, "manifest")
    classes = docs.where("lang IS NOT NULL").groupBy(F.col("lang").alias("class_name")).agg(F.count(F.lit(1)).alias("n"))
    classes = classes.select("class_name", (F.row_number().over(W.orderBy("class_name")) - 1).alias("class_index"))  # a row for each language
    index = F.when(i % 41 == 0, "x").otherwise((F.col("class_index") + F.when(i % 37 == 0, 1).otherwise(0)).cast("string"))
    rows = docs.join(F.broadcast(classes), F.col("lang") == F.col("class_name")).select(
        F.concat(F.lit("doc/"), F.when(i % 29 == 1, i - 1).otherwise(i).cast("string")).alias("path"),
        F.when(i % 50 == 3, "zz").otherwise(F.col("lang")).alias("class_name"),
        index.alias("class_index"),
        "doc_id",
        F.translate(F.substring("text", 1, 60), "\r", "").alias("note"),
    )
    rows.orderBy("class_name", "path", "doc_id").write.csv(path, header=True, emptyValue="", escape='"')
    manifest = numbered.across_files(numbered.parsed(numbered.numbered(spark, path), rows.columns))
    last = classes.agg(F.max("class_name").alias("class_name"))
    files = b.table(spark, d, "labels").select(F.concat(F.lit("doc/"), i.cast("string")).alias("path"))
    return numbered.manifest_errors(manifest, classes, classes.join(last, "class_name", "left_anti"), last, files, ["number"])


# ---------------------------------------------------------------------------------------------- SQL functions

_MARKED = text.SECTION.replace("(?i)", "").replace("'", "''")


def _view(df, name):
    df.createOrReplaceTempView(name)
    return df.sparkSession


@_query(
    rf"""WITH p AS (SELECT id, string_split(regexp_replace(text, '{_MARKED}', chr(1) || '\1' || chr(2), 'gi'), chr(1))[2:] AS parts FROM {b.RESPONSES}),
    e AS (SELECT id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS place FROM p)
    SELECT id, CAST(place AS INTEGER) AS place, upper(split_part(part, chr(2), 1)) AS name, regexp_replace(split_part(part, chr(2), 2), '^\s+|\s+$', '', 'g') AS body FROM e"""
)
def sql_response_sections(spark, d):
    """The sections of every response, asked for in SQL text."""
    sql.register(_view(b.responses(spark, d), "fieldloom_responses"))
    return spark.sql("SELECT id, s.* FROM fieldloom_responses, LATERAL response_sections(text) AS s")


@_query(
    rf"""WITH f AS (SELECT id, kind, regexp_replace(regexp_replace(string_split(path, '/')[-1], '\.(jpg|jpeg)$', '', 'i'), '{text.UUID_PREFIX.removeprefix("(?i)")}', '', 'i') AS s FROM {b.LEAF_FILES}),
    x AS (SELECT id, kind, regexp_extract(s, '{text.HEALTHY_NAME}', 1) AS h1, regexp_extract(s, '{text.BLIGHT_NAME}', 1) AS p, regexp_extract(s, '{text.BLIGHT_NAME}', 2) AS b2, regexp_extract(s, '{text.BLIGHT_NAME}', 6) AS b6 FROM f),
    k AS (SELECT id, CASE WHEN kind = 'healthy' THEN CASE WHEN h1 <> '' THEN 'th::Leaf' || CAST(h1 AS INTEGER) END
        ELSE CASE WHEN p <> '' THEN 'tlb::' || CASE WHEN upper(p) = 'GH_HL' THEN p ELSE upper(p) END || '::Leaf' || CAST(b2 AS INTEGER) END END AS group_key, CASE WHEN kind = 'blight' THEN TRY_CAST(b6 AS INTEGER) END AS day FROM x)
    SELECT group_key, count(*) AS files, count(day) AS dated FROM k GROUP BY group_key"""
)
def sql_leaf_groups(spark, d):
    """How many files each leaf has, by both naming conventions, in SQL text."""
    sql.register(_view(b.leaf_files(spark, d), "fieldloom_files"))
    return spark.sql(
        """SELECT if(kind = 'healthy', h.group_key, g.group_key) AS group_key, count(*) AS files, count(if(kind = 'healthy', NULL, g.day_number)) AS dated
        FROM fieldloom_files, LATERAL healthy_leaf(path) AS h, LATERAL blight_leaf(path) AS g GROUP BY 1"""
    )


# ------------------------------------------------------------------------------------------------ file digests


@_query(
    """SELECT lang || '/' || (doc_id // 250) AS folder, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS length, sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS sha256
    FROM documents WHERE lang IS NOT NULL GROUP BY ALL"""
)
def file_digests(spark, d):
    """Documents written as files of 250 ids and a language each, and the digest of every file's bytes."""
    path, part = new_path(spark, "files"), F.floor(F.col("doc_id") / 250)
    rows = b.table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("value"), "lang", part.alias("part"))
    rows.repartition("lang", "part").sortWithinPartitions("lang", "part", "doc_id").drop("doc_id").write.partitionBy("lang", "part").text(path)
    found = digests.file_digests(spark, path, "*.txt")
    return found.select(F.regexp_replace(F.regexp_extract("path", "lang=([^/]*/part=[^/]*)/", 1), "part=", "").alias("folder"), "length", "sha256")
