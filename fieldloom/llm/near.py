"""Near-duplicate groups of the pipeline: SimHash links by pigeonring, and the exact Jaccard join for what they miss.

Fingerprints link first; sets of one component of theirs are never compared again. The rest is found by signature trees
(``fieldloom.llm.jaccard``), which lose no pair of a similarity of 0.8 or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.jaccard import bucket_loads, classes_of, describe, merge_near, prefix, row_key, shingle_set, texts_of  # noqa: F401
from fieldloom.llm.simhash import fingerprint_of, near_links, shingle_hashes
from fieldloom.operators.graph import connected_components
from fieldloom.staging import long_rows, release, stage


def _fingerprint_components(rows: DataFrame, tau: int) -> DataFrame:
    """Staged ``(fp, first, component)`` of all fingerprints; equal sets whose fingerprints differ are linked besides."""
    reps = stage(rows.groupBy("fp").agg(F.min(F.struct("doc", "sig")).alias("first")), "representatives")
    sets = stage(rows.groupBy("sid").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most").select("sid", "least"), "equal-sets")
    known = rows.select("sid", "fp").join(sets, "sid").select(F.col("fp").alias("src"), F.col("least").alias("dst")).where("src <> dst").distinct()
    found = connected_components(near_links(reps, tau).unionByName(known)).withColumnRenamed("node", "fp")
    out = stage(reps.join(found, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "grouped")
    release(reps)
    release(sets)
    return out


def keep_one(docs: DataFrame, tau: int = 4, width: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component.

    Linked are documents whose SimHash fingerprints differ in ``tau`` bits or fewer, and documents whose sets of
    ``width``-word shingles have a Jaccard similarity of 0.8 or more. The one with the smallest doc_id stays (nulls
    last), then the smallest hash of its text. Rows are told apart by id and text; of repeated rows one stays.
    """
    texts = texts_of(docs)
    loads = bucket_loads(texts, width)
    with long_rows(docs.sparkSession):
        rows = stage(describe(texts, loads, width, extra=lambda t: fingerprint_of(shingle_hashes(t, width))), "described")
    reps = _fingerprint_components(rows, tau)
    classes = stage(classes_of(rows).join(reps.select("fp", "component"), "fp").drop("fp").withColumn("began", F.col("component")), "classes")
    merged = merge_near(rows, classes, texts, width)
    became = stage(merged.where("began <> component").select(F.col("began").alias("component"), F.col("component").alias("to")).distinct(), "became")
    last = reps.join(became, "component", "left").groupBy(F.coalesce("to", "component").alias("component")).agg(F.min("first").alias("first"))
    stay = stage(last.select("first.doc", "first.sig"), "kept")
    repeated = not rows.groupBy("doc", "sig").count().where("count > 1").isEmpty()
    for t in (rows, reps, merged, became):
        release(t)
    keyed = docs.select(F.struct("*").alias("row"), *row_key())
    kept = keyed.join(stay, ["doc", "sig"], "left_semi")
    return (kept.dropDuplicates(["doc", "sig"]) if repeated else kept).select("row.*")
