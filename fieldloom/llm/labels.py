"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of labelled text that are learned from, at most.
SAMPLE_BYTES = 32 << 20


def id_crc32(doc_id: Column) -> Column:
    """CRC-32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = SAMPLE_BYTES, seed: int = 42, where: Column | None = None) -> DataFrame:
    """``(doc_id, text, y, sig)`` of at most ``most`` labelled rows and ``most_bytes`` of text, first by a seeded hash of the id.

    Both bounds hold after the join. ``most`` labels are chosen and broadcast; the documents are scanned for the keys
    and sizes of their texts, of which ``most`` reach the driver, and scanned again for those that fit. A row too
    large for what is left of the bound is passed over. Documents are never shuffled, but for repeated rows, which
    are one example. ``sig`` is the text's hash, for a total order. Rows with a null id or label are no examples, null texts are empty ones.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    if where is not None:
        known = known.where(where)
    order = F.xxhash64(F.lit(seed), "doc_id")
    chosen = known.distinct().orderBy(order, "doc_id", "y").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("sig"))
    found = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "sig", F.octet_length("text").alias("size"))
    keys = found.groupBy("doc_id", "y", "sig").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    left, fit, repeated = most_bytes, [], False
    for r in keys.orderBy(order, "doc_id", "y", "sig").limit(most).collect():
        if r["size"] <= left:
            left -= r["size"]
            fit.append((r["doc_id"], r["y"], r["sig"]))
            repeated |= r["n"] > 1
    picked = docs.sparkSession.createDataFrame(fit, "doc_id long, y int, sig long")
    sample = rows.join(F.broadcast(picked), ["doc_id", "sig"])
    if repeated:
        sample = sample.dropDuplicates(["doc_id", "y", "sig"])
    return sample.select("doc_id", "text", "y", "sig")
