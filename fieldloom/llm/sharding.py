"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source, ranked, and ordered by fractional rank
``(rank + offset) / rows of the source`` with an offset in [0, 1) of the source's own, from a seeded hash; cutting that
order into equal runs gives every shard each source's share to within a row. With one offset for all, sources of one
row would all stand in the middle, in few shards and in one range; with their own they are spread like all else. Ranks come from counts of hash ranges plus a row number inside a range, so no task ever sorts a
whole source or the whole table. Rows alike in all are counted and numbered, and their number is hashed too, so
that no key, not even a null id that a third of all rows share, fills a range of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.staging import stage

#: Rows in one range on average: what a single sort inside a window handles.
RANGE_ROWS = 20_000
#: Rows alike that one task writes out.
ALIKE = 10_000


def _scaled(bits32: Column, n: int) -> Column:
    """Maps 0 .. 2^32-1 to 0 .. n-1, keeping order."""
    return F.shiftright(bits32 * F.lit(n), 32)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with column ``copy``: 0, 1, 2 ... among rows that are alike in all columns.

    Rows alike are interchangeable, so they are counted, partial counts first, and written out again from the count;
    a large count is dealt to many tasks in blocks.
    """
    keys = rows.columns
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("alike"))
    few = counted.where(F.col("alike") <= ALIKE).withColumn("first", F.lit(0).cast("long"))
    many = counted.where(F.col("alike") > ALIKE).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1, F.lit(ALIKE).cast("long"))))
    many = many.repartition("order", "first")
    last = F.least(F.col("alike"), F.col("first") + ALIKE) - 1
    return few.unionByName(many).select(*keys, F.explode(F.sequence("first", last)).alias("copy"))


def ordered(docs: DataFrame, ranges: int, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows with their stratum, their place ``order`` in a seeded shuffle, and the range of places it is in."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))).alias("stratum"),
        *[F.col(c).alias(f"carry_{c}") for c in carry],
    ).withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "stratum", "size", "text_crc32"))
    order = F.shiftrightunsigned(F.when(F.col("copy") == 0, F.col("order")).otherwise(F.xxhash64("order", "copy")), 1)
    return _numbered(rows).withColumn("order", order).drop("copy").withColumn("range", _scaled(F.shiftright("order", 31), ranges))


def stratified_shards(docs: DataFrame, shards: int = 40, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` and the ``carry`` columns for every row.

    ``law`` is ``rows``: shard counts differ by one at most. ``size`` is the text's UTF-8 bytes plus 16.
    ``slot`` counts from 0 in each shard. ``grown_shard`` belongs to the law ``key`` and is null.

    Null or empty text: 16 bytes, CRC of no bytes (0). A null source is a source of its own. Null doc_ids and
    repeated rows are kept; rows alike in all that is ordered by are interchangeable. Fewer rows than shards:
    some shards stay empty. Empty table: no rows.
    """
    n = docs.count()
    ranges = max(1, -(-n // RANGE_ROWS))
    rows = ordered(docs, ranges, seed, carry)
    ties = ["order", "doc_id", "size", "text_crc32"]
    own, here = W.partitionBy("stratum"), W.partitionBy("range").orderBy("stratum")
    counts = rows.groupBy("stratum", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(own.orderBy("range")) - F.col("n")  # of the source in earlier ranges
    ahead = F.sum("n").over(here) - F.col("n")  # of other sources in this range
    counts = counts.select("stratum", "range", (before - ahead).alias("shift"), F.sum("n").over(own).alias("of"))
    place = F.row_number().over(W.partitionBy("range").orderBy("stratum", *ties)) - 1  # a range is as large for any mix of sources
    ranked = rows.withColumn("place", place).join(counts, ["stratum", "range"]).withColumn("rank", F.col("place") + F.col("shift"))
    offset = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "stratum"), 12) / float(1 << 52)
    placed = stage(ranked.withColumn("fraction", (F.col("rank") + offset) / F.col("of")).drop("range", "place", "shift", "of", "rank"), "ranked")
    placed = placed.withColumn("range", F.least(F.floor(F.col("fraction") * ranges), F.lit(ranges - 1)))
    counts = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))  # one row per range
    at = placed.join(counts, "range").withColumn("at", F.col("before") + F.row_number().over(W.partitionBy("range").orderBy("fraction", "stratum", *ties)) - 1)
    shard = F.expr(f"at * {shards} div {max(n, 1)}")
    at = at.withColumn("shard", shard)
    return at.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("at") - F.expr(f"(shard * {n} + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"carry_{c}").alias(c) for c in carry],
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 42) -> None:
    """Write the documents' texts as Parquet, one folder per shard, rows by slot.

    Rows go to ``(shard, range of slots)`` first, so that a shard is as many files as its size asks for.
    """
    cut = stratified_shards(docs, shards, seed, carry=("text",))
    part = F.floor(F.col("slot") / (10 * RANGE_ROWS))
    cut.withColumn("part", part).repartition("shard", "part").sortWithinPartitions("shard", "slot").drop("part").write.partitionBy("shard").parquet(path)
