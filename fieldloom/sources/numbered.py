"""Row numbers of CSV files that are read in splits, and validation that names the row.

A file is read as lines in blocks, wherever they are cut. Each block's lines are counted in one pass, and its records
under either state that a quote may have been left open in before it; prefix sums over a file's blocks give what state it was and
how many records stand before. A line's numbers are its block's offsets plus its place in the block. So numbers are
those of a sequential read at any split size, and no task reads a whole file. A field that holds a quote, a comma or a line
break must be quoted, as CSV writers do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blocks whose offsets are broadcast; those of more blocks are joined by an exchange.
SMALL = 1 << 17
_PLACES = "file string, start long, value string, place int, odd int, rec0 int, rec1 int, blank boolean"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lines ``(file, start, value)``, a block's in order: the place in the block, whether the quotes before the line in
    the block are odd, the records that end before it if none was open at the block's begin (rec0) or one was (rec1),
    and whether it is empty."""
    name, place, quotes, ends = None, 0, 0, [0, 0]
    for b in batches:
        if not b.num_rows:
            continue
        file, start = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
        q = pc.count_substring(b.column(2), '"').to_numpy().astype(np.int64)
        empty = pc.equal(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (start[1:] != start[:-1]), True])
        out = {k: np.empty(b.num_rows, np.int32) for k in ("place", "odd", "rec0", "rec1")}
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if name != (file[i], start[i]):
                name, place, quotes, ends = (file[i], start[i]), 0, 0, [0, 0]
            after = quotes + np.cumsum(q[i:j])
            before = after - q[i:j]
            out["place"][i:j] = place + np.arange(j - i)
            out["odd"][i:j] = before % 2
            for p in (0, 1):
                # a record ends with a line after which no quote is open, unless the line is a blank one between records
                ended = ((after + p) % 2 == 0) & ~(empty[i:j] & ((before + p) % 2 == 0))
                total = ends[p] + np.cumsum(ended)
                out[f"rec{p}"][i:j] = total - ended
                ends[p] = int(total[-1])
            place, quotes = place + j - i, int(after[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x) for x in out.values()), pa.array(empty)], ["file", "start", "value", *out, "blank"])


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, row, value)`` of every record of the text files at a path that isn't a blank line.

    ``line`` is the number of the record's first line, ``row`` the record's own; both count from 1 in each file, so
    a header is row 1. ``value`` is the record's text, of several lines if quotes hold line breaks. Lines end with a line feed.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    places = lines.mapInArrow(_place, _PLACES)
    quotes = F.pmod(F.col("odd") + F.length("value") - F.length(F.replace("value", F.lit('"'))), F.lit(2))  # of the block up to the line's end
    last = F.max_by(F.struct((F.col("place") + 1).alias("lines"), quotes.alias("odd"), *[(F.col(f"rec{p}") + F.when(((quotes + p) % 2 == 0) & ~(F.col("blank") & ((F.col("odd") + p) % 2 == 0)), 1).otherwise(0)).alias(f"rec{p}") for p in (0, 1)]), "place")
    blocks = places.groupBy("file", "start").agg(last.alias("x")).select("file", "start", "x.*")
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)  # a row for each block
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    blocks = blocks.withColumn("open", F.pmod(earlier("odd"), F.lit(2)))
    own = F.when(F.col("open") == 1, F.col("rec1")).otherwise(F.col("rec0"))
    blocks = blocks.select("file", "start", "open", earlier("lines").alias("lines"), earlier(own).alias("records"))
    few = spark.read.format("binaryFile").load(path).select(F.sum(F.ceil(F.col("length") / _split_bytes(spark)) + 1).alias("n")).first()["n"] or 0
    at = places.join(F.broadcast(blocks) if few <= SMALL else blocks, ["file", "start"])
    odd, rec = F.pmod(F.col("odd") + F.col("open"), F.lit(2)), F.when(F.col("open") == 1, F.col("rec1")).otherwise(F.col("rec0"))
    at = at.where(~(F.col("blank") & (odd == 0)))
    alone = (odd == 0) & (F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'))), F.lit(2)) == 0)
    rows = at.select("file", (F.col("lines") + F.col("place") + 1).alias("line"), (F.col("records") + rec + 1).alias("row"), "value", alone.alias("alone"))
    parts = F.sort_array(F.collect_list(F.struct("line", "value")))  # the lines of one record
    many = rows.where("not alone").groupBy("file", "row").agg(F.min("line").alias("line"), F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("value"))
    return rows.where("alone").select("file", "line", "row", "value").unionByName(many)


def _split_bytes(spark: SparkSession) -> int:
    """The least that a block of a large file may have, by the session's settings."""
    sc = spark.sparkContext
    return sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes"))


def across_files(rows: DataFrame) -> DataFrame:
    """``rows`` with ``number``: the records below headers counted from 1 over all files, in the order of their names."""
    sizes = rows.groupBy("file").agg(F.max("row").alias("n"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    offsets = sizes.select("file", F.coalesce(F.sum(F.col("n") - 1).over(before), F.lit(0)).alias("offset"))
    return rows.where("row > 1").join(offsets, "file").withColumn("number", F.col("offset") + F.col("row") - 1).drop("offset")


# ------------------------------------------------------------------------------------------------- validation


def parsed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` below the headers with the named columns as text, in place of ``value``; an absent cell is null."""
    fields = ", ".join(f"`{c}` string" for c in columns)
    cells = F.from_csv(F.rtrim(F.col("value"), F.lit("\r")), fields, {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true"})
    return rows.where("row > 1").withColumn("c", cells).select(*[c for c in rows.columns if c != "value"], "c.*")


def header(spark: SparkSession, path: str, required: list[str]) -> list[str]:
    """The header's columns; all that are required must be among them."""
    found = spark.read.csv(path, header=True, escape='"').columns
    absent = [c for c in required if c not in found]
    if absent:
        raise ValueError(f"{path}: missing required column(s) {absent}; found columns {found}")
    return found


def manifest_errors(manifest: DataFrame, classes: DataFrame, active: DataFrame, excluded: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, path, rule, detail)``: the first rule that each row of a numbered manifest breaks.

    ``manifest`` has path, class_name and class_index as text, and its place in ``by``. ``classes`` (class_name, class_index)
    is the class map, ``active`` and ``excluded`` have class_name, ``files`` the paths that exist. Rules in order: a
    path that an earlier row has, an excluded class, one out of scope, one that the map lacks, an index that is no integer,
    another index than the map's, an absent file. Rows by their place, so what is first is what a sequential read meets.
    """
    place = F.struct(*by)
    first = manifest.groupBy("path").agg(F.min(place).alias("first"))
    # the class tables are as small as the model's list of classes
    named = manifest.join(F.broadcast(classes.select("class_name", F.col("class_index").alias("want"))), "class_name", "left")
    named = named.join(F.broadcast(active.select("class_name").distinct().withColumn("active", F.lit(True))), "class_name", "left")
    named = named.join(F.broadcast(excluded.select("class_name").distinct().withColumn("excluded", F.lit(True))), "class_name", "left")
    known = files.select("path").distinct().withColumn("there", F.lit(True))
    rows = named.join(first, "path", "left").join(known, "path", "left")
    index = F.expr("try_cast(trim(class_index) AS bigint)")
    no = lambda c: F.col(c).isNull()
    rules: list[tuple[str, Column, Column]] = [
        ("duplicate_path", F.col("first") < place, F.col("path")),
        ("excluded_class", ~no("excluded"), F.col("class_name")),
        ("class_out_of_scope", no("active"), F.col("class_name")),
        ("class_unknown", no("want"), F.col("class_name")),
        ("index_not_integer", index.isNull(), F.col("class_index")),
        ("index_mismatch", index != F.col("want"), F.concat_ws(" for ", F.col("class_index"), F.col("want").cast("string"))),
        ("file_missing", no("there"), F.col("path")),
    ]
    broken = F.coalesce(*[F.when(c, F.struct(F.lit(name).alias("rule"), detail.alias("detail"))) for name, c, detail in rules])
    return rows.withColumn("x", broken).where("x IS NOT NULL").select(*by, "path", "x.rule", "x.detail")
