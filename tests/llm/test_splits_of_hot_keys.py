"""Hot digests, forged revisits, sources of one row, and many blocks of items."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, sharding, warc
from fieldloom.staging import new_path, stage

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.files.maxPartitionBytes": "64k",
    "spark.sql.files.openCostInBytes": "1k",
}


@pytest.fixture
def skewed(spark):
    was = {k: spark.conf.get(k) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------------------------------------------ WARC


def test_revisits_of_a_hot_page_are_split(skewed):
    pages = skewed.range(60_000, numPartitions=16).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("error page " * 20)).otherwise(F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit("x"))).alias("html"))
    out = warc.round_trip(pages)
    assert "skew=true" in plan_of(out)
    assert out.where("record_type = 'revisit'").count() == 19_999 and out.count() == 60_000


def archive(spark, records):
    """An archive of the given records in one file, as a table of its path."""
    folder = new_path(spark, "forged")
    fs, base = warc._open(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/a.warc.gz", compression=None) as out:
        for r in records:
            out.write(warc.encode(*r))
    return spark.createDataFrame([(f"{folder}/a.warc.gz",)], "path string")


def test_a_forged_revisit_is_found(spark):
    body = b"y" * 200
    right, wrong = hashlib.sha256(body).hexdigest(), hashlib.sha256(b"other").hexdigest()
    response = (1, "u", body, None, False, right)
    fine = archive(spark, [response, (2, "u", body, 1, True, right)])
    assert warc.verified(warc.read_archives(fine)).count() == 2
    for forged in ((2, "u", body, 1, True, wrong), (2, "u", body, 7, True, right), (2, "u", body, None, True, right)):
        with pytest.raises(Exception, match="Corrupt"):
            warc.verified(warc.read_archives(archive(spark, [response, forged]))).collect()


# -------------------------------------------------------------------------------------------------- sharding


def test_sources_of_one_row_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 1000)
    held = {}
    monkeypatch.setattr(sharding, "stage", lambda df, label: held.setdefault(label, stage(df, label)))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("host"), "id").alias("source"))
    got = sharding.stratified_shards(docs, 40)
    assert {r["count"] for r in got.groupBy("shard").count().collect()} == {150}
    per = [r["count"] for r in held["ranked"].groupBy(F.floor(F.col("fraction") * 6).alias("range")).count().collect()]
    assert len(per) == 6 and max(per) < 2 * 1000


# -------------------------------------------------------------------------------------------- decontamination


def test_blocks_are_made_one_at_a_time(spark, monkeypatch):
    r = random.Random(4)
    items = [(k, " ".join(f"w{r.randrange(500)}" for _ in range(8))) for k in range(50)]
    docs = [(k if k % 9 else None, f"a b {items[k % 50][1]} c d" if k % 3 == 0 else "nothing of the kind here") for k in range(120)] + [(None, None), (3, "")]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(table, bench).collect()), key=str)
    clean = sorted(map(tuple, decontaminate.keep_clean(table, bench).collect()), key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 1)
    alive, most = [0], [0]
    made, written = decontaminate.Items.of, decontaminate.stage

    def of(*args, **kw):
        alive[0] += 1
        most[0] = max(most[0], alive[0])
        return made(*args, **kw)

    def put(df, label):
        out = written(df, label)
        alive[0] -= label == "matches"
        return out

    monkeypatch.setattr(decontaminate.Items, "of", of)
    monkeypatch.setattr(decontaminate, "stage", put)
    assert decontaminate.block_count(bench) == 50
    assert sorted(map(tuple, decontaminate.contaminated(table, bench).collect()), key=str) == whole and most == [1]
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 10)
    assert sorted(map(tuple, decontaminate.keep_clean(table, bench).collect()), key=str) == clean and len(clean) < len(docs)
