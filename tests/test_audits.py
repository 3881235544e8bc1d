"""Audits, reports and the rules that text and streams must keep."""

import pytest
from pyspark.sql import functions as F

from fieldloom import schemas
from fieldloom.functions import scalars, text
from fieldloom.operators import checks, dedup, evaluation, lineage, provenance
from fieldloom.sources import readers, reports, writers
from fieldloom.streaming import counters


def test_control_characters_are_no_section_marks(spark):
    said = "DIAGNOSIS: leaf\x01spot\x02s\nSEVERITY: high\n"
    r = spark.createDataFrame([(said,), (None,), ("",)], "t string").select(text.parsed_response(F.col("t")).alias("r")).collect()
    assert (r[0].r.diagnosis, r[0].r.severity) == ("leaf\x01spot\x02s", "high")
    assert r[1].r.severity == r[2].r.severity == "medium"


def test_urls_and_timeouts(spark):
    rows = [("http://a.b/", "2000", "http://a.b", 2000.0), (" ", None, "http://d", 5.0), ("ftp://x", "999", None, None), ("https://", "120001", None, None), (None, "x", "http://d", None)]
    df = spark.createDataFrame([r[:2] for r in rows], "u string, t string")
    got = df.select(scalars.service_url(F.col("u"), "http://d").alias("u"), scalars.timeout_ms(F.col("t"), 5).alias("t")).collect()
    assert [tuple(g) for g in got] == [r[2:] for r in rows]


def test_canonical_json_hash(spark):
    import hashlib
    import json

    rows = [("x", 'quote " and \\ é\n'), ("", "y")]
    df = spark.createDataFrame(rows, "b string, a string")
    want = [hashlib.sha256(json.dumps({"b": b, "a": a}, sort_keys=True, ensure_ascii=False).encode()).hexdigest() for b, a in rows]
    assert [r.h for r in df.select(text.canonical_sha256(b=F.col("b"), a=F.col("a")).alias("h")).collect()] == want


def test_reports_are_written_once_and_whole(spark, tmp_path):
    folder = str(tmp_path / "r")
    df = spark.createDataFrame([(1, "x")], "n int, a string")
    given = {name: df for name in reports.REPORTS["validation"]}
    with pytest.raises(ValueError):
        reports.write("validation", {"checks": df}, folder)
    assert len(reports.write("validation", given, folder, {"started": "now"})) == 3
    assert [tuple(r) for r in reports.read(spark, folder, "checks").collect()] == [("x", 1)]
    assert reports.read(spark, folder, reports.METADATA).first().value == "now"
    with pytest.raises(FileExistsError):
        reports.write("validation", given, folder)
    path = str(tmp_path / "t")
    assert [writers.once_or_stamped(df, path, "s1") for _ in range(2)] == [path, f"{path}-s1"]


def test_manifest_in_sorted_ranges(spark, tmp_path):
    df = spark.createDataFrame([(f"p{k}", "ab"[k % 2], f"g{k % 3}") for k in range(50)], "path string, class_name string, group_key string")
    writers.manifest_ranges(df.repartition(5), str(tmp_path / "m"))
    back = spark.read.csv(str(tmp_path / "m"), header=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_preview_of_clean_manifests_passes(spark):
    rows = [(f"p{s}{k}", "a", f"g{s}{k}", f"u{s}" if k == 0 else "", f"h{s}{k}", s) for s in ("train", "val", "test") for k in range(30)]
    m = spark.createDataFrame(rows, "path string, class_name string, group_key string, similarity_guard_group string, sha256 string, split string")
    guards = spark.createDataFrame([(f"u{s}", f"g{s}0") for s in ("train", "val", "test")], "guard_id string, group_key string")
    classes = spark.createDataFrame([("a",)], "class_name string")
    done = checks.preview_leakage(m, m.select("path"), m.select("path").limit(0), guards, classes, checks.minimums(classes))
    assert {(r.status, r.violations) for r in done.collect()} == {("PASS", 0)} and done.count() == 14
    told = checks.recorded(done, ["too_few_images"]).collect()
    assert not any(r.blocking_failed for r in told) and sum(not r.blocking for r in told) == 1
    one = checks.preview_leakage(m.where("split <> 'val'"), m.select("path"), m.select("path").limit(0), guards, classes, checks.minimums(classes))
    assert {r.check for r in one.where("status = 'FAIL'").collect()} == {"guard_keys_missing", "active_class_missing", "too_few_images", "too_few_groups"}


def test_candidates_of_near_hashes_stay_few(spark):
    import random

    r = random.Random(1)
    base = [r.getrandbits(63) for _ in range(400)]
    rows = [(4 * k + j, k % 3, h ^ (1 << r.randrange(60)) * (j > 0)) for k, h in enumerate(base) for j in range(3)] + [(10_000 + k, 0, base[0]) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, class_index int, hash long")
    found = {x.id: x.cluster_id for x in dedup.clusters(df, 5).collect()}
    assert len(found) == len(rows) and len(set(found.values())) == 400
    stats = {x.cluster_id: x for x in dedup.cluster_stats(dedup.clusters(df, 5), df).collect()}
    assert stats[0].members == 303 and all(x.max_distance <= 2 for x in stats.values()) and not any(x.cross_class for k, x in stats.items() if k)


def test_large_clusters_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 8)
    hashes = spark.createDataFrame([(k, 0, (1 << k) - 1) for k in range(60)] + [(99, 0, 0)], "id long, class_index int, hash long")
    stats = dedup.cluster_stats(dedup.clusters(hashes, 1), hashes).collect()
    assert [(x.cluster_id, x.members, x.max_distance) for x in stats] == [(0, 61, 59)]


def test_medians(spark):
    import random
    import statistics

    r = random.Random(2)
    for n in (1, 2, 501, 1000):
        values = [r.choice([0.0, 1.0, 0.5, r.random()]) for _ in range(n)]
        got = evaluation._medians(spark.createDataFrame([(True, v) for v in values] + [(False, None)], "correct boolean, v double"), "correct", "v").collect()
        assert [(x.correct, x.median) for x in got] == [(True, statistics.median(values))]


def test_leaf_ids_of_a_hot_key(spark):
    images = spark.createDataFrame([("a", "A", "k"), ("b", "B", "k"), ("c", "A", None), ("d", "A", "other")], "path string, class_name string, key string")
    leaf = spark.createDataFrame([("k", f"A:::{k}") for k in range(10, 500)], "key string, leaf_id string")
    assert sorted((x.path, x.leaf_id) for x in lineage.leaf_join(images, leaf).collect()) == [("a", "A:::10"), ("b", None), ("c", None), ("d", None)]


def test_secondary_opinion_bounds(spark):
    df = spark.createDataFrame([(1, "d" * 600, "low", 50.0, "t" * 5000, "p", ""), (2, "d", "odd", 50.0, "t", "p", None), (3, "d", "low", 101.0, "t", "p", "x"), (4, None, "low", None, "t", "p", "x"), (5, None, "low", 1.0, "t", "p", "x")], "id int, diagnosis string, severity string, confidence double, treatment string, prevention string, expertAdvice string")
    got = provenance.secondary_opinions(df).orderBy("id").collect()
    assert [x.error for x in got] == [None, "severity", "confidence", "confidence", "texts"]
    assert (len(got[0].diagnosis), len(got[0].treatment), got[0].expertAdvice) == (500, 4000, None)


def test_settled_stream_keeps_the_last_count(spark, tmp_path):
    src = str(tmp_path / "s")
    for k in range(3):
        spark.createDataFrame([(u, "2024-01-01 00:00:00") for u in range(k + 1)], "user_id int, t string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("user_id int, t string").option("maxFilesPerTrigger", 1).parquet(src)
    got = counters.settled(counters.user_counts(stream), "settled-test", "analysis_count").collect()
    assert {r.user_id: r.analysis_count for r in got} == {0: 3, 1: 2, 2: 1}
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema("user_id int, t string").parquet(str(tmp_path / "none"))
    assert counters.settled(counters.user_counts(empty), "settled-none", "analysis_count").count() == 0


def test_lookups(spark, tmp_path):
    df = spark.createDataFrame([(k, f"e{k}", k % 3) for k in range(30)], "id int, email string, userId int")
    df.write.parquet(str(tmp_path / "u"))
    back = spark.read.parquet(str(tmp_path / "u"))
    assert [r.email for r in readers.by_key(back, "id", 7).collect()] == ["e7"]
    assert readers.by_key(back, "email", "e99").count() == 0
    one = readers.by_user(back, 2)
    assert one.count() == 10 and "EqualTo(userId,2)" in one._jdf.queryExecution().executedPlan().toString()


def test_text_csvs_and_json_documents(spark, tmp_path):
    for name, rows in (("a.csv", "File Name,Leaf #\nx.jpg,1\ny.jpg,\n"), ("b.csv", "File Name,Leaf #\nz.jpg,007\n")):
        (tmp_path / name).write_text(rows)
    got = readers.text_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r["File Name"], r["Leaf #"], r.source_file.rsplit("/", 1)[1]) for r in got.collect()) == [("x.jpg", "1", "a.csv"), ("y.jpg", None, "a.csv"), ("z.jpg", "007", "b.csv")]
    assert checks.blank_rows(got, ["File Name", "Leaf #"]).first().malformed == 1
    (tmp_path / "c.json").write_text('{\n "status": "approved",\n "guards": [{"guard_group_id": "g"}]\n}')
    doc = readers.json_document(spark, str(tmp_path / "c.json")).first()
    assert doc.status == "approved" and doc.guards[0].guard_group_id == "g"
    (tmp_path / "d.json").write_text('{"status": ')
    with pytest.raises(Exception):
        readers.json_document(spark, str(tmp_path / "d.json"), "status string").collect()


def test_predictions_round_trip(spark, tmp_path):
    rows = [("p1", "a", 0, "b", 1, 0.75, [0.25, 0.75], "True", "g", ""), ("p,2", "a", 0, "a", 0, 0.5, [0.5, 0.5], "1", 'g"x', "u")]
    names = [f.name for f in schemas.PREDICTIONS.fields]
    df = spark.createDataFrame(rows, "path string, true_class_name string, true_class_index int, predicted_class_name string, predicted_class_index int, maximum_probability double, probabilities array<double>, correct string, group_key string, similarity_guard_group string")
    writers.predictions_csv(df.coalesce(1), str(tmp_path / "p"))
    back = readers.predictions(spark, str(tmp_path / "p")).collect()
    assert sorted(map(tuple, back)) == sorted((*r[:7], True, *r[8:]) for r in rows)
    at = names.index("maximum_probability") + 1
    wide = df.select(*names[:at], (F.col("maximum_probability") >= 0.6).alias("accepted"), *names[at:])
    writers.predictions_csv(wide.coalesce(1), str(tmp_path / "w"))
    told = readers.predictions(spark, str(tmp_path / "w"), with_accepted=True)
    assert {r.path: r.accepted for r in told.collect()} == {"p1": True, "p,2": False}
    assert checks.accepted_column(told, 0.6).count() == 0 and checks.accepted_column(told, 0.4).count() == 1


def test_file_inventory(spark, tmp_path):
    for name, content in (("a.csv", b"\xef\xbb\xbfx"), ("b.csv", "é".encode()), ("c.csv", b"\xff")):
        (tmp_path / name).write_bytes(content)
    got = checks.inventory(readers.binaries(spark, str(tmp_path), "*.csv")).collect()
    assert sorted((r.path[-5:], r.size_bytes, r.utf8_bom_present, r.encoding) for r in got) == [("a.csv", 4, True, "utf-8-sig"), ("b.csv", 2, False, "utf-8"), ("c.csv", 1, False, "latin-1")]


def test_json_keys_are_sorted_at_every_depth(spark, tmp_path):
    df = spark.createDataFrame([((2, [(1, "x")], None), 7)], "z struct<b int, a array<struct<d int, c string>>, none string>, k int")
    writers.report_json(df, str(tmp_path / "j"))
    writers.pretty_json(df, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"k":7,"z":{"a":[{"c":"x","d":1}],"b":2,"none":null}}'
    assert spark.read.text(str(tmp_path / "p"), wholetext=True).first().value.startswith('{\n  "k" : 7,')


def test_perceptual_hash(spark):
    import numpy as np

    x = np.random.default_rng(1).random((32, 32))
    y = x + 1e-6
    df = spark.createDataFrame([(1, x.ravel().tolist()), (2, y.ravel().tolist()), (3, None), (4, [1.0])], "id int, p array<double>")
    got = {r.id: r.hash for r in dedup.perceptual_hashes(df.withColumnRenamed("p", "pixels")).collect()}
    n = np.arange(32)
    low = np.array([[(x * np.outer(np.cos(np.pi * u * (2 * n + 1) / 64), np.cos(np.pi * v * (2 * n + 1) / 64))).sum() for v in range(8)] for u in range(8)])
    bits = (low > np.median(low)).ravel()
    assert got[1] % 2**64 == int("".join("01"[int(b)] for b in bits), 2) and got[2] == got[1] and got[3] is got[4] is None
