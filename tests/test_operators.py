"""Splits, lineage, graph, sources and streaming on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from fieldloom import schemas
from fieldloom.operators import checks, dedup, lineage, splits
from fieldloom.operators.graph import connected_components
from fieldloom.sources import readers, writers
from fieldloom.streaming import counters


def allocate_plainly(comps):
    """The rule as a loop: (class, id, size, groups) -> split."""
    out = {}
    for cls in {c[0] for c in comps}:
        own = sorted((c for c in comps if c[0] == cls), key=lambda c: (-c[2], c[1]))
        total = sum(c[2] for c in own)
        left = [round(total * 0.7), round(total * 0.15)]
        left.append(total - sum(left))
        groups = [0, 0, 0]
        for c in own:
            k = min(range(3), key=lambda k: (-left[k], groups[k], k))
            out[c[0], c[1]] = splits.SPLITS[k]
            left[k] -= c[2]
            groups[k] += c[3]
    return out


def test_allocation_equals_loop_in_any_order(spark):
    r = random.Random(3)
    comps = [(f"c{k % 3}", f"id{k}", r.randint(1, 40), r.randint(1, 3)) for k in range(150)]
    for _ in range(2):
        r.shuffle(comps)
        df = spark.createDataFrame(comps, "class_name string, component_id string, size long, group_count long").repartition(5)
        assert {(x.class_name, x.component_id): x.split for x in splits.allocate(df).collect()} == allocate_plainly(comps)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 10), (5, 5), (None, 4), (3, 2)] + [(100 + k, 101 + k) for k in range(50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10} | {100 + k: 100 for k in range(51)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_hamming_pairs_against_brute_force(spark):
    r = random.Random(5)
    base = [r.getrandbits(63) for _ in range(20)]
    hs = [b ^ sum(1 << r.randrange(63) for _ in range(r.randrange(5))) for b in base for _ in range(4)]
    df = spark.createDataFrame([(k, k % 3, h if h < 1 << 63 else h - (1 << 64)) for k, h in enumerate(hs)], "id long, class_index int, hash long")
    for most in (0, 3, 6):
        got = {(x.a, x.b, x.distance) for x in dedup.hamming_pairs(df, most).collect()}
        assert got == {(i, j, (hs[i] ^ hs[j]).bit_count()) for i in range(len(hs)) for j in range(i + 1, len(hs)) if (hs[i] ^ hs[j]).bit_count() <= most}


def test_quota_sample(spark):
    rows = [(f"g{k}", k % 3 + 1, f"p{k % 2}") for k in range(12)]
    out = lineage.quota_sample(spark.createDataFrame(rows, "group_key string, size long, session_prefix string"), 8).collect()
    assert len(out) == 8 and {r.session_prefix for r in out if r["pass"] == 1} == {"p0", "p1"}


def test_guard_and_manifest_checks(spark):
    groups = spark.createDataFrame([("A", "g1"), ("A", "g2"), ("B", "g3")], "class_name string, group_key string")
    guards = spark.createDataFrame([("x", "g1"), ("x", "g3"), ("y", "g1"), ("y", "nope")], "guard_id string, group_key string")
    assert {r.check: r.violations for r in checks.guard_checks(groups, guards).collect()} == {"guard_keys_exist": 1, "guard_in_one_class": 1, "key_in_one_guard": 1}
    m = spark.createDataFrame([("p", "A", 0, "s"), ("p", "Z", 0, ""), ("q", "A", 1, "t")], "path string, class_name string, class_index int, sha256 string")
    got = {r.check: r.violations for r in checks.manifest_checks(m, spark.createDataFrame([(0, "A")], "class_index int, class_name string")).collect()}
    assert got == {"unique_path": 1, "class_in_scope": 1, "class_index": 1, "sha256_present": 1}


def test_reconciled_predictions(spark):
    p, m = (spark.createDataFrame([(x,) for x in xs], "path string") for xs in (["a", "a", "b"], ["a", "c"]))
    assert {r.check: r.status for r in checks.reconciled(p, m).collect()} == {"unique_prediction": "FAIL", "prediction_in_manifest": "FAIL", "manifest_has_prediction": "FAIL"}


def test_manifest_round_trip_and_strict_header(spark, tmp_path):
    row = ("a,b.png", "Tomato Healthy", 0, 'g"1', "leaf_id", "", "ff")
    writers.manifest_csv(spark.createDataFrame([row], schemas.MANIFEST), str(tmp_path / "m"))
    back = readers.manifest(spark, str(tmp_path / "m")).first()
    assert tuple(back) == row
    (tmp_path / "bad.csv").write_text("path,class_name\nx,y\n")
    with pytest.raises(readers.HeaderMismatch):
        readers.manifest(spark, str(tmp_path / "bad.csv"))


def test_empty_predictions_fail(spark, tmp_path):
    (tmp_path / "p.csv").write_text(",".join(schemas.PREDICTIONS.names) + "\n")
    with pytest.raises(ValueError, match="no rows"):
        readers.predictions(spark, str(tmp_path / "p.csv"))
    (tmp_path / "q.csv").write_text(",".join(schemas.PREDICTIONS.names) + '\np,A,0,A,0,0.5,"[0.5, 0.5]",True,g,\n')
    r = readers.predictions(spark, str(tmp_path / "q.csv")).first()
    assert r.correct is True and r.probabilities == [0.5, 0.5]


def test_binaries(spark, tmp_path):
    (tmp_path / "Tomato").mkdir()
    (tmp_path / "Tomato/a.png").write_bytes(b"x" * 10)
    (tmp_path / "Tomato/b.png").write_bytes(b"x" * 1000)
    rows = readers.binaries(spark, str(tmp_path), "*.png", most=100).select("class_folder", "length").collect()
    assert [tuple(r) for r in rows] == [("Tomato", 10)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    writers.once(df, str(tmp_path / "o"))
    with pytest.raises(Exception, match="(?i)already exists"):
        writers.once(df, str(tmp_path / "o"))
    patch = spark.createDataFrame([(1, "")], "id int, name string")
    assert writers.patched(df, patch, "id", ["name"]).first().name == "a"
    new = spark.createDataFrame([("x", 2), ("x", 1), ("y", 3), (None, 4)], "email string, n int")
    old = spark.createDataFrame([("y",)], "email string")
    assert [tuple(r) for r in writers.new_by_key(new, old, "email").collect()] == [("x", 1)]


def test_streaming_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    events = [(k, f"2024-01-0{k % 3 + 1} 10:00:00", k % 2, "a") for k in range(9)] + [(0, "2024-01-01 10:00:00", 0, "a")]
    df = spark.createDataFrame(events, "event_id long, t string, user_id long, event_type string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(src)
    stream = lambda: spark.readStream.schema(df.schema).parquet(src)

    def run(out, mode, name):
        q = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert {r.user_id: r.analysis_count for r in run(counters.user_counts(stream()), "complete", "users_s").collect()} == {0: 6, 1: 4}
    assert run(counters.distinct_events(stream()), "append", "distinct_s").count() == 9
    assert sum(r.n for r in run(counters.windowed_counts(stream()), "complete", "windows_s").collect()) == 10
