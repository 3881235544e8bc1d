"""Stored counters: replayed and torn batches, and what a batch rewrites."""

import pytest
from pyspark.sql import functions as F

from fieldloom.streaming import stored


@pytest.fixture
def store(spark, tmp_path):
    return stored.Counters(spark, f"file://{tmp_path}/store", "k", buckets=8)


def content(store):
    return {r.k: r.value for r in store.values().collect()}


def batch(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "k long")


def test_batches_add_up_and_a_replay_changes_nothing(spark, store):
    assert content(store) == {} and store.get(1) is None
    assert store.merge(batch(spark, [1, 1, 2, None]), 0)
    assert store.merge(batch(spark, [2, 3]), 1)
    was = store.state()
    assert not store.merge(batch(spark, [2, 3]), 1) and not store.merge(batch(spark, [1, 1, 2, None]), 0)
    assert store.state() == was and content(store) == {1: 2, 2: 2, 3: 1}
    assert store.merge(batch(spark, [3]), 0, stream="another") and store.get(3) == 2 and store.get(99) is None
    assert store.merge(batch(spark, []), 2) and content(store) == {1: 2, 2: 2, 3: 2}


def test_only_touched_buckets_are_rewritten(spark, store):
    store.merge(batch(spark, range(200)), 0)
    was = store.state().folders
    assert len(was) == 8
    store.merge(batch(spark, [5] * 1000), 1)
    now = store.state().folders
    assert sum(was[k] != now[k] for k in was) == 1 and store.get(5) == 1001
    assert store.vacuum() == 1 and content(store) == {k: 1001 if k == 5 else 1 for k in range(200)}


def test_a_torn_batch_is_invisible_and_runs_again(spark, store, monkeypatch):
    store.merge(batch(spark, [1, 2]), 0)

    def fail(self, c):
        raise OSError("the driver died before the commit")

    whole = stored.Counters._commit
    monkeypatch.setattr(stored.Counters, "_commit", fail)
    with pytest.raises(OSError):
        store.merge(batch(spark, [1, 1]), 1)
    assert content(store) == {1: 1, 2: 1}
    monkeypatch.setattr(stored.Counters, "_commit", whole)
    assert store.merge(batch(spark, [1, 1]), 1) and content(store) == {1: 3, 2: 1}


def test_two_writers_cant_take_one_number(spark, store):
    store.merge(batch(spark, [1]), 0)
    with pytest.raises(RuntimeError):
        store._commit(stored.Commit(1, {}, {}))


def test_a_stream_that_is_started_again(spark, store, tmp_path):
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).select(F.pmod("id", F.lit(7)).alias("k")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        stored.follow(events, store, str(tmp_path / "log"))
    assert content(store) == {k: len(range(k, 40, 7)) for k in range(7)}
    # a new log gives the same numbers to batches that are in already
    stored.follow(events, store, str(tmp_path / "another-log"))
    assert sum(content(store).values()) == 40 and store.state().batches == {"": 3}
