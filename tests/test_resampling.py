"""The exact bootstrap: sums, moments, partitions, and a plain bootstrap beside it."""

import random

import numpy as np
from pyspark.sql import functions as F

from fieldloom.operators import resampling

SCHEMA = "path string, true_class_index int, predicted_class_index int, maximum_probability double, group_key long"


def made(n=1200, groups=260):
    r = random.Random(8)
    rows = []
    for k in range(n):
        t = r.randrange(3)
        p = t if r.random() < 0.85 else (t + 1) % 3
        rows.append((f"p{k}", t, p, round(r.random(), 3), r.randrange(groups)))
    return rows


def test_a_scatter_adds_up_and_has_the_moments_of_a_multinomial():
    w = np.array([5, 0, 1, 30, 64, 900])
    got = resampling.scatter(np.full(20_000, 1000), w, np.random.default_rng(1))
    assert (got.sum(axis=1) == 1000).all() and (got[:, 1] == 0).all()
    p = w / w.sum()
    assert np.allclose(got.mean(axis=0), 1000 * p, atol=0.6)
    assert np.allclose(got.var(axis=0), 1000 * p * (1 - p), rtol=0.06)
    assert abs(np.cov(got[:, 3], got[:, 4])[0, 1] + 1000 * p[3] * p[4]) < 0.5


def test_every_resample_has_as_many_units(spark, monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK", 7)
    rows = made()
    preds = spark.createDataFrame(rows, SCHEMA)
    for by_group, n in ((True, len({r[4] for r in rows})), (False, len(rows))):
        got = resampling.units_drawn(preds, draws=300, by_group=by_group).collect()
        assert len(got) == 300 and all(x.units == n for x in got)


def test_partitions_change_nothing(spark):
    preds = spark.createDataFrame(made(), SCHEMA)
    runs = [sorted(map(tuple, resampling.bootstrap(preds.repartition(n), 0.4, draws=200).collect())) for n in (1, 9)]
    assert runs[0] == runs[1] and len(runs[0]) == 4


def test_intervals_are_those_of_a_plain_bootstrap(spark):
    rows = made()
    preds = spark.createDataFrame(rows, SCHEMA)
    rng = np.random.default_rng(3)
    hit = np.array([r[1] == r[2] for r in rows])
    group = np.array([r[4] for r in rows])
    names = np.unique(group)
    n, right = (np.array([x[group == g].sum() for g in names]) for x in (np.ones(len(rows)), hit))
    plain = {False: [hit[rng.integers(0, len(hit), len(hit))].mean() for _ in range(4000)], True: []}
    for _ in range(4000):
        k = rng.integers(0, len(names), len(names))
        plain[True].append(right[k].sum() / n[k].sum())
    for by_group in (False, True):
        got = {x.metric: x for x in resampling.bootstrap(preds, 0.4, by_group=by_group).collect()}["raw_accuracy"]
        low, high = np.percentile(plain[by_group], [2.5, 97.5])
        assert abs(got.mean_of_resamples - np.mean(plain[by_group])) < 0.001
        assert abs(got.ci_lower_95 - low) < 0.003 and abs(got.ci_upper_95 - high) < 0.003


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert resampling.units_drawn(none, draws=5).count() == 0
    one = spark.createDataFrame([("a", 0, 0, None, None), ("b", 0, 1, 0.9, None)], SCHEMA)
    got = {x.metric: x for x in resampling.bootstrap(one, 0.5, draws=50).collect()}
    assert got["raw_accuracy"].ci_lower_95 == got["raw_accuracy"].ci_upper_95 == 0.5
    assert got["thresholded_coverage"].mean_of_resamples == 0.5
    assert resampling.kinds(one, 0.5).select(F.size("kind").alias("n")).first()["n"] == 2
