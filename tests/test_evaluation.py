"""Hand-computed results for the evaluation operators."""

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import evaluation

PRED = "path string, true_class_index int, predicted_class_index int, maximum_probability double, correct boolean, group_key string, similarity_guard_group string"


def preds(spark, spec):
    rows = [(f"p{i}", t, p, prob, t == p, f"g{i}", "") for i, (t, p, prob) in enumerate(r for n, t, p, prob in spec for r in [(t, p, prob)] * n)]
    return spark.createDataFrame(rows, PRED)


def classes(spark, n):
    return spark.createDataFrame([(k, "ABCDEF"[k]) for k in range(n)], "class_index int, class_name string")


CRAFTED = [(8, 0, 0, 0.95), (2, 0, 1, 0.55), (10, 1, 1, 0.60)]
PASSING = [(18, 0, 0, 0.95), (2, 0, 1, 0.55), (20, 1, 1, 0.90)]


def test_threshold_on_crafted_rows(spark):
    row = evaluation.threshold_sweep(preds(spark, CRAFTED), classes(spark, 2), [0.9]).first()
    assert (row.total_samples, row.accepted_count, row.rejected_count, row.coverage, row.selective_accuracy) == (20, 8, 12, 0.4, 1.0)
    assert row.classes_without_support == 1 and not row.passes
    b = evaluation.threshold_classes(preds(spark, CRAFTED), classes(spark, 2), [0.9]).where("class_index = 1").first()
    assert b.accuracy is None and b.accepted == 0


def test_no_threshold_passes_on_crafted_rows(spark):
    sweep = evaluation.threshold_sweep(preds(spark, CRAFTED), classes(spark, 2))
    assert evaluation.selected(sweep).count() == 0
    assert evaluation.pareto(sweep).count() > 0


def test_selection_on_passing_rows(spark):
    sweep = evaluation.threshold_sweep(preds(spark, PASSING), classes(spark, 2), [0.5, 0.6, 0.9, 0.96])
    assert evaluation.selected(sweep).first().threshold == 0.6


def test_selection_order(spark):
    rows = [(0.5, 0.95, None, True), (0.6, 0.95, 0.0, True), (0.7, 0.95, 0.2, True), (0.8, 0.90, 0.9, True)]
    sweep = spark.createDataFrame(rows, "threshold double, coverage double, selective_macro_f1 double, passes boolean")
    order = []
    while evaluation.selected(sweep).count():
        t = evaluation.selected(sweep).first().threshold
        order.append(t)
        sweep = sweep.where(F.col("threshold") != t)
    assert order == [0.7, 0.6, 0.5, 0.8]


def test_boundary_is_accepted(spark):
    row = evaluation.threshold_sweep(preds(spark, [(1, 0, 0, 0.7)]), classes(spark, 1), [0.7]).first()
    assert row.accepted_count == 1


def test_per_class_and_absent_class(spark):
    p = preds(spark, [(1, t, q, 0.9) for t, q in zip([0, 1, 0, 1], [0, 1, 1, 0])])
    m = {r.class_index: r for r in evaluation.per_class(p, classes(spark, 3)).collect()}
    assert (m[2].support, m[2].precision, m[2].recall, m[2].f1) == (0, 0.0, 0.0, 0.0)
    assert m[0].precision == m[0].recall == 0.5
    assert evaluation.macro(evaluation.per_class(p, classes(spark, 3))).first().macro_f1 == 0.5
    assert evaluation.macro(evaluation.per_class(p, classes(spark, 3)), present_only=False).first().macro_f1 == pytest.approx(1 / 3, abs=1e-6)


def test_support(spark):
    p = preds(spark, [(1, t, q, 0.9) for t, q in zip([0, 0, 1, 2, 2, 2], [0, 1, 1, 2, 2, 0])])
    assert [r.support for r in evaluation.per_class(p, classes(spark, 3)).orderBy("class_index").collect()] == [2, 1, 3]


def test_reliability_right_edges_and_empty_bins(spark):
    p = preds(spark, [(1, 0, 0, 0.1), (1, 0, 0, 0.1000001), (1, 0, 1, 1.0)])
    bins = {r.bin: r for r in evaluation.reliability(p).collect()}
    assert [bins[k]["count"] for k in (0, 1, 9, 5)] == [1, 1, 1, 0] and bins[5].gap is None
    assert {r.correct: r["count"] for r in evaluation.confidence_distribution(preds(spark, [(10, 0, 0, 0.9)])).collect()} == {True: 10, False: 0}


def test_group_bootstrap_is_wider(spark):
    rows = [(f"p{g}-{k}", 0, 0 if g % 2 else 1, 0.9, bool(g % 2), f"g{g}", "") for g in range(20) for k in range(5)]
    p = spark.createDataFrame(rows, PRED)

    def width(by_group):
        r = evaluation.bootstrap(p, 0.5, by_group=by_group).where("metric = 'raw_accuracy'").first()
        return r.ci_upper_95 - r.ci_lower_95

    assert width(True) > width(False)
    a, b = (evaluation.bootstrap(p.repartition(n), 0.5).orderBy("metric").collect() for n in (1, 7))
    assert [r.ci_lower_95 for r in a] == pytest.approx([r.ci_lower_95 for r in b])


def test_class_weights(spark):
    w = {r.class_index: r.weight for r in evaluation.class_weights(preds(spark, [(3, 0, 0, 0.9), (1, 1, 1, 0.9)]), classes(spark, 3)).collect()}
    assert w == {0: 4 / 9, 1: 4 / 3, 2: None}


def test_registered_bootstraps_draw_2000(spark, monkeypatch):
    from fieldloom.plans import catalog

    real, draws = F.sequence, []
    monkeypatch.setattr(evaluation.F, "sequence", lambda a, b: draws.append(b) or real(a, b))
    for name in ("bootstrap_ci", "bootstrap_ci_rows"):
        catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert [spark.range(1).select(d.alias("n")).first().n for d in draws] == [2000, 2000]


def test_top_k_reads_every_dimension(spark):
    import numpy as np

    from fieldloom.plans import catalog

    data = "/root/testdata/sf0.001"
    got = {(r["vec_id"], r["index"]): r["probability"] for r in catalog.queries()["top_k_predictions"](spark, data).collect()}
    want = {}
    for r in spark.read.parquet(f"{data}/embeddings.parquet").collect():
        e = np.exp(np.array(r.embedding, float) - max(r.embedding))
        p = e / e.sum()
        want |= {(r.vec_id, int(k)): p[k] for k in np.argsort(-p, kind="stable")[:3]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_units_share_the_values_of_the_resampling_hash():
    """Copies equal the rule that SQL states, at any density; values don't grow with units where these are dense."""
    import numpy as np

    r, low = np.random.default_rng(5), (1 << 32) - 1
    for span, most in ((1 << 32, 60_000), (1 << 12, (1 << 12) + 200)):
        place = np.sort(np.append(r.integers(0, span, 299), span - 1))
        values, begin = evaluation.windows(place, 200, 42)
        assert len(values) <= most
        for k in (0, 7, 150, 299):
            unit = int(place[k]) * pow(evaluation.STRIDE, -1, 1 << 32) & low
            for draw in (1, 2, 99, 200):
                h = (unit * evaluation.MIX[0] + draw * evaluation.MIX[1] + 42) & low
                h = (h ^ h >> 15) * evaluation.MIX[1] & low
                h = (h ^ h >> 13) * evaluation.MIX[2] & low
                h ^= h >> 16
                assert values[begin[k] + draw - 1] == sum(h >= c for c in evaluation.poisson_cuts())


def test_rows_without_a_group_are_in_no_resample(spark):
    """As in SQL, where the hash of a null key is null; its place among others doesn't matter."""
    rows = [(f"p{k}", k % 3, (k + (k % 5 == 0)) % 3, 0.4 + k % 7 / 10, True, f"g{k % 11}", "") for k in range(90)]
    lost = [(f"n{k}", 0, 1, 0.9, False, None, "") for k in range(40)]
    with_lost, without = (evaluation.bootstrap(spark.createDataFrame(x, PRED), 0.5, draws=200, classes=classes(spark, 3)).orderBy("metric").collect() for x in (rows + lost, rows))
    assert with_lost == without and len(without) == 4
