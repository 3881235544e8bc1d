"""Statistical evaluation of classifier predictions.

Predictions have true_class_index, predicted_class_index, maximum_probability, correct, group_key and
similarity_guard_group. Threshold metrics are computed from counts of (grid step, true, predicted), at most
51 times classes squared rows, however many predictions there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions import scalars
from fieldloom.staging import stage

# The candidate grid and the mandatory rules.
GRID = [(50 + k) / 100 for k in range(50)]
RULES = {"accuracy": 0.99, "coverage": 0.90, "class_coverage": 0.80, "class_accepted": 15}

_T, _P = "true_class_index", "predicted_class_index"


def _n(c: Column) -> Column:
    return F.coalesce(F.count_if(c), F.lit(0))


def confusion(preds: DataFrame, classes: DataFrame) -> DataFrame:
    """Counts of all (true, predicted) pairs of classes, zeros included."""
    cells = preds.groupBy(_T, _P).agg(F.count(F.lit(1)).alias("n"))
    dim = classes.select(F.col("class_index").alias(_T)).crossJoin(classes.select(F.col("class_index").alias(_P)))  # classes squared
    return dim.join(cells, [_T, _P], "left").select(_T, _P, F.coalesce("n", F.lit(0)).alias("n"))


def per_class(preds: DataFrame, classes: DataFrame) -> DataFrame:
    """Precision, recall, F1 (zero where undefined) and support of every class."""
    cells = confusion(preds, classes)
    side = F.explode(F.array(F.struct(F.col(_T).alias("class_index"), F.lit(1).alias("t")), F.struct(F.col(_P).alias("class_index"), F.lit(0).alias("t"))))
    flat = cells.select("n", (F.col(_T) == F.col(_P)).alias("hit"), side.alias("s")).select("n", "hit", "s.*")
    g = flat.groupBy("class_index").agg(F.sum(F.when(F.col("t") == 1, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("t") == 0, F.col("n")).otherwise(0)).alias("predicted"), F.sum(F.when(F.col("hit") & (F.col("t") == 1), F.col("n")).otherwise(0)).alias("tp"))
    g = g.join(classes, "class_index")
    return g.select("class_index", "class_name", "support", scalars.ratio0(F.col("tp"), F.col("predicted")).alias("precision"), scalars.ratio0(F.col("tp"), F.col("support")).alias("recall"), scalars.ratio0(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "predicted")


def macro(metrics: DataFrame, present_only: bool = True) -> DataFrame:
    """Accuracy, macro and weighted averages; over classes that occur as true or predicted, or over all."""
    used = metrics.where((F.col("support") > 0) | (F.col("predicted") > 0)) if present_only else metrics
    total = F.sum("support")
    return used.agg(
        scalars.ratio(F.sum(F.round(F.col("recall") * F.col("support"))), total).alias("accuracy"),
        F.round(F.avg("precision"), 6).alias("macro_precision"),
        F.round(F.avg("recall"), 6).alias("macro_recall"),
        F.round(F.avg("f1"), 6).alias("macro_f1"),
        F.round(F.sum(F.col("f1") * F.col("support")) / total, 6).alias("weighted_f1"),
    )


def class_weights(preds: DataFrame, classes: DataFrame) -> DataFrame:
    """Inverse-frequency weights; classes without rows count zero and have none."""
    n = preds.groupBy(F.col(_T).alias("class_index")).agg(F.count(F.lit(1)).alias("n"))
    n = classes.join(n, "class_index", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    every = W.partitionBy()
    return n.select("class_index", "class_name", "n", scalars.ratio(F.sum("n").over(every), F.count(F.lit(1)).over(every) * F.col("n")).alias("weight"))  # one row per class


def _cells(preds: DataFrame, grid: list[float]) -> DataFrame:
    """Accepted and all counts of (grid place, true, predicted), summed from counts by the number of thresholds reached."""
    reached = F.lit(0)
    for t in grid:
        reached = reached + F.when(F.col("maximum_probability") >= t, 1).otherwise(0)
    counts = preds.groupBy(reached.alias("reached"), _T, _P).agg(F.count(F.lit(1)).alias("n"))
    wide = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("place"))
    return wide.groupBy("place", _T, _P).agg(F.sum(F.when(F.col("reached") > F.col("place"), F.col("n")).otherwise(0)).alias("accepted"), F.sum("n").alias("total"))


def _threshold_table(preds: DataFrame, classes: DataFrame, grid: list[float]) -> DataFrame:
    """Per threshold and class, from one pass over the predictions: counts as true class and as predicted one."""
    hit = F.col(_T) == F.col(_P)
    side = F.explode(F.array(F.struct(F.col(_T).alias("class_index"), F.lit(True).alias("true")), F.struct(F.col(_P).alias("class_index"), F.lit(False).alias("true"))))
    flat = _cells(preds, grid).select("place", "total", "accepted", hit.alias("hit"), side.alias("s")).select("place", "total", "accepted", "hit", "s.*")
    only = lambda c, x: F.sum(F.when(c, F.col(x)).otherwise(0))
    true, right = F.col("true"), F.col("true") & F.col("hit")
    g = flat.groupBy("place", "class_index").agg(only(true, "total").alias("total"), only(true, "accepted").alias("accepted"), only(right, "accepted").alias("tp"), only(~true, "accepted").alias("predicted"), only(right, "total").alias("right"))
    dim = classes.select("class_index", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("place"))
    j = dim.join(g, ["place", "class_index"], "left").na.fill(0)
    t = F.get(F.array(*map(F.lit, grid)), F.col("place"))
    tp, n, p = F.col("tp"), F.col("accepted"), F.col("predicted")
    return j.select(t.alias("threshold"), "class_index", "total", "accepted", scalars.ratio(n, F.col("total")).alias("coverage"), scalars.ratio(tp, n).alias("accuracy"), scalars.ratio0(tp, p).alias("precision"), scalars.ratio0(tp, n).alias("recall"), scalars.ratio0(2 * tp, p + n).alias("f1"), "tp", "right")


def threshold_classes(preds: DataFrame, classes: DataFrame, grid: list[float] = GRID) -> DataFrame:
    """Per threshold and class: counts, coverage, accuracy, and F1 among accepted rows."""
    return _threshold_table(preds, classes, grid).drop("right")


def threshold_sweep(preds: DataFrame, classes: DataFrame, grid: list[float] = GRID) -> DataFrame:
    """Metrics of every threshold, and whether the mandatory rules hold."""
    c = _threshold_table(preds, classes, grid)
    g = c.groupBy("threshold").agg(
        F.sum("total").alias("total"), F.sum("accepted").alias("accepted"), F.sum("tp").alias("hits"), F.sum("right").alias("correct"), F.avg("precision").alias("p"), F.avg("recall").alias("r"), F.avg("f1").alias("f"),
        _n(F.col("accepted") == 0).alias("zero_support"), F.min(F.coalesce("coverage", F.lit(-1.0))).alias("least_coverage"), F.min("accepted").alias("least_accepted"),
    )
    g = g.withColumn("errors", F.col("total") - F.col("correct"))
    n, hits = F.col("accepted"), F.col("hits")
    some = lambda x: F.when(n > 0, F.round(x, 6))
    accuracy, coverage = scalars.ratio(hits, n), scalars.ratio0(n, F.col("total"))
    passes = F.coalesce(accuracy >= RULES["accuracy"], F.lit(False)) & (coverage >= RULES["coverage"]) & (F.col("zero_support") == 0) & (F.col("least_coverage") >= RULES["class_coverage"]) & (F.col("least_accepted") >= RULES["class_accepted"])
    return g.select(
        "threshold", F.col("total").alias("total_samples"), n.alias("accepted_count"), (F.col("total") - n).alias("rejected_count"), coverage.alias("coverage"), accuracy.alias("selective_accuracy"),
        some(F.col("p")).alias("selective_macro_precision"), some(F.col("r")).alias("selective_macro_recall"), some(F.col("f")).alias("selective_macro_f1"), (n - hits).alias("accepted_errors"),
        scalars.ratio(F.col("errors") - (n - hits), F.col("errors")).alias("error_rejection_rate"), scalars.ratio(F.col("correct") - hits, F.col("correct")).alias("correct_rejection_rate"),
        F.col("zero_support").alias("classes_without_support"), passes.alias("passes"),
    )


def selected(sweep: DataFrame) -> DataFrame:
    """The passing threshold of greatest coverage, then greatest macro F1 (null last), then the lowest; no row if none passes."""
    return sweep.where("passes").orderBy(F.col("coverage").desc(), F.coalesce("selective_macro_f1", F.lit(-1.0)).desc(), "threshold").limit(1)


def pareto(sweep: DataFrame) -> DataFrame:
    """Thresholds that no other beats in coverage and selective accuracy (50 rows on each side)."""
    c = sweep.where("selective_accuracy is not null").select("threshold", "coverage", "selective_accuracy", "selective_macro_f1")
    o = c.select(F.col("coverage").alias("oc"), F.col("selective_accuracy").alias("oa"))
    better = (F.col("oc") >= F.col("coverage")) & (F.col("oa") >= F.col("selective_accuracy")) & ((F.col("oc") > F.col("coverage")) | (F.col("oa") > F.col("selective_accuracy")))
    return c.join(F.broadcast(o), better, "left_anti")


def reliability(preds: DataFrame, bins: int = 10) -> DataFrame:
    """Count, mean confidence, accuracy and their gap in each bin; empty bins have nulls."""
    p, ok = F.col("maximum_probability"), F.col("correct").cast("int")
    g = preds.groupBy(scalars.bin_right(p, bins).alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.round(F.avg(p), 9).alias("avg_confidence"), F.avg(ok).alias("avg_accuracy"))
    every = preds.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(g, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"), "avg_confidence", "avg_accuracy", F.round(F.abs(F.col("avg_confidence") - F.col("avg_accuracy")), 9).alias("gap"))


def calibration(preds: DataFrame, bins: int = 10) -> DataFrame:
    """Expected and greatest calibration error and the Brier score."""
    b = reliability(preds, bins)
    errors = b.agg(F.round(F.sum(F.col("count") * F.col("gap")) / F.sum("count"), 6).alias("ece"), F.round(F.coalesce(F.max("gap"), F.lit(0.0)), 6).alias("mce"))
    d = F.col("maximum_probability") - F.col("correct").cast("int")
    return errors.crossJoin(preds.agg(F.round(F.avg(d * d), 6).alias("brier")))  # single rows


def _medians(preds: DataFrame, key: str, value: str, ranges: int = 4096) -> DataFrame:
    """The median of values in [0, 1] for each key: counts of ranges find where it lies, and only that range is sorted."""
    place = F.least(F.greatest(F.floor(F.col(value) * ranges), F.lit(0)), F.lit(ranges - 1))
    rows = preds.where(F.col(value).isNotNull()).select(key, F.col(value).alias("v"), place.alias("range"))
    counts = rows.groupBy(key, "range").agg(F.count(F.lit(1)).alias("n"))
    own = W.partitionBy(key)  # ranges of a key at most
    counts = counts.select(key, "range", (F.sum("n").over(own.orderBy("range")) - F.col("n")).alias("before"), "n", F.sum("n").over(own).alias("of"))
    low, high = F.floor((F.col("of") - 1) / 2), F.floor(F.col("of") / 2)
    meets = (F.col("before") <= high) & (F.col("before") + F.col("n") > low)
    mid = F.broadcast(counts.where(meets).select(key, "range", "before", low.alias("low"), high.alias("high")))  # two rows of a key at most
    same = rows.join(mid, [key, "range"]).groupBy(key, "range", "before", "low", "high", "v").agg(F.count(F.lit(1)).alias("c"))
    at = F.col("before") + F.sum("c").over(W.partitionBy(key, "range").orderBy("v"))
    placed = same.withColumn("end", at).withColumn("begin", F.col("end") - F.col("c"))
    holds = lambda r: F.max(F.when((F.col("begin") <= F.col(r)) & (F.col("end") > F.col(r)), F.col("v")))
    return placed.groupBy(key).agg(((holds("low") + holds("high")) / 2).alias("median"))


def confidence_distribution(preds: DataFrame) -> DataFrame:
    """Count, mean, least, greatest and median confidence of correct and of wrong rows; nulls where there are none."""
    p = F.col("maximum_probability")
    g = preds.groupBy("correct").agg(F.count(F.lit(1)).alias("count"), F.round(F.avg(p), 9).alias("mean"), F.min(p).alias("min"), F.max(p).alias("max"))
    both = preds.sparkSession.createDataFrame([(True,), (False,)], "correct boolean")
    return both.join(g, "correct", "left").join(_medians(preds, "correct", "maximum_probability"), "correct", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def error_pairs(preds: DataFrame, classes: DataFrame) -> DataFrame:
    """How often each wrong pair of classes occurs."""
    name = lambda key, alias: F.broadcast(classes.select(F.col("class_index").alias(key), F.col("class_name").alias(alias)))
    n = preds.where(~F.col("correct")).groupBy(_T, _P).agg(F.count(F.lit(1)).alias("count"))
    return n.join(name(_T, "t"), _T).join(name(_P, "p"), _P).select(F.concat("t", F.lit(" -> "), "p").alias("pair"), "count")


def extremes(preds: DataFrame, n: int = 10) -> DataFrame:
    """The n least confident correct and the n most confident wrong rows, ties by path."""
    cols = ["path", _T, _P, "maximum_probability", "group_key"]
    low = preds.where("correct").orderBy("maximum_probability", "path").limit(n).select(F.lit("lowest_correct").alias("kind"), *cols)
    high = preds.where(~F.col("correct")).orderBy(F.col("maximum_probability").desc(), "path").limit(n).select(F.lit("highest_wrong").alias("kind"), *cols)
    return low.unionByName(high)


def class_errors(preds: DataFrame, classes: DataFrame) -> DataFrame:
    """Errors of every true class, zeros included."""
    n = preds.where(~F.col("correct")).groupBy(F.col(_T).alias("class_index")).agg(F.count(F.lit(1)).alias("errors"))
    return classes.join(n, "class_index", "left").select("class_name", F.coalesce("errors", F.lit(0)).alias("errors"))


def enriched(preds: DataFrame, manifest: DataFrame, threshold: float | None = None) -> DataFrame:
    """Predictions with the group and guard of their path in the manifest, and whether a threshold accepts them."""
    meta = manifest.select("path", "group_key", "similarity_guard_group")
    out = preds.drop("group_key", "similarity_guard_group").join(meta, "path")
    return out if threshold is None else out.withColumn("accepted", F.col("maximum_probability") >= threshold)


def weighted_loss(batches: DataFrame) -> DataFrame:
    """Mean loss of each run over its batches (run, loss, n), each by its size."""
    return batches.groupBy("run").agg(scalars.ratio(F.sum(F.col("loss") * F.col("n")), F.sum("n")).alias("loss"), F.sum("n").alias("n"))


def error_groups(preds: DataFrame) -> DataFrame:
    """Groups with more than one error."""
    return preds.where(~F.col("correct")).groupBy("group_key").agg(F.count(F.lit(1)).alias("errors")).where("errors > 1")


def inconsistent_guards(preds: DataFrame) -> DataFrame:
    """Guards whose rows are partly right and partly wrong."""
    g = preds.where("similarity_guard_group <> ''").groupBy("similarity_guard_group").agg(_n("correct").alias("right"), _n(~F.col("correct")).alias("wrong"))
    return g.where("right > 0 and wrong > 0")


def accepted_correct(preds: DataFrame, threshold: float) -> DataFrame:
    """Rows by acceptance and correctness."""
    return preds.groupBy((F.col("maximum_probability") >= threshold).alias("accepted"), "correct").agg(F.count(F.lit(1)).alias("n"))


def best_epoch(epochs: DataFrame) -> DataFrame:
    """After each epoch of a run (run, epoch, f1, loss): the best so far (F1, then lower loss, then earlier) and the epochs since."""
    w = W.partitionBy("run").orderBy("epoch").rowsBetween(W.unboundedPreceding, W.currentRow)
    best = F.max(F.struct("f1", (-F.col("loss")).alias("l"), (-F.col("epoch")).alias("e"))).over(w)
    out = epochs.select("run", "epoch", (-best["e"]).alias("best_epoch"))
    return out.withColumn("waited", F.col("epoch") - F.col("best_epoch"))


# Fixed values of the resampling hash: multipliers of a 32-bit finaliser.
MIX = (2654435761, 2246822519, 3266489917)


def poisson_cuts() -> list[int]:
    """Places in 0 .. 2^32 from which on a hash means one copy more: a Poisson(1) number of copies."""
    out, tail, term = [], 0.0, 1 / 2.718281828459045
    for k in range(1, 10):
        tail += term
        out.append(round(tail * (1 << 32)))
        term /= k
    return out


#: What takes a unit's hash to its place: there, a unit's copies in consecutive draws lie one after the other.
STRIDE = MIX[0] * pow(MIX[1], -1, 1 << 32) % (1 << 32)


def place_of(unit: Column) -> Column:
    """Where a unit (a 32-bit hash) is: ``unit`` times STRIDE modulo 2^32, in halves so that no product overflows."""
    high = (unit * (STRIDE >> 16)).bitwiseAND(0xFFFF)
    return (high * (1 << 16) + unit * (STRIDE & 0xFFFF)).bitwiseAND(0xFFFFFFFF)


def _coarse_copies() -> np.ndarray:
    """Copies by the upper 16 bits of a hash; -1 where a cut lies within."""
    cuts = np.array(poisson_cuts(), np.uint64)
    low, high = (np.searchsorted(cuts, (np.arange(1 << 16, dtype=np.uint64) << np.uint64(16)) + np.uint64(x), side="right") for x in (0, 0xFFFF))
    return np.where(low == high, low, -1).astype(np.int8)


_COARSE = _coarse_copies()


def copies(at: np.ndarray, seed: int, step: int = 1 << 15) -> np.ndarray:
    """Copies at places plus draws ``at`` (32 bits unsigned): those of a unit in draw k are at its place plus k."""
    out, cuts = np.empty(len(at), np.int8), np.array(poisson_cuts(), np.uint32)
    for k in range(0, len(at), step):
        x = at[k : k + step] * np.uint32(MIX[1])
        x += np.uint32(seed % (1 << 32))
        for shift, m in ((15, MIX[1]), (13, MIX[2])):
            x ^= x >> np.uint32(shift)
            x *= np.uint32(m)
        x ^= x >> np.uint32(16)
        found = _COARSE.take(x >> np.uint32(16))
        near = np.flatnonzero(found < 0)
        found[near] = np.searchsorted(cuts, x[near], side="right")
        out[k : k + step] = found
    return out


def windows(place: np.ndarray, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The copies of units in ascending places: one row of values, and where in it each unit's ``draws`` values begin.

    Values that units share are made once, so there are 2^32 and ``draws`` for each end of a run, however many units.
    """
    begin = np.r_[0, np.cumsum(np.minimum(np.diff(place), draws))].astype(np.int64)
    at = np.repeat((place - begin + 1).astype(np.uint32), np.diff(np.r_[begin, begin[-1] + draws]))
    at += np.arange(len(at), dtype=np.uint32)
    return copies(at, seed), begin


def bootstrap(preds: DataFrame, threshold: float, draws: int = 2000, seed: int = 42, by_group: bool = True, classes: DataFrame | None = None) -> DataFrame:
    """Mean and 95% interval of four metrics over resamples of groups or of rows.

    Each unit has a Poisson(1) number of copies in each resample, from a hash of unit and draw: the distributed
    form of the bootstrap, the same whatever the partitioning. It stands for draws of as many units with replacement;
    the number of units then varies from draw to draw, which the ratios take out. Units are counted first, then dealt
    by ranges of their places and sorted, so that neighbours share the values of the hash; a task
    adds its units' counts to one array of draws for each cell (true, predicted), so that only cells times draws
    leave it. Macro F1 is over all ``classes``; without them, over those that occur as true or predicted.
    Rows without a unit are in no resample.
    """
    unit = F.conv(F.substring(F.md5((F.col("group_key") if by_group else F.col("path")).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    placed = preds.select(place_of(unit).alias("place"), _T, _P, "maximum_probability").where("place is not null")
    sums = placed.groupBy("place", _T, _P).agg(F.count(F.lit(1)).alias("n"), _n(F.col("maximum_probability") >= threshold).alias("acc"))
    dealt = sums.repartition(F.shiftright("place", 18)).sortWithinPartitions("place")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            place, t, p, n, acc = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for k in range(0, len(place), 1024):
                part = slice(k, k + 1024)
                values, begin = windows(place[part], draws, seed)
                each = np.lib.stride_tricks.sliding_window_view(values, draws)
                weights = np.stack([n[part], acc[part]])
                weights = weights.astype(np.float32 if weights[0].sum() < 1 << 20 else np.float64)  # sums are exact in either
                order = np.lexsort((p[part], t[part]))
                ts, ps = t[part][order], p[part][order]
                cuts = np.flatnonzero(np.r_[True, (ts[1:] != ts[:-1]) | (ps[1:] != ps[:-1]), True])
                for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    own, cell = order[i:j], (int(ts[i]), int(ps[i]))
                    found = weights[:, own] @ each[begin[own]].astype(weights.dtype)
                    if cell in cells:
                        cells[cell] += found
                    else:
                        cells[cell] = found.astype(np.float64)
        if cells:
            t, p = zip(*cells)
            lists = [pa.array([np.rint(x[k]).astype(np.int64) for x in cells.values()], pa.list_(pa.int64())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(p, pa.int32()), *lists], [_T, _P, "n", "acc"])

    added = dealt.mapInArrow(add, f"{_T} int, {_P} int, n array<long>, acc array<long>")
    return intervals(added, preds, draws, classes)


def intervals(added: DataFrame, preds: DataFrame, draws: int, classes: DataFrame | None = None) -> DataFrame:
    """Mean and 95% interval of four metrics from ``added``: arrays of ``draws`` counts of cells (true, predicted), all and accepted."""
    zipped = F.arrays_zip(F.sequence(F.lit(1), F.lit(draws)).alias("draw"), "n", "acc")
    each = added.select(_T, _P, F.explode(zipped).alias("x")).select(_T, _P, "x", "x.draw")
    cells = stage(each.groupBy("draw", _T, _P).agg(F.sum("x.n").alias("n"), F.sum("x.acc").alias("acc")), "resampled")  # read twice below, made once
    hit = F.col(_T) == F.col(_P)
    side = F.explode(F.array(F.struct(F.col(_T).alias("c"), F.lit(1).alias("t")), F.struct(F.col(_P).alias("c"), F.lit(0).alias("t"))))
    f1 = cells.select("draw", "n", hit.alias("hit"), side.alias("s")).groupBy("draw", "s.c").agg(F.sum(F.when(F.col("hit") & (F.col("s.t") == 1), 2 * F.col("n")).otherwise(0)).alias("tp2"), F.sum("n").alias("both"))
    known = preds.select(F.explode(F.array(_T, _P)).alias("class_index")).distinct() if classes is None else classes
    size = known.agg(F.count(F.lit(1)).alias("k"))
    f1 = f1.groupBy("draw").agg(F.sum(scalars.ratio0(F.col("tp2"), F.col("both"))).alias("f1")).crossJoin(F.broadcast(size)).select("draw", (F.col("f1") / F.col("k")).alias("raw_macro_f1"))  # one row
    g = cells.groupBy("draw").agg(scalars.ratio(F.sum(F.when(hit, F.col("n")).otherwise(0)), F.sum("n")).alias("raw_accuracy"), scalars.ratio(F.sum(F.when(hit, F.col("acc")).otherwise(0)), F.sum("acc")).alias("thresholded_selective_accuracy"), scalars.ratio(F.sum("acc"), F.sum("n")).alias("thresholded_coverage")).join(f1, "draw")
    names = ["raw_accuracy", "raw_macro_f1", "thresholded_selective_accuracy", "thresholded_coverage"]
    long = g.select(F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in names])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(*[F.round(x, 9).alias(c) for x, c in ((F.avg("value"), "mean_of_resamples"), (F.percentile("value", 0.025), "ci_lower_95"), (F.percentile("value", 0.975), "ci_upper_95"))])
