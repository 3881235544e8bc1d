"""The bootstrap with exactly as many draws as there are units, as a multinomial over what units look like.

A metric of a resample depends on its units' counts alone, so units with the same counts are one kind: resampling n units
with replacement is one multinomial draw of n over the kinds. That is split by a tree of conditional binomials, first over
BUCKETS buckets of kinds, then, where a bucket's kinds are, over chunks and single kinds. Every split adds up to what was
split, so every resample has exactly n units. The streams of random numbers belong to buckets and chunks of the kinds' own
order, so results don't depend on partitions.

Rows come in at most classes squared times two kinds, whatever the input; groups in as many as have different counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.evaluation import intervals
from fieldloom.staging import stage

BUCKETS, CHUNK = 256, 512
_T, _P = "true_class_index", "predicted_class_index"
#: The cell that counts units.
UNITS = -1


def scatter(m: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """``m`` of each draw over ``weights``, a row for each draw: a tree that halves the weights, a binomial at each node."""
    out = np.zeros((len(m), len(weights)), np.int64)
    total = np.r_[0, np.cumsum(weights)]
    todo = [(0, len(weights), m)]
    while todo:
        i, j, m = todo.pop()
        if j - i == 1:
            out[:, i] = m
        elif j > i:
            k = (i + j) // 2
            whole = total[j] - total[i]
            left = rng.binomial(m, (total[k] - total[i]) / whole) if whole else np.zeros_like(m)
            todo += [(i, k, left), (k, j, m - left)]
    return out


def _stream(seed: int, *place: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *place])))


def kinds(preds: DataFrame, threshold: float, by_group: bool = True) -> DataFrame:
    """``(bucket, kind, units)``: how many units have the counts ``kind``, an array of (true, predicted, rows, accepted)."""
    accepted = F.count_if(F.col("maximum_probability") >= threshold)
    cell = lambda n, acc: F.struct(F.col(_T).cast("int").alias("t"), F.col(_P).cast("int").alias("p"), n.cast("long").alias("n"), acc.cast("long").alias("acc"))
    if by_group:
        cells = preds.groupBy("group_key", _T, _P).agg(F.count(F.lit(1)).alias("n"), accepted.alias("acc"))
        units = cells.groupBy("group_key").agg(F.sort_array(F.collect_list(cell(F.col("n"), F.col("acc")))).alias("kind"))  # classes squared at most
        counts = units.groupBy("kind").agg(F.count(F.lit(1)).alias("units"))
    else:
        hit = (F.col("maximum_probability") >= threshold).cast("long")
        rows = preds.groupBy(_T, _P, hit.alias("acc")).agg(F.count(F.lit(1)).alias("units"))
        counts = rows.select(F.array(cell(F.lit(1), F.coalesce("acc", F.lit(0)))).alias("kind"), "units").groupBy("kind").agg(F.sum("units").alias("units"))
    return counts.select(F.pmod(F.xxhash64("kind"), F.lit(BUCKETS)).cast("int").alias("bucket"), "kind", "units")


def resampled_cells(of: DataFrame, draws: int = 2000, seed: int = 42) -> DataFrame:
    """``(true_class_index, predicted_class_index, n, acc)``: arrays of counts by draw; cell (UNITS, UNITS) counts units.

    ``of`` is what ``kinds`` gives, staged. BUCKETS counts reach the driver, and their split, draws by buckets, is broadcast.
    """
    sizes = np.zeros(BUCKETS, np.int64)
    for r in of.groupBy("bucket").agg(F.sum("units").alias("n")).collect():
        sizes[r["bucket"]] = r["n"]
    dealt = scatter(np.full(draws, sizes.sum(), np.int64), sizes, _stream(seed))
    shared = of.sparkSession.sparkContext.broadcast((dealt, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt, sizes = shared.value
        cells: dict[tuple[int, int], np.ndarray] = {}
        held: list[tuple[list, int]] = []
        bucket, chunk, left, rest = None, 0, np.zeros(0, np.int64), 0

        def close() -> None:
            """Deal a chunk of kinds what it gets of what is left of its bucket."""
            nonlocal held, chunk, left, rest
            rng, weights = _stream(seed, bucket + 1, chunk), np.array([n for _, n in held], np.int64)
            own = left if weights.sum() == rest else rng.binomial(left, weights.sum() / rest)
            copies = scatter(own, weights, rng).astype(np.float64)
            places = sorted({(c["t"], c["p"]) for kind, _ in held for c in kind})
            at = {c: k for k, c in enumerate(places)}
            per = np.zeros((len(held), 2 * len(places)))
            for k, (kind, _) in enumerate(held):
                for c in kind:
                    per[k, 2 * at[c["t"], c["p"]] + np.arange(2)] += c["n"], c["acc"]
            sums = np.rint(copies @ per).astype(np.int64)
            for c, k in at.items():
                cells[c] = cells.get(c, 0) + sums[:, 2 * k : 2 * k + 2]
            cells[UNITS, UNITS] = cells.get((UNITS, UNITS), 0) + np.repeat(own[:, None], 2, axis=1)
            left, rest, held, chunk = left - own, rest - weights.sum(), [], chunk + 1

        for b in batches:
            for k, kind, n in zip(*(c.to_pylist() for c in b.columns)):
                if k != bucket:
                    if held:
                        close()
                    bucket, chunk, left, rest = k, 0, dealt[:, k], sizes[k]
                held.append((kind, n))
                if len(held) == CHUNK:
                    close()
        if held:
            close()
        if cells:
            t, p = zip(*cells)
            arrays = [pa.array([x[:, k] for x in cells.values()], pa.list_(pa.int64())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(p, pa.int32()), *arrays], [_T, _P, "n", "acc"])

    rows = of.repartition("bucket").sortWithinPartitions("bucket", "kind").select("bucket", "kind", "units")
    return rows.mapInArrow(run, f"{_T} int, {_P} int, n array<long>, acc array<long>")


def bootstrap(preds: DataFrame, threshold: float, draws: int = 2000, seed: int = 42, by_group: bool = True, classes: DataFrame | None = None) -> DataFrame:
    """Mean and 95% interval of four metrics over resamples of exactly as many groups, or rows, as there are.

    Null group keys are one group. Rows with a null probability are never accepted. Columns as of ``evaluation.bootstrap``.
    """
    cells = resampled_cells(stage(kinds(preds, threshold, by_group), "kinds"), draws, seed)
    return intervals(cells.where(F.col(_T) != UNITS), preds, draws, classes)


def units_drawn(preds: DataFrame, draws: int = 2000, seed: int = 42, by_group: bool = True) -> DataFrame:
    """``(draw, units)``: how many units each resample has."""
    cells = resampled_cells(stage(kinds(preds, 0.5, by_group), "kinds"), draws, seed).where(F.col(_T) == UNITS)
    return cells.select(F.posexplode("n").alias("at", "n")).groupBy((F.col("at") + 1).cast("long").alias("draw")).agg(F.sum("n").alias("units"))
