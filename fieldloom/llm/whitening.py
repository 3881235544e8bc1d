"""Whitening of embeddings: an exact centring, a Gramian on the cluster, and a small eigenproblem on the driver.

Entries are fixed-point integers, so the sums S over the fit list are exact and so is ``n * x - S``; only its quotient
by n is rounded, once. Spark MLlib's RowMatrix multiplies the rows so centred (a task sends a matrix of dimension
squared); its Gramian divided by n is the covariance. The driver decomposes that with ``eigh`` and broadcasts the
components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.staging import release, stage

#: Components that are returned, at most.
COMPONENTS = 4
#: Entries are counted in units of 1 / SCALE.
SCALE = 256
_LONG = (1 << 63) - 1
_SCHEMA = "vec_id string, component int, n long, deviation long, whitened double, explained double"


def _largest(x: np.ndarray) -> int:
    """The largest magnitude among whole numbers."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


@dataclass(frozen=True)
class Whitening:
    """What is broadcast: ``n`` fitted vectors, their exact sums, unit components and their eigenvalues, the greatest first."""

    n: int
    sums: np.ndarray
    components: np.ndarray | None = None  # (dimension, k)
    eigenvalues: np.ndarray | None = None
    trace: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exactly: as longs, or as Python integers where longs could overflow."""
        if self.n * _largest(x) + _largest(self.sums) <= _LONG:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def rows(self, x: np.ndarray) -> np.ndarray:
        """The centred rows ``x - S / n``."""
        return (self.centred(x) / self.n).astype(np.float64)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components, over the root of the eigenvalue; NaN where a component has no variance."""
        root = np.sqrt(np.where(self.varies, self.eigenvalues, np.nan))
        return self.rows(x) @ self.components / root

    @property
    def varies(self) -> np.ndarray:
        """Which eigenvalues are more than rounding."""
        return self.eigenvalues > self.trace * len(self.sums) * np.finfo(float).eps

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace if self.trace > 0 else np.full(len(self.eigenvalues), np.nan)


def deviations(centred: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row; null where that is no long."""
    if centred.dtype != object and _largest(centred) ** 2 * centred.shape[1] <= _LONG:
        return (centred * centred).sum(axis=1).tolist()
    exact = [sum(v * v for v in r.tolist()) for r in centred]
    return [v if v <= _LONG else None for v in exact]


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_list()).astype(np.int64, copy=False)


def entries(vectors: DataFrame) -> DataFrame:
    """``(vec_id, x)``: the fixed-point vectors of rows whose vector is whole; the id as text."""
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return vectors.where(F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("string").alias("vec_id"), x.alias("x"))


def _dimension(rows: DataFrame) -> int:
    """The most frequent length of a vector, the greater one of two as frequent; zero without rows."""
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return sizes["d"] if sizes else 0


def _totals(distinct: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """The number of rows and their exact sums by dimension; a task sends a row for each dimension."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = 0, np.zeros(d, object)
        for f in frames:
            if len(f):
                x = _matrix(f["x"])
                n += len(x)
                sums = sums + (x.sum(axis=0) if _largest(x) * len(x) <= _LONG else x.astype(object).sum(axis=0)).astype(object)
        yield pd.DataFrame({"k": range(-1, d), "s": [Decimal(int(v)) for v in (n, *sums)]})

    parts = distinct.mapInPandas(run, "k int, s decimal(38,0)").groupBy("k").agg(F.sum("s").alias("s")).collect()
    of = {r["k"]: int(r["s"]) for r in parts}
    return of[-1], np.array([of[k] for k in range(d)], object)


def fit(distinct: DataFrame, d: int, most: int = COMPONENTS) -> Whitening:
    """The whitening of ``distinct(x)``, of which every row counts once; ``d`` is the length of all its vectors."""
    n, sums = _totals(distinct, d)
    plain = Whitening(n, sums)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"row": list(plain.rows(_matrix(f["x"])))})

    centred = distinct.mapInPandas(run, "row array<double>").select(array_to_vector("row").alias("row"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "row"), n, d).computeGramianMatrix().toArray()
    covariance = (gram + gram.T) / (2 * n)
    e, u = np.linalg.eigh(covariance)
    first = np.argsort(-e, kind="stable")[: min(most, d)]
    return Whitening(n, sums, u[:, first], np.maximum(e[first], 0.0), float(np.trace(covariance)))


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the whitened fit list's covariance minus the identity, over components with variance; null without any."""
    some = np.flatnonzero(model.varies)
    if not len(some):
        return None
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(some), len(some)))
        for f in frames:
            if len(f):
                w = shared.value.whiten(_matrix(f["x"]))[:, some]
                total += w.T @ w
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    cells = distinct.mapInPandas(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return max(abs(r["s"] / model.n - (r["i"] == r["j"])) for r in cells)


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """A row per whole vector of ``vectors(vec_id, embedding)`` and component, up to ``most`` of them.

    Columns: ``vec_id, component, n, deviation, whitened, explained, identity_error``. The fit list has every distinct
    fixed-point vector once, so copies weigh nothing.

    Null vectors and vectors with a null or non-finite entry are dropped, and so are those of another length than most
    have. Null vec_id: kept. Repeated rows and ties: each row gives its own rows. A component without variance (equal
    vectors, fewer vectors than components): ``whitened`` is null, and ``identity_error`` is over the others, null
    without any; ``explained`` is null if no component varies. ``deviation`` is null where it exceeds a long. Empty
    table: no rows. Columns besides the two are not read. The eigenproblem is the driver's: dimensions up to a few thousand.
    """
    spark = vectors.sparkSession
    rows = entries(vectors)
    d = _dimension(rows)
    if not d:
        return spark.createDataFrame([], f"{_SCHEMA.replace('vec_id string', 'vec_id long')}, identity_error double")
    rows = rows.where(F.size("x") == d)
    distinct = stage(rows.select("x").distinct(), "fit-list")
    model = fit(distinct, d, most)
    error = identity_error(distinct, model)
    release(distinct)
    shared = spark.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        k = len(m.eigenvalues)
        for f in frames:
            if not len(f):
                continue
            x = _matrix(f["x"])
            deviation = pd.Series(deviations(m.centred(x)), dtype=object)
            yield pd.DataFrame(
                {
                    "vec_id": f["vec_id"].repeat(k).to_numpy(),
                    "component": np.tile(np.arange(1, k + 1), len(x)),
                    "n": m.n,
                    "deviation": deviation.repeat(k).to_numpy(),
                    "whitened": m.whiten(x).ravel(),
                    "explained": np.tile(m.explained, len(x)),
                }
            )

    out = rows.mapInPandas(run, _SCHEMA)
    return out.withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("identity_error", F.lit(error).cast("double"))
