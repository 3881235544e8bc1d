"""Stored values that a stream increments: an idempotent keyed merge.

A store is a folder of bucket tables. A batch of increments is summed by key, and only the buckets that it touches are
rewritten, each into a folder of the batch's own. The batch takes effect by one small file, its commit, which names for every
bucket the folder that holds it and for every stream its last batch; it is renamed into place, so readers see all
of a batch or nothing. A batch that is run again after its commit changes nothing, and one that was torn before it is
written anew over its own folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import commits

_COMMITS = "commits"


@dataclass(frozen=True)
class Commit:
    """The state of a store: its number, the folder of each bucket that has rows, and the last batch of each stream."""

    number: int = 0
    folders: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class Counters:
    """A store of ``(key, value)`` with ``buckets`` bucket tables; a bucket is what an increment of one key rewrites."""

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str = "bigint", value: str = "value", buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.kind, self.value, self.buckets = spark, path.rstrip("/"), key, kind, value, buckets
        self._schema = f"{key} {kind}, {value} bigint"

    # ---------------------------------------------------------------------------------------------- commits

    def state(self) -> Commit:
        """The last commit; the one of a new store has no rows."""
        found = commits.last(self.spark, f"{self.path}/{_COMMITS}")
        return Commit(found[0], **found[1]) if found else Commit()

    def _commit(self, c: Commit) -> None:
        commits.put(self.spark, f"{self.path}/{_COMMITS}", c.number, {"folders": c.folders, "batches": c.batches})

    # --------------------------------------------------------------------------------------------- contents

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast(self.kind)), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self._schema)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], self._schema)

    def values(self) -> DataFrame:
        """``(key, value)`` as of the last commit."""
        return self._read([f"{self.path}/{f}" for f in self.state().folders.values()])

    def get(self, key) -> int | None:
        """The stored value of a key: one bucket is read."""
        one = self.spark.createDataFrame([(key,)], f"{self.key} {self.kind}")
        folder = self.state().folders.get(str(one.select(self._bucket()).first()[0]))
        row = self._read([f"{self.path}/{folder}"]).where(F.col(self.key) == F.lit(key)).first() if folder else None
        return row[self.value] if row else None

    def merge(self, increments: DataFrame, batch: int, stream: str = "", by: Column | None = None) -> bool:
        """Add the rows of ``increments`` to their keys, ``by`` each (one); False if the stream's batch is in already.

        Rows with a null key are no increments. Increments are summed before the exchange, so a hot key is a row a task.
        """
        was = self.state()
        if was.batches.get(stream, -1) >= batch:
            return False
        step = F.lit(1) if by is None else by
        sums = increments.where(F.col(self.key).isNotNull()).groupBy(F.col(self.key).cast(self.kind).alias(self.key)).agg(F.sum(step).cast("bigint").alias(self.value))
        sums = sums.withColumn("bucket", self._bucket()).persist()
        try:
            touched = sorted(r[0] for r in sums.select("bucket").distinct().collect())
            folders = dict(was.folders)
            if touched:
                home = f"batch-{was.number + 1:012d}"
                stored = self._read([f"{self.path}/{folders[str(k)]}" for k in touched if str(k) in folders]).withColumn("bucket", self._bucket())
                new = stored.unionByName(sums).groupBy("bucket", self.key).agg(F.sum(self.value).alias(self.value))
                new.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{home}")
                folders |= {str(k): f"{home}/bucket={k}" for k in touched}
        finally:
            sums.unpersist()
        self._commit(Commit(was.number + 1, folders, was.batches | {stream: batch}))
        return True

    def vacuum(self) -> int:
        """Delete the commits but the last, and the bucket tables that it doesn't name; returns how many of these."""
        fs, path = commits.files(self.spark, self.path)
        held, gone = set(self.state().folders.values()), 0
        for s in fs.globStatus(path(f"{self.path}/batch-*/bucket=*")) or []:
            p = s.getPath()
            if f"{p.getParent().getName()}/{p.getName()}" not in held:
                gone += fs.delete(p, True)
        commits.trim(self.spark, f"{self.path}/{_COMMITS}")
        return gone


def follow(events: DataFrame, store: Counters, checkpoint: str, stream: str = "", by: Column | None = None) -> None:
    """Merge all that a stream holds now into a store, a micro-batch at a time."""

    def put(batch: DataFrame, k: int) -> None:
        store.merge(batch, k, stream, by)

    events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
