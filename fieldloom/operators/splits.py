"""Leakage-safe train / validation / test splits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.staging import stage

# Split names in priority order, and their shares.
SPLITS = ["train", "val", "test"]
SHARES = {"train": 0.70, "val": 0.15}


def components(groups: DataFrame, guards: DataFrame) -> DataFrame:
    """Allocation components of ``groups(class_name, group_key, images)``: groups that share a guard go together."""
    joined = groups.join(guards, "group_key", "left")
    cid = F.coalesce("guard_id", "group_key")
    return joined.groupBy("class_name", cid.alias("component_id")).agg(F.sum("images").alias("size"), F.count(F.lit(1)).alias("group_count"))


Pattern = tuple[tuple[int, ...], int]


def deal(left: list[int], held: list[int], size: int, groups: int, count: int) -> list[Pattern]:
    """Deal ``count`` components alike by deficit; returns patterns of splits and how often each repeats, in order.

    ``left`` and ``held``, the images that each split lacks and the groups that it has, are brought up to date. As soon
    as the splits picked so far have been picked equally often, their differences are what they were, so the picks
    repeat until a split that wasn't picked could be; how often that is, is arithmetic. The number of patterns depends
    on the splits, not on ``count``.
    """
    out: list[Pattern] = []
    while count:
        l, g, picks, low = list(left), list(held), [], None
        repeats = 1
        while len(picks) < count:
            k = min(range(3), key=lambda i: (-l[i], g[i], i))
            low = l[k] if low is None else min(low, l[k])
            l[k], g[k] = l[k] - size, g[k] + groups
            picks.append(k)
            times = [picks.count(i) for i in range(3)]
            if len({t for t in times if t}) == 1:
                step = size * max(times)
                others = max((left[i] for i in range(3) if not times[i]), default=None)
                most = count // len(picks)
                if others is not None:
                    most = 0 if low <= others else min(most, (low - others - 1) // step + 1 if step else most)
                if most > 1:
                    repeats = most
                    break
            if len(picks) == 64:
                break
        out.append((tuple(picks), repeats))
        for i in range(3):
            n = picks.count(i) * repeats
            left[i], held[i] = left[i] - n * size, held[i] + n * groups
        count -= len(picks) * repeats
    return out


_ROWS = "class_name string, component_id string, size long, group_count long, part int, run long, place long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted components with the run of equal class, size and groups that each is in, within its partition, and its place there."""
    part, run, place, last = TaskContext.get().partitionId(), -1, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        name, size, groups = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
        new = np.r_[last != (name[0], size[0], groups[0]), (name[1:] != name[:-1]) | (size[1:] != size[:-1]) | (groups[1:] != groups[:-1])]
        first = np.flatnonzero(new)
        runs = run + np.cumsum(new)
        begin = np.full(len(new), -place, np.int64)
        if len(first):
            begin[first[0] :] = np.repeat(first, np.diff(np.r_[first, len(new)]))
        places = np.arange(len(new)) - begin
        run, place, last = int(runs[-1]), int(places[-1]) + 1, (name[-1], size[-1], groups[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(new), part, np.int32)), pa.array(runs), pa.array(places)], ["class_name", "component_id", "size", "group_count", "part", "run", "place"])


def _dealt(runs: pa.Table) -> pa.Table:
    """The runs ``(class_name, part, run, size, group_count, n)`` of one class, in order, with where each pattern begins."""
    runs = runs.sort_by([("part", "ascending"), ("run", "ascending")])
    total = sum(s * n for s, n in zip(runs["size"].to_pylist(), runs["n"].to_pylist()))
    train, val = (round(total * SHARES[k]) for k in ("train", "val"))
    left, held = [train, val, total - train - val], [0, 0, 0]
    out = []
    for part, run, size, groups, n in zip(*(runs[c].to_pylist() for c in ("part", "run", "size", "group_count", "n"))):
        at = 0
        for picks, repeats in deal(left, held, size, groups, n):
            out.append((runs["class_name"][0].as_py(), part, run, at, at + len(picks) * repeats, list(picks)))
            at = out[-1][4]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["class_name", "part", "run", "begin", "end", "picks"])


def allocate(comps: DataFrame, ranges: int | None = None) -> DataFrame:
    """``(class_name, component_id, size, group_count, split)`` by deficit: the largest component first (ties by id),
    each to the split that lacks most images of its share, then the one with fewer groups, then in priority order.

    The order of a class is sequential, but components alike are dealt by arithmetic (``deal``). So components are
    sorted in ranges, a row is left of every run of equal size and groups, the fold of a class sees runs only,
    and each component finds its split by its place in its run. Components are never gathered. ``ranges`` is the number of ranges
    (the session's shuffle partitions where it is None); it changes no result.
    """
    order = ["class_name", F.col("size").desc(), "component_id"]
    rows = comps.select("class_name", F.col("component_id").cast("string").alias("component_id"), F.col("size").cast("long").alias("size"), F.col("group_count").cast("long").alias("group_count"))
    placed = (rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    placed = stage(placed.mapInArrow(_runs, _ROWS), "placed-components")
    key = ["class_name", "part", "run"]
    runs = placed.groupBy(*key, "size", "group_count").agg(F.count(F.lit(1)).alias("n"))
    dealt = stage(runs.groupBy("class_name").applyInArrow(_dealt, "class_name string, part int, run long, begin long, end long, picks array<int>"), "dealt-runs")
    found = placed.join(dealt, key).where((F.col("place") >= F.col("begin")) & (F.col("place") < F.col("end")))
    pick = F.get("picks", F.pmod(F.col("place") - F.col("begin"), F.size("picks")).cast("int"))
    return found.select("class_name", "component_id", "size", "group_count", F.get(F.array(*map(F.lit, SPLITS)), pick).alias("split"))


def summary(allocated: DataFrame, min_images: int = 30, min_groups: int = 15) -> DataFrame:
    """Images and groups of each class and split, their share of the class, and whether the minimums are met."""
    g = allocated.groupBy("class_name", "split").agg(F.sum("size").alias("images"), F.sum("group_count").alias("groups"))
    total = allocated.groupBy("class_name").agg(F.sum("size").alias("total"))
    ok = (F.col("images") >= min_images) & (F.col("groups") >= min_groups)
    return g.join(total, "class_name").select("class_name", "split", "images", "groups", (F.col("images") * 100.0 / F.col("total")).alias("pct"), F.when(ok, "PASS").otherwise("FAIL").alias("status"))


def deviation(allocated: DataFrame) -> DataFrame:
    """How far each class and split is from its share, in percent of the class and in images."""
    share = F.element_at(F.create_map(*[F.lit(x) for kv in {**SHARES, "test": 1 - sum(SHARES.values())}.items() for x in kv]), F.col("split"))
    s = summary(allocated)
    return s.select("class_name", "split", "images", F.round("pct", 2).alias("pct"), F.round(F.col("pct") - share * 100, 2).alias("deviation_pct"))


def component_members(allocated: DataFrame, groups: DataFrame, guards: DataFrame, images: DataFrame) -> DataFrame:
    """The images (path, class_name, group_key) of each allocated component, by its groups: ``(path, component_id, split)``."""
    of = groups.select("class_name", "group_key").distinct().join(guards, "group_key", "left").select("class_name", "group_key", F.coalesce("guard_id", "group_key").alias("component_id"))
    placed = of.join(allocated.select("class_name", "component_id", "split"), ["class_name", "component_id"])
    return images.join(placed, ["class_name", "group_key"]).select("path", "component_id", "split")


def overlaps(rows: DataFrame, kinds: list[str], split: str = "split") -> DataFrame:
    """Values of each kind that occur in more than one split, in one pass: ``(kind, value, splits)``."""
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in kinds]))
    each = rows.select(split, pair.alias("p")).select(split, "p.kind", "p.value").where("value is not null and value <> ''")
    return each.groupBy("kind", "value").agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def pairwise(rows: DataFrame, column: str, split: str = "split") -> DataFrame:
    """How many values each pair of splits shares, from one set of splits per value: ``(pair, shared)``."""
    held = rows.groupBy(column).agg(F.collect_set(split).alias("held"))  # three at most
    pairs = [(a, b) for i, a in enumerate(SPLITS) for b in SPLITS[i + 1 :]]
    both = [F.struct(F.lit(f"{a}_{b}").alias("pair"), F.count_if(F.array_contains("held", a) & F.array_contains("held", b)).alias("shared")) for a, b in pairs]
    return held.agg(F.array(*both).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def shared_values(rows: DataFrame, column: str, split: str = "split") -> DataFrame:
    """``(pair, value)`` for every value that a pair of splits shares."""
    held = rows.groupBy(F.col(column).alias("value")).agg(F.collect_set(split).alias("held"))  # three at most
    pairs = [(a, b) for i, a in enumerate(SPLITS) for b in SPLITS[i + 1 :]]
    both = F.array_compact(F.array(*[F.when(F.array_contains("held", a) & F.array_contains("held", b), f"{a}_{b}") for a, b in pairs]))
    return held.select(F.explode(both).alias("pair"), "value")


def mismatches(expected: DataFrame, actual: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows missing on either side and differing cells: how many of each."""
    e = expected.select(key, F.lit(1).alias("in_e"), *[F.col(c).alias(f"e_{c}") for c in columns])
    a = actual.select(key, F.lit(1).alias("in_a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    both = F.col("in_e").isNotNull() & F.col("in_a").isNotNull()
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    sums = [n(F.col("in_a").isNull()).alias("missing"), n(F.col("in_e").isNull()).alias("unexpected")]
    sums += [n(both & ~F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}"))).alias(f"wrong_{c}") for c in columns]
    return e.join(a, key, "full_outer").agg(*sums)


def reconciliation(considered: int | DataFrame, duplicates: DataFrame, quarantined: DataFrame, rows: DataFrame) -> DataFrame:
    """Whether considered - duplicates - quarantined = rows."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [one(considered, "considered"), one(duplicates, "duplicates"), one(quarantined, "quarantined"), one(rows, "rows")]
    df = reduce(lambda a, b: a.crossJoin(b), parts)  # four single rows
    return df.withColumn("balanced", F.col("considered") - F.col("duplicates") - F.col("quarantined") == F.col("rows"))
