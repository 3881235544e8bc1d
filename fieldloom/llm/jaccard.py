"""Exact Jaccard self-join of shingle sets by signature trees.

Sets of Jaccard similarity 4/5 or more are found in three steps, none of which can lose a pair.

1. Groups. In any fixed order of all shingles the first ``n - ceil(4n/5) + 1`` of two near sets have one in common
   (the prefix filter), so sets meet in the group of a shingle. The order puts shingles first whose hash bucket is light. The
   load of each of BUCKETS buckets is counted over all documents; N shingles in B buckets leave a noise of sqrt(N / B),
   and what is more frequent than a few times that comes last. A fixed table therefore grows blind with the root of the
   corpus only. The order decides how many candidates there are, never which pairs are found.
2. Signature trees. A group is a tree over its sets: a node holds the OR of its members' bitmaps, the range of their
   sizes, the most tokens that a member's bitmap hides, and their component where it is one. A dual traversal walks pairs of
   nodes from the top and drops those whose sizes don't fit, whose maximum possible overlap is too small, or which are
   of one component. One tree over the whole corpus would be useless: bitmaps of a few thousand sets are full.
3. Verification of each pair on its whole sets, grouped by one end, which stands once before its partners.

Trees are walked twice. The first walk compares a set with its own leaf and the group's first one, and links it with
the best predecessor there; components of verified links then let the second walk, over all pairs, skip the inside of
a large group of near copies. A group of over BLOCK sets is dealt out in blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.text import window_hashes, word_hashes
from fieldloom.operators.graph import connected_components
from fieldloom.staging import long_rows, release, stage

#: Hash buckets whose loads order the shingles.
BUCKETS = 1 << 21
#: Bits of a set's bitmap.
BITS = 512
#: Members of a leaf, and children of a node.
LEAF, FAN = 32, 8
#: Members of one group that one task compares.
BLOCK = 4096
#: Node or set pairs that are expanded at once.
FRONT = 1 << 16
#: Rows that are broadcast at most; more are shuffled.
SMALL = 1 << 18
#: Partners of one set that are verified together.
PARTNERS = 512
_SLICES = 64
_WORDS = BITS // 64


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles of lower-cased words, sorted; of all words where they are fewer than ``width``."""
    ws = text.lower().split() if text else []
    return np.unique(window_hashes(word_hashes(ws), min(width, len(ws))).view(np.int64)) if ws else np.empty(0, np.int64)


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s.view(np.uint64) % np.uint64(BUCKETS)).astype(np.int64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """One bit for each member, by the top of its hash."""
    bits = np.zeros(BITS, np.uint8)
    bits[(s.view(np.uint64) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def prefix_length(n: int) -> int:
    """How many first shingles of a set of n there must be, so that one is in any set near it."""
    return n - -(-4 * n // 5) + 1 if n else 0


def prefix(s: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of count, then hash; ``counts`` of sorted ``keys``, zero for others."""
    return s[_order(s, keys, counts)[: prefix_length(len(s))]]


def _order(s: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if keys is not s:
        at = np.minimum(np.searchsorted(keys, s), max(len(keys) - 1, 0))
        counts = np.where(keys[at] == s, counts[at], 0) if len(keys) else np.zeros(len(s), np.int64)
    return np.lexsort((s, counts))


def near_enough(shared: int, n: int, m: int) -> bool:
    """Whether sets of n and m members that share so many have a Jaccard similarity of 4/5 or more."""
    return 9 * shared >= 4 * (n + m)


# ------------------------------------------------------------------------------------------------- description


def bucket_loads(texts: DataFrame, width: int = 5) -> np.ndarray:
    """How many shingles of all texts fall in each bucket; a task sends its table once, compressed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)  # all that the task holds besides a batch
        for b in batches:
            for t in b.column(0):
                ws = (t.as_py() or b"").lower().split()
                if ws:
                    np.add.at(total, _bucket(window_hashes(word_hashes(ws), min(width, len(ws)))), 1)
        packed = [zlib.compress(x.tobytes(), 1) for x in total.reshape(_SLICES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(packed, pa.binary())], ["slice", "counts"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                of[k] = of.get(k, 0) + np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(of), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in of.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    with long_rows(texts.sparkSession):
        parts = texts.select("text").mapInArrow(count, schema).repartition("slice").mapInArrow(join, schema).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in parts:
        out.reshape(_SLICES, -1)[r["slice"]] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return np.minimum(out, (1 << 32) - 1).astype(np.uint32)


def describe(docs: DataFrame, loads: np.ndarray, width: int = 5, extra: Callable[[bytes | None], int] | None = None) -> DataFrame:
    """``(doc, sig, sid, n, hidden, bits, keys, at, fp)`` of ``docs(doc, sig, text)``.

    ``sid`` is the set's hash, ``n`` its size, ``bits`` its bitmap and ``hidden`` how many members that hides. ``keys``
    are the prefix shingles that another document may hold, ``at`` their places in the order, below zero (-1 - place)
    if their bucket is so heavy that a group may be large. ``fp`` is ``extra`` of the text, else 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(loads)
    heavy = max(BLOCK, 4 * int(loads.sum(dtype=np.int64)) // BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = shared.value
        for b in batches:
            rows = b.num_rows
            sid, fp = np.empty(rows, np.uint64), np.zeros(rows, np.uint64)
            n, bits = np.empty(rows, np.int32), np.empty((rows, _WORDS), np.int64)
            keys, places = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for k, t in enumerate(b.column("text")):
                text = t.as_py()
                s = shingle_set(text, width)
                sid[k], n[k], bits[k] = xxhash.xxh64_intdigest(s.tobytes()), len(s), bitmap(s)
                load = loads[_bucket(s)]
                first = _order(s, s, load)[: prefix_length(len(s))]
                place, load = np.arange(len(first), dtype=np.int32), load[first]
                place = np.where(load > heavy, -1 - place, place)
                keys.append(s[first][load > 1])
                places.append(place[load > 1])
                if extra:
                    fp[k] = extra(text)
            hidden = n - np.bitwise_count(bits.view(np.uint64)).sum(axis=1, dtype=np.int32)
            offsets = pa.array(np.cumsum([len(x) for x in keys]).astype(np.int32))
            lists = lambda x: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x)))
            words = pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, _WORDS, dtype=np.int32)), pa.array(bits.ravel()))
            arrays = [b.column("doc"), b.column("sig"), pa.array(sid.view(np.int64)), pa.array(n), pa.array(hidden), words, lists(keys), lists(places), pa.array(fp.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "sig", "sid", "n", "hidden", "bits", "keys", "at", "fp"])

    return docs.select("doc", "sig", "text").mapInArrow(run, "doc long, sig long, sid long, n int, hidden int, bits array<long>, keys array<long>, at array<int>, fp long")


# ------------------------------------------------------------------------------------------------------ groups


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return first, np.diff(np.r_[first, len(key)])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings ``(key, sid, n, at)`` in order of key: those of keys of three or more sets, and pairs of keys of two.

    A heavy key's postings lie in several tasks, so all of them stay.
    """

    def of(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, sid, n, at = cols
        first, size = _runs(key)
        per = np.repeat(size, size)
        stay = (per > 2) | (at < 0)
        rem = n - np.where(at < 0, -1 - at, at)
        two = first[(size == 2) & (at[first] >= 0)]
        a, b = two, two + 1
        fits = 9 * np.minimum(rem[a], rem[b]) >= 4 * (n[a] + n[b])
        a, b = a[fits], b[fits]
        none = lambda k: pa.nulls(k, pa.int64())
        rows = int(stay.sum())
        columns = [
            pa.concat_arrays([pa.array(key[stay]), none(len(a))]),
            pa.concat_arrays([pa.array(sid[stay]), pa.array(np.minimum(sid[a], sid[b]))]),
            pa.concat_arrays([pa.array(rem[stay]), pa.nulls(len(a), pa.int32())]),
            pa.concat_arrays([none(rows), pa.array(np.maximum(sid[a], sid[b]))]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["key", "sid", "rem", "other"])

    rest = None
    for b in batches:
        new = [b.column(k).to_numpy() for k in range(4)]
        cols = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
        if not len(cols[0]):
            continue
        same = cols[0] == cols[0][-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last run may go on
        if len(same) - cut > 4 * BLOCK:  # what is long stays anyway; only its end must wait
            cut = len(same) - 3
        rest = [c[cut:] for c in cols]
        if cut:
            yield of([c[:cut] for c in cols])
    if rest is not None:
        yield of(rest)


def _fits(n: np.ndarray, rem: np.ndarray, m: np.ndarray, ren: np.ndarray) -> np.ndarray:
    """Whether sets of n and m members, with so many left from their first common one on, can be near."""
    return 9 * np.minimum(rem, ren) >= 4 * (n + m)


class SignatureTree:
    """A tree over sets: per level, from the sets upward, ORed bitmaps, size ranges and bounds of each node."""

    def __init__(self, n: np.ndarray, rem: np.ndarray, hidden: np.ndarray, bits: np.ndarray, component: np.ndarray) -> None:
        level = {"low": n, "high": n, "rem": rem, "hidden": hidden, "bits": bits.view(np.uint64), "one": component, "all": component}
        self.levels = [level]
        size = LEAF
        while len(level["low"]) > 1:
            at = np.arange(0, len(level["low"]), size)
            level = {
                "low": np.minimum.reduceat(level["low"], at),
                "high": np.maximum.reduceat(level["high"], at),
                "rem": np.maximum.reduceat(level["rem"], at),
                "hidden": np.maximum.reduceat(level["hidden"], at),
                "bits": np.bitwise_or.reduceat(level["bits"], at, axis=0),
                "one": np.minimum.reduceat(level["one"], at),
                "all": np.maximum.reduceat(level["all"], at),
            }
            self.levels.append(level)
            size = FAN

    def may_hold(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether nodes a and b of level k can hold near sets of different components."""
        x = self.levels[k]
        low_a, low_b = x["low"][a], x["low"][b]
        sized = 5 * np.minimum(x["high"][a], x["high"][b]) >= 4 * np.maximum(low_a, low_b)
        apart = (x["one"][a] != x["one"][b]) | (x["all"][a] != x["all"][b]) | (x["one"][a] != x["all"][a])
        common = np.bitwise_count(x["bits"][a] & x["bits"][b]).sum(axis=1, dtype=np.int64) + np.minimum(x["hidden"][a], x["hidden"][b])
        most = np.minimum(common, np.minimum(x["rem"][a], x["rem"][b]))
        return sized & apart & (9 * most >= 4 * (low_a + low_b))

    def _expand(self, k: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children, at level k - 1, of pairs of nodes; each unordered pair once, and none of a set with itself."""
        size, count = (LEAF if k == 1 else FAN), len(self.levels[k - 1]["low"])
        i, j = (x.ravel() for x in np.indices((size, size)))
        x, y = (a[:, None] * size + i).ravel(), (b[:, None] * size + j).ravel()
        fine = (x < count) & (y < count) & ((x < y) if k == 1 else (x <= y))
        return x[fine], y[fine]

    def pairs(self, near_only: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets a < b that survive the dual traversal; with ``near_only``, of one leaf or with the first leaf."""
        top = len(self.levels) - 1
        if near_only and top > 1:
            each = np.arange(len(self.levels[1]["low"]))
            todo = [(1, each, each), (1, np.zeros(len(each) - 1, np.int64), each[1:])]
        else:
            todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            k, a, b = todo.pop()
            step = max(1, FRONT // (LEAF * LEAF if k == 1 else FAN * FAN))
            if len(a) > step:
                todo.append((k, a[step:], b[step:]))
                a, b = a[:step], b[:step]
            kept = self.may_hold(k, a, b)
            a, b = a[kept], b[kept]
            if not len(a):
                continue
            if k == 0:
                yield a, b
                continue
            todo.append((k - 1, *self._expand(k, a, b)))

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """For each set the predecessor among its leaf and the first leaf with which it may share the most, if there is any."""
        bits = self.levels[0]["bits"]
        best, most = np.full(len(bits), -1, np.int64), np.full(len(bits), -1, np.int64)
        for a, b in self.pairs(near_only=True):
            shared = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64)
            order = np.lexsort((-a, shared, b))
            a, b, shared = a[order], b[order], shared[order]
            last = np.flatnonzero(np.r_[b[1:] != b[:-1], True])
            a, b, shared = a[last], b[last], shared[last]
            more = shared > most[b]
            best[b[more]], most[b[more]] = a[more], shared[more]
        linked = np.flatnonzero(best >= 0)
        return best[linked], linked


def _walk(forest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidate pairs of each run of equal (key, part) of members ``(key, part, sid, rem, n, hidden, component, bits)``."""

    def tree_of(cols: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        _, _, sid, rem, n, hidden, component, bits = cols
        if component.min() == component.max():
            return
        if forest:  # what blocks have in common, their group's first set, is in the first leaf
            order = np.lexsort((sid, n, bits[:, 0], sid != sid.min()))
        else:  # alike stand together: sets of one component, then single ones of like size
            _, of, count = np.unique(component, return_inverse=True, return_counts=True)
            order = np.lexsort((sid, n, np.where(count[of] > 1, of, len(count))))
        sid = sid[order]
        tree = SignatureTree(n[order], rem[order], hidden[order], bits[order], component[order])
        for a, b in [tree.forest()] if forest else tree.pairs():
            yield np.minimum(sid[a], sid[b]), np.maximum(sid[a], sid[b])

    def batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[list[np.ndarray]] = []  # of the group that may go on
        found, size = [], 0

        def groups(cols: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            edge = np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]), True])
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if j - i > 1:
                    yield from tree_of([c[i:j] for c in cols])

        def whole() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*pieces)]

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy() for k in range(7)]
            cols.append(b.column(7).flatten().to_numpy().reshape(-1, _WORDS))
            differs = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(differs[-1]) + 1 if len(differs) else 0
            if pieces and (cut or (pieces[-1][0][-1], pieces[-1][1][-1]) != (cols[0][-1], cols[1][-1])):
                pieces.append([c[:cut] for c in cols])
                ready, pieces = whole(), []
            else:
                ready = [c[:cut] for c in cols]
            pieces.append([c[cut:] for c in cols])
            for pair in groups(ready) if len(ready[0]) else ():
                found.append(pair)
                size += len(pair[0])
                if size > FRONT:
                    yield batch(found)
                    found, size = [], 0
        for pair in groups(whole()) if pieces else ():
            found.append(pair)
            size += len(pair[0])
            if size > FRONT:
                yield batch(found)
                found, size = [], 0
        if found:
            yield batch(found)

    return run


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _groups(rows: DataFrame, classes: DataFrame, repeated: bool) -> DataFrame:
    """Staged ``(key, sid, rem, other)``: postings of shingles that three or more distinct sets may share, and pairs of the others."""
    copies = stage(classes.where("copies > 1").select("sid", F.col("doc").alias("d"), F.col("sig").alias("g")), "copies")
    once = rows.where("n > 0").join(_small(copies, copies.count()), "sid", "left").where("d IS NULL OR (doc = d AND sig = g)").select("sid", "n", "keys", "at")
    if repeated:
        once = once.dropDuplicates(["sid"])
    postings = once.select("sid", "n", F.explode(F.arrays_zip("keys", "at")).alias("x")).select(F.col("x.keys").alias("key"), "sid", "n", F.col("x.at").alias("at"))
    lane = F.when(F.col("at") < 0, F.pmod(F.xxhash64("sid"), F.lit(64))).otherwise(0)
    dealt = postings.withColumn("lane", lane).repartition("key", "lane").sortWithinPartitions("key").select("key", "sid", "n", "at")
    out = stage(dealt.mapInArrow(_shared, "key long, sid long, rem int, other long"), "groups")
    release(copies)
    return out


def _members(groups: DataFrame, hot: DataFrame, classes: DataFrame, forest: bool) -> DataFrame:
    """Members of the groups with their sketches, each in the part or parts of its group in which it is compared."""
    known = classes.select("sid", "n", "hidden", "component", "bits")
    if hot.isEmpty():
        dealt = groups.withColumn("part", F.lit(0).cast("long"))
    else:
        g = F.coalesce("g", F.lit(1))
        mine = F.pmod(F.xxhash64("sid"), g)
        if forest:  # the group's first set is in every block, so that blocks are linked
            parts = F.when(F.col("sid") == F.col("first"), F.sequence(F.lit(0).cast("long"), g - 1)).otherwise(F.array(mine))
        else:
            parts = F.transform(F.sequence(F.lit(0).cast("long"), g - 1), lambda o: F.least(mine, o) * g + F.greatest(mine, o))
        dealt = groups.join(hot, "key", "left").select("key", "sid", "rem", F.explode(parts).alias("part"))
    return dealt.join(known, "sid").select("key", "part", "sid", "rem", "n", "hidden", "component", "bits")


def _candidates(members: DataFrame, forest: bool) -> DataFrame:
    return members.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_walk(forest), "a long, b long").distinct()


# ------------------------------------------------------------------------------------------------ verification


def _maybe(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``(a, b, src, dst)``, of the staged ``pairs``, of different components whose bitmaps allow that they are near."""
    side = lambda x, c: classes.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("hidden").alias(f"h{x}"), F.col("bits").alias(f"w{x}"), F.col("component").alias(c))
    n = pairs.count()
    left = side("a", "src").join(_small(pairs, n), "a")
    both = side("b", "dst").join(_small(left, n), "b").where("src <> dst")
    shared, differ = F.least("ha", "hb"), F.lit(0)
    for k in range(_WORDS):
        x, y = F.get("wa", F.lit(k)), F.get("wb", F.lit(k))
        shared, differ = shared + F.bit_count(x.bitwiseAND(y)), differ + F.bit_count(x.bitwiseXOR(y))
    size = F.col("na") + F.col("nb")
    return both.where((9 * shared >= 4 * size) & (9 * differ <= size)).select("a", "b", "src", "dst")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near ones among rows ``(a, part, kind, s, src, dst)``: of each (a, part) the set of a comes first, then its partners."""
    own = None
    for b in batches:
        near = np.zeros(b.num_rows, bool)
        for k, (kind, s) in enumerate(zip(b.column("kind").to_pylist(), b.column("s"))):
            s = np.frombuffer(s.as_py(), np.int64)
            if kind == 0:
                own = s
            else:
                near[k] = near_enough(len(np.intersect1d(own, s, assume_unique=True)), len(own), len(s))
        yield pa.RecordBatch.from_arrays([b.column("src"), b.column("dst")], ["src", "dst"]).filter(pa.array(near))


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, repeated: bool) -> DataFrame:
    """Staged links ``(src, dst)`` between components: of the pairs whose whole sets are near.

    Only sets of candidates are made anew from their texts. The sets of one end are grouped by the other, whose own set
    comes once for every PARTNERS of them.
    """
    pairs = stage(_maybe(pairs, classes), "maybe")
    ids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    wanted = stage(classes.join(ids, "sid").select("sid", "doc", "sig"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            new = [k for k, x in enumerate(b.column("sid").to_pylist()) if x not in seen and not seen.add(x)]
            b = b.take(pa.array(new, pa.int32()))
            packed = pa.array([shingle_set(t.as_py(), width).tobytes() for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("sid"), packed], ["sid", "s"])

    found = texts.join(_small(wanted, wanted.count()), ["doc", "sig"]).select("sid", "text")
    known = found.mapInArrow(sets, "sid long, s binary")
    with long_rows(texts.sparkSession):
        known = stage(known.dropDuplicates(["sid"]) if repeated else known, "sets")
    many = stage(pairs.groupBy("a").count().where(F.col("count") > PARTNERS).select("a", F.ceil(F.col("count") / PARTNERS).alias("g")), "centres")
    dealt = pairs.withColumn("part", F.lit(0).cast("long")) if many.isEmpty() else pairs.join(many, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("g", F.lit(1)))).drop("g")
    one, n = F.lit(None).cast("long"), pairs.count()
    own = known.withColumnRenamed("sid", "a").join(_small(dealt.select("a", "part").distinct(), n), "a").select("a", "part", F.lit(0).alias("kind"), "s", one.alias("src"), one.alias("dst"))
    others = known.withColumnRenamed("sid", "b").join(_small(dealt, n), "b").select("a", "part", F.lit(1).alias("kind"), "s", "src", "dst")
    rows = own.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", "kind").select("kind", "s", "src", "dst")
    with long_rows(texts.sparkSession):
        out = stage(rows.mapInArrow(_check, "src long, dst long").distinct(), "links")
    for t in (pairs, wanted, known, many):
        release(t)
    return out


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Staged ``classes`` with the components that the links make of theirs."""
    found = stage(connected_components(links).select(F.col("node").alias("component"), F.col("component").alias("to")), "merged")
    out = stage(classes.join(_small(found, found.count()), "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to"), "classes")
    for t in (found, classes, links):
        release(t)
    return out


def merge_near(rows: DataFrame, classes: DataFrame, texts: DataFrame, width: int = 5) -> DataFrame:
    """Staged ``classes`` with components joined wherever two sets of a Jaccard similarity of 0.8 or more link them.

    ``rows`` is what ``describe`` gives, staged, of ``texts(doc, sig, text)``. ``classes``, staged, has a row for each distinct
    set that isn't empty: ``(sid, doc, sig, n, hidden, bits, copies, component)``, with one of its documents and how many
    rows it has; it is released.
    """
    repeated = not rows.groupBy("doc", "sig").count().where("count > 1").isEmpty()
    groups = _groups(rows, classes, repeated)
    members = groups.where("key IS NOT NULL").select("key", "sid", "rem")
    sizes = stage(members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("sid").alias("first")).where(F.col("c") > BLOCK).select("key", F.ceil(F.col("c") / BLOCK).alias("g"), "first"), "hot")
    twos = groups.where("key IS NULL").select(F.col("sid").alias("a"), F.col("other").alias("b"))
    tried = stage(_candidates(_members(members, sizes, classes, True), True).union(twos).distinct(), "tried")
    classes = _joined(classes, _verified(tried, classes, texts, width, repeated))
    # a group of one component has nothing left
    of = members.join(classes.select("sid", "component"), "sid")
    open_ = stage(of.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("m")).where("l < m").select("key"), "open")
    rest = stage(members.join(open_, "key"), "rest")
    pairs = stage(_candidates(_members(rest, sizes, classes, False), False).join(tried, ["a", "b"], "left_anti"), "pairs")
    classes = _joined(classes, _verified(pairs, classes, texts, width, repeated))
    for t in (groups, sizes, tried, open_, rest, pairs):
        release(t)
    return classes


def row_key() -> list[Column]:
    """What tells rows apart: the id, nulls as the greatest long, and the text's hash."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("text").alias("sig")]


def texts_of(docs: DataFrame) -> DataFrame:
    """``(doc, sig, text)``: the key of each row and its text's bytes."""
    return docs.select(*row_key(), F.col("text").cast("binary").alias("text"))


def classes_of(rows: DataFrame) -> DataFrame:
    """``(sid, doc, sig, n, hidden, bits, fp, copies)`` of each distinct set that isn't empty, with its first document."""
    first = F.min(F.struct("doc", "sig", "n", "hidden", "bits", "fp")).alias("x")
    return rows.where("n > 0").groupBy("sid").agg(first, F.count(F.lit(1)).alias("copies")).select("sid", "x.*", "copies")


def jaccard_components(docs: DataFrame, width: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    Documents whose sets of distinct ``width``-word shingles have a Jaccard similarity of 0.8 or more are linked;
    ``component_id`` is the smallest doc_id reachable. Equal sets are one class, so copies cost one set.

    Null or empty text, or text of white space only: an empty set, linked with nothing, and ``component_id`` is the
    row's own id. Null doc_id: the row is kept and links others, but never names a component (null if no member has an
    id). Ties and repeated rows are kept. Empty table: no rows. Columns other than doc_id and text are not read. Sets
    and shingles are compared by 64-bit hashes.
    """
    texts = texts_of(docs)
    loads = bucket_loads(texts, width)
    with long_rows(docs.sparkSession):
        rows = stage(describe(texts, loads, width), "described")
    classes = stage(classes_of(rows).withColumn("component", F.col("sid")), "classes")
    found = merge_near(rows, classes, texts, width)
    doc = F.when(F.col("doc") != (1 << 63) - 1, F.col("doc"))
    least = stage(found.groupBy("component").agg(F.min(doc).alias("component_id")), "named")
    of = stage(found.select("sid", "component").join(least, "component").select("sid", "component_id"), "components")
    small = stage(rows.select(doc.alias("doc_id"), "sid", F.col("n").cast("long").alias("n_shingles")), "members")
    for t in (rows, found, least):
        release(t)
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return small.join(of, "sid", "left").select("doc_id", "n_shingles", own.alias("component_id"))
