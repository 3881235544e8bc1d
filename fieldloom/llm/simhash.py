"""SimHash near-duplicate detection with pigeonring candidate filtering.

A fingerprint of 64 bits is cut into ``SEGMENTS`` segments that lie on a ring. If two fingerprints differ in at
most ``tau`` bits, there is a segment from which every chain of 1, 2, 3 ... consecutive segments differs in at
most ``floor(length * tau / SEGMENTS)`` bits (the strong pigeonhole principle on a ring). The first ``chain``
links of that condition force some segments to be equal, which gives the keys of an exact equi-join; the whole
chain is then tested on each candidate, and only what passes reaches the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.graph import connected_components
from fieldloom.staging import stage

SEGMENTS = 9
#: Members of one bucket that are compared in one task; a larger bucket is dealt out in pairs of blocks.
BLOCK = 4096
_SLICE = 1 << 18
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_ROWS = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: bytes | None, width: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``width`` lower-cased words; one shingle of all words where there are fewer."""
    ws = text.lower().split() if text else []
    n = len(ws)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(ws)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lens = np.fromiter(map(len, ws), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], seed) for i, j in zip((ends - lens)[: n - width + 1].tolist(), ends[width - 1 :].tolist())), np.uint64, n - width + 1)


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """The fingerprint as an unsigned integer: bit b is set if it is set in over half the shingle hashes."""
    return fingerprint_of(shingle_hashes(text, width, seed))


def fingerprint_of(h: np.ndarray) -> int:
    """The same from the shingles' hashes."""
    if len(h) < 2:
        return int(h[0]) if len(h) else 0
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, len(h), _SLICE):
        part = h[at : at + _SLICE].view(np.uint8).reshape(-1, 8) + _ROWS
        ones += np.bincount(part.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * ones > len(h)).ravel(), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """The columns of ``docs`` with ``text`` replaced by ``fp``: the fingerprint's 64 bits as a signed long."""
    rows = docs.withColumn("text", F.col("text").cast("binary"))
    keys = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width, seed) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array(fp.view(np.int64))], [*keys, "fp"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keys)
    return rows.mapInArrow(run, f"{schema}, fp long")


# ---------------------------------------------------------------------------------------------- pigeonring


def layout(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(offset, width) of each segment of the 64 bits."""
    ends = [64 * (k + 1) // segments for k in range(segments)]
    return [(a, b - a) for a, b in zip([0, *ends], ends)]


def equal_sets(tau: int, chain: int, segments: int = SEGMENTS) -> list[tuple[int, ...]]:
    """Sets of chain positions, one of which must be equal throughout if the first ``chain`` budgets hold."""
    budget = [length * tau // segments for length in range(1, chain + 1)]
    fine = [e for e in product((0, 1), repeat=chain) if all(sum(e[: k + 1]) <= budget[k] for k in range(chain))]
    top = [e for e in fine if not any(o != e and all(x >= y for x, y in zip(o, e)) for o in fine)]
    return [tuple(k for k in range(chain) if not e[k]) for e in top]


def chain_for(n: int) -> int:
    """Chain length that keeps random bucket mates few among ``n`` fingerprints. Any length finds the same links."""
    return 4 if n <= 1 << 24 else 6 if n <= 1 << 31 else 8


def _keys(tau: int, chain: int) -> list[F.Column]:
    """Bucket keys of column ``fp``; the number of the key stands in the low byte(s)."""
    parts, sets = layout(), equal_sets(tau, chain)
    out = []
    for start in range(SEGMENTS):
        for k, same in enumerate(sets):
            key = F.lit(0).cast("long")
            for p in same:
                at, width = parts[(start + p) % SEGMENTS]
                key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)))
            out.append(F.shiftleft(key, 10).bitwiseOR(F.lit(start * len(sets) + k)))
    return out


def _chain_holds(x: np.ndarray, start: np.ndarray, tau: int) -> np.ndarray:
    """Whether every chain from ``start`` stays within its share of the budget. x: differing bits."""
    masks = np.array([((1 << w) - 1) << at for at, w in layout()], np.uint64)
    spent, holds = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for length in range(1, SEGMENTS + 1):
        spent += np.bitwise_count(x & masks[(start + length - 1) % SEGMENTS])
        holds &= spent * SEGMENTS <= length * tau
    return holds


def _forest(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds links a-b to the flat union-find ``root``; returns which of them joined two trees, and the new root."""
    new = np.flatnonzero(root[a] != root[b])
    used = []
    for k in new.tolist():
        x, y = a[k], b[k]
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            used.append(k)
    if used:
        while (flat := root[root]).tobytes() != root.tobytes():
            root = flat
    return np.array(used, np.int64), root


def links(key: np.ndarray, part: np.ndarray, fp: np.ndarray, tau: int, n_sets: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each run of equal (key, part): the two ends of each edge."""
    n = len(key)
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
    size = np.diff(np.r_[first, n])
    after = np.repeat(first + size, size) - np.arange(n) - 1
    start = (key & 1023) // n_sets
    root, out, at, step = np.arange(n), [], np.flatnonzero(after > 0), 1
    bits = fp.view(np.uint64)
    while len(at):
        x = bits[at] ^ bits[at + step]
        fits = _chain_holds(x, start[at], tau)
        near = at[fits][np.bitwise_count(x[fits]) <= tau]
        if len(near):
            used, root = _forest(near, near + step, root)
            out.append((fp[near[used]], fp[near[used] + step]))
        step += 1
        at = at[after[at] >= step]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def near_links(reps: DataFrame, tau: int = 4, chain: int | None = None) -> DataFrame:
    """Links ``(src, dst)`` that connect what fingerprints within ``tau`` bits connect; ``reps`` has distinct ``fp``.

    Each fingerprint goes to one bucket per key. A bucket is compared offset by offset in numpy and yields a
    spanning forest of its links, so a dense group gives as many rows as it has members. A bucket of over BLOCK
    members is cut into blocks by hash, and each pair of blocks is a task of its own.
    """
    chain = chain or chain_for(reps.count())
    n_sets = len(equal_sets(tau, chain))
    keys = reps.select("fp", F.explode(F.array(*_keys(tau, chain))).alias("key"))
    hot = stage(keys.groupBy("key").count().where(F.col("count") > BLOCK), "buckets")
    if hot.isEmpty():
        dealt = keys.withColumn("part", F.lit(0).cast("long"))
    else:
        g = F.ceil(F.coalesce("count", F.lit(1)) / BLOCK)
        mine = F.pmod(F.xxhash64("fp"), "g")
        dealt = keys.join(hot, "key", "left").withColumn("g", g).withColumn("b", mine)
        pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda o: F.least("b", o) * F.col("g") + F.greatest("b", o))
        dealt = dealt.select("fp", "key", F.explode(pair).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            new = [b.column(k).to_numpy() for k in range(3)]
            cols = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) if len(cols[0]) else np.zeros(0, bool)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last bucket may go on
            rest = [c[cut:] for c in cols]
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(*(c[:cut] for c in cols), tau, n_sets)], ["src", "dst"])
        if rest is not None and len(rest[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(*rest, tau, n_sets)], ["src", "dst"])

    near = dealt.select("key", "part", "fp").repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, "src long, dst long")
    return near.distinct()


def simhash_components(docs: DataFrame, tau: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Fingerprints that differ in ``tau`` bits or fewer are linked; ``component_id`` is the smallest doc_id reachable.
    Rows with equal fingerprints form one class, so a group of copies costs one representative.

    Null or empty text, or text of white space only: fingerprint zero, linked like any other. Null doc_id: the
    row is kept and links others, but never names a component (null if no member has an id). Repeated rows are
    kept. Empty table: no rows. Columns other than doc_id and text are not read.
    """
    fps = stage(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, seed), "fingerprints")
    reps = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "representatives")
    found = connected_components(near_links(reps, tau)).withColumnRenamed("node", "fp")
    member = found.join(reps, "fp")
    least = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named = member.join(least, "component").select("fp", "component_id")
    of_fp = reps.join(named.withColumn("linked", F.lit(True)), "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"))
    of_fp = stage(of_fp, "classes")  # so that both sides of the join below are plain exchanges, which AQE can split
    return fps.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, tau: int = 4, width: int = 5, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component.

    That is the one with the smallest doc_id (nulls last), then the smallest hash of its text. Rows are told apart
    by id and text; of repeated rows one stays. Groups of copies are pre-aggregated, and only the keys of what
    stays are joined back.
    """
    doc, sig = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("text").alias("sig")
    fps = stage(fingerprints(docs.select(doc, sig, "text"), width, seed), "fingerprints")
    reps = stage(fps.groupBy("fp").agg(F.min(F.struct("doc", "sig")).alias("first")), "representatives")
    found = connected_components(near_links(reps, tau)).withColumnRenamed("node", "fp")
    group = F.coalesce("component", "fp").alias("component")
    stay = stage(reps.join(found, "fp", "left").select(group, "first").groupBy("component").agg(F.min("first").alias("first")).select("first.doc", "first.sig"), "kept")
    kept = docs.select(F.struct("*").alias("row"), doc, sig).join(stay, ["doc", "sig"], "left_semi")
    if not fps.groupBy("doc", "sig").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc", "sig"])
    return kept.select("row.*")
