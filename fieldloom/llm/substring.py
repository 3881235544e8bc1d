"""Exact substring dedup by level-wise doubling.

A passage is repeated if a window of ``min_words`` words occurs more than once. The levels are the half length and
the length itself (35 words: 18, then 35, two halves that share a word).

Level 1. A window of full length holds several windows of half length; the one with the least hash stands for it,
so equal windows are stood for by equal halves. Consecutive windows with the same representative form a *run*: one
row instead of up to 18. Runs whose half-length window occurs once in the corpus can't hold a repeat and go.

Level 2. Only the surviving runs are extended. Runs that cover the same words are one class; a class of two or
more copies is repeated throughout, and costs one row however many copies there are. What is left, the edges of
passages, is compared window by window at full length. No longer level can remove more words, so the levels end
there, or earlier where no run survives.

Counts are pre-aggregated sums. Copies are matched by joins that AQE may split, and the most frequent edge windows,
of which a fixed number is broadcast, aren't matched by key at all, so a passage in a third of all documents goes
through many tasks. The documents' texts are shuffled once, to their runs and to their ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.text import mix, row_ranges, window_hashes, word_hashes, words
from fieldloom.staging import stage

MIN_WORDS = 35
#: Most frequent edge windows that are known to all tasks; any other has at most one in so many of the rows.
HOT = 1024
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            row = np.full(1 << max(12, (n - 1).bit_length()), b, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences from ``start`` to before ``end``."""
    up, down = _power(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of ``width`` values."""
    size, at = 1, g
    while size < width:
        step = min(size, width - size)
        at = np.minimum(at[: len(at) - step], at[step:])
        size += step
    return at


def runs(h: np.ndarray, min_words: int) -> tuple[np.ndarray, ...] | None:
    """Runs of windows by representative: its hash, first window, number of windows, occurrences, hash of the words."""
    if len(h) < min_words:
        return None
    half = (min_words + 1) // 2
    g = window_hashes(h, half)
    width = min_words - half + 1
    least = sliding_min(g, width)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    count = np.diff(np.r_[first, len(least)])
    value = least[first]
    lens = count + width - 1
    at, _ = row_ranges(lens)
    inside = np.repeat(first - at, lens) + np.arange(int(lens.sum()))
    seen = np.add.reduceat((g[inside] == np.repeat(value, lens)).astype(np.int64), at)
    return value, first, count, seen, span_hashes(h, first, first + count + min_words - 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _runs_of(docs: DataFrame, min_words: int, full: bool) -> DataFrame:
    """The runs of all documents; without ``full`` only their representatives and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, rows, size = [], [], 0
            for k in range(b.num_rows + 1):
                if size >= 1 << 19 or k == b.num_rows and held:
                    value, first, count, seen, span = (np.concatenate(c) for c in zip(*held))
                    if full:
                        which = np.repeat([r for r, _ in rows], [n for _, n in rows])
                        key = b.select(["doc", "sig"]).take(pa.array(which)).columns
                        yield pa.RecordBatch.from_arrays([_signed(value), _signed(span), *key, pa.array(first << 32 | count)], ["rep", "span", "doc", "sig", "place"])
                    else:
                        yield pa.RecordBatch.from_arrays([_signed(value), pa.array(seen)], ["rep", "seen"])
                    held, rows, size = [], [], 0
                if k == b.num_rows:
                    break
                found = runs(word_hashes(words(b.column(2)[k].as_py())), min_words)
                if found:
                    held.append(found)
                    rows.append((k, len(found[0])))
                    size += len(found[0])

    schema = "rep long, span long, doc long, sig long, place long" if full else "rep long, seen long"
    return docs.select("doc", "sig", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key of the row, 128 hash bits of its id and text, null ids included: repeated rows share it, which is
    right, as they share all that is decided by it."""
    return docs.withColumn("doc", F.xxhash64("doc_id", "text")).withColumn("sig", F.xxhash64(F.lit(1), "text", "doc_id"))


def _windows(rows: DataFrame, min_words: int) -> DataFrame:
    """Full-length windows of the runs in column ``need`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, sig, text, need in zip(*(b.column(b.schema.get_field_index(c)) for c in ("doc", "sig", "text", "need"))):
                h = window_hashes(word_hashes(words(text.as_py())), min_words)
                for r in need.as_py():
                    first, count = r["place"] >> 32, r["place"] & 0xFFFFFFFF
                    n = np.ones(count, np.int64)
                    out.append((n * r["rep"], h[first : first + count].view(np.int64), n * r["copies"], n * doc.as_py(), n * sig.as_py(), np.arange(first, first + count) << 32 | 1))
                    if len(out) >= 20_000:
                        yield pack(out)
                        out = []
            if out:
                yield pack(out)

    def pack(out: list) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["rep", "window", "copies", "doc", "sig", "place"])

    return rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, "rep long, window long, copies long, doc long, sig long, place long")


def repeated_ranges(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its key and ``ranges``: places (first window << 32 | windows) of repeated windows, null if none."""
    keyed = _keyed(docs)
    twice = stage(_runs_of(keyed, min_words, False).groupBy("rep").agg(F.sum("seen").alias("n")).where("n > 1").select("rep"), "halves")
    survive = stage(_runs_of(keyed, min_words, True).join(twice, "rep", "left_semi"), "runs")
    classes = survive.groupBy("rep", "span").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "sig", "place")).alias("one"))
    classes = stage(classes, "classes")
    settled = survive.join(classes.where("copies > 1").select("rep", "span"), ["rep", "span"]).select("doc", "sig", "place")
    # staged, so that both sides of the join below are plain exchanges, which AQE can split: the edges of a passage
    # that a third of the documents hold share a representative
    unsettled = stage(classes.where("copies = 1").select("rep").distinct(), "unsettled")
    need = classes.join(unsettled, "rep", "left_semi").select("one.doc", "one.sig", F.struct("rep", "copies", "one.place").alias("need"))
    need = need.groupBy("doc", "sig").agg(F.collect_list("need").alias("need"))
    each = _windows(keyed.join(need, ["doc", "sig"]), min_words)
    again = each.groupBy("rep", "window").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 1")
    hot = again.orderBy(F.col("rows").desc(), "rep", "window").limit(HOT).select("rep", "window", F.lit(True).alias("hot"))
    single = each.where("copies = 1").join(F.broadcast(hot), ["rep", "window"], "left")
    key = F.when(F.col("hot"), F.xxhash64("doc", "place")).otherwise(F.col("rep"))  # known to be repeated: spread out
    found = again.select(F.col("rep").alias("key"), "window", F.lit(True).alias("seen"))
    edges = single.select("doc", "sig", "place", "window", "hot", key.alias("key")).join(found, ["key", "window"], "left").where("hot or seen").select("doc", "sig", "place")
    ranges = settled.unionByName(edges).groupBy("doc", "sig").agg(F.collect_set("place").alias("ranges"))
    return keyed.join(ranges, ["doc", "sig"], "left")


def kept_words(text: bytes | None, ranges: list[int] | None, min_words: int) -> tuple[list[bytes], int]:
    """Words of a text outside all repeated windows, and how many lie inside."""
    ws = words(text)
    if not ranges:
        return ws, 0
    places = np.array(ranges, np.int64)
    edge = np.zeros(len(ws) + 1, np.int64)
    np.add.at(edge, places >> 32, 1)
    np.add.at(edge, (places >> 32) + (places & 0xFFFFFFFF) + min_words - 1, -1)
    inside = np.cumsum(edge)[:-1] > 0
    return [w for w, x in zip(ws, inside.tolist()) if not x], int(inside.sum())


def dedup_digests(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``: words covered by a window that starts anywhere else too go.

    Windows are judged on the input. Null or empty text, and text of fewer than ``min_words`` words: nothing is
    removed. Null doc_ids and repeated rows are kept, and repeated rows repeat each other's windows. Overlapping
    repeats within one text count. Empty table: no rows. Equality is of 128 hash bits or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, digest = [], [], []
            for text, ranges in zip(b.column(1), b.column(2)):
                kept, removed = kept_words(text.as_py(), ranges.as_py(), min_words)
                n.append(len(kept) + removed)
                gone.append(removed)
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = repeated_ranges(docs.select("doc_id", "text"), min_words).select("doc_id", F.col("text").cast("binary").alias("text"), "ranges")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_texts(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated words removed from ``text``; a text that loses none keeps its white space.

    A text that loses words becomes the kept ones joined by single spaces, the empty text if none are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, ranges in zip(b.column("text"), b.column("ranges")):
                kept, removed = kept_words(text.as_py(), ranges.as_py(), min_words) if ranges.is_valid else ([], 0)
                out.append(b" ".join(kept) if removed else text.as_py())
            texts = pa.array([None if t is None else t.decode() for t in out], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), texts, b.column("rest")], ["doc_id", "text", "rest"])

    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*other) if other else F.struct(F.lit(0).alias("none"))  # apart from the names used inside
    rows = repeated_ranges(docs.select("doc_id", "text", rest.alias("rest")), min_words).select("doc_id", F.col("text").cast("binary").alias("text"), "rest", "ranges")
    done = rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType()), rows.schema["rest"]]))
    return done.select(*[c if c in ("doc_id", "text") else F.col(f"rest.{c}") for c in docs.columns])
