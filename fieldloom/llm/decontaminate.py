"""Benchmark decontamination by pigeonhole edit matching.

A test item of n words may differ from a passage in ``floor(n / 5)`` words (similarity of 0.8): inserted, lost or
replaced. It is cut into one piece more than that, so one piece at least stands in the passage unchanged. Exact
hits of pieces place the item in a text, and Myers' bit-parallel distance, a bit per word of the item, verifies:
once for each stretch of text that hits of one item cover, however many lie in it. Words are runs of letters and
digits; in scripts that are written without spaces each character is one.

The items are taken in blocks of bounded size; a block's tables are broadcast and the documents scanned once,
and its result is written before the next block is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.text import plain_tokens, window_hashes, word_hashes
from fieldloom.staging import stage

BUDGET = 0.2
#: Items of fewer words are left out unless a caller asks for them: chance repeats them.
LEAST_WORDS = 5
#: Items and bytes of text in a block.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
_SIEVE = 22
#: Scripts without spaces between words, and bytes of the UTF-8 of any of their characters.
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_HIGH = regex.compile(rb"[\xe0-\xf4]")
FIELDS = "doc_id long, item_id long, distance long, item_words long, first_word long, end_word long"


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words; a character of a script without spaces is a word."""
    if text and _HIGH.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text.decode("utf-8", "replace")).encode()
    return plain_tokens(text)


def pieces(n: int, budget: float = BUDGET) -> list[tuple[int, int]]:
    """(offset, width) of the error budget plus one pieces of n words."""
    k = int(n * budget + 1e-9) + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _masks(pattern: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(pattern):
        out[w] = out.get(w, 0) | 1 << k
    return out


def myers(masks: dict[int, int], n: int, text: list[int], anchored: bool = False) -> list[int]:
    """Least edit distance of a pattern of n words to a part of ``text`` that ends after each word.

    The part begins anywhere, or with the text if ``anchored``.
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, out = full, 0, n, []
    for w in text:
        eq = masks.get(w, 0)
        v = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(h | plus))
        down = plus & h
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | anchored) & full, (down << 1) & full
        plus = down | (full & ~(v | up))
        minus = up & v
        out.append(score)
    return out


@dataclass
class Items:
    """Tables of a block of test items; items of equal words are one pattern."""

    patterns: list[list[int]] = field(default_factory=list)
    ids: list[list[int]] = field(default_factory=list)
    hits: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)
    budget: float = BUDGET

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]], budget: float = BUDGET, least_words: int = LEAST_WORDS) -> Items:
        found: dict[tuple[int, ...], list[int]] = {}
        for item_id, text in rows:
            h = word_hashes(tokens((text or "").encode()))
            if len(h) >= max(least_words, 1):
                found.setdefault(tuple(h.tolist()), []).append(item_id)
        out = cls(budget=budget)
        for p, (ws, ids) in enumerate(found.items()):
            out.patterns.append(list(ws))
            out.ids.append(sorted(set(ids), key=lambda x: (x is None, x)))
            h = np.array(ws, np.uint64)
            for at, width in pieces(len(ws), budget):
                key = int(window_hashes(h[at : at + width], width)[0])
                out.hits.setdefault(width, {}).setdefault(key, []).append((p, at))
        return out

    def sieves(self) -> dict[int, np.ndarray]:
        """For each width, a bit table that says of most windows that they are no piece."""
        out = {}
        for width, keys in self.hits.items():
            out[width] = np.zeros(1 << _SIEVE, bool)
            out[width][np.fromiter(keys, np.uint64, len(keys)) >> np.uint64(64 - _SIEVE)] = True
        return out


def _stretches(starts: np.ndarray, n: int, most: int, end: int) -> list[tuple[int, int]]:
    """The parts of a text of ``end`` words that windows of n words and ``most`` more on either side cover together."""
    low, high = np.maximum(starts - most, 0), np.minimum(starts + n + most, end)
    new = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
    return list(zip(low[new].tolist(), high[np.r_[new[1:] - 1, len(starts) - 1]].tolist()))


def matches(items: Items, sieves: dict[int, np.ndarray], text: bytes | None) -> list[tuple[int, int, int, int]]:
    """``(pattern, distance, first word, end)`` of the best passage for each pattern found in a text."""
    h = word_hashes(tokens(text))
    places: dict[int, list[np.ndarray]] = {}
    for width, keys in items.hits.items():
        g = window_hashes(h, width)
        maybe = np.flatnonzero(sieves[width][g >> np.uint64(64 - _SIEVE)])
        if not len(maybe):
            continue
        found, which = np.unique(g[maybe], return_inverse=True)
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(len(found) + 1))
        for k, value in enumerate(found.tolist()):
            for p, at in keys.get(value, ()):
                places.setdefault(p, []).append(maybe[order[cuts[k] : cuts[k + 1]]] - at)
    out = []
    for p, starts in places.items():
        pattern = items.patterns[p]
        n = len(pattern)
        most = int(n * items.budget + 1e-9)
        masks, best = _masks(pattern), None
        known, often = np.unique(np.array(pattern, np.uint64), return_counts=True)
        for low, high in _stretches(np.unique(np.concatenate(starts)), n, most, len(h)):
            at = np.minimum(np.searchsorted(known, h[low:high]), len(known) - 1)
            held = np.bincount(at[known[at] == h[low:high]], minlength=len(known))
            if np.minimum(held, often).sum() < n - most:  # so many words of the item at least stay as they are
                continue
            found = myers(masks, n, h[low:high].tolist())
            d = min(found, default=n)
            if d <= most and (best is None or d < best[0]):
                best = (d, low + found.index(d) + 1)
            if best and best[0] == 0:
                break
        if best:
            d, end = best
            back = myers(_masks(pattern[::-1]), n, h[max(0, end - n - most) : end][::-1].tolist(), anchored=True)
            first = end - 1 - back.index(min(back))
            out.append((p, d, first, end))
    return out


def block_count(benchmark: DataFrame) -> int:
    """How many blocks of bounded size the items make."""
    size = _rows(benchmark).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    return max(-(-size["n"] // BLOCK_ITEMS), -(-size["b"] // BLOCK_BYTES), 1)


def _rows(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())


def blocks(benchmark: DataFrame, least_words: int = LEAST_WORDS, k: int | None = None) -> Iterator[Items]:
    """The items in ``k`` blocks, by default of bounded size; equal texts come in one block. One is made at a time."""
    rows, k = _rows(benchmark), k or block_count(benchmark)
    for b in range(k):
        own = rows if k == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(k)) == b)
        yield Items.of([(r["item_id"], r["text"]) for r in own.collect()], least_words=least_words)


_sieves: dict[int, tuple[Items, dict[int, np.ndarray]]] = {}


def _tables(items: Items) -> dict[int, np.ndarray]:
    if id(items) not in _sieves:
        _sieves.clear()
        _sieves[id(items)] = (items, items.sieves())
    return _sieves[id(items)][1]


def contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, item_id, distance, item_words, first_word, end_word)``: test items that documents hold.

    One row for each document row and item whose words occur within the budget, with the best passage (the first
    of equals), in words of the document from ``first_word`` to before ``end_word``. Words are lower-cased runs of
    letters, digits and non-ASCII characters, and single characters of scripts without spaces. Documents without an
    item give no row.

    Items of fewer than ``least_words`` words are left out; with 1 all items count, those of up to four words exactly
    (their budget is zero). Null or empty texts on either side match nothing. Null ids are kept as
    they are, repeated documents give repeated rows, and items of equal words each give theirs. Empty tables: no
    rows. Other columns are not read.
    """

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def scan(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            sieves = _tables(items)
            for b in batches:
                out = []
                for doc_id, text in zip(b.column("doc_id"), b.column("text")):
                    for p, d, first, end in matches(items, sieves, text.as_py()):
                        out += [(doc_id.as_py(), i, d, len(items.patterns[p]), first, end) for i in items.ids[p]]
                if out:
                    names = [f.split()[0] for f in FIELDS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

        return rows.mapInArrow(run, FIELDS)

    return _each_block(benchmark, least_words, scan)


def _each_block(benchmark: DataFrame, least_words: int, scan: Callable[[Broadcast], DataFrame]) -> DataFrame:
    """What ``scan`` gives for all blocks of items. With more blocks than one each result is written before the next
    block is made, so that one block at a time is on the driver and the executors."""
    k = block_count(benchmark)
    context = benchmark.sparkSession.sparkContext
    if k == 1:
        return scan(context.broadcast(next(blocks(benchmark, least_words, 1))))
    found = []
    for items in blocks(benchmark, least_words, k):
        shared = context.broadcast(items)
        found.append(stage(scan(shared), "matches"))
        shared.destroy()
        del items, shared
    return reduce(DataFrame.unionByName, found)


def keep_clean(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item of ``least_words`` words or more.

    Null and empty texts hold none and stay; repeated rows and null ids stay or go as they are. Empty tables: all
    documents stay.
    """

    if block_count(benchmark) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(next(blocks(benchmark, least_words, 1)))

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            sieves = _tables(items)
            for b in batches:
                yield b.filter(pa.array([not matches(items, sieves, t.as_py()) for t in b.column("text").cast(pa.binary())], pa.bool_()))

        return docs.mapInArrow(clean, docs.schema)
    doc, sig = F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("sig")
    texts = docs.select(doc, sig, F.col("text").cast("binary").alias("text"))

    def scan(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            sieves = _tables(items)
            for b in batches:
                dirty = pa.array([bool(matches(items, sieves, t.as_py())) for t in b.column("text")], pa.bool_())
                yield b.select(["doc", "sig"]).filter(dirty)

        return texts.mapInArrow(run, "doc long, sig long")

    dirty = stage(_each_block(benchmark, least_words, scan).distinct(), "dirty")
    rows = docs.select(F.struct("*").alias("row"), doc, sig)
    gone = (rows["sig"] == dirty["sig"]) & rows["doc"].eqNullSafe(dirty["doc"])
    return rows.join(dirty, gone, "left_anti").select("row.*")
