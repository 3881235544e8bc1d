"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is in the vocabulary is resolved by a minimal perfect hash. Any other is merged from its bytes:
a linked list of parts, and a heap of the pairs that the vocabulary can merge, lowest rank and leftmost first.
The tables are built on the driver from the rank file and broadcast; their size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
import sys
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A larger vocabulary is refused: it is broadcast.
MAX_VOCABULARY_BYTES = 256 << 20
#: Distinct pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 400_000
_M = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base64 token and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


#: Texts whose characters all lie below this take a pattern of small sets, which is the faster one.
LATIN_END = 0x250


@functools.cache
def members(name: str) -> tuple[tuple[int, int], ...]:
    """Runs of code points in a character class, as the reference tokenizer's pattern engine has it."""
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    engine = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    found = np.array(sorted(map(ord, set(engine.decode(engine.encode_ordinary(every))))))
    cut = np.flatnonzero(np.diff(found) > 1)
    return tuple(zip(found[np.r_[0, cut + 1]].tolist(), found[np.r_[cut, len(found) - 1]].tolist()))


def plain_pattern(pattern: str, below: int = sys.maxunicode + 1) -> str:
    """The same pattern for ``re``: its Unicode classes are spelled out, as far as code point ``below``."""
    spelled = lambda name: "".join(f"\\U{a:08x}-\\U{min(b, below - 1):08x}" for a, b in members(name) if a < below)
    sets = {name: spelled(name) for name in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = next((n for n in (*sets, r"\S") if pattern.startswith(n, at)), None)
        if name == r"\S":
            out.append(f"[^{sets[r'\s']}]")
        elif name:
            out.append(sets[name] if inside else f"[{sets[name]}]")
        else:
            inside = pattern[at] == "[" or (inside and pattern[at] != "]")
            out.append(pattern[at])
        at += len(name or " ")
    return "".join(out)


class PerfectHash:
    """A minimal perfect hash over byte strings by hashing and displacing: n keys fill n slots.

    Keys fall into buckets; each bucket, larger ones first, gets the first displacement that sends its keys to
    free slots. Buckets of one key store the slot itself.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        groups: dict[int, list[int]] = {}
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        for k, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(k)
        self.shift, self.at = [0] * self.buckets, [-1] * self.n
        order = sorted(groups.items(), key=lambda g: -len(g[1]))
        for b, own in order:
            if len(own) == 1:
                break
            d = 1
            while len(slots := {self._slot(hashes[k], d) for k in own}) < len(own) or any(self.at[s] >= 0 for s in slots):
                d += 1
            self.shift[b] = d
            for k in own:
                self.at[self._slot(hashes[k], d)] = k
        free = (s for s in range(self.n) if self.at[s] < 0)
        for b, own in order:
            if len(own) == 1:
                s = next(free)
                self.shift[b], self.at[s] = -1 - s, own[0]

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xC2B2AE3D27D4EB4F) & _M
        return (x ^ (x >> 29)) % self.n

    def find(self, key: bytes) -> int:
        """The number of the only key that ``key`` can be; the caller compares."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        return self.at[-1 - d if d < 0 else self._slot(h, d)]


class ByteBPE:
    """Encoder and decoder for one vocabulary and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if sum(map(len, ranks)) > MAX_VOCABULARY_BYTES:
            raise ValueError("the vocabulary is too large to broadcast")
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.name = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
        self.ranks, self.pattern, self.latin = ranks, plain_pattern(pattern), plain_pattern(pattern, LATIN_END)
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.keys = list(ranks)
        self.known = PerfectHash(self.keys)
        self.ids = [ranks[k] for k in self.keys]
        size = max(ranks.values()) + 1
        self.length = np.zeros(size, np.int64)
        for k, r in ranks.items():
            self.length[r] = len(k)
        self.start = np.cumsum(self.length) - self.length
        by_rank = sorted((r, k) for k, r in ranks.items())
        self.blob = np.frombuffer(b"".join(k for _, k in by_rank), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that isn't in the vocabulary."""
        n, rank_of, none = len(piece), self.ranks.get, -1
        end = list(range(1, n + 1))  # of the part that begins here
        begin = list(range(-1, n))  # of the part that ends here
        ids = [self.single[c] for c in piece]  # of the part that begins here
        pair = [none] * n  # rank of that part with the next one
        heap = []
        for i in range(n - 1):
            r = rank_of(piece[i : i + 2], none)
            if r >= 0:
                pair[i] = r
                heap.append(r * n + i)
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            if pair[i] != r:
                continue
            j = end[i]
            e = end[j]
            end[i], begin[e], ids[i], pair[j], pair[i] = e, i, r, none, none
            if e < n:
                r = rank_of(piece[i : end[e]], none)
                if r >= 0:
                    pair[i] = r
                    heappush(heap, r * n + i)
            if i:
                p = begin[i]
                pair[p] = r = rank_of(piece[p:e], none)
                if r >= 0:
                    heappush(heap, r * n + p)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = end[i]
        return out

    def piece_ids(self, piece: str) -> bytes:
        """Ids of a pre-token as little-endian 32-bit integers."""
        raw = piece.encode()
        k = self.known.find(raw)
        if self.keys[k] == raw:
            return self.ids[k].to_bytes(4, "little")
        return struct.pack(f"<{len(ids := self.merge(raw))}I", *ids)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``."""
        parts = []
        for at in range(0, len(ids), 1 << 20):
            own = ids[at : at + (1 << 20)].astype(np.int64)
            lens = self.length[own]
            ends = np.cumsum(lens)
            parts.append(self.blob[np.repeat(self.start[own] - (ends - lens), lens) + np.arange(ends[-1])].tobytes())
        return b"".join(parts)


class _Memory(dict):
    """Encodings of pre-tokens seen lately."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.bpe.piece_ids(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """A ``ByteBPE`` with its compiled pattern and memory, one to a worker process."""

    _held: dict[str, Encoder] = {}

    def __init__(self, bpe: ByteBPE):
        self.bpe, self.memory = bpe, _Memory(bpe)
        self.beyond = re.compile(f"[^\0-{chr(LATIN_END - 1)}]").search
        self.latin, self.every = re.compile(bpe.latin).findall, re.compile(bpe.pattern).findall

    @classmethod
    def of(cls, shared) -> Encoder:
        """The encoder of a broadcast vocabulary; later tasks in the same process find it again."""
        bpe = shared.value
        if bpe.name not in cls._held:
            cls._held.clear()
            cls._held[bpe.name] = cls(bpe)
        return cls._held[bpe.name]

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return (self.every if self.beyond(text) else self.latin)(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        return b"".join(map(self.memory.__getitem__, self.split(text)))


def _shared(docs: DataFrame, bpe: ByteBPE):
    return docs.sparkSession.sparkContext.broadcast(bpe)


def encode(docs: DataFrame, bpe: ByteBPE) -> DataFrame:
    """``(doc_id, ids)`` for each row of ``docs(doc_id, text)``. Null or empty text: no ids."""
    shared = _shared(docs, bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Encoder.of(shared)
        for b in batches:
            ids = [np.frombuffer(code.encode(t.as_py() or ""), "<u4") for t in b.column(1)]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = pa.array(np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, bpe: ByteBPE) -> DataFrame:
    """``(doc_id, text)`` of ``coded(doc_id, ids)``. Null ids: empty text."""
    shared = _shared(coded, bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for b in batches:
            texts = [bpe.decode(np.array(x.as_py() or [], np.int64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, bpe: ByteBPE) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: each whole text encoded, and its ids decoded again.

    Null text counts as empty: no tokens, digests of no bytes. Null doc_ids and repeated rows are kept. Empty
    table: no rows. Other columns are not read. A text is one value, so its length is bounded by a row's.
    """
    shared = _shared(docs, bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, sha = Encoder.of(shared), hashlib.sha256
        for b in batches:
            n, of_ids, of_text = [], [], []
            for t in b.column(1):
                ids = code.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                of_ids.append(sha(ids).hexdigest())
                of_text.append(sha(code.bpe.decode(np.frombuffer(ids, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
