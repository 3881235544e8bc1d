"""Prefix trie of conversations by mergeable partial tries.

A node is a sequence of first turns; its key is a chained 128-bit hash of their roles and texts, so equal prefixes have
equal keys wherever they are met. Each task reads its conversations turn by turn and emits a table of the nodes that it
met, combined locally: members, the smallest one, and the conversations that end there. Tables merge by key in rounds
of FAN_IN, which sum members and join end lists. End lists are held in chunks of 1,024 ids, so that no node's list is
one value, however many conversations are alike.

The rollup goes from the leaves upward by doubling: after round k each node has what stands less than 2^k turns below
it, and a node tells its sum to the ancestor 2^k turns above. A trie of depth d takes log2(d) rounds, in each of which
only nodes of depth 2^k or more say anything.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.staging import release, stage

#: Partial tries that one round of merging makes one.
FAN_IN = 32
#: Nodes and ends that a task holds before it emits them; a conversation's own nodes come besides.
HELD = 1 << 17
#: Conversations of one block, the first of which lends the others their first turns.
SHARED = 20
ROOT = bytes(16)
_CHUNK_BITS = 10
_SCHEMA = "part int, key binary, depth long, words long, jumps binary, n_convs long, conv_id long, ends array<long>"


class PartialTrie:
    """Nodes of conversations read in turn, by key: ``[depth, words, jumps, n_convs, conv_id, ends]``."""

    def __init__(self) -> None:
        self.nodes: dict[bytes, list] = {}
        self.held = 0

    def begin(self, conv_id: int) -> None:
        """A conversation of no turns so far."""
        self.conv_id, self.path = conv_id, [ROOT]
        self._count(ROOT, 0)

    def add(self, digest: bytes, words: int) -> None:
        """Its next turn."""
        key = hashlib.blake2b(self.path[-1] + digest, digest_size=16).digest()
        self.path.append(key)
        self._count(key, words)

    def end(self) -> None:
        self.nodes[self.path[-1]][5].append(self.conv_id)
        self.held += 1

    def _count(self, key: bytes, words: int) -> None:
        node = self.nodes.get(key)
        if node is None:
            depth = len(self.path) - 1
            self.nodes[key] = [depth, words, b"".join(self.path[depth - (1 << k)] for k in range(depth.bit_length())), 1, self.conv_id, []]
            self.held += 1
        else:
            node[3] += 1
            node[4] = min(node[4], self.conv_id)

    def emit(self, part: int) -> pa.RecordBatch:
        """All nodes so far; the table starts anew."""
        depth, words, jumps, n, conv, ends = (list(x) for x in zip(*self.nodes.values()))
        keys = list(self.nodes)
        self.__init__()
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.binary()), *(pa.array(x, pa.int64()) for x in (depth, words)), pa.array(jumps, pa.binary()), pa.array(n, pa.int64()), pa.array(conv, pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
            ["part", "key", "depth", "words", "jumps", "n_convs", "conv_id", "ends"],
        )


def lent(conv_id: int) -> int:
    """How many first turns a conversation takes from its block's first."""
    return zlib.crc32(str(conv_id).encode()) % 4


def _reader(held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partial tries of rebuilt conversations; rows ``(block, conv_id, digest, words)`` come in order, a block's first conversation first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, trie = TaskContext.get().partitionId(), PartialTrie()
        block = conv = None
        first: list[tuple[bytes, int]] = []
        own = take = 0
        for b in batches:
            for at, c, digest, words in zip(*(b.column(k).to_pylist() for k in range(4))):
                if (at, c) != (block, conv):
                    if conv is not None:
                        trie.end()
                        if trie.held >= held:
                            yield trie.emit(part)
                    if at != block:
                        first = []
                    block, conv, own, take = at, c, 0, lent(c)
                    trie.begin(c)
                    if c != at:
                        for turn in first[:take]:
                            trie.add(*turn)
                if c == at:
                    trie.add(digest, words)
                    if own < 3:
                        first.append((digest, words))
                elif own >= take:
                    trie.add(digest, words)
                own += 1
        if conv is not None:
            trie.end()
            yield trie.emit(part)

    return run


def partial_tries(turns: DataFrame, held: int = HELD) -> DataFrame:
    """Node tables of the rebuilt conversations of ``turns``, a row per node and task that met it.

    Only a digest and a word count stand for a turn's text, so no text is shuffled. A block of conversations that share
    their first turns meets in one task, which reads each conversation once, in order.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        (F.col("conv_id") - F.col("conv_id") % SHARED).cast("long").alias("block"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.substr(F.unhex(F.sha2(said.cast("binary"), 256)), F.lit(1), F.lit(16)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        "turn",
    )
    order = ["block", F.col("conv_id") != F.col("block"), "conv_id", F.col("turn").asc_nulls_first(), "digest"]
    return rows.repartition("block").sortWithinPartitions(*order).select("block", "conv_id", "digest", "words").mapInArrow(_reader(held), _SCHEMA)


def _rounds(width: int) -> int:
    """Rounds that make ``width`` partial tries one; one at least, as a task may emit a node twice."""
    n = 1
    while width > FAN_IN:
        width, n = -(-width // FAN_IN), n + 1
    return n


def merge(partial: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """``(key, depth, words, jumps, n_convs, conv_id)`` of the whole trie, and its ends ``(key, chunk, ids)``.

    ``partial`` has partial tries of parts 0 to ``width`` - 1.
    """
    up = F.floor(F.col("part") / FAN_IN).cast("int").alias("part")
    nodes = partial.drop("ends")
    ends = partial.select("part", "key", F.explode("ends").alias("id"))
    ends = ends.select("part", "key", F.shiftright("id", _CHUNK_BITS).alias("chunk"), F.array("id").alias("ids"))
    for _ in range(_rounds(width)):
        nodes = nodes.groupBy(up, "key", "depth", "words", "jumps").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
        ends = ends.groupBy(up, "key", "chunk").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return nodes.drop("part"), ends.select("key", "chunk", F.sort_array("ids").alias("ids"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's chunks, which come in order; the state is one hash."""
    key, state = None, None
    for b in batches:
        done: list[tuple[bytes, str]] = []
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``(key, ends_sha256)``: of the ids that end at a node, in order, comma-joined.

    A digest is taken in order by its nature; a task sees a chunk of a node's ids at a time and holds one hash.
    """
    rows = ends.select("key", "chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    return rows.repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids").mapInArrow(_digests, "key binary, ends_sha256 string")


def _ancestor(k: int) -> F.Column:
    return F.substr("jumps", F.lit(16 * k + 1), F.lit(16))


def roll_up(nodes: DataFrame, height: int) -> DataFrame:
    """``nodes`` with ``n_children``, and sums over each node's subtree: ``n_leaves`` and ``saved_tokens``."""
    children = stage(nodes.where("depth > 0").groupBy(_ancestor(0).alias("key")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    kids = F.coalesce("n_children", F.lit(0))
    sums = nodes.join(children, "key", "left").withColumn("n_children", kids).withColumn("n_leaves", (kids == 0).cast("long"))
    sums = stage(sums.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")).drop("words"), "sums")
    for k in range(height.bit_length()):
        told = sums.where(F.col("depth") >= 1 << k).groupBy(_ancestor(k).alias("key")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        told, before = stage(told, "told"), sums
        more = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
        sums = stage(before.join(told, "key", "left").select("key", "depth", "jumps", "n_convs", "conv_id", "n_children", more("n_leaves", "l"), more("saved_tokens", "s")), "sums")
        release(before)
        release(told)
    release(children)
    return sums


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations of ``turns(conv_id, turn, role, text)``.

    A conversation c is rebuilt from the first h turns of conversation c - c % 20 and its own turns after its first h,
    with h = crc32(decimal c) % 4. Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the
    root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Null role or text: empty. Null turn: first. Rows of one turn are ordered by a hash of role and text; repeated rows
    are repeated turns. Rows with a null conv_id belong to no conversation and are left out, as a member is an id.
    Empty table: no rows. Columns besides the four are not read. A very long text costs its length once; a very long
    conversation holds a key for each of its turns in the task that reads it.
    """
    partial = stage(partial_tries(turns), "partial-tries")
    size = partial.agg(F.max("part").alias("part"), F.max("depth").alias("depth")).first()
    nodes, ends = merge(partial, (size["part"] or 0) + 1)
    merged = stage(nodes, "nodes")
    sums = roll_up(merged, size["depth"] or 0)
    digests = stage(end_digests(ends), "ends")
    release(partial)
    release(merged)
    above = F.when(F.col("depth") > 0, _ancestor(0)).alias("above")
    parents = sums.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    out = sums.withColumn("above", above).join(parents, "above", "left").join(digests, "key", "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
