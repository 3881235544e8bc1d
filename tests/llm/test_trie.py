"""The prefix trie against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

from fieldloom.llm import trie

COLUMNS = "conv_id long, turn long, role string, text string, part int, key string, depth int, words string"


def table(spark, rows):
    """Turns with columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, 1, "k", 2, "w") for r in rows], COLUMNS)


def plain(rows):
    """The contract, by dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        turns = said.get(donor, [])[:h] + said[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode().split()) if p else 0
    out = []
    for p, m in members.items():
        done = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], done))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def random_rows(n=300):
    r = random.Random(3)
    rows = []
    for c in r.sample(range(-60, 2000), n):
        for t in range(r.choice([0, 1, 1, 2, 3, 4, 5, 8])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a b", "a  b c", "", None, "é x\ty", "z"])))
    rows += [(7000, t, "user", f"turn {t}") for t in range(150)] + [(7001, t, "user", f"turn {t}") for t in range(140)]
    rows += [(7020 + k, t, "user", f"hot {t}") for k in range(400) for t in range(5)]
    return rows


def test_trie_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(trie, "FAN_IN", 2)
    whole = trie.partial_tries
    monkeypatch.setattr(trie, "partial_tries", lambda turns: whole(turns, held=40))
    rows = random_rows()
    random.Random(1).shuffle(rows)
    assert got(trie.prefix_trie(table(spark, rows))) == plain(rows)


def test_nulls_ties_and_repeats(spark):
    rows = [(None, 0, "user", "x"), (3, None, None, None), (3, 1, "user", "b"), (5, 0, "user", "same"), (5, 0, "user", "same"), (20, 0, None, "one two"), (21, 0, "a", "b"), (21, None, "a", "first")]
    assert got(trie.prefix_trie(table(spark, rows))) == plain(rows)
    tied = [(40, 0, "user", t) for t in "cab"]
    a, b = (got(trie.prefix_trie(table(spark, x))) for x in (tied, tied[::-1]))
    assert a == b and len(a) == 4


def test_a_long_text_and_empty_tables(spark):
    rows = [(0, 0, "user", "long " * 300_000), (1, 0, "user", "x")]
    assert got(trie.prefix_trie(table(spark, rows))) == plain(rows)
    assert got(trie.prefix_trie(table(spark, []))) == []
    assert got(trie.prefix_trie(table(spark, [(None, 1, "user", "x")]))) == []


def test_no_turns_left_is_the_root_alone(spark):
    c = next(c for c in range(1, 200) if c % 20 and trie.lent(c) == 3)
    rows = [(c, 0, "user", "own")]
    assert got(trie.prefix_trie(table(spark, rows))) == plain(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_partial_tries_are_combined_locally(spark):
    rows = [(20 * k, t, "user", f"same {t}") for k in range(500) for t in range(3)]
    partial = trie.partial_tries(table(spark, rows).coalesce(3))
    per = partial.groupBy("part", "key").count().collect()
    assert max(r["count"] for r in per) == 1 and sum(r["n_convs"] for r in partial.where("depth = 3").collect()) == 500
