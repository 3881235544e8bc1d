"""The Jaccard join against all pairs, and signature trees against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import jaccard

DOCS = "doc_id long, text string, lang string, n long, sid string, key int, doc int, sig string, at int"


def table(spark, rows):
    """Documents with columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, "en", 1, "s", 2, 3, "g", 4) for i, t in rows], DOCS)


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    """The contract by all pairs."""
    sets = [plain_set(t) for _, t in rows]
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if name[i] != name[j] and x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((name[i], name[j]))
                name = [a if c == b else c for c in name]
    least = {c: min((i for (i, _), k in zip(rows, name) if k == c and i is not None), default=None) for c in name}
    return sorted([(i, len(s), least[c]) for (i, _), s, c in zip(rows, sets, name)], key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def changed(r, words, share):
    words = list(words)
    for _ in range(round(len(words) * share / 5)):
        words[r.randrange(len(words))] = f"x{r.randrange(9999)}"
    return words


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(9)
    rows = []
    passage = [f"p{k}" for k in range(60)]
    for n in (6, 15, 40, 90, 300):
        for _ in range(8):
            base = [f"w{r.randrange(4000)}" for _ in range(n)]
            for share in (0, 0, 0.05, 0.1, 0.15, 0.2, 0.22, 0.3):
                rows.append(" ".join(changed(r, base, share)))
            rows.append(" ".join(base[: n // 2] + passage + base[n // 2 :]))  # many hold one passage
    base = [f"g{k}" for k in range(120)]
    for k in range(150):  # a large group of near copies, not all of them near each other
        rows.append(" ".join(changed(r, base, r.choice([0.05, 0.1, 0.12, 0.2]))))
    rows += ["one two", "ONE  two", "a b c d", "a b c d e", "", " \t", None, None, "Ünï ünï", "long " * 200_000]
    out = list(enumerate(rows))
    r.shuffle(out)
    return out + [out[0], out[0], (None, rows[0]), (None, rows[0]), (None, "alone of its kind"), (None, None)]


def test_components_equal_all_pairs(spark, corpus):
    assert got(jaccard.jaccard_components(table(spark, corpus).repartition(7))) == plain(corpus)


def test_blocks_and_small_bounds_change_nothing(spark, corpus, monkeypatch):
    for name, value in (("BLOCK", 20), ("SMALL", 0), ("PARTNERS", 3)):
        monkeypatch.setattr(jaccard, name, value)
    assert got(jaccard.jaccard_components(table(spark, corpus))) == plain(corpus)


def test_empty_tables(spark):
    assert got(jaccard.jaccard_components(table(spark, []))) == []
    assert got(jaccard.jaccard_components(table(spark, [(1, None), (2, ""), (2, "")]))) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]


def test_dual_traversal_loses_no_pair(monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 4)
    monkeypatch.setattr(jaccard, "FAN", 3)
    r = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = r.integers(-(2**62), 2**62, r.integers(4, 900))
        for keep in (1, 0.95, 0.85, 0.5):
            sets.append(np.unique(base[: max(1, int(len(base) * keep))]))
    n = np.array([len(s) for s in sets])
    bits = np.array([jaccard.bitmap(s) for s in sets])
    hidden = n - np.bitwise_count(bits.view(np.uint64)).sum(axis=1, dtype=np.int64)
    group = np.arange(len(sets)) // 9
    tree = jaccard.SignatureTree(n, n, hidden, bits, group)
    found = [(int(a), int(b)) for x, y in tree.pairs() for a, b in zip(x, y)]
    assert len(found) == len(set(found)) and all(a < b and group[a] != group[b] for a, b in found)
    near = {(a, b) for b in range(len(sets)) for a in range(b) if jaccard.near_enough(len(np.intersect1d(sets[a], sets[b])), n[a], n[b])}
    assert {p for p in near if group[p[0]] != group[p[1]]} <= set(found)
    assert len(found) < len(sets) ** 2 / 20
    a, b = jaccard.SignatureTree(n, n, hidden, bits, np.arange(len(sets))).forest()
    assert len(set(b.tolist())) == len(b) and (a < b).all()


def test_loads_count_all_texts(spark):
    docs = spark.range(3000).select(F.concat_ws(" ", F.lit("a b c d e f"), F.col("id").cast("string")).cast("binary").alias("text"))
    loads = jaccard.bucket_loads(docs)
    assert loads.sum() == 9000 and loads.max() >= 3000
