"""SimHash, substring dedup and decontamination against brute force."""

import random

import numpy as np
import pytest
import xxhash

from fieldloom.llm import decontaminate, simhash, substring

DOCS = "doc_id long, text string, lang string, fp long, doc long, sig int, ranges string"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, "x") for i, t in rows], DOCS)


def text_of(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.fixture(scope="module")
def near_copies():
    r = random.Random(11)
    rows = []
    for g in range(12):
        base = text_of(r, 150).split()
        for _ in range(6):
            copy = list(base)
            for _ in range(r.randrange(3)):
                copy[r.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " \t\n", "One two", "one TWO", "x", text_of(r, 30_000)])]
    return rows + [rows[0], (None, rows[3][1]), (None, "alone in its class")]


def test_simhash_components(spark, near_copies):
    got = simhash.simhash_components(table(spark, near_copies)).collect()
    fps = [plain_fingerprint(t) for _, t in near_copies]
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    least = {c: min((i for (i, _), x in zip(near_copies, root) if x == c and i is not None), default=None) for c in root}
    want = [(i, f"{f:016x}", least[c]) for (i, _), f, c in zip(near_copies, fps, root)]
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    assert any(r.component_id != r.doc_id for r in got)


def test_simhash_on_no_rows(spark):
    assert simhash.simhash_components(table(spark, [])).count() == 0
    assert simhash.keep_one(table(spark, [])).count() == 0


@pytest.mark.parametrize("chain", [4, 6, 8])
def test_every_chain_length_finds_all_links(chain):
    sets = simhash.equal_sets(4, chain)
    r = random.Random(chain)
    parts = simhash.layout()
    for _ in range(300):
        x = 0
        for b in r.sample(range(64), r.randrange(5)):
            x |= 1 << b
        zero = [(x >> at) & ((1 << w) - 1) == 0 for at, w in parts]
        starts = [s for s in range(9) if any(all(zero[(s + p) % 9] for p in same) for same in sets)]
        assert starts
        assert any(simhash._chain_holds(np.array([x], np.uint64), np.array([s]), 4)[0] for s in starts)


def test_large_buckets_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    fps = [(1 << a) | (1 << b) for a in range(12) for b in range(a)] + [0]
    reps = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash.near_links(reps, 4).collect()
    nodes = {f: f for f in fps}
    for e in edges:
        a, b = nodes[e.src], nodes[e.dst]
        nodes = {k: a if v == b else v for k, v in nodes.items()}
    assert len(set(nodes.values())) == 1
    assert all((e.src ^ e.dst).bit_count() <= 4 for e in edges)


def test_keep_one(spark, near_copies):
    kept = simhash.keep_one(table(spark, near_copies), width=4).collect()
    whole = simhash.simhash_components(table(spark, near_copies)).collect()
    groups = {(r.component_id if r.component_id is not None else r.fingerprint) for r in whole}
    assert len(kept) == len(groups) and list(kept[0].asDict()) == table(spark, []).columns
    assert {r.doc_id for r in kept if r.doc_id is not None} == {r.component_id for r in whole if r.component_id is not None}


# ------------------------------------------------------------------------------------------------- substring


def plain_dedup(rows, n):
    places = {}
    for r, (_, t) in enumerate(rows):
        ws = (t or "").encode().split()
        for k in range(len(ws) - n + 1):
            places.setdefault(tuple(ws[k : k + n]), []).append((r, k))
    gone = [set() for _ in rows]
    for found in places.values():
        if len(found) > 1:
            for r, k in found:
                gone[r].update(range(k, k + n))
    return [(i, len(ws := (t or "").encode().split()), len(gone[r]), b" ".join(w for k, w in enumerate(ws) if k not in gone[r])) for r, (i, t) in enumerate(rows)]


def passages(n):
    r = random.Random(n)
    shared = [text_of(r, n + k) for k in (0, 1, 3, 2 * n, 5)]
    rows = []
    for k in range(40):
        parts = [text_of(r, r.randrange(60), 50)]
        for _ in range(r.randrange(3)):
            parts += [r.choice(shared), text_of(r, r.randrange(40), 50)]
        rows.append((k, " ".join(parts)))
    cut = shared[3].split()
    rows += [(100, " ".join(cut[: n - 1])), (101, " ".join(cut[3 : 3 + n])), (102, "tick " * (3 * n)), (103, "tock tick " * n), (104, None), (105, ""), (106, "été x \x1c y " * n)]
    rows += [(107, rows[5][1]), rows[6], (None, rows[7][1]), (None, rows[7][1]), (5, "same id, other text"), (108, text_of(r, 20_000, 9000))]
    return rows


@pytest.mark.parametrize("n", [35, 8, 3])
def test_substring_dedup(spark, n):
    import hashlib

    rows = passages(n)
    got = substring.dedup_digests(table(spark, rows), n).collect()
    want = [(i, w, g, hashlib.sha256(t).hexdigest()) for i, w, g, t in plain_dedup(rows, n)]
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    assert sum(w[2] for w in want) > 0


def test_substring_texts(spark):
    rows = passages(8)
    got = substring.dedup_texts(table(spark, rows), 8)
    assert got.columns == table(spark, []).columns
    want = [t if not gone else kept.decode() for (_, t), (_, _, gone, kept) in zip(rows, plain_dedup(rows, 8))]
    assert sorted(r.text or "" for r in got.collect()) == sorted(x or "" for x in want)
    assert substring.dedup_digests(table(spark, [])).count() == 0


# ------------------------------------------------------------------------------------------- decontamination


def plain_distance(pattern, text):
    """Least edit distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_contaminated(spark):
    r = random.Random(4)
    items = [(k, text_of(r, n, 300)) for k, n in enumerate((5, 9, 20, 38, 80))] + [(90, "two words"), (91, None), (92, ""), (93, None)]
    items.append((94, items[2][1].upper()))
    docs = []
    for k in range(60):
        ws = items[k % 5][1].split()
        for _ in range(r.randrange(len(ws) // 4 + 2)):
            at = r.randrange(len(ws))
            ws[at : at + r.randrange(2)] = ["new"] * r.randrange(2)
        docs.append((k, f"{text_of(r, r.randrange(50), 300)} {', '.join(ws)}! {text_of(r, 20, 300)}"))
    docs += [(200, None), (201, ""), (202, "two words"), (3, docs[3][1]), (None, items[3][1])]
    got = decontaminate.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    from fieldloom.llm.text import plain_tokens as tokens

    want = []
    for i, t in docs:
        for j, u in items:
            p, x = tokens((u or "").encode()), tokens((t or "").encode())
            if len(p) >= 5 and (d := plain_distance(p, x)) <= len(p) * 0.2:
                want.append((i, j, d, len(p)))
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted([(g.doc_id, g.item_id, g.distance, g.item_words) for g in got], key=key) == sorted(want, key=key)
    assert 0 < len({w[0] for w in want}) < len(docs) and any(w[2] for w in want)
    text = dict(docs)
    for g in got:
        if g.doc_id is not None:
            part = tokens(text[g.doc_id].encode())[g.first_word : g.end_word]
            assert plain_distance(tokens(dict(items)[g.item_id].encode()), part) == g.distance
    kept = decontaminate.keep_clean(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.count() == len(docs) - len([d for d in docs if d[0] in {w[0] for w in want}])


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    items = [(k, f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(10)]
    docs = [(k, f"x y {t} z") for k, t in items]
    got = decontaminate.contaminated(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((g.doc_id, g.item_id) for g in got) == [(k, k) for k in range(10)]


def test_nothing_to_match(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(table(spark, [(1, "a b c d e f")]), empty).count() == 0
    assert decontaminate.keep_clean(table(spark, [(1, "a b c d e f")]), empty).count() == 1
    assert decontaminate.contaminated(table(spark, []), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0
