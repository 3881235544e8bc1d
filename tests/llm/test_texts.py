"""WARC, chat, BPE, classifiers, sharding, language model and the pipeline."""

import gzip
import hashlib
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from fieldloom.llm import bpe, chat, lm, quality, sharding, toxicity, warc

DATA = "/root/testdata/sf0.001"
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def documents(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, 1, 2, 3) for i, t, s in rows], "doc_id long, text string, lang string, source string, rid long, score long, range long")


def key(r):
    return [(x is None, str(x)) for x in r]


# ------------------------------------------------------------------------------------------------------ WARC


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


LONG = "<p>" + "é" * 60 + "</p>"


def test_warc_round_trip(spark):
    rows = [(5, "http://a/b c?q=é\r\nX: y", LONG), (3, None, LONG), (9, "http://z", LONG), (1, "u", None), (2, "u", ""), (7, "u", "short"), (8, "u", "short"), (None, "u", LONG), (6, "u", "\r\n\r\nWARC/1.1\r\n" * 9), (3, None, LONG), (10, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", "y" * 100), (13, "u", "y" * 100)]
    archives = warc.write_archives(pages(spark, rows), warc.new_path(spark, "test"))
    got = warc.read_archives(archives, texts=True).collect()
    assert len(got) == len(rows) == archives.agg(F.sum("records")).first()[0]
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = b in first and first[b] != i
        want.append((i, len(b), sha(b), "revisit" if revisit else "response", first[b] if revisit else None))
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    folder = archives.first().path.rsplit("/", 1)[0]
    assert warc.read_files(spark, f"{folder}/*.warc.gz").count() == len(rows)
    assert sorted([tuple(r) for r in warc.round_trip(pages(spark, rows)).collect()], key=key) == sorted(want, key=key)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_archives_roll_over(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1000)
    rows = [(k, "u", f"{random.Random(k).random()}" * 40) for k in range(50)]
    archives = warc.write_archives(pages(spark, rows).coalesce(1), warc.new_path(spark, "test"))
    assert archives.count() > 3
    assert {r.page_id for r in warc.read_archives(archives).collect()} == set(range(50))


def test_damaged_archives():
    good = [warc.encode(k, "u", b"payload %d" % k, None, False, sha(b"payload %d" % k)) for k in range(3)]
    assert [r.page_id for r in warc.read_records(io.BytesIO(b"".join(good)))] == [0, 1, 2]
    body = gzip.decompress(good[1])
    for bad in (good[0][:-9], b"junk" + good[0], gzip.compress(body.replace(b"payload 1", b"payload 2")), gzip.compress(body + b"x"), gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n")):
        with pytest.raises(warc.Corrupt):
            list(warc.read_records(io.BytesIO(good[2] + bad)))
    info = gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n")
    assert len(list(warc.read_records(io.BytesIO(info + good[0])))) == 1


# ------------------------------------------------------------------------------------------------------ chat


def test_chat_grammar(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "plain", "", None, "[/INST][INST", "<s", "é\n</s", "$1 \\$2", "x" * 50_000, "a\\nb [INST]"]
    rows = [(k, t, r, x) for k in range(4) for t, (r, x) in enumerate(zip(["user", "assistant", "system", None, "[INST]", "a\\"] * 3, random.Random(k).sample(said, len(said))))]
    rows += [(9, 1, "user", "b"), (9, 1, "user", "a"), (9, None, "assistant", "first"), (9, 1, "user", "a"), (None, 0, "assistant", "no id")]
    df = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, n int, rendered string, p string").unionByName(chat.hostile(spark), allowMissingColumns=True)
    out = chat.format_conversations(df.repartition(5)).collect()
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    rows += [(-1, 0, "user", said[0]), (-1, 1, "assistant", said[0])]
    for r in out:
        own = sorted(((t is not None, t or 0, (a or "").encode(), (x or "").encode()) for c, t, a, x in rows if c == r.conv_id))
        own = [(a.decode(), x.decode()) for *_, a, x in own]
        assert [tuple(t) for t in r.turns] == own
        loss = "".join(x for a, x in own if a == "assistant")
        g = got[r.conv_id]
        assert tuple(g)[1:] == (len(own), sha("".join(f"{a}\n{x}\n" for a, x in own)), len(loss), sha(loss), len(r.formatted))
        assert r.formatted.count("</s>") == r.formatted.count("<s>") == r.formatted.count("[INST]") == r.formatted.count("[/INST]") == len(own)
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert [x.replace("\\", "") for x in spans] == [x.replace("\\", "") for a, x in own if a == "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)


def texts():
    r = random.Random(8)
    points = [chr(c) for c in [*range(0x250), *(r.randrange(0x250, 0x110000) for _ in range(4000))] if not 0xD800 <= c < 0xE000]
    out = ["".join(r.choice(points if k % 2 else points[:0x250]) for _ in range(r.randrange(60))) for k in range(400)]
    return out + ["", " ", "a" * 5000, " \n\t x", "I'll don't '''s'S", "日本語と한국어", "ab" * 3000 + " " * 300, "<|endoftext|>", "\U00013440\U0001e030"]


def test_bpe_equals_tiktoken(codec):
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    own = bpe.Encoder(codec)
    for t in texts():
        ids = np.frombuffer(own.encode(t), "<u4")
        assert ids.tolist() == want.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_perfect_hash(codec):
    assert sorted(codec.known.find(k) for k in codec.keys) == list(range(len(codec.keys)))
    small = bpe.PerfectHash([b"a"])
    assert small.find(b"a") == small.find(b"zzz") == 0


def test_bpe_tables(spark, codec):
    rows = [(k, t, "s") for k, t in enumerate(texts()[-60:])] + [(900, None, "s"), (1, "x", None), (1, "x", None), (None, "y", None)]
    df = documents(spark, rows)
    got = [tuple(r) for r in bpe.round_trip(df, codec).collect()]
    own = bpe.Encoder(codec)
    want = [(i, len(ids := own.encode(t or "")) // 4, sha(ids), sha(t or "")) for i, t, _ in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    back = bpe.decode(bpe.encode(df, codec), codec).collect()
    assert sorted([(r.doc_id, r.text) for r in back], key=key) == sorted([(i, t or "") for i, t, _ in rows], key=key)
    assert bpe.round_trip(documents(spark, []), codec).count() == 0


# ----------------------------------------------------------------------------------------------- classifiers


def labelled(spark, n=400):
    r = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        ws = [f"w{r.randrange(200)}" for _ in range(r.randrange(20, 80))]
        if bad:
            ws[r.randrange(len(ws))] = r.choice(["Vileword!", "nastyone,"])
        rows.append((k, " ".join(ws), "s"))
        labels.append((k, 1, int(bad), "x"))
    labels += [(5, None, None, "x"), (None, 1, 1, "x"), (99999, 0, 1, "x")]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 400 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    model = toxicity.train(docs, labels)
    assert len(model.at) < 2000
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    docs, labels = labelled(spark, 200)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, turned))
    assert a.bias == b.bias and (a.at == b.at).all() and (a.weight == b.weight).all()


def test_classifiers_on_odd_inputs(spark):
    docs = documents(spark, [(1, None, "s"), (2, "", "s"), (3, " \n ", None), (3, " \n ", None), (None, "word " * 30_000, "s")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 5
        got = quality.assess(docs, quality.train(docs, labels)).collect()
        assert sorted(r.n_words for r in got) == [0, 0, 0, 0, 30_000] and all(r.base_failed and not r.kept for r in got)
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == quality.assess(empty, quality.train(empty, none)).count() == 0


def plain_counts(text):
    raw = (text or "").encode()
    ws = raw.split()
    grams = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
    inside = {k + d for k in range(len(ws) - 4) if grams[tuple(ws[k : k + 5])] > 1 for d in range(5)}
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    return [len(ws), sum(len(w.decode()) for w in ws), sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")), dup, len(inside)]


def test_quality_counts(spark):
    r = random.Random(6)
    cases = [None, "", " ", "a b c d e a b c d e", "x\nx\n x\n\nx \nx", "é#ü|<>  a\x1cb\x0bc", "a a a a a a a", "one two", "| | |\n| | |\n \t\n \t"]
    cases += ["".join(r.choice("ab \n#é") for _ in range(r.randrange(300))) for _ in range(60)]
    for t in cases:
        assert quality.statistics(t and t.encode())[0] == plain_counts(t), t
    docs = documents(spark, [(k, t, "s") for k, t in enumerate(cases)])
    forest = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    for row in quality.assess(docs, forest).collect():
        n = plain_counts(cases[row.doc_id])
        assert [row[c] for c in quality.COUNTS] == n
        assert row.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and row.kept == (not row.base_failed)


def test_forest_learns_and_is_monotonic():
    r = np.random.default_rng(1)
    x = r.random((3000, len(quality.FEATURES)))
    s = quality.FEATURES.index("symbols_per_word")
    y = ((x[:, s] < 0.5) & (x[:, 0] > 0.2) ^ (r.random(3000) < 0.05)).astype(float)
    forest = quality.fit(x[:2000], y[:2000])
    assert ((forest.probability(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
    grid = np.repeat(x[:50], 40, axis=0)
    grid[:, s] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(forest.margin(grid).reshape(50, 40), axis=1) <= 1e-12).all()
    loose = quality.fit(x, 1 - y, monotone={})
    assert (np.diff(loose.margin(grid).reshape(50, 40), axis=1) > 0).any()


def test_quality_on_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    q = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.assess(docs, quality.train(docs, labels.where("doc_id % 2 = 0"))).collect()
    held = [r for r in got if r.doc_id in q and r.doc_id % 2 and not r.base_failed]
    assert sum(r.kept == q[r.doc_id] for r in held) >= 0.9 * len(held)


# -------------------------------------------------------------------------------------------------- sharding


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    r = random.Random(7)
    rows = [(k, "x" * r.randrange(9), r.choice(["a"] * 6 + ["b", "c", None])) for k in range(1003)] + [(1, "dup", "a")] * 5 + [(None, None, "b"), (2000, "é", "")]
    df = documents(spark, rows)
    got = sharding.stratified_shards(df.repartition(7), 40, carry=("source", "text")).collect()
    n = len(rows)
    assert sorted([(g.doc_id, g.text, g.source) for g in got], key=key) == sorted(rows, key=key)
    assert all(g.size == len((g.text or "").encode()) + 16 and g.text_crc32 == zlib.crc32((g.text or "").encode()) and g.law == "rows" and g.grown_shard is None for g in got)
    by = {s: [g for g in got if g.shard == s] for s in range(40)}
    assert {len(x) for x in by.values()} <= {n // 40, -(-n // 40)}
    assert all(sorted(g.slot for g in x) == list(range(len(x))) for x in by.values())
    for source, total in Counter(s for *_, s in rows).items():
        assert all(abs(sum(g.source == source for g in x) - total / 40) <= 2 for x in by.values())
    again = sharding.stratified_shards(df.coalesce(1), 40).collect()
    assert sorted(map(tuple, again), key=key) == sorted([tuple(g)[:7] for g in got], key=key)
    assert sharding.stratified_shards(documents(spark, []), 40).count() == 0
    assert sorted(g.shard for g in sharding.stratified_shards(df.limit(3), 40).collect()) == [0, 13, 26]


def test_written_shards(spark, tmp_path):
    df = documents(spark, [(k, f"t{k}", "ab"[k % 2]) for k in range(20)])
    sharding.write_shards(df, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 20 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


# -------------------------------------------------------------------------------------------- language model


def corpus():
    r = random.Random(9)
    rows = []
    for k in range(500):
        side = "ab"[k % 2]
        rows.append((k, " ".join(f"{side}{min(r.randrange(40), r.randrange(40))}" for _ in range(400)), "s"))
    return rows + [(600, None, "s"), (601, "", None), (602, "Unseen WORDS only here", "s"), (3, "a1 A1 b1", "s"), (None, "a1 a2", "s")]


@pytest.mark.parametrize("head", [1 << 18, 10])
def test_language_model(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "CLASSES", 30)
    rows = corpus()
    vocabulary = lm.vocabulary
    monkeypatch.setattr(lm, "vocabulary", lambda counts: vocabulary(counts, 30, head))
    got = lm.score(documents(spark, rows)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t, _ in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = [(i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t, _ in rows]
    assert sorted([(*tuple(r)[:5], round(r.base_score, 6)) for r in got], key=key) == sorted(want, key=key)
    out = [r for r in got if r.held_out and r.n_tokens > 50]
    if head > 10:
        assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm.score(documents(spark, [])).count() == 0


def test_model_is_normalised():
    noise = np.array([0.5, 0.3, 0.15, 0.05])
    model = lm.LogBilinear.start(noise)
    before = np.array([[0, 1, 4, 4]] * 4, np.int16)
    assert np.exp(model.log_probs(np.arange(4), before)).sum() == pytest.approx(1, abs=1e-5)
    c = np.tile([0, 1, 2, 3], 500).astype(np.int16)
    own = lm.Trainer(model, noise, 1)
    ctx = lm.contexts(c, np.array([2000]), 4)
    for _ in range(5):
        own.learn(c, ctx)
    assert own.m.log_probs(c, ctx).mean() > model.log_probs(c, ctx).mean() + 0.3


def test_shares_of_the_vocabulary_sum_to_one():
    v = lm.Vocabulary(100, 7, 10, np.array([3, 5, lm.END]), np.array([40, 20, 10]), np.array([0, 1, 3]), 2)
    rest = 100 - 40 - 20 - 10  # in four other words
    assert v.other_total == rest + 4 + 1
    assert v.noise().sum() == pytest.approx(1)


# -------------------------------------------------------------------------------------------------- pipeline


def plain_least_distance(pattern, text):
    """Least edit distance of the pattern to a part of the text, a row at a time."""
    at = np.arange(len(text) + 1)
    row, text = np.zeros(len(text) + 1, int), np.array(text, object)
    for i, p in enumerate(pattern, 1):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != p))
        new[0] = i
        row = np.minimum.accumulate(new - at) + at
    return row.min()


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    from test_pairs import plain_dedup

    from fieldloom.llm.simhash import fingerprint
    from fieldloom.llm.text import plain_tokens

    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    rows = {r.doc_id: r.text for r in read("documents").collect()}
    start = len(rows)

    model = toxicity.train(read("documents"), read("labels"))
    weights = model.dense()
    rows = {i: t for i, t in rows.items() if toxicity.sigmoid(weights[toxicity.features(t.encode())].sum() + model.bias) < 0.5}
    kept = [set(rows)]

    fps = {i: fingerprint(t.encode(), 5) for i, t in rows.items()}
    words = {i: t.encode().lower().split() for i, t in rows.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4 or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    name = {i: i for i in fps}
    for i in fps:
        for j in fps:
            if i < j and name[i] != name[j] and near(i, j):
                a, b = sorted((name[i], name[j]))
                name = {k: a if v == b else v for k, v in name.items()}
    rows = {i: t for i, t in rows.items() if name[i] == i}
    kept.append(set(rows))

    cut = plain_dedup(list(rows.items()), 35)
    rows = {i: rows[i] if not gone else left.decode() for i, _, gone, left in cut}
    kept.append(set(rows))

    items = [plain_tokens(r.text.encode()) for r in read("benchmark").collect()]
    rows = {i: t for i, t in rows.items() if not any(plain_least_distance(p, plain_tokens(t.encode())) <= len(p) // 5 for p in items)}
    kept.append(set(rows))
    assert start > len(kept[0]) > len(kept[1]) and len(kept[3]) >= 0.8 * start

    docs, columns = read("documents"), read("documents").columns
    for (_, step), ids in zip(corpus_pipeline.STAGES, kept):
        docs = corpus_pipeline.stage(step(spark, docs, DATA), "test")
        assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(ids)
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t)) for i, t in rows.items()}

    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    want = []
    for i, t in rows.items():
        ids = np.array(codec.encode_ordinary(t), "<u4")
        want.append((i, len(ids), sha(ids.tobytes()), sha(t)))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(want)
