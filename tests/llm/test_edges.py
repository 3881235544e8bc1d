"""Cases that a key, a bound or a partitioning could get wrong."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import chat, decontaminate, labels, lm, sharding, substring, toxicity


def key(r):
    return [(x is None, str(x)) for x in r]


# ------------------------------------------------------------------------------------------------- substring


def test_texts_of_equal_short_hash_are_told_apart(spark):
    words = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("w"), F.hash("id", i).cast("string")))
    made = spark.range(200_000).select(F.array_join(words, " ").alias("text"))
    hit = made.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).where(F.size("t") > 1).first()
    a, b = hit["t"][:2]
    for doc_id in (None, 7):
        rows = [(doc_id, a), (doc_id, b), (8, a)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = [(r.doc_id, r.n_removed, r.kept_sha256) for r in substring.dedup_digests(docs).collect()]
        gone = hashlib.sha256(b"").hexdigest()
        want = [(doc_id, 40, gone), (doc_id, 0, hashlib.sha256(b.encode()).hexdigest()), (8, 40, gone)]
        assert sorted(got, key=key) == sorted(want, key=key)


# ------------------------------------------------------------------------------------------- labelled sample


def test_labelled_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(5000)] + [(2, "same")] * 50 + [(3, None)], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1)], "doc_id long, y int")
    assert labels.labelled_sample(docs, one, "y", 10).count() == 10
    known = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (None, 1), (4, None)], "doc_id long, y int")
    for most_bytes, most in ((10_000_000, 100_000), (300, 100_000), (10_000_000, 70)):
        a, b = ([tuple(r) for r in labels.labelled_sample(docs.repartition(n), known, "y", most, most_bytes).collect()] for n in (1, 9))
        assert sorted(a) == sorted(b) and len(a) == len(set(a)) <= most and sum(len(t) for _, t, *_ in a) <= most_bytes
    assert len(a) == 70
    whole = labels.labelled_sample(docs, known, "y", 100_000).collect()
    assert sorted((r.doc_id, r.text, r.y) for r in whole) == sorted([(1, f"text {k}", 1) for k in range(5000)] + [(2, "same", 0), (3, "", 1)])


def test_ftrl_equals_a_plain_one():
    r = random.Random(3)
    rows = [(np.array(sorted(r.sample(range(40), 8)), np.int64), r.randrange(2)) for _ in range(60)]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.4, 0.1
    z, n = {}, {}

    def weight(i):
        s = z.get(i, 0.0)
        if i != "bias" and abs(s) <= l1:
            return 0.0
        return -(s - (0 if i == "bias" else math.copysign(l1, s))) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(3):
        for at, y in rows:
            places = [*at.tolist(), "bias"]
            w = {i: weight(i) for i in places}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in places:
                was = n.get(i, 0.0)
                n[i] = was + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(was)) / alpha * w[i]
    model = toxicity.fit(rows, alpha, beta, l1, l2, epochs=3)
    dense = model.dense()
    assert abs(model.bias - weight("bias")) < 1e-9 and len(model.at) and any(weight(i) == 0 for i in range(40))
    assert all(abs(dense[i] - weight(i)) < 1e-9 for i in range(40))


# ------------------------------------------------------------------------------------------------------ chat


def conversation(spark):
    said = ["plain", "a</s>b", "\\", "é𝄞<s>x", "﻿first", "", "[INST] [/INST]", "\\<s>\\\\"]
    rows = [(c, t, "assistant" if (t + c) % 2 else "user", said[(t * 3 + c) % len(said)]) for c in range(4) for t in range(9)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_loss_is_what_the_spans_cut_out(spark):
    rows, df = conversation(spark)
    done = chat.format_conversations(df).cache()
    for r in done.collect():
        own = [x for c, _, a, x in rows if c == r.conv_id and a == "assistant"]
        assert len(own) == len(r.loss_spans)
        for s, x in zip(r.loss_spans, own):
            cut = r.formatted[s.start : s.start + s.length]
            assert s.escaped == any(m in x for m in ("<s>", "</s>", "[INST]", "[/INST]"))
            want = x.replace("\\", "\\\\") if s.escaped else x
            for m in ("<s>", "</s>", "[INST]", "[/INST]") if s.escaped else ():
                want = want.replace(m, f"{m[0]}\\{m[1:]}")
            assert cut == want
    right = {r.conv_id: r for r in chat.digests(done).collect()}
    for c, r in right.items():
        text = "".join(x for k, _, a, x in rows if k == c and a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())
    moved = F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["length"].alias("length"), s["escaped"].alias("escaped")))
    assert all(r.loss_sha256 != right[r.conv_id].loss_sha256 for r in chat.digests(done.withColumn("loss_spans", moved)).collect())


# -------------------------------------------------------------------------------------------------- sharding


def test_rows_alike_fill_no_range(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ALIKE", 3000)
    same = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("copy").alias("text"), F.lit("web").alias("source"))
    texts = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("web").alias("source"))
    other = spark.range(5_000).select("id", F.lit("x").alias("text"), F.lit("book").alias("source"))
    for docs in (same, texts, same.union(texts).union(other)):
        rows = sharding.ordered(docs, 20)
        counts = [r["count"] for r in rows.groupBy("range").count().collect()]
        assert len(counts) == 20 and sum(counts) == docs.count() and max(counts) <= 2 * sum(counts) / 20
    a, b = (sorted((tuple(r) for r in sharding.stratified_shards(docs.repartition(n), 40).collect()), key=key) for n in (2, 9))
    assert a == b and len(a) == 45_000


# ------------------------------------------------------------------------------------------- decontamination


def test_short_items_match_exactly_when_asked_for(spark):
    items = spark.createDataFrame([(1, "two words"), (2, "a b c d"), (3, "你好世界你好吗"), (4, "One, two three four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "here are Two words"), (2, "two x words a b x d"), (3, "foo你好世界你很吗 bar"), (4, "你好世界"), (5, "one TWO three, four six"), (6, "z a b c d")], "doc_id long, text string")
    got = lambda least: sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(docs, items, least).collect())
    assert got(1) == [(1, 1, 0), (3, 3, 1), (5, 4, 1), (6, 2, 0)]
    assert got(5) == [(3, 3, 1), (5, 4, 1)]
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, items, 1).collect()) == [2, 4]


def test_a_long_text_of_one_pair_is_verified_once():
    items = decontaminate.Items.of([(k, " ".join(f"a{k} b{j} x y c{j}" for j in range(8))) for k in range(50)] + [(99, "x y x y x y x y")])
    verified = []
    plain = decontaminate.myers
    decontaminate.myers = lambda masks, n, text, anchored=False: verified.append(len(text)) or plain(masks, n, text, anchored)
    try:
        found = decontaminate.matches(items, items.sieves(), b"x y " * 250_000)
    finally:
        decontaminate.myers = plain
    assert [(items.ids[p], d, first, end) for p, d, first, end in found] == [([99], 0, 0, 8)]
    assert len(verified) == 2 and sum(verified) < 1_100_000


# -------------------------------------------------------------------------------------------- language model


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "STREAM", 5_000)
    r = random.Random(4)
    rows = [(k, " ".join(f"{'ab'[k % 2]}{min(r.randrange(60), r.randrange(60))}" for _ in range(r.randrange(200)))) for k in range(400)] + [(None, None), (3, "again"), (3, "again"), (1000, "long " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ([(x.doc_id, x.n_tokens, x.n_known, round(x.base_score, 6), round(x.score, 4)) for x in lm.score(docs.repartition(n)).collect()] for n in (1, 8))
    assert sorted(a, key=key) == sorted(b, key=key) and len(a) == len(rows)


def test_grouped_words_are_normalised_and_learned():
    r = np.random.default_rng(5)
    noise = r.random(52) + 0.05
    noise /= noise.sum()
    model = lm.LogBilinear.start(noise)
    assert model.width > 1
    before = np.tile(r.integers(0, 53, (1, 4)), (52, 1)).astype(np.uint16)
    assert abs(np.exp(model.log_probs(np.arange(52), before)).sum() - 1) < 1e-5
    c = np.tile(np.arange(10), 3000).astype(np.uint16)
    own = lm.Trainer(model, noise, 1)
    ctx = lm.contexts(c, np.array([len(c)]), 52)
    own.learn(c, ctx)
    assert own.m.log_probs(c, ctx).mean() > model.log_probs(c, ctx).mean() + 0.5
    assert abs(np.exp(own.m.log_probs(np.arange(52), before)).sum() - 1) < 1e-4
