"""Scores against plain counterparts, and very long texts."""

import hashlib
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import lm, quality, sharding, toxicity, warc

LONG = "long Words and more of them " * 120_000


def test_the_forest_scores_as_its_trees_do_one_by_one():
    r = np.random.default_rng(3)
    x = r.random((900, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 3] * x[:, 5] + r.normal(0, 0.2, 900) > 0.8).astype(float)
    forest = quality.fit(x, y, trees=25)

    def walk(node, row):
        if forest.left[node] == node:
            return forest.value[node]
        return walk(forest.left[node] if row[forest.feature[node]] <= forest.cut[node] else forest.right[node], row)

    for row, p in zip(x[:60], forest.probability(x[:60])):
        margin = forest.base + sum(walk(k, row) for k in forest.roots.tolist())
        assert abs(p - 1 / (1 + math.exp(-margin))) < 1e-12
    low, high = x[:200].copy(), x[:200].copy()
    for f in quality.MONOTONE:
        k = quality.FEATURES.index(f)
        high[:, k] = low[:, k] + r.random(200)
    assert (forest.probability(high) <= forest.probability(low) + 1e-12).all()


def test_quality_learns_what_a_held_out_set_shows():
    r = random.Random(4)
    texts, y = [], []
    for k in range(600):
        n = r.randrange(30, 200)
        good = k % 2
        words = [f"w{r.randrange(900)}" if good or r.random() < 0.5 else r.choice(["#$%", "||", "buy", "buy"]) for _ in range(n)]
        texts.append(" ".join(words).encode())
        y.append(good)
    x = np.array([quality.statistics(t)[1] for t in texts])
    forest = quality.fit(x[:400], np.array(y[:400], float))
    assert ((forest.probability(x[400:]) >= 0.5) == np.array(y[400:], bool)).mean() > 0.95


def test_a_text_scores_as_the_plain_log_bilinear_model_does():
    r = np.random.default_rng(6)
    noise = r.random(37) + 0.1
    noise /= noise.sum()
    model = lm.LogBilinear.start(noise)
    model.word_bias[:] += r.normal(0, 0.3, len(model.word_bias)).astype(np.float32)
    c = r.integers(0, 37, 60).astype(np.uint16)
    row, real = lm.laid_out([c[:25], c[25:]], len(noise))

    def softmax(scores, k):
        e = [math.exp(s - max(scores)) for s in scores]
        return e[k] / sum(e)

    want = []
    for text in (c[:25], c[25:]):
        for i, w in enumerate(text.tolist()):
            before = [int(text[i - d]) if i >= d else len(noise) for d in range(1, lm.CONTEXT + 1)]
            q = sum(model.context[b].astype(float) * model.distance[d] for d, b in enumerate(before))
            words = len(model.word)
            g = w // model.width if w < words else w - words + len(model.bias) - 2
            p = softmax([float(q @ t) + float(b) for t, b in zip(model.target, model.bias)], g)
            if w < words:
                own = range(g * model.width, min((g + 1) * model.width, words))
                p *= softmax([float(q @ model.word[k]) + float(model.word_bias[k]) for k in own], w - g * model.width)
            want.append(math.log(p))
    assert np.allclose(model.text_log_probs(row, real), want, atol=1e-4)


def test_toxicity_scores_as_its_weights_say(spark):
    rows = [(k, f"word{k % 7} {'vile' if k % 3 == 0 else 'kind'} thing number {k}") for k in range(300)] + [(1000, ""), (1001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(300))
    assert got[1000].score == got[1001].score and all((x.score >= 0.5) == (x.predicted == 1) for x in got.values())
    assert min(got[k].score for k in range(0, 300, 3)) > max(got[k].score for k in range(1, 300, 3))


def test_very_long_texts(spark):
    rows = [(1, LONG), (2, "short and plain words of the usual kind, ten of them or so"), (3, LONG), (4, None)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    shards = {x.doc_id: x for x in sharding.stratified_shards(docs, 40).collect()}
    assert shards[1].size == len(LONG) + 16 and shards[1].text_crc32 == zlib.crc32(LONG.encode()) and shards[4].size == 16
    assessed = {x.doc_id: x for x in quality.assess(docs, quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))).collect()}
    assert assessed[1].n_words == len(LONG.split()) == assessed[1].n_repeat_words and assessed[1].base_failed and assessed[2].kept
    scored = {x.doc_id: x for x in lm.score(docs.select("doc_id", "text")).collect()}
    assert scored[1].n_tokens == len(LONG.split()) + 1 and scored[4].n_tokens == 1 and scored[1].score == scored[3].score < 0
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    read = {x.page_id: x for x in warc.round_trip(pages).collect()}
    assert read[3].refers_to == 1 and read[1].payload_digest == hashlib.sha256(LONG.encode()).hexdigest() and read[1].payload_bytes == len(LONG)


def test_training_stays_in_single_precision():
    """What a minibatch adds up is float32 throughout: a double among the factors would double the work."""
    import numpy as np

    from fieldloom.llm import lm

    noise = np.array([0.4, 0.3, 0.2, 0.05, 0.05])
    trainer = lm.Trainer(lm.LogBilinear.start(noise), noise, 3)
    dtypes, real = set(), trainer._add
    trainer._add = lambda at, rows: (dtypes.update(x.dtype for x in rows.values()), real(at, rows))
    trainer.learn_texts(*lm.laid_out([np.array([0, 1, 2, 4], np.uint16)] * 5, 5))
    assert dtypes == {np.dtype(np.float32)}
