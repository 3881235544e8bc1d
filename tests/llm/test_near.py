"""Near-duplicate groups of the pipeline against all pairs."""

import random

import corpus_pipeline

from fieldloom.llm.near import prefix, shingle_set


def jaccard(a, b):
    shingles = lambda t: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_pipeline_keeps_one_of_all_pairs_of_four_fifths(spark):
    r = random.Random(5)
    rows = []
    for n in (20, 60, 150, 400):
        for _ in range(6):
            base = [f"w{r.randrange(5000)}" for _ in range(n)]
            for cut in (0, 0.04, 0.08, 0.12, 0.25):
                rows.append((len(rows), " ".join(base[: round(n * (1 - cut))] + [f"x{r.randrange(5000)}" for _ in range(round(n * cut / 3))])))
    group = [f"g{k}" for k in range(300)]
    for _ in range(40):  # more than a star's worth that share most of their shingles
        rows.append((len(rows), " ".join(group[: 300 - r.randrange(40)] + [f"y{r.randrange(9999)}"])))
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if name[i] != name[j] and jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = sorted((name[i], name[j]))
                name = [a if x == b else x for x in name]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in corpus_pipeline.simhash_dedup(spark, docs, "").collect()) == sorted(set(name))


def test_prefixes_of_near_sets_meet():
    import numpy as np

    r = np.random.default_rng(1)
    s = shingle_set(" ".join(f"w{k}" for k in range(104)).encode(), 5)
    assert len(s) == 100
    for _ in range(50):
        t = np.sort(r.permutation(s)[:80])
        keys = np.sort(r.permutation(s)[:50])
        counts = r.integers(3, 99, 50)
        assert set(prefix(s, keys, counts)) & set(prefix(t, keys, counts))


def test_long_rows_come_in_short_batches(spark, monkeypatch):
    """Steps that hand whole texts or sets to Python do so by TEXT_ROWS rows; the session's own batches hold again after."""
    import pyarrow as pa

    from fieldloom import staging
    from fieldloom.llm import jaccard, near

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), {}
    for module in (near, jaccard):
        monkeypatch.setattr(module, "stage", lambda df, label, *by: seen.update({label: int(spark.conf.get(key))}) or staging.stage(df, label, *by))
    docs = spark.createDataFrame([(k, " ".join(f"w{k % 700}x{j}" for j in range(20))) for k in range(1400)], "doc_id long, text string")
    assert near.keep_one(docs).count() == 700
    assert [seen[x] for x in ("described", "sets", "links")] == [staging.TEXT_ROWS] * 3 and spark.conf.get(key) == before
    with staging.long_rows(spark):
        sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"id": [b.num_rows]}) for b in bs), "id long").collect()
    assert max(x.id for x in sizes) == staging.TEXT_ROWS and spark.conf.get(key) == before


def test_bucket_loads_count_every_shingle(spark):
    import numpy as np

    from fieldloom.llm.jaccard import BUCKETS, _bucket, bucket_loads
    from fieldloom.llm.text import window_hashes, word_hashes

    texts = [None, b" ", b"a b", b"x " * 900, *(f"w{k} W{k} y z v u".encode() for k in range(50))]
    want = np.zeros(BUCKETS, np.int64)
    for t in texts:
        ws = (t or b"").lower().split()
        if ws:
            want += np.bincount(_bucket(window_hashes(word_hashes(ws), min(5, len(ws)))), minlength=BUCKETS)
    got = bucket_loads(spark.createDataFrame([(bytearray(t) if t is not None else None,) for t in texts], "text binary").repartition(3))
    assert (got == want).all() and got.sum() == 1 + 896 + 2 * 50
