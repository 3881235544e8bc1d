"""Greatest distances of clusters: pruned by pivots, equal to all pairs."""

import random

import numpy as np

from fieldloom.operators import dedup
from fieldloom.staging import stage


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def cluster(r, n, reach):
    """Distinct hashes around one, each with up to ``reach`` bits flipped, few of them with many."""
    base, out = r.getrandbits(64), set()
    while len(out) < n:
        x = base
        for k in r.sample(range(64), min(reach, int(r.expovariate(0.35)))):
            x ^= 1 << k
        out.add(signed(x))
    return sorted(out)


def plain(hashes):
    h = np.array(hashes, np.int64)
    return max(int(np.bitwise_count((x ^ h).view(np.uint64)).max()) for x in h)


def test_pruned_diameters_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 64)
    r = random.Random(12)
    clusters = {1: cluster(r, 3000, 20), 2: cluster(r, 900, 40), 3: cluster(r, 64, 9), 4: [5], 5: [0, -1], 6: sorted(signed((1 << k) - 1) for k in range(64))}
    clusters[7] = sorted({signed(r.getrandbits(64)) for _ in range(300)})
    rows = [(c, h) for c, hs in clusters.items() for h in hs]
    r.shuffle(rows)
    uniq = stage(spark.createDataFrame(rows, "cluster_id long, hash long"), "hashes")
    got = {}
    for x in dedup.diameters(uniq).collect():
        got[x.cluster_id] = max(got.get(x.cluster_id, 0), x.max_distance)
    assert got == {c: plain(hs) for c, hs in clusters.items()}


def test_a_large_cluster_compares_a_tenth_of_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 64)
    hashes = cluster(random.Random(3), 4000, 20)
    rows = dedup.pivoted(spark.createDataFrame([(1, h) for h in hashes], "cluster_id long, hash long"))
    _, _, pairs = dedup.block_pairs(rows)
    compared = sum(x.na * x.nb if x.a != x.b else x.na * (x.na - 1) // 2 for x in pairs.collect())
    assert 0 <= compared < len(hashes) * (len(hashes) - 1) / 2 / 10
