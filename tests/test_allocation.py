"""Run-length allocation against the plain loop."""

import random

from fieldloom.operators import splits


def plain(components):
    """One component at a time, largest first, then by id: ``{id: split}``."""
    total = sum(s for _, s, _ in components)
    train, val = round(total * 0.70), round(total * 0.15)
    left, held, out = [train, val, total - train - val], [0, 0, 0], {}
    for cid, size, groups in sorted(components, key=lambda c: (-c[1], c[0])):
        k = min(range(3), key=lambda i: (-left[i], held[i], i))
        left[k], held[k], out[cid] = left[k] - size, held[k] + groups, splits.SPLITS[k]
    return out


def made(r, n, sizes, groups):
    return [(f"c{k:05d}", r.choice(sizes), r.choice(groups)) for k in range(n)]


def test_patterns_equal_single_picks():
    r = random.Random(1)
    for _ in range(3000):
        left, held = [r.randrange(-40, 400) for _ in range(3)], [r.randrange(5) for _ in range(3)]
        size, groups, n = r.randrange(0, 9), r.randrange(1, 4), r.randrange(1, 400)
        l, g, want = list(left), list(held), []
        for _ in range(n):
            k = min(range(3), key=lambda i: (-l[i], g[i], i))
            l[k], g[k] = l[k] - size, g[k] + groups
            want.append(k)
        found = splits.deal(left, held, size, groups, n)
        assert [k for picks, times in found for _ in range(times) for k in picks] == want and (left, held) == (l, g)
        assert size == 0 or len(found) < 40


def test_a_long_run_takes_few_patterns():
    n = 10**12
    left = [round(0.7 * n), round(0.15 * n), n - round(0.7 * n) - round(0.15 * n)]
    found = splits.deal(left, [0, 0, 0], 1, 1, n)
    assert len(found) < 10 and sum(len(p) * t for p, t in found) == n and left == [0, 0, 0]


def test_allocation_equals_the_plain_loop(spark):
    r = random.Random(6)
    classes = {"ones": made(r, 900, [1], [1]), "ties": made(r, 700, [1, 2, 2, 4], [1, 1, 2]), "wide": made(r, 400, list(range(1, 300)), [1, 3]), "one": [("only", 5, 1)], "empty": [("z", 0, 1), ("y", 0, 2)]}
    rows = [(name, *c) for name, cs in classes.items() for c in cs]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "class_name string, component_id string, size long, group_count long")
    want = {(name, cid): s for name, cs in classes.items() for cid, s in plain(cs).items()}
    for ranges in (1, 7):
        got = {(x.class_name, x.component_id): x.split for x in splits.allocate(df, ranges).collect()}
        assert got == want
    assert splits.allocate(df.limit(0)).count() == 0


def test_components_are_never_gathered(spark):
    df = spark.range(100).selectExpr("'a' class_name", "cast(id as string) component_id", "1L size", "1L group_count")
    plan = splits.allocate(df)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Window" not in plan
