import random

import pytest

from stratapoint.operators import hierarchy


def brute(links):
    up = {}
    for i, p in links:
        if i is not None:
            up[i] = max(up[i], p, key=lambda v: (v is not None, v)) if i in up else p
    out = {}
    for i in up:
        chain, at = [i], i
        while True:
            p = up[at]
            if p is None or p < 0:
                out[i] = (at, len(chain) - 1, "rooted")
                break
            if p not in up:
                out[i] = (at, len(chain) - 1, "orphaned")
                break
            if p in chain:
                cycle = chain[chain.index(p) :]
                out[i] = (min(cycle), 0, "on_cycle") if i in cycle else (min(cycle), chain.index(p), "below_cycle")
                break
            chain.append(p)
            at = p
    return out


def run(spark, links):
    df = spark.createDataFrame([(i, p, "x") for i, p in links], "id long, parent long, root string")
    return {r["id"]: (r["root"], r["depth"], r["kind"]) for r in hierarchy.resolve_hierarchy(df, with_path=True).collect()}


@pytest.mark.parametrize("links", [
    [], [(1, None)], [(1, 1)], [(1, -1), (2, 1), (3, 2), (3, 2)], [(5, 9)], [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 6), (7, 6)],
    [(i, i - 1 if i else None) for i in range(130)], [(None, 3), (3, None)],
])
def test_cases(spark, links):
    assert run(spark, links) == brute(links)


def test_random_graphs(spark):
    for seed in range(2):
        rng = random.Random(seed)
        links = [(i, rng.choice([None, -1, rng.randrange(140), rng.randrange(140), rng.randrange(max(1, i))])) for i in range(120)]
        assert run(spark, links) == brute(links)


def test_paths_and_descendants(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1)], "id long, parent long")
    h = hierarchy.resolve_hierarchy(df, with_path=True)
    assert {r["id"]: r["path"] for r in h.collect()} == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 4]}
    assert {tuple(r) for r in hierarchy.descendants(h).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 1)}


def test_hot_pointers_take_the_broadcast_way(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "HOT", 2)
    links = [(0, None), (1, 0)] + [(i, 1) for i in range(2, 400)] + [(i, i - 1) for i in range(400, 420)]
    assert run(spark, links) == brute(links)


def test_stars_are_split(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "TASK_ROWS", 20)
    monkeypatch.setattr(hierarchy, "HOT", 10)
    for top in ([], [(0, None)], [(0, 0)], [(0, 1), (1, 0)]):  # orphaned, rooted, on circles
        two_steps = [(k, 0) for k in range(10, 70)] + [(k, k - 100) for k in range(110, 170)] + [(k, 10) for k in range(200, 260)]
        links = top + two_steps
        assert run(spark, links) == brute(links)


def test_folds_and_inheritance_equal_plain_ones(spark, monkeypatch):
    rng = random.Random(4)
    links = [(0, None)] + [(k, rng.choice([rng.randrange(k), k - 1])) for k in range(1, 150)] + [(200, 999), (201, 200), (300, 301), (301, 300), (302, 301), (303, 302), (400, -1)]
    values = {i: rng.choice([None, float(rng.randrange(100))]) for i, _ in links}
    up = dict(links)
    below = {i: [] for i, _ in links}
    for i in up:
        at, seen = up[i], set()
        while at in up and at not in seen:
            seen.add(at)
            below[at].append(values[i])
            at = up[at]
    df = spark.createDataFrame([(i, p, values[i], 1) for i, p in links], "id long, parent long, v double, one long")
    for limit in (200_000, 20):
        monkeypatch.setattr(hierarchy, "TASK_ROWS", limit)
        got = {r.id: (r.below_v, r.below_one, r.low) for r in hierarchy.fold_below(df.withColumn("low", df.v), {"v": "max", "one": "sum", "low": "min"}).withColumnRenamed("below_low", "l").drop("low").withColumnRenamed("l", "low").collect()}
        assert set(got) == {i for i, _ in links if not 300 <= i < 400}
        for i, (most, count, least) in got.items():
            known = [v for v in below[i] if v is not None]
            assert (most, count, least) == (max(known, default=None), len(below[i]) or None, min(known, default=None))
        carried = {r.id: r.v for r in hierarchy.carry_down(df, "v").collect()}
        for i in up:
            at, seen = i, set()
            while at in up and values[at] is None and at not in seen:
                seen.add(at)
                at = up[at]
            assert carried[i] == (values[at] if at in up else None)


def test_a_very_deep_chain(spark):
    from pyspark.sql import functions as F

    chain = spark.range(20_000).select("id", (F.col("id") - 1).alias("parent"))
    r = hierarchy.resolve_hierarchy(chain).agg(F.max("depth").alias("deepest"), F.countDistinct("root").alias("roots"), F.sum("depth").alias("total")).first()
    assert (r.deepest, r.roots, r.total) == (19_999, 1, 19_999 * 20_000 // 2)
    below = hierarchy.fold_below(chain.withColumn("one", F.lit(1)), {"one": "sum"}).agg(F.max("below_one"), F.sum("below_one")).first()
    assert tuple(below) == (19_999, 19_999 * 20_000 // 2)
