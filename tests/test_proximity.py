import itertools
import math
import random

from stratapoint.operators import proximity

P = "id long, group int, x double, y double, z double, cell string"


def brute(rows, r):
    ok = [p for p in rows if None not in p and not any(math.isnan(v) for v in p[2:])]
    return {(min(a[0], b[0]), max(a[0], b[0])) for a, b in itertools.combinations(ok, 2) if a[1] == b[1] and sum((u - v) ** 2 for u, v in zip(a[2:], b[2:], strict=True)) <= r * r}


def run(spark, rows, r=0.25):
    out = [tuple(x) for x in proximity.pairs_within(spark.createDataFrame([(*p, "clash") for p in rows], P), r).collect()]
    assert len(out) == len(set(out))
    return set(out)


def cloud(n, size, seed, near=(0.0, 0.0, 0.0)):
    rng = random.Random(seed)
    return [(i, rng.randrange(2), *[near[k] + rng.uniform(-size, size) for k in range(3)]) for i in range(n)]


def test_sparse_dense_and_edges(spark):
    rows = cloud(300, 2.0, 1) + [(1000, 1, 0.0, 0.0, 0.0), (1001, 1, 0.25, 0.0, 0.0), (1002, 1, -0.25, 0.0, 0.0), (1003, None, 0.0, 0.0, 0.0), (1004, 1, float("nan"), 0.0, 0.0), (1005, 1, None, 0.0, 0.0), (1006, 1, 0.0, 0.0, 0.0)]
    assert run(spark, rows) == brute(rows, 0.25)


def test_crowded_places_are_split(spark, monkeypatch):
    monkeypatch.setattr(proximity, "CROWDED", 4)
    monkeypatch.setattr(proximity, "SALT_ROWS", 5)
    rows = cloud(250, 0.7, 2, (100.0, -50.0, 3.0)) + [(500 + i, 0, 7.0, 7.0, 7.0) for i in range(30)]
    assert run(spark, rows) == brute(rows, 0.25)


def test_large_coordinates(spark):
    rows = cloud(200, 1.0, 3, (1081741.0, 369871.0, 50.0))
    assert run(spark, rows) == brute(rows, 0.25)


def test_points_very_far_out(spark, monkeypatch):
    far = [1e15, 1e15 - 0.125, 1e15 + 0.125, 2.0**50 + 0.25, 2.0**50, 2.0**51, -1e18, 1e150, float("inf")]
    places = [(x, y, 5.0) for x in far for y in (0.0, 0.2, -0.3)] + [(1.0, far[6], far[7])] * 4 + [(1.0, 2.0, 3.0)] * 2
    rows = [(i, i % 2, *p) for i, p in enumerate(places + places)] + [(1000 + i, 0, 1e17, 1e17, 1e17) for i in range(30)]
    want = brute(rows, 0.25)
    assert run(spark, rows) == want and len(want) > 30 * 29 / 2
    monkeypatch.setattr(proximity, "SALT_ROWS", 5)
    assert run(spark, rows) == want


def test_empty(spark):
    assert run(spark, []) == set()


def inside(px, py, xs, ys):
    odd, j = False, len(xs) - 1
    for i in range(len(xs)):
        if (ys[i] > py) != (ys[j] > py) and px < (xs[j] - xs[i]) * (py - ys[i]) / (ys[j] - ys[i]) + xs[i]:
            odd = not odd
        j = i
    return odd


def test_regions(spark):
    rng = random.Random(5)
    star = ([math.cos(k) * (3 + 2 * (k % 2)) for k in range(7)], [math.sin(k) * (3 + 2 * (k % 2)) for k in range(7)])
    regions = [(1, *star), (2, [0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0]), (3, [0.0, 1.0], [0.0, 1.0]), (4, None, None)]
    points = [(i, rng.uniform(-6, 6), rng.uniform(-6, 6)) for i in range(800)] + [(900, 0.0, 0.0), (901, 4.0, 4.0), (902, None, 1.0), (903, 4.0, 0.0), (904, 0.0, 2.0)]
    got = proximity.points_in_regions(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(regions, "region_id long, xs array<double>, ys array<double>"), 4.0, 4)
    want = {(i, r) for i, x, y in points if x is not None for r, xs, ys in regions[:2] if inside(x, y, xs, ys)}
    assert {tuple(r) for r in got.collect()} == want


def test_inside_cells_accept_part_of_the_pairs(spark):
    rows = cloud(300, 0.6, 4, (10.0, 20.0, 30.0))
    df = spark.createDataFrame([(i, g, x, y, z) for i, g, x, y, z in rows], "id long, group long, x double, y double, z double")
    told = proximity.pairs_within(df, 0.25, tell=True).collect()
    sure = {(r.id_a, r.id_b) for r in told if r.sure}
    assert len(told) == len({(r.id_a, r.id_b) for r in told}) and sure and len(sure) < len(told) and {(r.id_a, r.id_b) for r in told} == brute(rows, 0.25)


def test_rings_of_many_sides_shuffled_and_broadcast(spark, monkeypatch):
    rng = random.Random(9)
    turn = [2 * math.pi * k / 700 for k in range(700)]
    size = [rng.uniform(2.0, 6.0) for _ in turn]
    regions = [(1, [math.cos(t) * s for t, s in zip(turn, size)], [math.sin(t) * s for t, s in zip(turn, size)]), (2, [-5.0, 5.0, 5.0, 0.0, 0.0, -5.0], [-5.0, -5.0, 5.0, 5.0, 0.0, 0.0])]
    points = [(i, rng.choice([-5.0, 0.0, 2.5, rng.uniform(-6, 6)]), rng.choice([-5.0, 0.0, 5.0, rng.uniform(-6, 6)])) for i in range(1500)]
    want = {(i, r) for i, x, y in points for r, xs, ys in regions if inside(x, y, xs, ys)}
    for limit in (200_000, 0):
        monkeypatch.setattr(proximity, "BROADCAST_ROWS", limit)
        got = proximity.points_in_regions(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(regions, "region_id long, xs array<double>, ys array<double>"), 8.0, 4)
        assert {tuple(r) for r in got.collect()} == want and len(want) > 300


def test_cover_cells_are_inside_or_on_the_border():
    xs, ys = [0.0, 8.0, 8.0, 0.0], [0.0, 0.0, 8.0, 8.0]
    cells = list(proximity.cover_polygon(xs, ys, 4.0, 3))
    assert any(c[3] for c in cells) and any(not c[3] for c in cells)
    for level, cx, cy, interior in cells:
        e = 4.0 / 2**level
        if interior:
            assert all(inside((cx + a) * e, (cy + b) * e, xs, ys) for a in (0.01, 0.99) for b in (0.01, 0.99))
