import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapoint.functions import geometry as G
from stratapoint.operators import octree


def cloud(n, seed, scale=(10.0, 10.0, 10.0), same=0):
    rng = np.random.default_rng(seed)
    p = rng.random((n, 3)) * scale
    if same:
        p[rng.permutation(n)[:same]] = np.array(scale) / 3
    return p.astype(np.float32)


def frame(spark, p):
    return spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "id long, x double, y double, z double")


def model(p, root, capacity):
    """Level by level in plain NumPy: node of every point."""
    out = {}
    pending = {"": (list(range(len(p))), np.array(root.low))}

    def split(ids, low, level, name):
        size, flat = np.array(root.sizes(level)), root.flat_at(level)
        center = ((low + (low + size)) * 0.5).astype(np.float32)
        if flat:
            center[2] = np.float32(low[2] + size[2])
        for i in ids:
            bits = (p[i] >= center).astype(int)
            d = bits[0] * 4 + bits[1] * 2 + bits[2]
            step = np.array([size[0] / 2 * bits[0], size[1] / 2 * bits[1], 0 if flat else size[2] / 2 * bits[2]])
            yield i, f"{name}{d}", low + step

    def group(rows):
        g = {}
        for i, n, low in rows:
            g.setdefault(n, ([], low))[0].append(i)
        return g

    pending = group(split(pending[""][0], pending[""][1], 0, ""))
    level = 1
    while pending:
        spacing, rest = root.spacing / 2**level, []
        for name, (ids, low) in pending.items():
            if len(ids) < capacity or spacing <= octree.MIN_SPACING * root.scale:
                out.update({i: name for i in ids})
                continue
            size = np.array(root.sizes(level)).astype(np.float32)
            kept = {}
            for i in ids:
                inverse = (1.0 / size.astype(float)).astype(np.float32).astype(float)
                cell = tuple(np.clip((3.0 * inverse * (p[i] - low.astype(np.float32)).astype(float)).astype(int), 0, 2))
                near = kept.setdefault(cell, [])
                if all(((p[i].astype(float) - p[j].astype(float)) ** 2).sum() >= spacing**2 for j in near):
                    near.append(i)
                    out[i] = name
                else:
                    rest += split([i], low, level, name)
        pending = group(rest)
        level += 1
    return out


@pytest.mark.parametrize(("scale", "same"), [((10.0, 10.0, 10.0), 0), ((100.0, 100.0, 5.0), 0), ((8.0, 9.0, 10.0), 300)])
def test_lod_equals_a_plain_model(spark, scale, same):
    p = cloud(900, 4, scale, same)
    df = frame(spark, p)
    root = octree.root_of(df)
    got = {r.id: r.node for r in octree.build_lod(df.withColumn("node", F.lit("clash")), ["id"], root, 60).collect()}
    assert got == model(p, root, 60)


def test_crowded_cells_are_relieved_first(spark, monkeypatch):
    p = cloud(2500, 6, (10.0, 9.0, 11.0), 200)
    df = frame(spark, p)
    root = octree.root_of(df)
    plain = {r.id: r.node for r in octree.build_lod(df, ["id"], root, 60).collect()}
    monkeypatch.setattr(octree, "CELL_ROWS", 5)
    gone = []
    relief = octree._surely_refused

    def counted(*given):
        left, refused = relief(*given)
        gone.append(refused.count())
        return left, refused

    monkeypatch.setattr(octree, "_surely_refused", counted)
    assert {r.id: r.node for r in octree.build_lod(df, ["id"], root, 60).collect()} == plain == model(p, root, 60) and sum(gone) > 20


def test_stacks_take_the_short_way(spark):
    p = cloud(600, 9)
    p[100:400] = [1.5, 2.5, 3.5]
    p[400:520] = [8.0, 8.0, 8.0]
    df = frame(spark, p)
    root = octree.root_of(df)
    assert octree._set_stacks_apart(df, ["id"], root.last_level)[2].count() == 2
    got = {r.id: r.node for r in octree.build_lod(df, ["id"], root, 50).collect()}
    assert got == model(p, root, 50)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 1.0, 1.0), (3, float("nan"), 1.0, 1.0), (4, 1.0, 1.0, 1.0)], "id long, x double, y double, z double")
    root = octree.Root((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))
    assert {r.id for r in octree.build_lod(df, ["id"], root).collect()} == {1, 4}
    assert octree.build_lod(df.where("false"), ["id"], root).collect() == []
    assert octree.root_of(df.where("false")) is None


def test_cell_keys(spark):
    rng = np.random.default_rng(8)
    probes = np.concatenate([rng.random((60, 3)) * 1.6 - 0.3, np.eye(3), np.zeros((1, 3))])  # some out of the box, which count to its edge
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(probes)], "k int, x double, y double, z double")
    for cells in (1, 2, 3, 5):
        place = np.clip(np.trunc(probes.astype(np.float32).astype(float) * cells).astype(int), 0, cells - 1)
        keys = (place << (np.arange(3) * (cells - 1).bit_length())).sum(axis=1).tolist()
        key = G.cell_key([F.col(v) for v in "xyz"], [F.lit(0.0)] * 3, [F.lit(1.0)] * 3, cells)
        assert [r[0] for r in df.orderBy("k").select(key).collect()] == keys


def test_node_files(spark):
    names = ["", "7", "01234567", "012345670", "76543210012345674"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(G.node_file(F.col("n"), ".pnts")).collect()] == ["r.pnts", "r7.pnts", "r01234567.pnts", "01234567/r0.pnts", "76543210/01234567/r4.pnts"]


def test_prune_and_tree(spark):
    counts = [("0", 10), ("00", 500), ("01", 40), ("010", 70), ("011", 500), ("02", 30), ("1", 5), ("10", 99)]
    m = {r.node: (r.target, r.total) for r in octree.prune_map(spark.createDataFrame(counts, "node string, n long")).collect()}
    assert m["010"] == ("01", 70) and m["01"] == ("01", 110) and m["02"] == ("0", 30) and m["0"] == ("0", 40) and m["10"] == ("1", 99) and m["00"] == ("00", 500)
    shown = spark.createDataFrame([("0", 1.0, 1.0, 1.0), ("011", 2.0, 2.0, 2.0), ("011", 4.0, 3.0, 2.0)], "node string, x double, y double, z double")
    root = octree.Root((0.0, 0.0, 0.0), (125.0, 0.0, 0.0))
    t = {r.node: r for r in octree.tile_tree(shown, root).collect()}
    assert set(t) == {"", "0", "01", "011"} and t["011"].geometric_error == 0 and t["01"].geometric_error == 2.5 and not t["01"].has_content and t["01"].max_x == 4.0 and t["0"].max_x == 4.0 and t["0"].inner_tile and not t["011"].inner_tile
    assert octree.prune_map(spark.createDataFrame([], "node string, n long")).collect() == []


def test_seeded_sample_is_exact_and_repeatable(spark):
    df = spark.createDataFrame([(k % 2, k) for k in range(1000)], "file int, id long")
    take = spark.createDataFrame([(0, 40), (1, 0)], "file int, take int")
    a = sorted(r.id for r in octree.seeded_sample(df, take, "file", ["id"], 3).collect())
    b = sorted(r.id for r in octree.seeded_sample(df.repartition(7), take, "file", ["id"], 3).collect())
    assert len(a) == 40 and a == b and all(i % 2 == 0 for i in a)


def test_feature_quadtree(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(x), float(y), float(k % 13)) for k, (x, y) in enumerate(rng.random((300, 2)) * 4000)] + [(1000 + k, 10.0, 10.0, 1.0) for k in range(50)]
    t = octree.feature_quadtree(spark.createDataFrame(rows, "id long, x double, y double, weight double"), 2000.0, 20).collect()
    assert len(t) == 350 and len({r.id for r in t}) == 350
    tiles = {}
    for r in t:
        tiles.setdefault((r.level, r.tx, r.ty), []).append(r)
    assert all(len(v) <= 20 or len({(r.x, r.y) for r in v}) == 1 for v in tiles.values()) and any(len(v) > 20 for v in tiles.values())


def test_spacing_and_flatness():
    r = octree.Root((0.0, 0.0, 0.0), (8.0, 8.0, 1.0))
    assert math.isclose(r.spacing, math.sqrt(129) / 125) and r.flat_at(0) and r.flat_at(1) and not r.flat_at(2)
