import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratapoint.operators import mesh

SMALL = "/root/testdata/sf0.001"


def area(t):
    return np.linalg.norm(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), axis=1).sum() / 2


def star(n=10, turn=1, plane=(0, 1)):
    ring = np.zeros((n, 3))
    a = np.arange(n) * 2 * np.pi / n * turn
    r = np.where(np.arange(n) % 2, 2.0, 1.0)
    ring[:, plane[0]], ring[:, plane[1]] = r * np.cos(a), r * np.sin(a)
    return ring


def test_triangulation_keeps_area_and_turn():
    for turn in (1, -1):
        for plane in ((0, 1), (1, 2), (2, 0)):
            ring = star(10, turn, plane)
            t = mesh.triangulate([ring])
            v = mesh.area_vector(ring)
            assert len(t) == 8 and np.isclose(area(t), np.linalg.norm(v) / 2)
            assert (np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) @ v >= 0).all()


def test_holes():
    outer = np.array([[0.0, 0, 0], [10, 0, 0], [10, 10, 0], [0, 10, 0]])
    holes = [np.array([[x, y, 0.0], [x + 1, y, 0], [x + 1, y + 1, 0], [x, y + 1, 0]]) for x, y in ((2, 2), (5, 2), (5, 6), (2, 7))]
    assert np.isclose(area(mesh.triangulate([outer, *holes])), 96)
    square = mesh.triangulate([np.array([[0.0, 0, 0], [0, 10, 0], [10, 10, 0], [10, 0, 0]])])
    assert len(square) == 2 and np.isclose(area(square), 100)


def test_degenerate():
    assert len(mesh.triangulate([])) == 0 and len(mesh.triangulate([np.zeros((2, 3))])) == 0
    assert area(mesh.triangulate([np.array([[0.0, 0, 0], [1, 0, 0], [2, 0, 0], [2, 1, 0], [2, 1, 0]])])) > 0.99


def plane(n):
    p = np.array([[x, y, 0.0] for x in range(n + 1) for y in range(n + 1)])
    f = [t for x in range(n) for y in range(n) for a in [x * (n + 1) + y] for t in ((a, a + n + 1, a + 1), (a + 1, a + n + 1, a + n + 2))]
    return p, np.array(f)


def test_decimation():
    p, f = plane(8)
    q, g, _ = mesh.decimate(p, f, 64)
    assert 50 <= len(g) <= 64 and np.isclose(area(q[g]), 64)
    q, g, a = mesh.decimate_lossless(p, f, attributes=p[:, :2])
    assert len(g) < 40 and np.isclose(area(q[g]), 64) and len(a) == len(q)
    q, g, _ = mesh.decimate(p, f, 2, mesh.Options(preserve_border=True, aggressiveness=15))
    border = mesh._border(q, g)
    assert border.sum() == 32 and np.isclose(area(q[g]), 64)
    assert mesh.decimate(p, f, 10, attributes=np.zeros((3, 1)))[2] is None
    assert len(mesh.decimate(np.zeros((0, 3)), np.zeros((0, 3), int), 0)[1]) == 0


def test_welding():
    p, f = plane(2)
    both, faces = np.concatenate([p, p + [2.0, 1e-6, 0]]), np.concatenate([f, f + len(p)])
    _, g, _ = mesh.decimate(both, faces, 1000, mesh.Options(link_distance=1e-3))
    _, times = mesh._edges(g)
    assert (times == 1).sum() < 16


def test_links_are_seams_or_foldovers():
    p, f = plane(3)
    both, faces = np.concatenate([p, p + [3.0, 0, 0]]), np.concatenate([f, f + len(p)])
    shared = 4  # vertices on the common side
    for attributes, options, joined in ((None, mesh.Options(), True), (np.zeros((32, 1)), mesh.Options(), True), (np.repeat([[0.0], [1.0]], 16, axis=0), mesh.Options(), False), (None, mesh.Options(link=False), False)):
        _, g, _ = mesh.decimate(both, faces, 1000, options, attributes)
        edges, times = mesh._edges(g)
        assert len(np.unique(g)) == 32 - (shared if joined else 0) and (times == 1).sum() == (18 if joined else 24)
    # a seam keeps its vertices, a welded line too if asked
    q, g, a = mesh.decimate(both, faces, 4, mesh.Options(aggressiveness=15), np.repeat([[0.0], [1.0]], 16, axis=0))
    at = q[:, 0] == 3
    assert len(g) < 30 and at.sum() == 2 * shared and np.isclose(area(q[g]), 18)
    q, g, _ = mesh.decimate(both, faces, 4, mesh.Options(aggressiveness=15, preserve_foldovers=True))
    assert ((q[:, 0] == 3) & (q[:, 1] == np.round(q[:, 1]))).sum() >= shared and len(g) < 30
    q, g, _ = mesh.decimate(both, faces, 4, mesh.Options(aggressiveness=15))
    assert len(g) <= 8 and np.isclose(area(q[g]), 18)


def test_tables(spark):
    p, f = plane(3)
    v = spark.createDataFrame([(1, k, *map(float, x)) for k, x in enumerate(p)], "mesh long, vertex long, x double, y double, z double")
    t = spark.createDataFrame([(1, k, *map(int, x)) for k, x in enumerate(f)], "mesh long, face long, v0 long, v1 long, v2 long")
    assert {r.vertex for r in mesh.border_vertices(t).collect()} == set(np.nonzero(mesh._border(p, f))[0].tolist())
    q = mesh._quadrics(p, f)
    for r in mesh.vertex_quadrics(t, v).collect():
        assert np.allclose([r[f"q{k}"] for k in range(10)], q[r.vertex][np.triu_indices(4)])
    assert {round(r.curvature, 9) for r in mesh.vertex_curvature(t, v).collect()} == {0.0}
    assert mesh.near_pairs(v, 1.0).count() == 24
    assert mesh.border_vertices(t.where("false")).count() == 0


@pytest.mark.parametrize("name", ["quadric_sum", "vertex_curvature"])
@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_exploded_rows_are_never_broadcast(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange") <= 2


@pytest.mark.parametrize(("kind", "bounds"), [("long", (0, 60)), ("string", (60,))])
def test_whole_meshes_equal_joined_ones(spark, monkeypatch, kind, bounds):
    p, f = plane(4)
    p[:, 2] = np.arange(len(p)) * 7 % 5 / 3
    hub = [(0.0, 0.0, 1.0), *[(float(np.cos(a)), float(np.sin(a)), float(k % 3)) for k, a in enumerate(np.arange(50))]]
    v = [(m, k + 2**60, *map(float, x)) for m in (1, 2, 3) for k, x in enumerate(p)] + [(4, k, *x) for k, x in enumerate(hub)]
    t = [(m, k, *(int(x) + 2**60 for x in c)) for m in (1, 2, 3) for k, c in enumerate(f)] + [(4, k, 0, k + 1, (k + 1) % 50 + 1) for k in range(50)]
    v += [(2, 2**60 + 6, 9.0, 9.0, 9.0), (3, 2**60 + 99, None, 0.0, 0.0), (None, 0, 0.0, 0.0, 0.0), (5, 0, 0.0, 0.0, 0.0)]  # repeated, missing, without faces
    t += [(1, 90, 2**60, 2**60 + 1, 77), (1, 91, 2**60, 2**60, 2**60 + 1), (1, 92, 2**60, None, 2**60 + 1), (6, 0, 0, 1, 2), (3, 93, 2**60 + 99, 2**60, 2**60 + 1)]
    v = spark.createDataFrame(v, "mesh long, vertex long, x double, y double, z double").withColumn("mesh", F.col("mesh").cast(kind))
    t = spark.createDataFrame(t, "mesh long, face long, v0 long, v1 long, v2 long").withColumn("mesh", F.col("mesh").cast(kind))

    def got():
        both = [mesh.vertex_quadrics(t, v, with_points=True), mesh.vertex_quadrics(t, v), mesh.vertex_curvature(t, v)]
        return [sorted((tuple(None if x is None else round(x, 9) + 0.0 if isinstance(x, float) else x for x in r) for r in d.select(sorted(d.columns)).collect()), key=repr) for d in both]

    whole = got()
    for rows in bounds:
        monkeypatch.setattr(mesh, "MESH_ROWS", rows)
        assert got() == whole
    assert [len(x) for x in whole] == [25 * 3 + 1 + 1 + 51, 25 * 3 + 1 + 51, 25 * 3 + 1 + 51]
