import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapoint import tileset as T
from stratapoint.functions import matrices as M
from stratapoint.operators import tiles


def test_sync_boxes_like_the_objects(spark):
    rng = np.random.default_rng(2)
    objects, rows = {}, []
    for k in range(25):
        parent = None if k == 0 else int(rng.integers(0, k))
        box = None if k in (0, 3) else T.box_from_bounds(rng.random(3) * 10, rng.random(3) * 10 + 10)
        m = M.translation(rng.random(3)) if k % 3 else np.eye(4)
        if k % 5 == 1:
            m[:3, :3] = M.rotation_between([1, 0, 0], rng.random(3))
        objects[k] = T.Tile(0, box, m)
        if parent is not None:
            objects[parent].children.append(objects[k])
        rows.append((k, parent, None if box is None else box.tolist(), M.column_major(m) if k % 3 else None))
        if not k % 3 and k % 5 == 1:
            rows[-1] = (*rows[-1][:3], M.column_major(m))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "tile_id long, parent_id long, box array<double>, transform array<double>, depth string")
    objects[0].sync_boxes()
    for r in tiles.sync_boxes(df.drop("depth")).collect():
        want = objects[r.tile_id].box
        assert (r.box is None) == (want is None)
        if want is not None:
            a, b = T.box_corners(np.array(r.box)), T.box_corners(want)
            assert np.allclose(a.min(axis=0), b.min(axis=0)) and np.allclose(a.max(axis=0), b.max(axis=0))
    assert tiles.sync_boxes(df.drop("depth").where("false")).count() == 0


def test_matrices():
    for a, b in (([1, 0, 0], [0, 1, 0]), ([1, 2, 3], [1, 2, 3]), ([0, 0, 1], [0, 0, -1]), ([3, 1, 2], [-1, 5, 0])):
        r = M.rotation_between(a, b)
        assert np.allclose(r @ np.array(a) / np.linalg.norm(a), np.array(b) / np.linalg.norm(b)) and np.isclose(np.linalg.det(r), 1)
    f = M.local_frame(-435960.0, -5438487.0, 3292675.0)
    assert np.allclose(f @ f.T, np.eye(3)) and np.allclose(f @ np.array([-435960.0, -5438487.0, 3292675.0]) / np.linalg.norm([-435960.0, -5438487.0, 3292675.0]), [0, 0, 1])
    m = M.root_transform([1, 2, 3], 0.1, f)
    p = np.array([5.0, 6, 7])
    assert np.allclose((m @ np.append(f @ ((p - [1, 2, 3]) * 0.1), 1))[:3], p)


def test_merging_and_division(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "x int, f double"), spark.createDataFrame([(3, 4)], "x int, g int")
    assert {tuple(r) for r in tiles.merge_zero_filled([a, b]).collect()} == {(1, 2.0, 0), (3, 0.0, 4)}
    with pytest.raises(ValueError, match="fields differ"):
        tiles.merge_strict([a, b])
    rows = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a"), (None, "b"), ("q", None)], "g string, v string")
    assert [r.v for r in tiles.on_every_group(rows, "g", "v").collect()] == ["a"]
    assert tiles.on_every_group(rows.where("false"), "g", "v").count() == 0


def test_contents_by_uri(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.bin").write_bytes(b"xyz")
    df = spark.createDataFrame([("sub/a.bin",), ("none",), (None,)], "content_uri string")
    got = {r.content_uri: r.content for r in tiles.with_contents(df, str(tmp_path)).collect()}
    assert bytes(got["sub/a.bin"]) == b"xyz" and got["none"] is None


def test_instances_and_cells(spark):
    df = spark.createDataFrame([(1, "b"), (0, "z"), (1, "a")], "c int, n string")
    assert {(r.c, r.n): r.instance for r in tiles.class_instances(df, "c", [F.col("n")]).collect()} == {(0, "z"): 0, (1, "a"): 1, (1, "b"): 2}
