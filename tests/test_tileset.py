import json
import os

import numpy as np
import pytest

from stratapoint import metadata as M
from stratapoint import sources
from stratapoint import tileset as T
from stratapoint.codecs import pnts
from stratapoint.convert import PointTiler, assign, convert, make_folder
from stratapoint.errors import BoxMissing, InvalidMetadata, InvalidTileset, MissingCrs, MixedCrs, NoTilerFound, TilingFailed, UnknownExtension
from stratapoint.sources import las


def test_boxes():
    b = T.box_from_bounds([0, 0, 0], [2, 4, 6])
    assert b.tolist() == [1, 2, 3, 1, 0, 0, 0, 2, 0, 0, 0, 3] and T.box_union([b]) is b
    turn = np.array([[0.0, -1, 0, 10], [1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    moved = T.box_transformed(b, turn)
    assert np.allclose(T.box_corners(moved).min(axis=0), [6, 0, 0]) and np.allclose(T.box_corners(moved).max(axis=0), [10, 2, 6])
    u = T.box_union([b, T.box_from_bounds([-1, 0, 0], [0, 1, 1])])
    assert np.allclose(T.box_corners(u).min(axis=0), [-1, 0, 0])
    with pytest.raises(InvalidTileset):
        T.check_box([1, 2])


def tile(low, high, **kw):
    return T.Tile(1.0, T.box_from_bounds(low, high), **kw)


def test_sync_and_order():
    rng = np.random.default_rng(12)
    made = []
    for k in range(9):
        low = rng.random(3) * 20 - 10
        made.append(tile(low, low + rng.random(3) * (k + 1)))
    for k, up in ((1, 0), (2, 0), (3, 2), (4, 2), (5, 4), (6, 0), (7, 6), (8, 7)):
        made[up].children.append(made[k])
    places = {id(t): k for k, t in enumerate(made)}
    assert [places[id(t)] for t in made[0].descendants()] == [1, 2, 3, 4, 5, 6, 7, 8]
    corners = [T.box_corners(t.box) for t in made]
    made[0].sync_boxes()
    for top, below in ((0, range(9)), (2, (2, 3, 4, 5)), (6, (6, 7, 8))):
        inside = np.concatenate([corners[k] for k in below])
        got = T.box_corners(made[top].box)
        assert np.allclose(got.min(axis=0), inside.min(axis=0)) and np.allclose(got.max(axis=0), inside.max(axis=0))
    with pytest.raises(BoxMissing):
        T.Tile().to_dict()


def test_json_round_trip_and_inheritance(tmp_path):
    d = {"asset": {"version": "1.0", "tilesetVersion": "7"}, "geometricError": 9, "extensionsUsed": ["X"], "extras": {"k": 1}, "root": {
        "boundingVolume": {"box": [0.0] * 12}, "geometricError": 3, "refine": "replace", "transform": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 5, 6, 7, 1], "children": [{"boundingVolume": {"box": [1.0] * 12}, "geometricError": 0, "content": {"url": "a.pnts"}}], "extensions": {"X": {"v": 2}},
    }}
    ts = T.TileSet.from_dict(d)
    assert ts.root.transform[:3, 3].tolist() == [5, 6, 7] and ts.root.children[0].refine is None and ts.root.refine == "REPLACE"
    out = json.loads(json.dumps(ts.to_dict()))
    assert "refine" not in out["root"]["children"][0] and out["root"]["transform"][12:15] == [5, 6, 7] and out["extensionsUsed"] == ["X"] and out["root"]["extensions"] == {"X": {"v": 2}} and out["extras"] == {"k": 1}
    with pytest.raises(UnknownExtension):
        T.TileSet.from_dict(d | {"extensionsRequired": ["Y"]})
    T.register_extension("Y", dict)
    assert T.is_registered("Y") and T.TileSet.from_dict(d | {"extensionsRequired": ["Y"]})
    for bad in ({"root": None}, {"root": {"geometricError": 1}}):
        with pytest.raises(InvalidTileset):
            T.TileSet.from_dict(bad)
    with pytest.raises(NotImplementedError):
        T.Tile.from_dict({"boundingVolume": {"sphere": [0, 0, 0, 1]}})


def points_file(folder, name, n, shift):
    p = (np.random.default_rng(n).random((n, 3)) + shift).astype(np.float32)
    (folder / name).write_bytes(pnts.encode(pnts.from_arrays(p, np.full((n, 3), 9, np.uint8), {"f": np.arange(n, dtype=np.float32)})))
    return p


def test_counting_nested_merging_and_deleting(tmp_path):
    for k, shift in enumerate((0.0, 5.0)):
        folder = tmp_path / f"t{k}"
        folder.mkdir()
        points_file(folder, "root.pnts", 20, shift)
        points_file(folder, "child.pnts", 30, shift)
        root = tile([shift] * 3, [shift + 1] * 3, content_uri="root.pnts", refine="REPLACE", children=[tile([shift] * 3, [shift + 1] * 3, content_uri="child.pnts")])
        T.TileSet(root).write(str(folder / "tileset.json"))
    one = T.TileSet.read(str(tmp_path / "t0" / "tileset.json"))
    assert one.count_points() == 30 and len(list(one.contents())) == 2
    out = str(tmp_path / "tileset.json")
    merged = T.merge_files([str(tmp_path / f"t{k}" / "tileset.json") for k in (0, 1)], out)
    back = T.TileSet.read(out)
    assert back.count_points() == 60 and np.allclose(back.root.transform[:3, 3], [3, 3, 3]) and merged.root.content_uri == "preview.pnts"
    assert np.isclose(back.root.geometric_error, np.sqrt(3) * 6) and len(back.fetch(back.root)[1]) == 40
    assert np.allclose(back.root.children[1].transform[:3, 3], -3)
    back.delete(out, nested=True)
    assert not os.path.exists(out) and os.listdir(tmp_path / "t0") == []


def test_long_subtrees_are_split(tmp_path):
    leaf = [tile([0, 0, 0], [1, 1, 1], content_uri=f"{k}.pnts") for k in range(1500)]
    T.TileSet(tile([0, 0, 0], [1, 1, 1], children=[tile([0, 0, 0], [1, 1, 1], children=leaf, extras={"node": "3"})])).write(str(tmp_path / "tileset.json"))
    assert sorted(os.listdir(tmp_path)) == ["tileset.3.json", "tileset.json"] and (tmp_path / "tileset.json").stat().st_size < 2000


def test_rebase():
    t = tile([0, 0, 0], [1, 1, 1], content_uri="a/b.pnts", children=[tile([0, 0, 0], [1, 1, 1], content_uri="/abs.pnts")])
    t.rebase("up")
    assert (t.content_uri, t.children[0].content_uri) == ("up/a/b.pnts", "/abs.pnts")


def test_folders_and_routing(tmp_path):
    (tmp_path / "x").mkdir()
    make_folder(str(tmp_path / "x"))
    (tmp_path / "x" / "f").write_text("")
    with pytest.raises(FileExistsError):
        make_folder(str(tmp_path / "x"))
    with pytest.raises(FileExistsError):
        make_folder(str(tmp_path / "x" / "f"), overwrite=True)
    make_folder(str(tmp_path / "x"), overwrite=True)
    assert os.listdir(tmp_path / "x") == []
    with pytest.raises(NoTilerFound, match="a.txt, b.doc"):
        assign([PointTiler()], ["a.txt", "c.XYZ", "b.doc"])


def test_reference_systems_of_files(spark, tmp_path):
    p = np.random.default_rng(3).random((50, 3)) * 100
    geog = 'GEOGCS["WGS 84",DATUM["W",SPHEROID["WGS 84",6378137,298.257223563,AUTHORITY["EPSG","7030"]],AUTHORITY["EPSG","6326"]],AUTHORITY["EPSG","4326"]]'
    wkt = f'PROJCS["UTM, 31 (N)",{geog},PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],AUTHORITY["EPSG","32631"]]'
    compound = f'COMPD_CS["both",{wkt},VERT_CS["h",VERT_DATUM["v",2005,AUTHORITY["EPSG","5100"]],AUTHORITY["EPSG","5720"]],AUTHORITY["EPSG","7405"]]'
    newer = 'PROJCRS["x",BASEGEOGCRS["g",DATUM["d",ELLIPSOID["e",6378137,298.257222101]],ID["EPSG",4171]],CONVERSION["c",METHOD["m",ID["EPSG",9802]]],CS[Cartesian,2],ID["EPSG",2154]]'
    for name, code in (("a", 3857), ("b", 3857), ("c", 2154), ("none", None), ("wkt", wkt), ("both", compound), ("geog", geog), ("newer", newer), ("odd", 'LOCAL_CS["x"]'), ("own", 32767)):
        las.write(str(tmp_path / f"{name}.las"), p + [281345, 369123, 0], crs=code)
    found = {os.path.basename(r.path)[:-4]: r.crs for r in sources.named_crs(spark, [str(tmp_path / f) for f in os.listdir(tmp_path)]).collect()}
    assert found == {"a": "EPSG:3857", "b": "EPSG:3857", "c": "EPSG:2154", "none": None, "wkt": "EPSG:32631", "both": "EPSG:32631", "geog": "EPSG:4326", "newer": "EPSG:2154", "odd": None, "own": None}
    assert len(las.scan(spark, [str(tmp_path / "wkt.las")]).collect()) == 50
    path = lambda *names: [str(tmp_path / f"{n}.las") for n in names]
    assert PointTiler().source_crs(spark, path("a", "b", "none")) == "EPSG:3857" and PointTiler(3857).source_crs(spark, path("a", "none")) == "EPSG:3857"
    for tiler, files in ((PointTiler(), path("a", "c")), (PointTiler(2154), path("a"))):
        with pytest.raises(MixedCrs, match="2154.*3857"):
            tiler.source_crs(spark, files)
    assert PointTiler(2154, force_crs_in=True).source_crs(spark, path("a")) == 2154
    with pytest.raises(MissingCrs):
        convert(spark, path("none"), str(tmp_path / "x"), [PointTiler(crs_out=3857)])
    assert not os.path.exists(tmp_path / "x")
    ts = convert(spark, path("a"), str(tmp_path / "y"), [PointTiler(crs_out=4978)])
    assert abs(np.linalg.norm(ts.root.transform[:3, 3]) - 6378000) < 1000 and ts.count_points() == 50


@pytest.mark.parametrize("form", ["pnts", "glb"])
def test_convert_points(spark, tmp_path, form):
    p = np.random.default_rng(3).random((3000, 3)) * [40, 40, 30] + [1000, 2000, 5]
    p[:400] = [1010, 2010, 7]  # many at one place
    las.write(str(tmp_path / "a.las"), p[:2000], np.full((2000, 3), 512), intensity=np.arange(2000))
    las.write(str(tmp_path / "b.las"), p[2000:], np.full((1000, 3), 512))
    out = str(tmp_path / "out")
    ts = convert(spark, [str(tmp_path / "a.las"), str(tmp_path / "b.las")], out, [PointTiler(fields=["intensity"], form=form, leaf_capacity=300)])
    back = T.TileSet.read(os.path.join(out, "tileset.json"))
    assert back.count_points() == 3000 and ts.root.refine == "REPLACE" and back.root.content_uri
    world = T.box_corners(back.root.world_box())
    assert np.allclose(world.min(axis=0), p.min(axis=0), atol=0.1) and np.allclose(world.max(axis=0), p.max(axis=0), atol=0.1)
    assert all(t.geometric_error == 0 or t.children or t.content_uri.endswith(".json") for t in back.root.descendants())
    with pytest.raises(FileExistsError):
        convert(spark, [str(tmp_path / "a.las")], out)
    las.write(str(tmp_path / "c.las"), np.empty((0, 3)))
    with pytest.raises(TilingFailed):
        convert(spark, [str(tmp_path / "c.las")], str(tmp_path / "none"))
    assert not os.path.exists(tmp_path / "none")


def test_convert_meshes(spark, tmp_path):
    from tests_support import IFC, OBJ

    (tmp_path / "a.obj").write_text(OBJ)
    (tmp_path / "b.IFC").write_text(IFC)
    convert(spark, [str(tmp_path / "a.obj"), str(tmp_path / "b.IFC")], str(tmp_path / "out"))
    back = T.TileSet.read(str(tmp_path / "out" / "tileset.json"))
    assert len(list(back.contents())) == 2 and back.root.extras == {"skippedItems": 1}


def test_metadata():
    c = M.MetadataClass({"a": M.Property("VEC3", "INT16", nodata=[1, 2, 3], minimum=0), "e": M.Property("ENUM", enum="kinds"), "s": M.Property("STRING", array=True)})
    s = M.Schema("id1", {"c": c}, {"kinds": M.Enumeration({"x": 0, "y": 1}, name="K")})
    d = s.to_dict()
    assert d["classes"]["c"]["properties"]["a"] == {"type": "VEC3", "componentType": "INT16", "noData": [1, 2, 3]} and d["enums"]["kinds"] == {"name": "K", "values": [{"name": "x", "value": 0}, {"name": "y", "value": 1}]}
    assert c.spark_type().simpleString() == "struct<a:array<smallint>,e:int,s:array<string>>"
    with pytest.raises(KeyError):
        M.Schema("i", {"c": c}).to_dict()
    with pytest.raises(InvalidMetadata):
        M.check_identifier("1a")
    with pytest.raises(InvalidMetadata):
        M.Property("VEC2")
    assert M.check_identifier("") == ""
    assert M.class_of(c.spark_type()["a"].dataType and M.T.StructType().add("n", "double", False)).to_dict()["properties"] == {"n": {"type": "SCALAR", "componentType": "FLOAT64", "required": True}}


def all_tiles(folder, name="tileset.json"):
    """Tiles of a tree over all of its files: (tile, links from the root, the boxes around it)."""
    ts = T.TileSet.read(os.path.join(folder, name))
    stack = [(ts.root, [], 0)]
    while stack:
        t, around, links = stack.pop()
        if (t.content_uri or "").endswith(".json"):
            assert links < 20
            for u, above, deeper in all_tiles(folder, t.content_uri):
                yield u, around + above, links + 1 + deeper
            continue
        yield t, around, links
        stack += [(c, [*around, t.box], links) for c in t.children]


def test_large_trees_are_written_by_tasks_in_files_of_few_levels(spark, tmp_path, monkeypatch):
    from stratapoint import convert as C

    p = np.random.default_rng(5).random((4000, 3)) * 64
    p[:700] = [10, 20, 30]
    las.write(str(tmp_path / "a.las"), p)
    out = str(tmp_path / "out")
    monkeypatch.setattr(C, "CONTENT_POINTS", 250)
    monkeypatch.setattr(C, "FILE_LEVELS", 2)
    ts = convert(spark, [str(tmp_path / "a.las")], out, [PointTiler(leaf_capacity=200)])
    tiles = list(all_tiles(out))
    assert max(links for _, _, links in tiles) >= 3 and all(len(list(T.TileSet.read(os.path.join(out, f)).root.descendants())) <= 100 for f in os.listdir(out) if f.endswith(".json"))
    files = [t.content_uri for t, _, _ in tiles if t.content_uri]
    on_disk = {os.path.relpath(os.path.join(d, f), out) for d, _, names in os.walk(out) for f in names if f.endswith(".pnts")}
    assert len(files) == len(set(files)) and set(files) == on_disk and any(".1." in f for f in files)
    assert ts.count_points() == 4000
    total = 0
    for t, around, _ in tiles:
        for box in around:
            a, b = T.box_corners(box), T.box_corners(t.box)
            assert (a.min(axis=0) <= b.min(axis=0) + 1e-6).all() and (a.max(axis=0) >= b.max(axis=0) - 1e-6).all()
        if t.content_uri and t.content_uri != "r.pnts":
            content = pnts.decode((tmp_path / "out" / t.content_uri).read_bytes())
            assert len(content) <= 330
            total += len(content)
    assert total == 4000


def test_mesh_files_are_read_by_tasks(spark, tmp_path):
    rng = np.random.default_rng(2)
    for k in range(3):
        v = rng.random((12, 3)) * 5 + [1000 * k, 50, 7]
        lines = [f"v {x} {y} {z}" for x, y, z in v] + [f"o part{k}", "usemtl none"] + [f"f {j + 1} {j + 2} {j + 3}" for j in range(10)]
        (tmp_path / f"m{k}.obj").write_text("\n".join(lines))
    out = str(tmp_path / "out")
    ts = convert(spark, [str(tmp_path / f"m{k}.obj") for k in range(3)], out)
    back = T.TileSet.read(os.path.join(out, "tileset.json"))
    tops = back.root.children
    assert len(tops) == 3 and len({tuple(t.transform[:3, 3]) for t in tops}) == 3 and sorted(os.listdir(out)) == ["0_0.b3dm", "1_0.b3dm", "2_0.b3dm", "tileset.json"]
    assert all(abs(t.world_box()[0] - 1000 * k) < 10 for k, t in enumerate(tops)) and ts.geometric_error > 0
    (tmp_path / "empty.obj").write_text("o x\n")
    with pytest.raises(TilingFailed):
        convert(spark, [str(tmp_path / "empty.obj")], str(tmp_path / "none"))
