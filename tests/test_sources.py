import os

import numpy as np
import pytest

from stratapoint import sources
from stratapoint.errors import FormatNotSupported, InvalidIfc
from stratapoint.functions import crs
from stratapoint.sources import las, obj, ply, step, wkb, xyz


def test_sniff():
    assert xyz.sniff("1 2 3\n4 5 6\n") == xyz.Dialect(" ", 3, False)
    assert xyz.sniff("x,y,z,I,R,G,B,class\n1,2,3,4,5,6,7,8\n") == xyz.Dialect(",", 8, True)
    assert xyz.sniff("1;2;3;4\n").roles == ("x", "y", "z", "intensity")
    for bad in ("", "a\n", "1 2 3 4 5\n"):
        with pytest.raises(FormatNotSupported):
            xyz.sniff(bad).roles


def test_xyz_files(spark, tmp_path):
    a, b = tmp_path / "a.xyz", tmp_path / "b.csv"
    a.write_text("281345.1234 369123.4567 0\n281345.5678 369123.8901 0\nbroken line\n")
    b.write_text("x,y,z,I,R,G,B,class,note\r\n1,2,3,4,5,6,7,8,n\r\n")
    rows = {r.path.rsplit("/", 1)[1] + str(r.x): r for r in sources.read_points(spark, [str(a), str(b)]).collect()}
    assert len(rows) == 3 and any(abs(r.x - 281345.1234) < 0.02 and r.x == float(np.float32(281345.1234)) for r in rows.values())
    full = next(r for r in rows.values() if r.classification == 8)
    assert (full.intensity, full.red, full.blue) == (4.0, 5, 7)
    with pytest.raises(FormatNotSupported):
        sources.read_points(spark, ["a.e57"])


def test_las(spark, tmp_path):
    f, g = str(tmp_path / "a.LAS"), str(tmp_path / "b.las")
    p = np.array([[0.0, 0, 0], [1.5, 2.25, -3], [4, 5, 6]])
    las.write(f, p, np.array([[65535, 256, 0]] * 3), intensity=np.array([7, 8, 9]), classification=np.array([1, 2, 3]))
    las.write(g, p + 10)
    got = sources.read_points(spark, [f, g]).orderBy("x").collect()
    assert len(got) == 6 and got[1].x == 1.5 and got[1].z == -3 and got[0].red == 255 and got[0].green == 1 and got[5].red == 0 and got[1].intensity == 8 and got[4].classification == 0
    m = las.metadata(spark, [f]).first()
    assert m.point_count == 3 and m.aabb == [0, 0, -3, 4, 5, 6] and m.has_color
    (tmp_path / "c.las").write_bytes(b"nothing")
    with pytest.raises(FormatNotSupported):
        las.read_header(str(tmp_path / "c.las"))


@pytest.mark.parametrize("dark", [100_000, 1_000_000])
def test_las_colours_that_begin_dark(spark, tmp_path, dark):
    f, g = str(tmp_path / "a.las"), str(tmp_path / "b.las")
    p, c = np.zeros((dark + 2, 3)), np.zeros((dark + 2, 3), np.uint16)
    c[-2:] = [[255, 0, 7], [65535, 512, 0]]
    las.write(f, p, c)
    las.write(g, p, np.minimum(c, 255))
    got = {(r.path, r.point_no): (r.red, r.green, r.blue) for r in las.scan(spark, [f, g]).where(f"point_no >= {dark}").collect()}
    assert got == {(f, dark): (0, 0, 0), (f, dark + 1): (255, 2, 0), (g, dark): (255, 0, 7), (g, dark + 1): (255, 255, 0)}


@pytest.mark.parametrize("order", ["", "<", ">"])
def test_ply(spark, tmp_path, order):
    f = str(tmp_path / "a.ply")
    v = {"x": np.array([0, 0, 1, 1], np.float32), "y": np.array([0, 1, 0, 1], np.float32), "z": np.array([0, 1, 1, 0], np.float32), "red": np.array([0, 65535, 256, 512], np.uint16), "green": np.zeros(4, np.uint16), "blue": np.zeros(4, np.uint16), "intensity": np.array([80.5, -129, -15, 90.25], np.float32)}
    ply.write(f, v, order)
    got = ply.scan(spark, [f], ("intensity", "absent")).orderBy("point_no").collect()
    assert [r.red for r in got] == [0, 255, 1, 2] and [r.intensity for r in got] == [80.5, -129, -15, 90.25] and "absent" not in got[0]
    assert ply.read_header(f).extra_fields == [("intensity", "f4")]
    assert "i2" in ply.with_renamed_property(ply.scan(spark, [f], ("intensity",)), "intensity", "i2").columns
    ply.write(str(tmp_path / "b.ply"), {"x": v["x"]})
    with pytest.raises(KeyError):
        ply.read_header(str(tmp_path / "b.ply"))


def test_many_ply_files_share_tasks(spark, tmp_path):
    files = [str(tmp_path / f"{k}.ply") for k in range(60)]
    for k, f in enumerate(files):
        v = {c: np.arange(k % 5, dtype=float) + k for c in "xyz"}
        ply.write(f, v | ({"n": np.arange(k % 5, dtype=np.int32)} if k % 2 else {}), ("", "<", ">")[k % 3])
    points = ply.scan(spark, [*files, files[1]], ("n",))
    assert points.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism < len(files)
    got = sorted((r.path, r.point_no, r.x, r.n) for r in points.collect())
    assert got == sorted((f, i, float(k + i), float(i * (k % 2))) for k, f in enumerate(files) for i in range(k % 5))
    assert ply.scan(spark, []).count() == 0


@pytest.mark.filterwarnings("ignore:Input line")
def test_ply_in_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(ply, "BATCH", 3)
    f, head = str(tmp_path / "a.ply"), "ply\nformat ascii 1.0\nelement camera 2\nproperty int n\nelement vertex 7\nproperty float x\nproperty float y\nproperty float z\n{}end_header\n7\n8\n"
    lines = "".join(f"{k} {k * 2} 0\n" + "\n" * (k % 2) for k in range(7))
    for faces, rest in (("", ""), ("element face 1\nproperty list uchar int vertex_indices\n", "3 0 1 2\n")):
        with open(f, "w", encoding="ascii") as out:
            out.write(head.format(faces) + lines + rest)
        got = list(ply._rows(ply.read_header(f), 0, 7))
        assert [at for at, _ in got] == [0, 3, 6] and np.concatenate([r for _, r in got]).tolist() == [[k, k * 2, 0] for k in range(7)]
    for order in ("", "<"):
        ply.write(f, {c: np.arange(7.0) for c in "xyz"}, order)
        with open(f, "rb+") as out:
            out.truncate(os.path.getsize(f) - 24)
        with pytest.raises(FormatNotSupported, match="of 7 points"):
            list(ply._rows(ply.read_header(f), 0, 7))


OBJ = """mtllib a.mtl
o cube
v -1 -1 -1
v 1 -1 -1
v 1 1 -1
v -1 1 -1
vn 0 0 1
vt 0.25 0.75
usemtl red
f 1/1/1 2/1/1 3/1/1 4/1/1
f -4//1 -3//1 -2//1
"""


def test_obj(spark, tmp_path):
    (tmp_path / "a.obj").write_text(OBJ)
    (tmp_path / "a.mtl").write_text("newmtl red\nKd 1 0 0\nKs 0.5 0.5 0.5\nNs 500\nd 0.5\n")
    got = obj.scan(spark, [str(tmp_path / "a.obj")]).orderBy("face", "corner").collect()
    assert len(got) == 9 and {r.material for r in got} == {"red"} and got[0].v == -0.75 and got[6].u is None and got[8].x == 1
    m = obj.read_materials(str(tmp_path / "a.mtl"))[0]
    assert m["diffuse"] == [1, 0, 0] and m["opacity"] == 0.5 and m["shininess"] == 500


def test_wkb(spark, tmp_path):
    square = [[(0.0, 0.0, 0.0), (0.0, 10.0, 0.0), (10.0, 10.0, 0.0), (10.0, 0.0, 0.0)]]
    for order in "<>":
        assert [r.tolist() for r in wkb.parse(wkb.write([square], order))[0]] == [[list(p) for p in square[0]]]
    flat = wkb.write([[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]])
    df = spark.createDataFrame([(1, flat), (2, None)], "geom_id long, wkb binary")
    assert [tuple(r)[3:] for r in wkb.points(df).orderBy("point").collect()] == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0)]
    (tmp_path / "a.wkb").write_bytes(flat)
    (tmp_path / "b.txt").write_bytes(b"no")
    assert wkb.directory(spark, str(tmp_path)).count() == 1
    for bad in (b"", b"\1\2\0\0\0\1\0\0\0", flat[:20]):
        with pytest.raises(FormatNotSupported):
            wkb.parse(bad)


IFC = """ISO-10303-21;
DATA;
#1=IFCPROJECT('p',$,'Proj (1)',$,$,$,$,$,$);
#2=IFCSITE('s',$,'Site',$,$,$,$,$,$,(48,30,0,0),(8,15,36),100.,$,$);
#3=IFCBUILDING('b',$,'It''s',$,$,$,$,$,$,$,$,$);
#10=IFCRELAGGREGATES('r1',$,$,$,#1,(#2));
#11=IFCRELAGGREGATES('r2',$,$,$,#2,(#3));
#12=IFCRELCONTAINEDINSPATIALSTRUCTURE('r3',$,$,$,(#20),#3);
#20=IFCWALL('w',$,'Wall',$,$,#30,#40,$);
#30=IFCLOCALPLACEMENT($,#31);
#31=IFCAXIS2PLACEMENT3D(#32,$,$);
#32=IFCCARTESIANPOINT((10.,0.,0.));
#40=IFCPRODUCTDEFINITIONSHAPE($,$,(#41));
#41=IFCSHAPEREPRESENTATION($,'Body','SweptSolid',(#42,#49));
#42=IFCEXTRUDEDAREASOLID(#43,#44,#45,3.);
#43=IFCRECTANGLEPROFILEDEF(.AREA.,$,#46,2.,4.);
#44=IFCAXIS2PLACEMENT3D(#47,$,$);
#45=IFCDIRECTION((0.,0.,1.));
#46=IFCAXIS2PLACEMENT2D(#48,$);
#47=IFCCARTESIANPOINT((0.,0.,0.));
#48=IFCCARTESIANPOINT((0.,0.));
#49=IFCADVANCEDBREP($);
ENDSEC;
"""


def test_ifc(spark, tmp_path):
    f = tmp_path / "a.ifc"
    f.write_text(IFC)
    rows = {r.id: r for r in step.spatial_tree(spark, [str(f)]).collect()}
    assert [(r.id, r.parent_id, r.depth) for r in sorted(rows.values(), key=lambda r: r.depth)] == [(1, None, 0), (2, 1, 1), (3, 2, 2), (20, 3, 3)] and rows[3].name == "It's"
    model = step.Model.parse(IFC)
    t, skipped = model.element_triangles(20)
    assert skipped == 1 and len(t) == 12 and t.reshape(-1, 3).min(axis=0).tolist() == [9, -2, 0] and t.reshape(-1, 3).max(axis=0).tolist() == [11, 2, 3]
    assert step.degrees([48, 30, 0, 0]) == 48.5 and step.degrees(None) is None
    assert step.entities(spark, [str(f)]).where("type = 'IFCWALL'").count() == 1
    with pytest.raises(InvalidIfc):
        list(step.Model.parse("DATA;\n").tree())


def test_crs(spark):
    x, y, z = crs.transform(3857, 4978, np.array([281345.1234]), np.array([369123.4567]), np.array([0.0]))
    assert abs(np.sqrt(x**2 + y**2 + z**2)[0] - 6378000) < 1000
    for code in (3949, 3950, 2154, 2326, 32631):
        lon, lat = (114.2, 22.3) if code == 2326 else (3.5, 47.0)
        out = crs.transform(code, 4326, *crs.transform(4326, code, np.array([lon]), np.array([lat]), np.zeros(1)))
        assert abs(out[0][0] - lon) < 1e-8 and abs(out[1][0] - lat) < 1e-8
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    assert crs.reproject(df, 3857, 3857) is df and crs.reproject(df, None, None) is df
    with pytest.raises(crs.UnsupportedCrs):
        crs.reproject(df, 3857, 5514)
    with pytest.raises(ValueError):
        crs.reproject(df, None, 3857)


def near(got, want, off):
    assert all(abs(float(g[0]) - w) <= off for g, w in zip(got, want, strict=False)), (got, want)


def test_projections_at_published_points():
    at = lambda lon, lat: (np.array([lon]), np.array([lat]), np.zeros(1))
    # worked examples of the projections, on their own datums
    near(crs.from_geodetic(crs.known(28992), *at(6.0, 53.0)), (196105.283, 557057.739), 0.01)
    near(crs.from_geodetic(crs.known(27700), *at(1 + 43 / 60 + 4.5177 / 3600, 52 + 39 / 60 + 27.2531 / 3600)), (651409.903, 313177.270), 0.01)
    near(crs.from_geodetic(crs.known(31370), *at(5.807370277777778, 50.679572500000006)), (251763.203, 153034.169), 0.05)
    near(crs.from_geodetic(crs.known(2056), *at(7.439583333333333, 46.95240555555556)), (2600000.0, 1200000.0), 0.001)
    # and shifted, within the metre or so that seven parameters are good for: a place by its coordinates on both datums
    near(crs.transform(28992, 4326, np.array([155000.0]), np.array([463000.0]), np.zeros(1)), (5.38720621, 52.15517440), 5e-6)
    near(crs.transform(2056, 4326, np.array([2600000.0]), np.array([1200000.0]), np.zeros(1)), (7.438632, 46.951083), 2e-5)
    near(crs.transform(27700, 4326, np.array([651409.903]), np.array([313177.270]), np.zeros(1)), (1.716073972, 52.658007833), 6e-5)


def test_all_systems_there_and_back(spark):
    places = {2056: (8.2, 46.8), 21781: (8.2, 46.8), 2157: (-7.0, 53.0), 2180: (20.0, 52.0), 2193: (172.0, -42.0), 2326: (114.2, 22.3), 27700: (-1.5, 52.0), 28992: (5.1, 52.3), 31370: (4.8, 50.6), 3812: (4.8, 50.6)}
    for code, p in crs.KNOWN.items():
        lon, lat = places.get(code, (p.lon0 + 0.7, (p.lat0 if 30 < p.lat0 < 80 else 47.0) + 0.3))
        if p.y0 == 1e7:
            lat = -33.0
        there = crs.transform(4326, code, np.array([lon]), np.array([lat]), np.array([12.0]))
        near(crs.transform(code, 4326, *there), (lon, lat, 12.0), 1e-6 if p.kind == "geocentric" else 3e-8 if p.shift else 2e-8)
    df = spark.createDataFrame([(155000.0, 463000.0, 3.0)], "x double, y double, z double")
    r = crs.reproject(df, 28992, 4978).first()
    near([[v] for v in r], [v[0] for v in crs.transform(4326, 4978, np.array([5.38720621]), np.array([52.15517440]), np.array([3.0]))], 0.5)
    crs.register(990001, crs.Projection("tm", crs.BESSEL, 10.0, 0.0, 0, 0, 1.0, 5e5, 0.0))
    assert crs.known("EPSG:990001").ellipsoid == crs.BESSEL


def las_items(n, seed):
    import random
    import struct

    rng, out = random.Random(seed), []
    for k in range(n):
        p = struct.pack("<iiiHBBbBH", (k * k * 37) % 2**31, rng.randrange(-(2**31), 2**31) if k % 97 == 0 else k * 3, rng.randrange(-100, 100), rng.randrange(65536) if k % 5 == 0 else 7, rng.choice([9, 17, 18, 0x49, 0xFF]), rng.randrange(256) if k % 7 == 0 else 2, rng.randrange(-128, 128) if k % 11 == 0 else -5, k % 3, 5 + k // 500)
        t = struct.pack("<d", 1e5 + k * 0.001 + (rng.random() * 1e6 if k % 211 == 0 else 0) - (50 if k % 37 == 0 else 0)) if k % 13 else struct.pack("<q", rng.choice([0, -1, 2**62]))
        c = struct.pack("<HHH", *([rng.randrange(65536)] * 3 if k % 2 else [rng.randrange(65536) for _ in range(3)]))
        out.append(p + t + c + bytes([k % 256, rng.randrange(256)]))
    return out


@pytest.mark.parametrize("n", [1, 2, 5, 3000])
def test_compressed_chunks_round_trip(n):
    from stratapoint.sources import laz

    items = ((laz.POINT, 20), (laz.TIME, 8), (laz.COLOUR, 6), (laz.BYTES, 2))
    records = las_items(n, n)
    data = laz.write_chunk(records, items)
    assert laz.read_chunk(data, items, n) == b"".join(records)
    regular = [las_items(1, 0)[0][:12] + b"\0" * 24] * n
    if n > 1000:
        assert len(laz.write_chunk(regular, items)) < 36 * n / 100  # the same again and again costs next to nothing
    assert laz.describe(laz.record(items, 500)) == (items, 500)
    with pytest.raises(FormatNotSupported):
        laz.describe(b"\3" + laz.record(items, 500)[1:])


def test_a_median_of_five_follows_its_rule():
    from stratapoint.sources import laz

    m, x, high = laz.Median(), [0] * 5, True
    for v in np.random.default_rng(3).integers(-9, 9, 400).tolist():
        m.add(v)
        middle = x[2]
        x = sorted([*(x[:-1] if high else x[1:]), v])
        high = v < middle if high else v <= middle
        assert m.values == x and m.drop_largest == high


def test_compressed_files(spark, tmp_path, monkeypatch):
    from stratapoint.sources import las

    monkeypatch.setattr(las, "CHUNK", 300)
    rng = np.random.default_rng(1)
    p, c = rng.random((1000, 3)) * 50, rng.integers(0, 65536, (1000, 3))
    for name in ("a.las", "b.laz"):
        las.write(str(tmp_path / name), p, c, crs=3857, intensity=np.arange(1000))
    h = las.read_header(str(tmp_path / "b.laz"))
    assert len(h.coding.starts) == 4 and h.crs == "EPSG:3857" and h.count == 1000
    rows = {}
    for name in ("a.las", "b.laz"):
        t = las.scan(spark, [str(tmp_path / name)], ("intensity", "classification"))
        rows[name] = sorted(tuple(r)[1:] for r in t.collect())
    assert rows["a.las"] == rows["b.laz"] and len(rows["b.laz"]) == 1000
    las.write(str(tmp_path / "empty.laz"), np.empty((0, 3)))
    assert las.scan(spark, [str(tmp_path / "empty.laz")]).count() == 0


def solid(*lines):
    """A model whose item is entity 1, with a plain placement as 90."""
    return step.Model.parse("DATA;\n" + "\n".join(lines) + "\n#90=IFCAXIS2PLACEMENT3D(#91,$,$);\n#91=IFCCARTESIANPOINT((0.,0.,0.));\n#92=IFCDIRECTION((0.,0.,1.));\n#93=IFCAXIS2PLACEMENT2D(#91,$);\nENDSEC;")


def volume(t):
    """Of a closed surface that looks outwards."""
    return float((t[:, 0] * np.cross(t[:, 1], t[:, 2])).sum() / 6)


SWEPT = "#1=IFCEXTRUDEDAREASOLID(#2,#90,#92,2.);"


@pytest.mark.parametrize(("profile", "area"), [
    (["#2=IFCRECTANGLEPROFILEDEF(.AREA.,$,#93,3.,4.);"], 12), (["#2=IFCRECTANGLEHOLLOWPROFILEDEF(.AREA.,$,#93,3.,4.,0.5,$,$);"], 6), (["#2=IFCCIRCLEPROFILEDEF(.AREA.,$,#93,2.);"], 12 * 4 * np.sin(np.pi / 12)),
    (["#2=IFCCIRCLEHOLLOWPROFILEDEF(.AREA.,$,#93,2.,1.);"], 12 * 3 * np.sin(np.pi / 12)), (["#2=IFCELLIPSEPROFILEDEF(.AREA.,$,#93,2.,1.);"], 12 * 2 * np.sin(np.pi / 12)),
    (["#2=IFCISHAPEPROFILEDEF(.AREA.,$,#93,4.,6.,1.,0.5,$,$,$);"], 9), (["#2=IFCLSHAPEPROFILEDEF(.AREA.,$,#93,5.,3.,1.,$,$,$);"], 7), (["#2=IFCTSHAPEPROFILEDEF(.AREA.,$,#93,5.,3.,1.,1.,$,$,$,$,$);"], 7),
    (["#2=IFCUSHAPEPROFILEDEF(.AREA.,$,#93,5.,3.,1.,1.,$,$,$);"], 9), (["#2=IFCROUNDEDRECTANGLEPROFILEDEF(.AREA.,$,#93,4.,3.,1.);"], 12 - 4 + 12 * np.sin(np.pi / 12)),
    (["#2=IFCARBITRARYPROFILEDEFWITHVOIDS(.AREA.,$,#3,(#4));", "#3=IFCPOLYLINE((#5,#6,#7,#8,#5));", "#4=IFCINDEXEDPOLYCURVE(#9,(IFCLINEINDEX((1,2,3)),IFCLINEINDEX((3,4,1))),$);", "#5=IFCCARTESIANPOINT((0.,0.));", "#6=IFCCARTESIANPOINT((5.,0.));", "#7=IFCCARTESIANPOINT((5.,5.));", "#8=IFCCARTESIANPOINT((0.,5.));", "#9=IFCCARTESIANPOINTLIST2D(((1.,1.),(2.,1.),(2.,3.),(1.,3.)));"], 23),
    (["#2=IFCARBITRARYCLOSEDPROFILEDEF(.AREA.,$,#4);", "#4=IFCINDEXEDPOLYCURVE(#9,(IFCLINEINDEX((1,2)),IFCARCINDEX((2,3,1))),$);", "#9=IFCCARTESIANPOINTLIST2D(((-2.,0.),(2.,0.),(0.,2.)));"], 12 * 2 * np.sin(np.pi / 12)),
])
def test_swept_profiles_have_their_volume(profile, area):
    t = solid(SWEPT, *profile).triangles(step.Ref(1))
    assert abs(volume(t) - 2 * area) < 1e-6


def test_turned_cut_mapped_and_scaled_solids():
    ring = solid("#1=IFCREVOLVEDAREASOLID(#2,#90,#3,6.283185307179586);", "#2=IFCRECTANGLEPROFILEDEF(.AREA.,$,#93,1.,1.);", "#3=IFCAXIS1PLACEMENT(#4,#5);", "#4=IFCCARTESIANPOINT((3.,0.,0.));", "#5=IFCDIRECTION((0.,1.,0.));").triangles(step.Ref(1))
    assert abs(abs(volume(ring)) - 12 * np.sin(np.pi / 12) * (3.5**2 - 2.5**2)) < 1e-6
    part = solid("#1=IFCREVOLVEDAREASOLID(#2,#90,#3,1.5707963267948966);", "#2=IFCRECTANGLEPROFILEDEF(.AREA.,$,#93,1.,1.);", "#3=IFCAXIS1PLACEMENT(#4,#5);", "#4=IFCCARTESIANPOINT((3.,0.,0.));", "#5=IFCDIRECTION((0.,1.,0.));").triangles(step.Ref(1))
    assert abs(abs(volume(part)) * 4 - abs(volume(ring))) < 1e-6
    box = ["#2=IFCEXTRUDEDAREASOLID(#3,#90,#92,4.);", "#3=IFCRECTANGLEHOLLOWPROFILEDEF(.AREA.,$,#93,4.,4.,1.,$,$);", "#5=IFCPLANE(#6);", "#6=IFCAXIS2PLACEMENT3D(#7,#8,$);", "#7=IFCCARTESIANPOINT((0.,0.,1.));", "#8=IFCDIRECTION((0.,0.,1.));"]
    for flag, want in ((".T.", 36), (".F.", 12)):
        t = solid("#1=IFCBOOLEANCLIPPINGRESULT(.DIFFERENCE.,#2,#4);", f"#4=IFCHALFSPACESOLID(#5,{flag});", *box).triangles(step.Ref(1))
        assert abs(volume(t) - want) < 1e-6
    slanted = [b.replace("(0.,0.,1.));", "(1.,0.,1.));") if b.startswith("#8") else b.replace("HOLLOW", "").replace(",1.,$,$", "") for b in box]
    t = solid("#1=IFCBOOLEANCLIPPINGRESULT(.DIFFERENCE.,#2,#4);", "#4=IFCHALFSPACESOLID(#5,.T.);", *slanted).triangles(step.Ref(1))
    cut = 4 * (9 / 2)  # below z = 1 - x within the box: a triangle with legs of 3, four long
    assert abs(volume(t) - (64 - cut)) < 1e-6
    mapped = solid("#1=IFCMAPPEDITEM(#20,#21);", "#20=IFCREPRESENTATIONMAP(#22,#23);", "#21=IFCCARTESIANTRANSFORMATIONOPERATOR3D(#24,#25,#26,2.,$);", "#22=IFCAXIS2PLACEMENT3D(#27,$,$);", "#23=IFCSHAPEREPRESENTATION($,'Body','x',(#2));", "#24=IFCDIRECTION((0.,1.,0.));", "#25=IFCDIRECTION((-1.,0.,0.));", "#26=IFCCARTESIANPOINT((10.,0.,0.));", "#27=IFCCARTESIANPOINT((0.,0.,1.));", "#2=IFCEXTRUDEDAREASOLID(#3,#90,#92,4.);", "#3=IFCRECTANGLEPROFILEDEF(.AREA.,$,#93,1.,3.);").triangles(step.Ref(1)).reshape(-1, 3)
    assert np.allclose(mapped.min(axis=0), [7, -1, -2]) and np.allclose(mapped.max(axis=0), [13, 1, 6])
    for unit, want in (("#50=IFCSIUNIT(*,.LENGTHUNIT.,.MILLI.,.METRE.);", 1e-3), ("#50=IFCSIUNIT(*,.LENGTHUNIT.,$,.METRE.);", 1.0), ("#50=IFCCONVERSIONBASEDUNIT(#52,.LENGTHUNIT.,'FOOT',#53);\n#53=IFCMEASUREWITHUNIT(IFCLENGTHMEASURE(0.3048),#54);\n#54=IFCSIUNIT(*,.LENGTHUNIT.,$,.METRE.);", 0.3048), ("", 1.0)):
        m = step.Model.parse(IFC.replace("ENDSEC;", f"#51=IFCUNITASSIGNMENT((#50));\n{unit}\nENDSEC;") if unit else IFC)
        t, _ = m.element_triangles(20)
        assert np.allclose(t.reshape(-1, 3).max(axis=0), np.array([11, 2, 3]) * want)
    assert solid("#1=IFCADVANCEDBREP($);").triangles(step.Ref(1)) is None
