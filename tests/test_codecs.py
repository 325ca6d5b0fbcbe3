import json

import numpy as np
import pytest

from stratapoint.codecs import b3dm, batch_table, glb, pnts, sniff
from stratapoint.errors import InvalidBatchedModel, InvalidContent, InvalidPoints


def points(n, seed=0):
    rng = np.random.default_rng(seed)
    return rng.random((n, 3)).astype(np.float32), rng.integers(0, 256, (n, 3)).astype(np.uint8)


def test_pnts_lengths_and_round_trip():
    p, c = points(1000)
    data = pnts.encode(pnts.from_arrays(p, c))
    assert len(data) % 8 == 0 and int.from_bytes(data[12:16], "little") % 8 == 4 and int.from_bytes(data[16:20], "little") == 15_000
    back = pnts.decode(data)
    assert np.array_equal(back.positions, p) and np.array_equal(back.colours, c) and len(back) == 1000


def test_pnts_properties_padding_and_text():
    p, _ = points(3)
    props = {"a": np.array([1, 2, 3], np.uint8), "b": np.array([1.5, 2, 3], np.float32), "c": np.array([7, 8, 9], np.uint8), "d": np.arange(6, dtype=np.int16).reshape(3, 2), "name": ["ä", "é", "中"]}
    back = pnts.decode(pnts.encode(pnts.from_arrays(p, None, props))).properties
    assert back["name"] == props["name"] and all(np.array_equal(back[k], props[k]) for k in "abcd")


def test_pnts_other_fields():
    p, _ = points(4)
    q = pnts.Points({"POSITION_QUANTIZED": (p * 65535).astype(np.uint16), "RGB565": np.array([0xFFFF, 0xF800, 0x07E0, 0x001F], np.uint16), "NORMAL_OCT16P": np.array([[128, 128], [255, 128], [128, 255], [0, 0]], np.uint8)}, {"QUANTIZED_VOLUME_OFFSET": [10.0, 0.0, 0.0], "QUANTIZED_VOLUME_SCALE": [2.0, 2.0, 2.0], "RTC_CENTER": [0.0, 5.0, 0.0]})
    b = pnts.decode(pnts.encode(q))
    assert np.allclose(b.positions, p * 2 + [10, 5, 0], atol=1e-4) and b.colours.tolist() == [[255, 255, 255], [255, 0, 0], [0, 255, 0], [0, 0, 255]]
    assert np.allclose(np.linalg.norm(b.normals, axis=1), 1, atol=1e-5) and np.allclose(b.normals[0], [0, 0, 1], atol=0.01) and b.normals[3, 2] < 0


def test_pnts_refusals():
    p, c = points(3)
    good = pnts.encode(pnts.from_arrays(p, c))
    for bad in (b"", good[:-1], b"x" + good[1:], good[:40]):
        with pytest.raises(InvalidPoints):
            pnts.decode(bad)
    with pytest.raises(InvalidPoints):
        pnts.merge([pnts.from_arrays(p, c), pnts.from_arrays(p)])
    with pytest.raises(InvalidPoints):
        pnts.from_arrays(p, c.astype(np.int64))
    merged = pnts.merge([pnts.from_arrays(p, c, {"k": [1, 2, 3]}), pnts.from_arrays(p, c, {"k": [4, 5, 6]})])
    assert len(merged) == 6 and merged.properties["k"] == [1, 2, 3, 4, 5, 6]


def test_batch_table():
    head, body = batch_table.encode({"u": np.array([1, 2, 3], np.uint8), "f": np.array([1, 2, 3], np.float32), "v": np.array([4, 5, 6], np.uint8)})
    h = json.loads(head)
    assert (h["u"]["byteOffset"], h["f"]["byteOffset"], h["v"]["byteOffset"]) == (0, 4, 16) and len(head) % 8 == 0 and len(body) == 24
    with pytest.raises(InvalidContent):
        batch_table.encode({"l": np.array([1], np.int64)})
    with pytest.raises(InvalidContent):
        batch_table.binary_property({"n": [1]}, "n")
    for other in ({"b": [1]}, {"a": np.array([1], np.uint8)}):
        with pytest.raises(InvalidContent):
            batch_table.merge([{"a": [1]}, other])


def test_hierarchy():
    classes = [("Lamp", ["watts", "lit"]), ("Street", ["label"]), ("District", [])]
    instances = [(2, {}, []), (1, {"label": "A 1"}, [0]), (1, {"label": None}, [0]), (0, {"watts": 40, "lit": True}, [1, 2]), (0, {"watts": 0, "lit": False}, [2])]
    h = batch_table.encode_hierarchy(classes, instances)
    assert h["classIds"] == [2, 1, 1, 0, 0] and h["parentCounts"] == [0, 1, 1, 2, 1] and h["parentIds"] == [0, 0, 1, 2, 2] and h["instancesLength"] == 5
    assert batch_table.decode_hierarchy(h) == [(classes[k][0], values, ups) for k, values, ups in instances]
    with pytest.raises(InvalidContent):
        batch_table.encode_hierarchy(classes, [(0, {}, [5])])


def test_glb_points_and_merge():
    p, c = points(3)
    a = glb.from_points(p, c, {"echo": np.array([250, 0, 4], np.uint32)})
    assert len(a) % 4 == 0 and sniff.read(a)[0] == "points"
    q, d, e = glb.to_points(a)
    assert np.array_equal(q, p) and np.array_equal(d, c) and e["echo"].dtype == np.float32
    both = glb.merge_points([a, glb.from_points(p + 10, c, {"echo": np.array([9, 80, 1], np.uint32)})])
    q, _, e = glb.to_points(both)
    assert e["echo"].tolist() == [250, 0, 4, 9, 80, 1] and len(q) == 6
    gltf, _ = glb.unpack(both)
    assert gltf["accessors"][0]["max"][0] >= 10
    with pytest.raises(InvalidContent):
        glb.merge_points([a, glb.from_points(p)])
    empty = glb.from_points(np.empty((0, 3), np.float32))
    assert len(glb.to_points(empty)[0]) == 0 and np.array_equal(glb.to_points(glb.merge_points([empty, a]))[0], p)


def test_glb_meshes_share_buffers():
    p, _ = points(4)
    m = glb.Mesh(p.astype(float), normals=p, uvs=p[:, :2], extras={"height": p[:, 2]}, primitives=[glb.Primitive(np.array([[0, 1, 2]]), {"pbrMetallicRoughness": {"metallicFactor": 1.0}}, "t.png"), glb.Primitive(np.array([[1, 2, 3]]))])
    gltf, body = glb.unpack(glb.encode([m, m]))
    assert glb.vertex_count(gltf) == 8 and len(gltf["materials"]) == 2 and gltf["materials"][0] == glb.DEFAULT_MATERIAL and len(gltf["images"]) == 1
    assert glb.attribute(gltf, body, "POSITION").shape == (12, 3) and glb.own_attributes(gltf) == ["_HEIGHT"]
    assert np.array_equal(glb.attribute(gltf, body, "POSITION")[3:6], p[[1, 2, 3]])
    with pytest.raises(InvalidContent):
        glb.unpack(b"glTF" + b"\0" * 30)


def test_b3dm():
    p, _ = points(3)
    data = b3dm.from_meshes([glb.Mesh(p), glb.Mesh(p + 1)], {"h": np.array([1.0, 2.0], np.float32), "n": ["a", "ü"]})
    features, props, gltf = b3dm.decode(data)
    assert features["BATCH_LENGTH"] == 2 and props["n"] == ["a", "ü"] and props["h"].tolist() == [1, 2] and len(data) % 8 == 0
    g, body = glb.unpack(gltf)
    assert glb.attribute(g, body, "_BATCHID").tolist() == [0, 0, 0, 1, 1, 1]
    assert "features: 2" in sniff.describe(data)
    for bad in (b"", data[:-8], b"pnts" + data[4:]):
        with pytest.raises(InvalidBatchedModel):
            b3dm.decode(bad)
    with pytest.raises(InvalidContent):
        sniff.read(b"what")
