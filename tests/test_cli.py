import json
import os
import threading
import urllib.request

import numpy as np
import pytest

from stratapoint import cli
from stratapoint import tileset as T
from stratapoint.codecs import glb, pnts
from stratapoint.errors import InvalidTileset
from stratapoint.export import export
from stratapoint.sources import wkb


def squares(n, edge=10.0):
    return [(k, wkb.write([[[(k * 97 % 5000, 0, k * 31 % 3000), (k * 97 % 5000, 0, k * 31 % 3000 + edge), (k * 97 % 5000 + edge, 3, k * 31 % 3000 + edge), (k * 97 % 5000 + edge, 3, k * 31 % 3000)]]]), float(k)) for k in range(n)]


def test_export(spark, tmp_path):
    out = str(tmp_path / "out")
    export(spark.createDataFrame(squares(150), "geom_id long, wkb binary, weight double"), out, edge=2000.0, per_tile=20)
    ts = T.TileSet.read(os.path.join(out, "tileset.json"))
    total = 0
    for t, (kind, content) in ts.contents():
        assert kind == "b3dm" and len(content[1]["id"]) <= 20
        g, body = glb.unpack(content[2])
        p = glb.attribute(g, body, "POSITION")
        corners = T.box_corners(t.box)
        assert (p >= corners.min(axis=0) - 1e-2).all() and (p <= corners.max(axis=0) + 1e-2).all()
        total += len(content[1]["id"])
    assert total == 150 and ts.count_points() == 150 * 6
    top = [t for t in ts.root.children if t.children]
    assert top and all(t.geometric_error == 250 for t in top)


def test_info_and_merge(tmp_path, capsys):
    p = np.random.default_rng(0).random((5, 3)).astype(np.float32)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "r.pnts").write_bytes(pnts.encode(pnts.from_arrays(p)))
    T.TileSet(T.Tile(1.0, T.box_from_points(p), content_uri="r.pnts")).write(str(tmp_path / "a" / "tileset.json"))
    cli.main(["info", str(tmp_path / "a" / "r.pnts")])
    assert "points: 5" in capsys.readouterr().out
    out = str(tmp_path / "m.json")
    cli.main(["merge", str(tmp_path / "a" / "tileset.json"), "--out", out])
    assert T.TileSet.read(out).count_points() == 5
    with pytest.raises(FileExistsError):
        cli.main(["merge", str(tmp_path / "a" / "tileset.json"), "--out", out])


def test_view(tmp_path):
    (tmp_path / "tileset.json").write_text('{"asset": {}}')
    s = cli.server(str(tmp_path), 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{s.server_address[1]}/tileset.json") as r:
        assert r.headers["Access-Control-Allow-Origin"] == "*" and json.load(r) == {"asset": {}}
    s.shutdown()
    with pytest.raises(InvalidTileset):
        cli.find_tileset(str(tmp_path / "none"))


def test_parser():
    a = cli.parser().parse_args(["convert", "a.las", "--out", "o", "--spec-version", "1.1", "--field", "intensity"])
    assert a.files == ["a.las"] and a.field == ["intensity"] and a.leaf_capacity == 20_000
