import json
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratapoint.operators import nested

json_values = st.recursive(st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=5), c, max_size=4), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(json_values, st.sampled_from([None, 1]))
def test_deep_parser_reads_json(value, indent):
    assert nested.parse_deep(json.dumps(value, indent=indent)) == value


@pytest.mark.parametrize("text", ["", "{", '{"a":}', '{"a":1,}', "[1,]", "[1 2]", "{a:1}", "NaN", "01", '"a', "[1]]", '{"a" 1}', "tru", "-", '"\n"'])
def test_deep_parser_refuses(text):
    with pytest.raises(ValueError):
        nested.parse_deep(text)


def test_depth_without_bound():
    doc = '{"root":' + '{"children":[' * 30_000 + '{"content":{"uri":"x"}}' + "]}" * 30_000 + "}"
    tiles = [n for n in nested.walk(nested.parse_strict(doc)) if n[0] == "tile"]
    assert len(tiles) == 30_001 and max(n[3] for n in tiles) == 30_000


ROWS = "tileset_id long, doc string, loaded_at timestamp, kind string"
OLD, NEW = datetime(2030, 1, 1), datetime(2030, 1, 2)


def found(spark, rows):
    return {tuple(r) for r in nested.tiles_with_contents(spark.createDataFrame([(*r, "clash") for r in rows], ROWS)).collect()}


def test_tiles_and_contents(spark):
    box = {"box": [0] * 12}
    doc = {"root": {"geometricError": "12.5", "boundingVolume": box, "content": {"url": "a"}, "children": [
        None, {"geometricError": None, "contents": [{"uri": "b"}, {"uri": "c"}], "extras": {"children": [{"content": {"uri": "no"}}]}},
        {"geometricError": 3, "boundingVolume": {"box": None}, "content": {}, "children": [{"boundingVolume": {"box": [1] * 9}, "content": None}]},
        7, {"geometricError": True, "children": {"a": {}}},
    ]}}
    got = found(spark, [(1, json.dumps(doc), NEW), (1, "{}", OLD), (2, "[1", NEW), (3, None, NEW), (3, json.dumps(doc), OLD), (4, '{"root": 3}', NEW), (5, '{"root": {"geometricError": NaN}}', NEW), (None, "{}", NEW)])
    assert got == {
        (1, "root", "", 12500, 12, "a"), (1, "root/1", "root", -1, 0, "b"), (1, "root/1", "root", -1, 0, "c"), (1, "root/2", "root", 3000, 0, ""),
        (1, "root/2/0", "root/2", -1, 9, ""), (1, "root/4", "root", -1, 0, ""),
    }


def test_intervals_hold_each_other(spark):
    doc = {"root": {"children": [{"children": [{}, {"content": {"uri": "u"}}]}, {}]}}
    df = spark.createDataFrame([(1, json.dumps(doc), NEW, "")], ROWS)
    tiles = {r["tile_path"]: r for r in nested.tile_table(df).collect()}
    assert tiles["root/0/1"]["parent_path"] == "root/0"
    for path, r in tiles.items():
        for other, o in tiles.items():
            assert (r["pre"] < o["pre"] and o["post"] < r["post"]) == (other != path and other.startswith(path + "/"))
    c = nested.content_table(df).collect()
    assert [(r["tile_path"], r["uri"]) for r in c] == [("root/0/1", "u")]


def test_errors_round_halves_away_and_end_at_a_long():
    for given, want in ((0.0125, 13), (-0.0125, -13), (0.0135, 14), ("0.0125", 13), (0.0124, 12), (9.1e15, 9100000000000000000), (1e16, 2**63 - 1), (-1e16, -(2**63)), ("1e999", 2**63 - 1), (10**30, 2**63 - 1), (7, 7000), (0, 0), (True, -1), ("x", -1), (None, -1)):
        assert nested._error_milli({"geometricError": given}) == want


def test_empty(spark):
    assert found(spark, []) == set()
