from datetime import datetime, timedelta

from stratapoint.functions.dtypes import promoted
from stratapoint.operators import drift

T0 = datetime(2030, 1, 31)
META = "file_id long, series_id long, extra_fields array<struct<name: string, dtype: string>>, delivered_at timestamp, loaded_at timestamp, file string"
TERMS = [("intensity", "intensity"), ("refl", "intensity"), ("hag", "height"), ("z_norm", "height")]


def files(spark, rows):
    return spark.createDataFrame([(f, s, e, T0 + timedelta(days=20 * d), T0 + timedelta(days=400 + u), "clash") for f, s, e, d, u in rows], META)


def terms(spark):
    return spark.createDataFrame(TERMS, "term string, quantity string")


def report(spark, rows):
    return {tuple(r) for r in drift.drift_report(files(spark, rows), terms(spark)).collect()}


def test_changes(spark):
    got = report(spark, [
        (1, 1, [("Intensity", "u2"), ("hag", "<f4"), ("gone", "i4")], 0, 0),
        (2, 1, None, 1, 0),  # passed over
        (3, 1, [("refl ", "uint16"), ("hag", ">f8"), ("new one", "|u1"), ("new one", "|u1")], 2, 0),
        (4, 1, [], 3, 0),
    ])
    assert got == {
        (3, "renamed", "Intensity", "refl"), (3, "retyped", "hag", "hag"), (3, "removed", "gone", ""), (3, "added", "", "new one"),
        (4, "removed", "refl", ""), (4, "removed", "hag", ""), (4, "removed", "new one", ""),
    }


def test_redeliveries_count_by_latest(spark):
    rows = [(1, 1, [("a", "i1")], 0, 0), (2, 1, [("a", "i1")], 1, 5), (2, 1, [("b", "i1")], 1, 4), (2, 1, [("a", "i1")], 1, 5)]
    assert report(spark, rows) == set()


def test_own_name_of_a_quantity_stands_for_itself(spark):
    assert report(spark, [(1, 1, [("height", "f4")], 0, 0), (2, 1, [("hag", "f4")], 1, 0)]) == {(2, "removed", "height", ""), (2, "added", "", "hag")}


def test_null_entries_and_empty_tables(spark):
    assert report(spark, [(1, 1, [(None, "i1"), ("a", None)], 0, 0), (2, 1, [("a", "i2")], 1, 0), (3, None, [("a", "i2")], 2, 0)]) == {(2, "retyped", "a", "a")}
    assert report(spark, []) == set()


def test_names_without_letters(spark):
    assert report(spark, [(1, 1, [("--", "i1")], 0, 0), (2, 1, [("--", "i1"), ("++", "i1")], 1, 0)]) == {(2, "added", "", "++")}


def test_unified_table_and_branches(spark):
    meta = files(spark, [(1, 1, [("Refl", "u2"), ("x y", "f4")], 0, 0), (2, 1, [("intensity", "u4")], 1, 0)])
    samples = spark.createDataFrame(
        [(1, 0, '{"Refl": 7, "x y": "1.5"}'), (1, 0, '{"Refl": 7, "x y": "1.5"}'), (2, 1, '{"intensity": "9", "other": "abc"}'), (2, 2, None), (2, 3, "broken"), (2, 4, "{}")],
        "file_id long, point_no int, payload string",
    )
    got = {(r.file_id, r.point_no): (r.q_intensity, r.q_xy) for r in drift.unified_table(meta, samples, terms(spark)).collect()}
    assert "q_other" in drift.unified_table(meta, samples, terms(spark)).columns
    assert got == {(1, 0): (7, 1.5), (2, 1): (9, None), (2, 2): (None, None), (2, 3): (None, None), (2, 4): (None, None)}
    tags = {(r.quantity, r.tag) for r in drift.tagged_values(samples, terms(spark)).collect()}
    assert tags == {("intensity", "whole"), ("xy", "real"), ("other", "text")}


def test_union_schema_keeps_alternatives(spark):
    s = {r.quantity: r for r in drift.union_schema(files(spark, [(1, 1, [("refl", "u2")], 0, 0), (2, 1, [("intensity", "f4")], 1, 0)]), terms(spark)).collect()}
    assert s["intensity"].canonical == "double" and s["intensity"].spellings == ["intensity", "refl"]
    assert [(a.type, a.first_file) for a in s["intensity"].alternatives] == [("f4", 2), ("u2", 1)]


def test_promotion():
    assert [promoted(t) for t in (["u2", "i2"], ["u4", "f4"], ["i1", "u1"], ["f4"], ["i2", "f4"])] == ["i4", "f8", "i2", "f4", "f4"]


def test_long_series_in_blocks_equals_a_plain_pass(spark, monkeypatch):
    import random

    monkeypatch.setattr(drift, "BLOCK", 4)
    r = random.Random(5)
    names = ["refl", "Intensity", "hag", "z_norm", "q1", "Q1", "q2"]
    meaning = {"refl": "intensity", "intensity": "intensity", "hag": "height", "znorm": "height"}
    rows, want = [], set()
    for series in range(15):
        last = None
        for k in range(r.choice([1, 3, 4, 5, 9, 23])):
            file = series * 100 + k
            fields = None if r.random() < 0.1 else [(r.choice(names), r.choice(["i1", "<i2", "f4"])) for _ in range(r.randrange(5))]
            rows.append((file, series, fields, k, 0))
            if fields is None:
                continue
            now = {}
            for name, kind in fields:
                bare = "".join(c for c in name.lower() if c.isalnum())
                now.setdefault(meaning.get(bare, bare), (name, kind.strip("<")))
            if last is not None:
                for q in set(last) | set(now):
                    if q not in last:
                        want.add((file, "added", "", now[q][0]))
                    elif q not in now:
                        want.add((file, "removed", last[q][0], ""))
                    else:
                        if last[q][0] != now[q][0]:
                            want.add((file, "renamed", last[q][0], now[q][0]))
                        if last[q][1] != now[q][1]:
                            want.add((file, "retyped", last[q][0], now[q][0]))
            last = now
    r.shuffle(rows)
    assert report(spark, rows) == want and len(want) > 100


def test_values_keep_their_digits_and_kinds(spark, monkeypatch):
    monkeypatch.setattr(drift, "WIDTH", 2)
    meta = files(spark, [(1, 1, [("id", "i8"), ("ok", "bool"), ("hash", "u8"), ("mixed", "i4"), ("part", "f8")], 0, 0), (2, 1, [("mixed", "bool")], 1, 0)])
    samples = spark.createDataFrame(
        [
            (1, 0, '{"id": 1234567890123456789, "ok": true, "hash": 18446744073709551615, "mixed": true, "part": 1, "new": 3, "word": "x", "size": 99999999999999999999}'),
            (1, 1, '{"id": "-9223372036854775808", "ok": false, "hash": 0, "mixed": 7.0, "part": true, "new": 2.5, "word": 4, "size": 1}'),
            (1, 2, '{"id": 1.5, "ok": 3, "hash": -1, "mixed": 2.5, "part": "x", "new": null, "word": null, "size": null}'),
        ],
        "file_id long, point_no int, payload string",
    )
    t = drift.unified_table(meta, samples, terms(spark))
    assert dict(t.dtypes) == {"file_id": "bigint", "point_no": "int", "q_id": "bigint", "q_ok": "boolean", "q_hash": "decimal(20,0)", "q_mixed": "bigint", "q_part": "double", "q_new": "double", "q_word": "string", "q_size": "decimal(20,0)"}
    got = {r.point_no: [r[f"q_{c}"] for c in ("id", "ok", "hash", "mixed", "part", "new", "word", "size")] for r in t.collect()}
    assert got == {
        0: [1234567890123456789, True, 18446744073709551615, 1, 1.0, 3.0, "x", 99999999999999999999], 1: [-(2**63), False, 0, 7, 1.0, 2.5, "4", 1], 2: [None, None, -1, None, None, None, None, None],
    }
    tags = {(r.point_no, r.quantity): r.tag for r in drift.tagged_values(samples, terms(spark)).collect()}
    assert tags[0, "hash"] == "big" and tags[0, "ok"] == "flag" and tags[2, "part"] == "text" and tags[2, "new"] == "null"
