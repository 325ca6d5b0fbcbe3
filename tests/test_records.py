import math
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stratapoint.operators import records

LAYOUT = "file_id long, separator string, n_columns int, has_header boolean, path string"
LINES = "line_id long, file_id long, line_no int, line string, reason string"


def split(s, sep):
    """Fields of a line by a plain walk over it, or None if its quoting is broken."""
    if sep == " ":
        s = s.strip(" ")
    out, i, n = [], 0, len(s)
    while True:
        while i < n and s[i] == " ":
            i += 1
        if i < n and s[i] == '"':
            i += 1
            buf = ""
            while True:
                j = s.find('"', i)
                if j < 0:
                    return None
                buf += s[i:j]
                i = j + 1
                if i < n and s[i] == '"':
                    buf += '"'
                    i += 1
                    continue
                break
            k = i
            while i < n and s[i] == " ":
                i += 1
            out.append(buf)
            if i == n:
                return out
            if sep == " ":
                if k == i:
                    return None
                continue
            if s[i] != sep:
                return None
            i += 1
        else:
            j = s.find(sep, i)
            j = n if j < 0 else j
            x = s[i:j].rstrip(" ")
            if '"' in x:
                return None
            out.append(x)
            if j == n:
                return out
            i = j + 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet='a1é ",;\t', min_size=0, max_size=300), st.sampled_from([",", ";", " ", "\t"])), min_size=1, max_size=12))
def test_machine_equals_a_plain_walk(rows):
    rows = [(s, sep) for s, sep in rows if s.strip(" ")] or [("a", ",")]
    count, error, first, fields = records.tokenize(pa.array([s for s, _ in rows]), [sep for _, sep in rows])
    for k, (s, sep) in enumerate(rows):
        want = split(s, sep)
        assert (want is None) == (error[k] >= 0)
        if want is not None:
            assert count[k] == len(want)
            assert [f.decode() for f in fields.slice(first[k], count[k]).to_pylist()] == want


def test_composition_over_chunks():
    rng = np.random.default_rng(0)
    classes = rng.integers(0, 6, 5000).astype(np.uint8)
    state, want = records.START, []
    for c in classes:
        state = records.NEXT[c, state]
        want.append(state)
    assert records.run_machine(classes).tolist() == want


def read(spark, lines, layouts):
    df = records.read_records(spark.createDataFrame(lines, LINES), spark.createDataFrame(layouts, LAYOUT))
    return {r["line_id"]: r for r in df.collect()}


def test_reasons_and_points(spark):
    layouts = [(1, ",", 8, True, ""), (2, " ", 9, False, ""), (2, " ", 9, False, ""), (3, None, 8, False, "")]
    lines = [
        (1, 1, 1, "x,y,z,I,R,G,B,class"), (2, 1, 2, "1.,.5,-2e1,+3,0,255,007,+4294967295\r"), (3, 1, 3, '"1",2,3,4,5,6,7,"8'), (4, 1, 4, "1,2,3"), (5, 1, 5, "1e400,2,3,4,5,6,7,8"),
        (6, 1, 6, "1,2,3,4,256,6,-7,8"), (7, 1, 7, " \t\r"), (8, 1, 8, '1,2,3,4,5,6,7"x,8'), (9, 2, 1, '  1 2  3 4 5 6 7 8 "a ""b"" c" '), (10, 2, 2, "1 2 3 nan 5 6 7 8 x"),
        (11, 9, 1, "1,2"), (12, 1, None, None), (13, 3, 1, "1"), (14, 1, 9, "1,2,3,4,5,6,7,4294967296"), (15, 1, 10, "1,2,３,4,5,6,7,8"), (16, 1, 11, ""), (17, 1, 12, "1_0,2,3,4,5,6,7,8"),
    ]
    got = read(spark, [(*x, "clash") for x in lines], layouts)
    reasons = {k: (r["reason"], r["field"]) for k, r in got.items() if r["reason"]}
    assert reasons == {3: ("quoting", ""), 4: ("columns", ""), 5: ("value", "x"), 6: ("value", "R"), 8: ("quoting", ""), 10: ("value", "I"), 14: ("value", "class"), 15: ("value", "z"), 17: ("value", "x")}
    assert set(got) == {2, 9, *reasons}
    p = got[2]
    assert (p["x"], p["y"], p["z"], p["intensity"], p["red"], p["green"], p["blue"], p["classification"]) == (1.0, 0.5, -20.0, 3.0, 0, 255, 7, 4294967295)
    assert got[3]["at"] == len('"1",2,3,4,5,6,7,"8') and got[4]["at"] is None


def test_empty_and_very_long(spark):
    assert read(spark, [], [(1, ",", 8, False, "")]) == {}
    long = ",".join(["1"] * 7) + "," + "0" * 200_000 + "5"
    got = read(spark, [(1, 1, 1, long, ""), (2, 1, 2, '"' + "a" * 300_000, "")], [(1, ",", 8, False, "")])
    assert got[1]["reason"] is None and got[1]["classification"] == 5 and got[2]["reason"] == "quoting" and got[2]["at"] == 300_001


def test_short_layouts(spark):
    got = read(spark, [(1, 1, 1, "1;2;3", "")], [(1, ";", 3, None, "")])
    assert got[1]["reason"] is None and got[1]["z"] == 3 and got[1]["intensity"] is None and not math.isnan(got[1]["x"])
    assert re.fullmatch(records.DECIMAL, "5.") and not re.fullmatch(records.DECIMAL, ".")


def test_numbers_at_the_edges():
    import pyarrow as pa

    from stratapoint.operators import records as R

    texts = ["+1", "-.5", "1.", "007.25", "1e5", "1E-400", "0", "123456789012345678901234567890"]
    assert R._decimals(pa.array(texts, pa.large_string())).tolist() == [float(t) for t in texts]
    assert R._decimals(pa.array([*texts, "1e999", "-1e999"], pa.large_string())).tolist() == [float(t) for t in [*texts, "1e999", "-1e999"]]
    assert R._wholes(pa.array(["0", "000", "+007", "4294967295", "0004294967296", "9" * 40], pa.large_string())).tolist() == [0, 0, 7, 4294967295, 4294967296, 2**62]
