"""Queries against the whole of their input, stated apart from the registered SQL."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from stratapoint.plans.problem_sql import P3_POINTS

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{D}/{f}')")
    return c


def run(spark, name, columns, d=D):
    return Counter(tuple(r) for r in entry.queries()[name](spark, d).select(*columns).collect())


POINTS = f"(SELECT file_id, x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y, z::FLOAT::DOUBLE AS z, intensity::FLOAT::DOUBLE AS intensity, classification FROM ({P3_POINTS}))"


def test_xyz_scan_has_all_readable_points(spark, db):
    want = Counter(db.execute(f"SELECT file_id, x, y, z, intensity, classification FROM {POINTS}").fetchall())
    assert run(spark, "xyz_scan", ("file_id", "x", "y", "z", "intensity", "classification")) == want and want.total() > 500


def test_xyz_metadata_counts_all_readable_points(spark, db):
    columns = ("file_id", "n", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z")
    want = db.execute(f"SELECT file_id, count(*), min(x), min(y), min(z), max(x), max(y), max(z) FROM {POINTS} GROUP BY 1").fetchall()
    assert run(spark, "xyz_metadata", columns) == Counter(want)


def test_batch_offsets_lay_out_all_parts(spark):
    larger = D.replace("0.001", "0.01")  # parts of the smallest scale all have small keys
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{larger}/part.parquet')")
    want, till = Counter(), {}
    for key, size in db.execute("SELECT p_partkey, p_size FROM part ORDER BY p_partkey").fetchall():
        t, k, item = key % 50, key // 50, (1, 2, 4, 8)[size % 4]
        at = -(-till.get(t, 0) // item) * item
        length = item * (1 + size % 3) * 3
        till[t] = at + length
        want[t, k, at, length] += 1
    got = run(spark, "batch_offsets", ("t", "k", "byte_offset", "byte_length"), larger)
    assert got == want and got.total() == db.execute("SELECT count(*) FROM part").fetchone()[0]
    stated = Counter(db.execute(entry.oracle_sql()["batch_offsets"]).fetchall())
    assert stated == got
