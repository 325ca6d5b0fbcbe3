"""Test tables seen as points, trees and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapoint.session import table

#: All columns of lineitem, in order: they put its rows in arrival order (equal rows are interchangeable).
LI_ARRIVAL = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def pts_li(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.withColumns({"x": F.col("l_quantity"), "y": F.col("l_extendedprice"), "z": F.col("l_discount"), "intensity": F.col("l_tax"), "classification": F.col("l_linenumber"), "file": F.col("l_returnflag")})


def pts_li_n(spark: SparkSession, d: str) -> DataFrame:
    """The same with axes of like size."""
    return pts_li(spark, d).withColumns({"x": F.col("l_quantity") * 2000, "z": F.col("l_discount") * 1e6})


def pts_emb(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", *[F.element_at(e, k + 1).alias(v) for k, v in enumerate("xyz")], F.col("label").alias("classification"))


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as tiles: tile_id, parent_id, value (of customers: the balance), refine."""
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("tile_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("double").alias("value"), F.when(F.col("r_regionkey") % 2 == 0, "ADD").otherwise("REPLACE").alias("refine"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("tile_id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.lit(None).cast("double").alias("value"), F.when(F.col("n_nationkey") % 5 == 0, "ADD").alias("refine"))
    c = table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("tile_id"), (F.col("c_nationkey") + 100).cast("long").alias("parent_id"), F.col("c_acctbal").alias("value"), F.lit(None).cast("string").alias("refine"))
    return r.unionByName(n).unionByName(c)


TREE_SQL = """(SELECT r_regionkey::BIGINT AS tile_id, NULL::BIGINT AS parent_id, NULL::DOUBLE AS value, CASE WHEN r_regionkey % 2 = 0 THEN 'ADD' ELSE 'REPLACE' END AS refine FROM region
 UNION ALL SELECT n_nationkey + 100, n_regionkey::BIGINT, NULL, CASE WHEN n_nationkey % 5 = 0 THEN 'ADD' END FROM nation
 UNION ALL SELECT c_custkey + 1000, (c_nationkey + 100)::BIGINT, c_acctbal, NULL FROM customer)"""

PTS_LI_SQL = "(SELECT l_quantity AS x, l_extendedprice AS y, l_discount AS z, * FROM lineitem)"
PTS_LI_N_SQL = "(SELECT l_quantity * 2000 AS x, l_extendedprice AS y, l_discount * 1e6::DOUBLE AS z, * FROM lineitem)"
PTS_EMB_SQL = "(SELECT vec_id, embedding[1] AS x, embedding[2] AS y, embedding[3] AS z, label FROM embeddings)"


def path_sql(points: str, levels: int, columns: str) -> str:
    """SQL that names each point's node: box halves in double, centres in float, level by level; the shape of the boxes
    (flat or not) is followed per level from the root's."""
    low = ", ".join(f"min({v}::FLOAT)::DOUBLE AS l{v}, CASE WHEN min({v}::FLOAT) = max({v}::FLOAT) THEN min({v}::FLOAT)::DOUBLE + 1e-5 ELSE max({v}::FLOAT)::DOUBLE END AS h{v}" for v in "xyz")
    steps = [f"r0 AS (SELECT {low} FROM {points})", "s0 AS (SELECT lx, ly, lz, hx - lx AS sx, hy - ly AS sy, hz - lz AS sz, (hz - lz) / least(hx - lx, hy - ly) < 0.5 AS flat FROM r0)"]
    steps.append(f"p0 AS (SELECT p.*, '' AS node, s0.lx, s0.ly, s0.lz, sx, sy, sz, flat FROM {points} p, s0)")
    for k in range(levels):
        digit = (
            "(CASE WHEN x::FLOAT >= ((lx + (lx + sx)) * 0.5)::FLOAT THEN 4 ELSE 0 END + CASE WHEN y::FLOAT >= ((ly + (ly + sy)) * 0.5)::FLOAT THEN 2 ELSE 0 END"
            " + CASE WHEN z::FLOAT >= (CASE WHEN flat THEN (lz + sz)::FLOAT ELSE ((lz + (lz + sz)) * 0.5)::FLOAT END) THEN 1 ELSE 0 END)"
        )
        steps.append(f"d{k} AS (SELECT *, {digit} AS digit FROM p{k})")
        steps.append(
            f"""e{k} AS (SELECT * EXCLUDE (node, digit, lx, ly, lz, sx, sy, sz, flat), node || digit::VARCHAR AS node, lx + CASE WHEN digit & 4 > 0 THEN sx * 0.5 ELSE 0 END AS lx, ly + CASE WHEN digit & 2 > 0 THEN sy * 0.5 ELSE 0 END AS ly,
 CASE WHEN NOT flat AND digit & 1 > 0 THEN lz + sz * 0.5 ELSE lz END AS lz, sx / 2 AS sx, sy / 2 AS sy, CASE WHEN flat THEN sz ELSE sz / 2 END AS sz FROM d{k})"""
        )
        steps.append(f"p{k + 1} AS (SELECT *, sz / least(sx, sy) < 0.5 AS flat FROM e{k})")
    return ",\n".join(steps) + f",\nplaced AS (SELECT {columns} FROM p{levels})"


def cell_sql(cells: int = 3) -> str:
    """SQL of the packed grid cell of a placed point."""
    shift = (cells - 1).bit_length()
    parts = []
    for k, v in enumerate("xyz"):
        place = f"{float(cells)}::DOUBLE * (1.0::DOUBLE / s{v}::FLOAT::DOUBLE)::FLOAT::DOUBLE * ({v}::FLOAT - l{v}::FLOAT)::DOUBLE"
        parts.append(f"(least(greatest(trunc({place})::BIGINT, 0), {cells - 1}) << {shift * k})")
    return "(" + " + ".join(parts) + ")::INTEGER"


def _thin_level(k: int) -> list[str]:
    """SQL steps of one level over q{k} (points placed in nodes, with id as their order) and n{k} (the nodes to thin): k{k} tells
    which points are far enough from those kept before them in their cell."""
    near = "len(list_filter(kept, lambda o: (o.x - p.x) * (o.x - p.x) + (o.y - p.y) * (o.y - p.y) + (o.z - p.z) * (o.z - p.z) < spacing * spacing)) > 0"
    return [
        f"c{k} AS MATERIALIZED (SELECT id, node, {cell_sql()} AS cell, x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y, z::FLOAT::DOUBLE AS z FROM q{k} WHERE node IN (SELECT node FROM n{k}))",
        f"r{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY node, cell ORDER BY id) AS rn FROM c{k})",
        f"w{k} AS (SELECT (sqrt(sx * sx + sy * sy + sz * sz) / 125 / {2**k}) AS spacing FROM s0)",
        f"""g{k} AS (SELECT node, cell, rn, id, true AS far, [{{'x': x, 'y': y, 'z': z}}] AS kept FROM r{k} WHERE rn = 1
 UNION ALL SELECT p.node, p.cell, p.rn, p.id, NOT ({near}), CASE WHEN {near} THEN kept ELSE list_append(kept, {{'x': p.x, 'y': p.y, 'z': p.z}}) END
 FROM g{k} g JOIN r{k} p ON p.node = g.node AND p.cell = g.cell AND p.rn = g.rn + 1, w{k})""",
        f"k{k} AS MATERIALIZED (SELECT id, node, far FROM g{k})",
    ]


def _numbered_path(points: str, order: str) -> list[str]:
    return [path_sql(points, 1, "*").replace("p0 AS (SELECT p.*, '' AS node", f"p0 AS (SELECT p.*, row_number() OVER (ORDER BY {order}) AS id, '' AS node"), "q1 AS MATERIALIZED (SELECT * FROM placed)"]


def thin_sql(points: str, key: str, level: int = 1) -> str:
    """SQL of the thinning of all first-level nodes, in order of a unique key: k1 (key, node, far)."""
    steps = [*_numbered_path(points, key), "n1 AS (SELECT DISTINCT node FROM q1)", *_thin_level(level)]
    return "RECURSIVE " + ",\n".join(steps).replace("k1 AS MATERIALIZED (SELECT id, node, far FROM g1)", f"k1 AS MATERIALIZED (SELECT q1.{key}, g1.node, g1.far FROM g1 JOIN q1 USING (id))")


def lod_sql(points: str, arrival: str, capacity: int, levels: int) -> str:
    """SQL that thins points level by level: ``shown`` (the points' columns and node). Within a cell of a node that is split, rows
    are visited one after the other in arrival order by recursion; each is kept if it is no nearer than the spacing to those kept.
    ``levels`` must reach down to where no node is split."""
    steps = _numbered_path(points, arrival)
    shown = []
    for k in range(1, levels + 1):
        steps.append(f"n{k} AS MATERIALIZED (SELECT node FROM q{k} GROUP BY 1 HAVING count(*) >= {capacity})")
        shown.append(f"SELECT id, node FROM q{k} WHERE node NOT IN (SELECT node FROM n{k})")
        if k == levels:
            break
        steps += _thin_level(k)
        shown.append(f"SELECT id, node FROM k{k} WHERE far")
        digit = (
            "(CASE WHEN x::FLOAT >= ((lx + (lx + sx)) * 0.5)::FLOAT THEN 4 ELSE 0 END + CASE WHEN y::FLOAT >= ((ly + (ly + sy)) * 0.5)::FLOAT THEN 2 ELSE 0 END"
            " + CASE WHEN z::FLOAT >= (CASE WHEN flat THEN (lz + sz)::FLOAT ELSE ((lz + (lz + sz)) * 0.5)::FLOAT END) THEN 1 ELSE 0 END)"
        )
        steps.append(f"t{k} AS (SELECT q.*, {digit} AS digit FROM q{k} q WHERE id IN (SELECT id FROM k{k} WHERE NOT far))")
        steps.append(
            f"""u{k} AS (SELECT * EXCLUDE (node, digit, lx, ly, lz, sx, sy, sz, flat), node || digit::VARCHAR AS node, lx + CASE WHEN digit & 4 > 0 THEN sx * 0.5 ELSE 0 END AS lx, ly + CASE WHEN digit & 2 > 0 THEN sy * 0.5 ELSE 0 END AS ly,
 CASE WHEN NOT flat AND digit & 1 > 0 THEN lz + sz * 0.5 ELSE lz END AS lz, sx / 2 AS sx, sy / 2 AS sy, CASE WHEN flat THEN sz ELSE sz / 2 END AS sz FROM t{k})"""
        )
        steps.append(f"q{k + 1} AS MATERIALIZED (SELECT *, sz / least(sx, sy) < 0.5 AS flat FROM u{k})")
    return "RECURSIVE " + ",\n".join(steps) + ",\nnodes_of AS (" + " UNION ALL ".join(shown) + "),\nshown AS MATERIALIZED (SELECT p.*, n.node AS shown_in FROM q1 p JOIN nodes_of n USING (id))"


def prune_sql(levels: int, least: int) -> str:
    """SQL after ``shown``: ``tiles`` (node, level, n), where small nodes below level 1 have given their points to their parents."""
    steps = ["own AS (SELECT shown_in AS node, count(*) AS n FROM shown GROUP BY 1)"]
    for k in range(levels, 0, -1):
        given = "" if k == levels else f" UNION ALL SELECT substr(node, 1, {k}), n FROM a{k + 1} WHERE n < {least}"
        steps.append(f"a{k} AS (SELECT node, sum(n)::BIGINT AS n FROM (SELECT node, n FROM own WHERE length(node) = {k}{given}) GROUP BY 1)")
    left = " UNION ALL ".join(f"SELECT node, {k} AS level, n FROM a{k}" + ("" if k == 1 else f" WHERE n >= {least}") for k in range(1, levels + 1))
    return ",\n".join(steps) + f""",
stay AS ({left}),
up AS (SELECT DISTINCT substr(node, 1, k) AS node FROM stay, range({levels}) r(k) WHERE k < length(node)),
tiles AS (SELECT node, level, n FROM stay UNION ALL SELECT node, length(node), 0 FROM up WHERE node NOT IN (SELECT node FROM stay))"""
