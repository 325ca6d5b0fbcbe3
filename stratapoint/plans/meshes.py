"""Queries on polygons and meshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapoint.operators import mesh
from stratapoint.plans.catalogue import query
from stratapoint.session import table

# One mesh a part: a grid of n by n squares, two triangles each, with heights.
_SIZE = "2 + p_size % 4"


def grid_vertices(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("mesh"), F.expr(_SIZE).cast("long").alias("n"))
    v = p.select("mesh", "n", F.explode(F.expr("sequence(0L, (n + 1) * (n + 1) - 1)")).alias("vertex"))
    i, j = F.expr("vertex div (n + 1)"), F.expr("vertex % (n + 1)")
    return v.select("mesh", "vertex", i.cast("double").alias("x"), j.cast("double").alias("y"), (((i * 7 + j * 13 + F.col("mesh")) % 5) / 10.0).alias("z"))


def grid_faces(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("mesh"), F.expr(_SIZE).cast("long").alias("n"))
    quads = p.select("mesh", "n", F.explode(F.expr("sequence(0L, n * n - 1)")).alias("q")).withColumn("a", F.expr("q div n * (n + 1) + q % n"))
    a, n = F.col("a"), F.col("n")
    both = F.explode(F.array(F.struct(F.lit(0).alias("t"), a.alias("v0"), (a + n + 1).alias("v1"), (a + 1).alias("v2")), F.struct(F.lit(1).alias("t"), (a + 1).alias("v0"), (a + n + 1).alias("v1"), (a + n + 2).alias("v2"))))
    return quads.select("mesh", "q", both.alias("f")).select("mesh", (F.col("q") * 2 + F.col("f.t")).alias("face"), "f.v0", "f.v1", "f.v2")


GRID_SQL = f"""m AS (SELECT p_partkey AS mesh, ({_SIZE})::BIGINT AS n FROM part),
v AS (SELECT mesh, n, id AS vertex, (id // (n + 1))::DOUBLE AS x, (id % (n + 1))::DOUBLE AS y, ((id // (n + 1) * 7 + id % (n + 1) * 13 + mesh) % 5) / 10.0::DOUBLE AS z FROM (SELECT mesh, n, unnest(range((n + 1) * (n + 1))) AS id FROM m)),
q AS (SELECT mesh, n, id, id // n * (n + 1) + id % n AS a FROM (SELECT mesh, n, unnest(range(n * n)) AS id FROM m)),
f AS (SELECT mesh, id * 2 AS face, a AS v0, a + n + 1 AS v1, a + 1 AS v2 FROM q UNION ALL SELECT mesh, id * 2 + 1, a + 1, a + n + 1, a + n + 2 FROM q),
c AS (SELECT f.*, a.x AS x0, a.y AS y0, a.z AS z0, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS wx, c.y - a.y AS wy, c.z - a.z AS wz
 FROM f JOIN v a ON a.mesh = f.mesh AND a.vertex = v0 JOIN v b ON b.mesh = f.mesh AND b.vertex = v1 JOIN v c ON c.mesh = f.mesh AND c.vertex = v2),
k AS (SELECT *, uy * wz - uz * wy AS cx, uz * wx - ux * wz AS cy, ux * wy - uy * wx AS cz FROM c),
n AS (SELECT *, cx / sqrt(cx * cx + cy * cy + cz * cz) AS nx, cy / sqrt(cx * cx + cy * cy + cz * cz) AS ny, cz / sqrt(cx * cx + cy * cy + cz * cz) AS nz FROM k),
p AS (SELECT *, -(nx * x0 + ny * y0 + nz * z0) AS d FROM n),
i AS (SELECT mesh, v0 AS vertex, face, nx, ny, nz, d FROM p UNION ALL SELECT mesh, v1, face, nx, ny, nz, d FROM p UNION ALL SELECT mesh, v2, face, nx, ny, nz, d FROM p)"""


@query(f"""WITH {GRID_SQL} SELECT mesh, vertex, round(sum(nx * nx), 5) AS q0, round(sum(nx * ny), 5) + 0.0 AS q1, round(sum(ny * ny), 5) AS q4, round(sum(nz * nz), 5) AS q7, round(sum(d * d), 4) AS q9,
 round(sum((nx * (x + 1) + ny * y + nz * z + d) * (nx * (x + 1) + ny * y + nz * z + d)), 4) AS error FROM i JOIN v USING (mesh, vertex) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY mesh, vertex"))
def quadric_sum(spark: SparkSession, d: str) -> DataFrame:
    """Quadrics of the meshes' vertices, and the error of moving each by one along x."""
    q = mesh.vertex_quadrics(grid_faces(spark, d), grid_vertices(spark, d), with_points=True)
    e = mesh.quadric_error(q.withColumn("x", F.col("x") + 1))
    return e.select("mesh", "vertex", *[(F.round(c, 5) + 0.0).alias(c) for c in ("q0", "q1", "q4", "q7")], F.round("q9", 4).alias("q9"), F.round("error", 4).alias("error"))


@query(f"WITH {GRID_SQL} SELECT mesh, vertex FROM v WHERE x IN (0, n) OR y IN (0, n)")
def border_vertices(spark: SparkSession, d: str) -> DataFrame:
    return mesh.border_vertices(grid_faces(spark, d))


@query(f"WITH {GRID_SQL} SELECT a.mesh, a.vertex, round(max((1 - (a.nx * b.nx + a.ny * b.ny + a.nz * b.nz)) / 2), 6) + 0.0 AS curvature FROM i a JOIN i b ON a.mesh = b.mesh AND a.vertex = b.vertex GROUP BY a.mesh, a.vertex")
def vertex_curvature(spark: SparkSession, d: str) -> DataFrame:
    return mesh.vertex_curvature(grid_faces(spark, d), grid_vertices(spark, d)).withColumn("curvature", F.round("curvature", 6) + 0.0)


@query(f"WITH {GRID_SQL} SELECT mesh, vertex, count(*) AS faces, min(face) AS first_face FROM i GROUP BY 1, 2")
def vertex_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return mesh.incidences(grid_faces(spark, d)).groupBy("mesh", "vertex").agg(F.count(F.lit(1)).alias("faces"), F.min("face").alias("first_face"))


@query(f"WITH {GRID_SQL} SELECT a.mesh, a.vertex AS a, b.vertex AS b FROM v a JOIN v b ON a.mesh = b.mesh AND a.vertex < b.vertex WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 1.05")
def near_vertices(spark: SparkSession, d: str) -> DataFrame:
    return mesh.near_pairs(grid_vertices(spark, d), 1.05**0.5)


_TRIPLES = """t AS (SELECT l_orderkey AS g, min(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS ax, min(CASE WHEN l_linenumber = 1 THEN l_tax * 100 END) AS ay, min(CASE WHEN l_linenumber = 1 THEN l_discount * 100 END) AS az,
 min(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS bx, min(CASE WHEN l_linenumber = 2 THEN l_tax * 100 END) AS by_, min(CASE WHEN l_linenumber = 2 THEN l_discount * 100 END) AS bz,
 min(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS cx, min(CASE WHEN l_linenumber = 3 THEN l_tax * 100 END) AS cy, min(CASE WHEN l_linenumber = 3 THEN l_discount * 100 END) AS cz FROM lineitem GROUP BY 1),
w AS (SELECT * FROM t WHERE ax IS NOT NULL AND bx IS NOT NULL AND cx IS NOT NULL)"""


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """Triangles of the first three lines of each order."""
    t = table(spark, d, "lineitem")
    of = lambda k, c: F.min(F.when(F.col("l_linenumber") == k, c))
    parts = []
    for k, name in enumerate("abc", 1):
        parts += [of(k, F.col("l_quantity")).alias(f"{name}x"), of(k, F.col("l_tax") * 100).alias(f"{name}y"), of(k, F.col("l_discount") * 100).alias(f"{name}z")]
    g = t.groupBy(F.col("l_orderkey").alias("g")).agg(*parts).where("ax is not null and bx is not null and cx is not null")
    return g.select("g", *[F.struct(*[F.col(f"{n}{v}").alias(v) for v in "xyz"]).alias(n) for n in "abc"])


@query(f"""WITH {_TRIPLES}, n AS (SELECT g, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM w),
l AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS s FROM n) SELECT g, round(CASE WHEN s = 0 THEN 0 ELSE nx / s END, 6) + 0.0 AS nx, round(CASE WHEN s = 0 THEN 0 ELSE ny / s END, 6) + 0.0 AS ny, round(CASE WHEN s = 0 THEN 1 ELSE nz / s END, 6) + 0.0 AS nz FROM l WHERE s = 0 OR s > 1e-6""")
def triangle_normals(spark: SparkSession, d: str) -> DataFrame:
    n = mesh.normals(_triples(spark, d))
    size = F.sqrt(sum((c * c for c in G_cross()), F.lit(0.0)))
    return n.withColumn("s", size).where("s = 0 or s > 1e-6").select("g", *[(F.round(c, 6) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


def G_cross():  # noqa: ANN201, N802
    from stratapoint.functions.geometry import cross

    e = lambda k: [F.col(f"{k}.{v}") - F.col(f"a.{v}") for v in "xyz"]
    return cross(e("b"), e("c"))


@query("""WITH c AS (SELECT l_returnflag, l_quantity AS x, l_tax AS y, l_discount AS z FROM lineitem), u AS (SELECT DISTINCT * FROM c)
SELECT l_returnflag, x, y, z, (dense_rank() OVER (PARTITION BY l_returnflag ORDER BY x, y, z) - 1)::INTEGER AS vertex FROM u""")
def vertex_dense_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"), F.col("l_discount").alias("z"))
    return mesh.dense_vertices(c, "l_returnflag")


def _polygons(spark: SparkSession, d: str) -> DataFrame:
    """A star around each part: ten points whose radius alternates, with a square hole for even parts."""
    from stratapoint.sources import wkb

    parts = table(spark, d, "part").select(F.col("p_partkey").alias("geom_id"), F.col("p_size").cast("double").alias("r"))

    def make(batches):  # noqa: ANN001, ANN202
        import math

        for batch in batches:
            out = []
            for g, r in zip(batch["geom_id"], batch["r"], strict=True):
                ring = [((r + 4) * (1 + k % 2) * math.cos(k * math.pi / 5), (r + 4) * (1 + k % 2) * math.sin(k * math.pi / 5), float(g % 7)) for k in range(10)]
                rings = [ring, [(-1.0, -1.0, float(g % 7)), (-1.0, 1.0, float(g % 7)), (1.0, 1.0, float(g % 7)), (1.0, -1.0, float(g % 7))]] if g % 2 == 0 else [ring]
                out.append(wkb.write([rings], "<" if g % 3 else ">"))
            yield batch.assign(wkb=out)[["geom_id", "wkb"]]

    return wkb.points(parts.mapInPandas(make, "geom_id long, wkb binary"))


@query("""SELECT p_partkey AS geom_id, round(2 * 10 * 0.5 * (p_size + 4) * (p_size + 4) * 2 * sin(pi() / 5) / 2 - CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 0 END, 1) AS area FROM part""")
def triangulate_area(spark: SparkSession, d: str) -> DataFrame:
    """Summed area of the triangles of each polygon: that of its ring less its hole."""
    t = mesh.triangles_of(_polygons(spark, d))
    at = lambda c, v: F.max(F.when(F.col("corner") == c, F.col(v).cast("double")))
    g = t.groupBy("geom_id", "polygon", "triangle").agg(*[at(c, v).alias(f"{v}{c}") for c in range(3) for v in "xy"])
    size = F.abs((F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0"))) / 2
    return g.groupBy("geom_id").agg(F.round(F.sum(size), 1).alias("area"))


@query("""SELECT p_partkey AS geom_id, 0 AS ring, round(2 * 10 * (p_size + 4) * (p_size + 4) * sin(pi() / 5), 1) AS az, 'xy' AS plane FROM part UNION ALL SELECT p_partkey, 1, -8.0, 'xy' FROM part WHERE p_partkey % 2 = 0""")
def polygon_area_vector(spark: SparkSession, d: str) -> DataFrame:
    return mesh.ring_area_vectors(_polygons(spark, d)).select("geom_id", "ring", F.round("az", 1).alias("az"), "plane")


# A flat square without loss: four triangles from its corners to one point inside, whatever it was cut into.
@query(f"SELECT p_partkey AS mesh, 4 AS n_faces, 5 AS n_points, round(pow({_SIZE}, 2), 3) AS area FROM part")
def simplify_lossless(spark: SparkSession, d: str) -> DataFrame:
    """Flat meshes, reduced as far as no error arises."""
    s = mesh.simplify(_meshes(grid_vertices(spark, d).withColumn("z", F.lit(0.0)), grid_faces(spark, d)), 0.0, lossless=True)
    return s.select("mesh", F.size("faces").alias("n_faces"), F.size("points").alias("n_points"), F.round(_area(), 3).alias("area"))


def _area() -> Column:
    """Area, seen from above, of a row's triangles (points, faces)."""
    at = lambda f, k, axis: f"element_at(element_at(points, {f}[{k}] + 1), {axis})"
    side = lambda k, axis: f"({at('f', k, axis)} - {at('f', 0, axis)})"
    return F.expr(f"aggregate(faces, 0D, (s, f) -> s + abs({side(1, 1)} * {side(2, 2)} - {side(1, 2)} * {side(2, 1)}) / 2)")


def _meshes(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    v = vertices.groupBy("mesh").agg(F.array_sort(F.collect_list(F.struct("vertex", F.array("x", "y", "z").alias("p")))).alias("v"))
    f = faces.groupBy("mesh").agg(F.array_sort(F.collect_list(F.struct("face", F.array(*[F.col(c).cast("int") for c in ("v0", "v1", "v2")]).alias("f")))).alias("f"))
    return v.join(f, "mesh").select("mesh", F.col("v.p").alias("points"), F.col("f.f").alias("faces"))


# Half of the triangles, or as many as are left when all points inside but one are gone; points follow from Euler's formula.
@query(f"""WITH m AS (SELECT p_partkey AS mesh, ({_SIZE})::BIGINT AS n FROM part), c AS (SELECT *, greatest(n * n // 2 * 2, 2 * n * n - 2 * ((n - 1) * (n - 1) - 1)) AS n_faces FROM m)
SELECT mesh, n_faces::INTEGER AS n_faces, ((n_faces + 4 * n + 2) // 2)::INTEGER AS n_points, round(n * n::DOUBLE, 3) AS area FROM c""")
def simplify_mesh(spark: SparkSession, d: str) -> DataFrame:
    """Each mesh at about half of its triangles with its border kept; seen from above it covers what it covered."""
    s = mesh.simplify(_meshes(grid_vertices(spark, d), grid_faces(spark, d)), 0.5, mesh.Options(preserve_border=True))
    return s.select("mesh", F.size("faces").alias("n_faces"), F.size("points").alias("n_points"), F.round(_area(), 3).alias("area"))
