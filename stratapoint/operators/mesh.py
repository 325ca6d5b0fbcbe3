"""Triangles, polygons and meshes: triangulation, vertex tables, quadrics and decimation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapoint.functions import geometry as G
from stratapoint.session import BROADCAST_ROWS, cut_lineage, join_dimension, numbered, spread

# ---- polygons ----


def area_vector(ring: np.ndarray) -> np.ndarray:
    """Twice the area of a ring seen along each axis; its direction is the ring's normal (counter-clockwise is positive)."""
    return np.cross(ring, np.roll(ring, -1, axis=0)).sum(axis=0)


def _flat(rings: list[np.ndarray], normal: np.ndarray) -> list[np.ndarray]:
    """Rings in the plane in which the polygon is largest; equal areas go to x and y, then to x and z."""
    a = np.abs(normal)
    axes = (1, 2) if a[0] > a[1] and a[0] > a[2] else (0, 2) if a[1] > a[2] else (0, 1)
    return [r[:, axes] for r in rings]


def _area2(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())


def _turn(a: Sequence[float], b: Sequence[float], c: Sequence[float]) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _bridge(outer: list[int], hole: list[int], pts: list[tuple[float, float]]) -> list[int]:
    """One ring of two: the hole's rightmost point is tied to a point of the ring that sees it."""
    h = max(range(len(hole)), key=lambda k: pts[hole[k]])
    hole = hole[h:] + hole[:h]
    p = pts[hole[0]]
    best, best_x = None, math.inf
    for k, i in enumerate(outer):
        a, b = pts[i], pts[outer[(k + 1) % len(outer)]]
        if (a[1] <= p[1] <= b[1] or b[1] <= p[1] <= a[1]) and a[1] != b[1]:
            x = a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1])
            if p[0] <= x < best_x:
                best_x, best = x, k if a[0] > b[0] else (k + 1) % len(outer)
    if best is None:
        best = min(range(len(outer)), key=lambda k: math.dist(pts[outer[k]], p))
    else:  # a reflex point inside the triangle to the seen edge hides its end: take the one of least angle
        m = pts[outer[best]]
        hit = (best_x, p[1])
        inside = [k for k, i in enumerate(outer) if pts[i] != m and pts[i][0] >= p[0] and _in_triangle(pts[i], p, hit, m)]
        if inside:
            best = min(inside, key=lambda k: (abs(pts[outer[k]][1] - p[1]) / (pts[outer[k]][0] - p[0] + 1e-300), math.dist(pts[outer[k]], p)))
    n = len(outer)
    same = [k for k in range(n) if pts[outer[k]] == pts[outer[best]]]  # bridges repeat points: take the copy that faces the hole
    best = next((k for k in same if _within(pts[outer[k - 1]], pts[outer[k]], pts[outer[(k + 1) % n]], p)), best)
    return outer[: best + 1] + hole + [hole[0]] + outer[best:]


def _in_triangle(q: tuple, a: tuple, b: tuple, c: tuple) -> bool:
    d1, d2, d3 = _turn(a, b, q), _turn(b, c, q), _turn(c, a, q)
    return (d1 >= 0 and d2 >= 0 and d3 >= 0) or (d1 <= 0 and d2 <= 0 and d3 <= 0)


def _ear(ring: list[int], pts: list[tuple[float, float]]) -> int:
    """The place of an ear: convex, with no other point inside; else of a point on a straight line; else (crossing sides) of
    any convex point, or the first."""
    n = len(ring)
    p = [pts[i] for i in ring]
    turns = [_turn(p[k - 1], p[k], p[(k + 1) % n]) for k in range(n)]
    inward = [q for q, t in zip(p, turns, strict=True) if t <= 0]  # only these can lie in an ear
    convex = None
    for k, t in enumerate(turns):
        if t > 0:
            convex = k if convex is None else convex
            a, b, c = p[k - 1], p[k], p[(k + 1) % n]
            if not any(_in_triangle(q, a, b, c) for q in inward if q not in (a, b, c)):
                return k
    straight = next((k for k, t in enumerate(turns) if t == 0), None)
    return straight if straight is not None else convex if convex is not None else 0


def _within(before: tuple, at: tuple, after: tuple, p: tuple) -> bool:
    """Whether p lies in the ring's inner angle at a point."""
    left, right = _turn(before, at, p) >= 0, _turn(at, after, p) >= 0
    return (left and right) if _turn(before, at, after) >= 0 else (left or right)


def triangulate_indices(rings: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(points, triangles): the rings' points in a row, and indices of triangles turned as the outer ring is.

    Ears are cut off the outer ring with its holes tied in. A ring of fewer than three points gives none.
    """
    points = np.concatenate([np.asarray(r, float).reshape(-1, len(r[0]) if len(r) else 3) for r in rings]) if rings else np.empty((0, 3))
    if points.shape[1] == 2:
        points = np.column_stack([points, np.zeros(len(points))])
    if not rings or len(rings[0]) < 3:
        return points, np.empty((0, 3), int)
    bounds = np.cumsum([0, *[len(r) for r in rings]])
    normal = area_vector(points[: bounds[1]] - points[0])
    flat = np.concatenate(_flat([points], normal))
    pts = [tuple(p) for p in flat.tolist()]
    ring = list(range(bounds[1]))
    if _area2(flat[: bounds[1]]) < 0:
        ring.reverse()
    holes = []
    for a, b in zip(bounds[1:-1], bounds[2:], strict=True):
        h = list(range(a, b))
        if len(h) >= 3:
            holes.append(h[::-1] if _area2(flat[a:b]) > 0 else h)
    for h in sorted(holes, key=lambda h: -max(pts[i][0] for i in h)):
        ring = _bridge(ring, h, pts)
    out = []
    while len(ring) > 3:
        k = _ear(ring, pts)
        a, b, c = ring[k - 1], ring[k], ring[(k + 1) % len(ring)]
        if _turn(pts[a], pts[b], pts[c]) != 0:
            out.append((a, b, c))
        del ring[k]
    if len(ring) == 3:
        out.append(tuple(ring))
    tri = np.array(out, int).reshape(-1, 3)
    if len(tri):
        p = points[tri]
        wrong = (np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]) @ normal) < 0
        tri[wrong] = tri[wrong][:, [1, 0, 2]]
    return points, tri


def triangulate(rings: Sequence[np.ndarray]) -> np.ndarray:
    """Triangles (n, 3, 3) of a polygon with holes."""
    points, tri = triangulate_indices(rings)
    return points[tri]


def triangles_of(points: DataFrame) -> DataFrame:
    """points: geom_id, polygon, ring, point, x, y, z. geom_id, polygon, triangle, corner, x, y, z.

    A polygon's points are gathered in a row (as many as its own source row held), in order, and cut by an Arrow function.
    """
    rings = spread(points, "geom_id", "polygon").groupBy("geom_id", "polygon").agg(F.array_sort(F.collect_list(F.struct("ring", "point", "x", "y", "z"))).alias("p"))
    schema = "geom_id long, polygon int, triangle int, corner int, x float, y float, z float"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for g, a, p in zip(batch["geom_id"], batch["polygon"], batch["p"], strict=True):
                by: dict[int, list] = {}
                for q in p:
                    by.setdefault(q["ring"], []).append((q["x"], q["y"], q["z"]))
                for t, tri in enumerate(triangulate([np.array(by[k]) for k in sorted(by)])):
                    rows += [(g, a, t, c, *map(float, v)) for c, v in enumerate(tri)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return rings.mapInPandas(cut, schema)


def ring_area_vectors(points: DataFrame) -> DataFrame:
    """Area vector of each ring and the plane it is largest in: geom_id, polygon, ring, ax, ay, az, plane. All in expressions."""
    g = points.groupBy("geom_id", "polygon", "ring").agg(F.array_sort(F.collect_list(F.struct("point", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z")))).alias("p"))

    def total(a: str, b: str) -> str:
        nxt = "element_at(p, if(i = size(p), 1, i + 1))"
        return f"aggregate(sequence(1, size(p)), 0D, (s, i) -> s + element_at(p, i).{a} * {nxt}.{b} - element_at(p, i).{b} * {nxt}.{a})"

    v = g.select("geom_id", "polygon", "ring", F.expr(total("y", "z")).alias("ax"), F.expr(total("z", "x")).alias("ay"), F.expr(total("x", "y")).alias("az"))
    ax, ay, az = F.abs("ax"), F.abs("ay"), F.abs("az")
    return v.withColumn("plane", F.when((ax > ay) & (ax > az), "yz").when(ay > az, "zx").otherwise("xy"))


# ---- triangle tables: geom_id, tri, corners a, b, c as structs of x, y, z ----


def normals(triangles: DataFrame) -> DataFrame:
    p = [[F.col(f"{k}.{v}").cast("double") for v in "xyz"] for k in "abc"]
    return triangles.withColumns(dict(zip(("nx", "ny", "nz"), G.triangle_normal(p), strict=True)))


def dense_vertices(corners: DataFrame, key: str) -> DataFrame:
    """corners: key, x, y, z. The number of each distinct vertex in its mesh, from 0 in order of x, y, z: key, x, y, z, vertex.

    Duplicates are dropped before the shuffle; all vertices are numbered in ranges of their order, so a mesh of very many
    is no single task's, and each mesh's numbers are moved to begin at 0. Corners without a key are left out.
    """
    distinct = corners.where(F.col(key).isNotNull()).select(key, "x", "y", "z").distinct()
    placed = numbered(distinct, "_at", key, "x", "y", "z")
    starts = placed.groupBy(key).agg(F.min("_at").alias("_start"))
    return join_dimension(placed, starts, key).select(key, "x", "y", "z", (F.col("_at") - F.col("_start")).cast("int").alias("vertex"))


def incidences(faces: DataFrame) -> DataFrame:
    """faces: mesh, face, v0, v1, v2. Each vertex with each face it is a corner of."""
    return faces.select("mesh", "face", F.explode(F.array("v0", "v1", "v2")).alias("vertex"))


def border_vertices(faces: DataFrame) -> DataFrame:
    """Vertices with a neighbour that only one of their faces shares: mesh, vertex."""
    pairs = faces.select("mesh", F.explode(F.array(*[F.struct(F.col(a).alias("v"), F.col(b).alias("w")) for a, b in (("v0", "v1"), ("v0", "v2"), ("v1", "v0"), ("v1", "v2"), ("v2", "v0"), ("v2", "v1"))])).alias("p"))
    return pairs.groupBy("mesh", "p.v", "p.w").count().where("count = 1").select("mesh", F.col("v").alias("vertex")).distinct()


def _with_points(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with their corners' x, y, z. Never by broadcast: the planner takes rows that were exploded for as few as before."""
    out = faces
    for k in range(3):
        side = vertices.select(F.col("mesh").alias("_m"), F.col("vertex").alias("_v"), *[F.col(v).alias(f"{v}{k}") for v in "xyz"])
        out = out.join(side.hint("merge"), (F.col("mesh") == F.col("_m")) & (F.col(f"v{k}") == F.col("_v"))).drop("_m", "_v")
    return out


def face_planes(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Each face's unit normal and plane offset: mesh, face, v0..v2, nx, ny, nz, d."""
    p = _with_points(faces, vertices)
    n = G.triangle_normal([[F.col(f"{v}{k}") for v in "xyz"] for k in range(3)])
    p = p.withColumns(dict(zip(("nx", "ny", "nz"), n, strict=True)))
    return p.withColumn("d", -(F.col("nx") * F.col("x0") + F.col("ny") * F.col("y0") + F.col("nz") * F.col("z0"))).select("mesh", "face", "v0", "v1", "v2", "nx", "ny", "nz", "d")


#: Rows (faces and vertices) up to which a mesh is worked on in one piece; larger ones are joined row by row.
MESH_ROWS = 100_000
#: Rows of whole meshes that one call of NumPy works on, and those of one task.
_CALL_ROWS, _TASK_ROWS = 100_000, 1_000_000
_KEYS, _IDS = ("tinyint", "smallint", "int", "bigint", "string"), ("tinyint", "smallint", "int", "bigint")


def _by_mesh(faces: DataFrame, vertices: DataFrame, work: Callable[[np.ndarray, np.ndarray, int], dict[str, np.ndarray]], names: Sequence[str], joined: Callable[[DataFrame, DataFrame], DataFrame], with_points: bool = False) -> DataFrame:
    """mesh, vertex and the doubles ``names`` of each vertex of a face, by ``work`` on whole meshes and by ``joined`` on the rest;
    ``with_points``: x, y, z of each vertex as well.

    Faces and vertices meet in one shuffle by mesh. ``work`` gets the points of the corners of some meshes' faces (n, 3, 3), the
    places of their vertices (n, 3) and the number of places, and returns values by place. Meshes beyond ``MESH_ROWS``, with
    missing coordinates, or with keys of other types are left to ``joined``; as in a join, faces without all their vertices
    count for nothing and repeated vertices repeat their faces.
    """
    kinds = dict(vertices.dtypes) | dict(faces.dtypes)
    if kinds["mesh"] not in _KEYS or dict(vertices.dtypes)["mesh"] != kinds["mesh"] or any(kinds[c] not in _IDS for c in ("vertex", "v0", "v1", "v2")):
        return joined(faces, vertices)
    v = vertices.where("mesh is not null and vertex is not null").select("mesh", F.col("vertex").cast("long").alias("v0"), *[F.lit(None).cast("long").alias(c) for c in ("v1", "v2")], *[F.col(c).cast("double").alias(c) for c in "xyz"])
    f = faces.where("mesh is not null and v0 is not null and v1 is not null and v2 is not null").select("mesh", *[F.col(c).cast("long").alias(c) for c in ("v0", "v1", "v2")], *[F.lit(None).cast("double").alias(c) for c in "xyz"])
    rows = v.unionByName(f)
    sizes = rows.groupBy("mesh").agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("v1 is null and (x is null or y is null or z is null)")).alias("holes"))
    apart = F.expr(f"n > {MESH_ROWS} or holes")
    n, n_apart = sizes.agg(F.sum("n"), F.count_if(apart)).first()
    rest = None
    if n_apart:
        keys = cut_lineage(sizes.where(apart).select("mesh"))
        keys = F.broadcast(keys) if n_apart <= BROADCAST_ROWS else keys.hint("merge")
        rows, rest = rows.join(keys, "mesh", "left_anti"), joined(faces.join(keys, "mesh", "left_semi"), vertices.join(keys, "mesh", "left_semi"))
    kind = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kinds["mesh"]]

    def solve(t: pa.Table) -> pa.RecordBatch:
        mesh, a = t.column("mesh").combine_chunks(), t.column("v0").to_numpy()
        starts = np.concatenate([[0], 1 + np.nonzero(pc.not_equal(mesh.slice(1), mesh.slice(0, len(mesh) - 1)).to_numpy(zero_copy_only=False))[0]])
        at = np.repeat(np.arange(len(starts)), np.diff([*starts, len(mesh)]))
        is_face = t.column("v1").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        order = np.nonzero(~is_face)[0]
        order = order[np.lexsort((a[order], at[order]))]
        points = np.column_stack([t.column(c).to_numpy()[order] for c in "xyz"])
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(at[order]) != 0) | (np.diff(a[order]) != 0)
        place = np.cumsum(new) - 1  # vertices of one number share a place
        first = np.append(np.nonzero(new)[0], len(order))
        key_at, key_v = at[order][new], a[order][new]
        of, ids = at[is_face], np.column_stack([t.column(c).combine_chunks().filter(pa.array(is_face)).to_numpy() for c in ("v0", "v1", "v2")])
        places, there = np.zeros(ids.shape, np.int64), np.ones(len(ids), bool)
        numbers, coded = np.unique(np.concatenate([key_v, ids.ravel()]), return_inverse=True)
        keys, wanted = key_at * len(numbers) + coded[: len(key_v)], of[:, None] * len(numbers) + coded[len(key_v) :].reshape(ids.shape)
        if len(keys):
            places = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            there = (keys[places] == wanted).all(axis=1)
        else:
            there[:] = False
        places = places[there]
        corners = first[places] if len(places) else np.empty((0, 3), np.int64)
        for k in range(3) if len(first) - 1 < len(order) else ():
            times = (first[1:] - first[:-1])[places[:, k]]
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            places, corners = np.repeat(places, times, axis=0), np.repeat(corners, times, axis=0)
            corners[:, k] += step
        out = work(points[corners], places, len(key_v))
        used = np.zeros(len(key_v), bool)
        used[places.ravel()] = True
        rows = np.nonzero(used[place])[0] if with_points else first[:-1][used]
        to = place[rows]
        found = {c: pa.array(out[c][to]) for c in names} | {c: pa.array(points[rows, k]) for k, c in enumerate("xyz") if with_points}
        return pa.RecordBatch.from_arrays([mesh.take(pa.array(starts[key_at[to]])), pa.array(key_v[to]), *found.values()], ["mesh", "vertex", *found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        due = _CALL_ROWS
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < due:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            mesh = t.column("mesh").combine_chunks()
            ends = np.nonzero(pc.not_equal(mesh.slice(1), mesh.slice(0, len(mesh) - 1)).to_numpy(zero_copy_only=False))[0]
            if not len(ends):
                due += _CALL_ROWS
                continue
            cut = int(ends[-1]) + 1
            yield solve(t.slice(0, cut))
            held, due = t.slice(cut).to_batches(), _CALL_ROWS
        if held and sum(b.num_rows for b in held):
            yield solve(pa.Table.from_batches(held).combine_chunks())

    names_out = [*names, *("xyz" if with_points else "")]
    parts = max(int(faces.sparkSession.conf.get("spark.sql.shuffle.partitions")), (n or 0) // _TASK_ROWS)
    out = rows.repartition(parts, "mesh").sortWithinPartitions("mesh").mapInArrow(run, f"mesh {kinds['mesh']}, vertex long, " + ", ".join(f"{c} double" for c in names_out))
    out = out.withColumn("vertex", F.col("vertex").cast(kinds["v0"]))
    return out if rest is None else out.unionByName(rest.select("mesh", F.col("vertex").cast(kinds["v0"]).alias("vertex"), *[F.col(c).cast("double").alias(c) for c in names_out]))


def _planes(corners: np.ndarray) -> np.ndarray:
    """Unit normals and plane offsets (n, 4) of triangles (n, 3, 3); (0, 0, 1) is the normal of one without area."""
    u, w = corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]
    n = np.column_stack([u[:, 1] * w[:, 2] - u[:, 2] * w[:, 1], u[:, 2] * w[:, 0] - u[:, 0] * w[:, 2], u[:, 0] * w[:, 1] - u[:, 1] * w[:, 0]])
    size = np.sqrt((n * n).sum(axis=1))
    flat = size == 0
    n[flat], size[flat] = (0.0, 0.0, 1.0), 1.0
    n /= size[:, None]
    return np.column_stack([n, -(n * corners[:, 0]).sum(axis=1)])


_TERMS = [(i, j) for i in range(4) for j in range(i, 4)]


def vertex_quadrics(faces: DataFrame, vertices: DataFrame, with_points: bool = False) -> DataFrame:
    """Sum over a vertex's faces of the ten coefficients of their squared plane distance: mesh, vertex, q0..q9 (and x, y, z)."""

    def work(corners: np.ndarray, places: np.ndarray, n: int) -> dict[str, np.ndarray]:
        p = _planes(corners)
        at = places.ravel()
        return {f"q{k}": np.bincount(at, np.repeat(p[:, i] * p[:, j], 3), n) for k, (i, j) in enumerate(_TERMS)}

    def joined(faces: DataFrame, vertices: DataFrame) -> DataFrame:
        planes = face_planes(faces, vertices)
        names = ("nx", "ny", "nz", "d")
        terms = [F.col(names[i]) * F.col(names[j]) for i, j in _TERMS]
        each = planes.select("mesh", *[t.alias(f"q{k}") for k, t in enumerate(terms)], F.explode(F.array("v0", "v1", "v2")).alias("vertex"))
        q = each.groupBy("mesh", "vertex").agg(*[F.sum(f"q{k}").alias(f"q{k}") for k in range(10)])
        return q.join(vertices.select("mesh", "vertex", "x", "y", "z").hint("merge"), ["mesh", "vertex"]) if with_points else q

    return _by_mesh(faces, vertices, work, [f"q{k}" for k in range(10)], joined, with_points)


def quadric_error(q: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Squared distance of (x, y, z) to the planes summed in q0..q9."""
    c = [F.col(x), F.col(y), F.col(z), F.lit(1.0)]
    total, k = F.lit(0.0), 0
    for i in range(4):
        for j in range(i, 4):
            total = total + F.col(f"q{k}") * c[i] * c[j] * (1.0 if i == j else 2.0)
            k += 1
    return q.withColumn("error", total)


def vertex_curvature(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Largest (1 - n·m)/2 over pairs of a vertex's faces: mesh, vertex, curvature. A vertex of one face has 0.

    Equal normals of a vertex count once, so the pairs grow with the directions around it, not with its faces.
    """

    def work(corners: np.ndarray, places: np.ndarray, n: int) -> dict[str, np.ndarray]:
        return {"curvature": (1 - _least_products(np.repeat(_planes(corners)[:, :3], 3, axis=0), places.ravel(), n)) / 2}

    def joined(faces: DataFrame, vertices: DataFrame) -> DataFrame:
        planes = face_planes(faces, vertices).select("mesh", "nx", "ny", "nz", F.explode(F.array("v0", "v1", "v2")).alias("vertex")).distinct()
        other = planes.select(F.col("mesh").alias("_m"), F.col("vertex").alias("_v"), *[F.col(c).alias(f"_{c}") for c in ("nx", "ny", "nz")])
        both = planes.join(other.hint("merge"), (F.col("mesh") == F.col("_m")) & (F.col("vertex") == F.col("_v")))
        bend = (1 - (F.col("nx") * F.col("_nx") + F.col("ny") * F.col("_ny") + F.col("nz") * F.col("_nz"))) / 2
        return both.groupBy("mesh", "vertex").agg(F.max(bend).alias("curvature"))

    return _by_mesh(faces, vertices, work, ["curvature"], joined)


def _least_products(normals: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The least product of two normals (or of one with itself) at each of n places; infinite where there is none."""
    order = np.argsort(at, kind="stable")
    m, counts = normals[order], np.bincount(at, minlength=n)
    starts = np.cumsum(counts) - counts
    least = np.full(n, np.inf)
    for k in np.nonzero(counts > 32)[0]:
        own = np.unique(m[starts[k] : starts[k] + counts[k]], axis=0)
        least[k] = min((own[i : i + 1000] @ own.T).min() for i in range(0, len(own), 1000))
    for c in np.unique(counts[(counts > 0) & (counts <= 32)]):  # places of as many faces at once
        some = np.nonzero(counts == c)[0]
        for part in np.array_split(some, max(1, len(some) * int(c) // 1_000_000)):
            own = m[starts[part][:, None] + np.arange(c)]
            best = np.full(len(part), np.inf)
            for i in range(c):
                best = np.minimum(best, (own[:, i:] * own[:, i : i + 1]).sum(axis=2).min(axis=1))
            least[part] = best
    return least


def near_pairs(vertices: DataFrame, distance: float) -> DataFrame:
    """Pairs of vertices of one mesh at most ``distance`` apart: mesh, a, b (a < b), by the operator for near points."""
    from stratapoint.operators.proximity import pairs_within

    keyed = vertices.select(F.struct("mesh", "vertex").alias("id"), F.col("mesh").alias("group"), "x", "y", "z")
    found = pairs_within(keyed, distance)
    return found.select(F.col("id_a.mesh").alias("mesh"), F.col("id_a.vertex").alias("a"), F.col("id_b.vertex").alias("b"))


# ---- decimation ----


@dataclass(frozen=True)
class Options:
    preserve_border: bool = False
    preserve_seams: bool = False  # vertices at one place with other attributes stay, on borders or not
    preserve_foldovers: bool = False  # vertices that were welded stay
    preserve_curvature: bool = False
    link: bool = True  # border vertices at one place belong together
    link_distance: float = 100 * 2.0**-52  # and so do those this far apart
    max_iterations: int = 100
    aggressiveness: float = 7.0
    rebuild_every: int = 5


def _quadrics(points: np.ndarray, faces: np.ndarray) -> np.ndarray:
    p = points[faces]
    n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    size = np.linalg.norm(n, axis=1, keepdims=True)
    n = np.divide(n, size, out=np.zeros_like(n), where=size > 0)
    plane = np.column_stack([n, -(n * p[:, 0]).sum(axis=1)])
    q = plane[:, :, None] * plane[:, None, :]
    out = np.zeros((len(points), 4, 4))
    for k in range(3):
        np.add.at(out, faces[:, k], q)
    return out


def _border_quadrics(points: np.ndarray, faces: np.ndarray) -> np.ndarray:
    """Quadrics of planes that stand on the border's sides, so that a border keeps its course."""
    sides = np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]])
    p = points[faces]
    normals = np.tile(np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]), (3, 1))
    _, at, times = np.unique(np.sort(sides, axis=1), axis=0, return_index=True, return_counts=True)
    lone = at[times == 1]
    along = points[sides[lone, 1]] - points[sides[lone, 0]]
    n = np.cross(along, normals[lone])
    size = np.linalg.norm(n, axis=1, keepdims=True)
    n = np.divide(n, size, out=np.zeros_like(n), where=size > 0)
    plane = np.column_stack([n, -(n * points[sides[lone, 0]]).sum(axis=1)])
    q = plane[:, :, None] * plane[:, None, :]
    out = np.zeros((len(points), 4, 4))
    for k in range(2):
        np.add.at(out, sides[lone, k], q)
    return out


def _link(points: np.ndarray, faces: np.ndarray, attributes: np.ndarray | None, distance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Border vertices within ``distance`` of each other: (faces, seam, foldover).

    Those with the same attributes are welded (foldover); others stay two (seam), as each side keeps its attributes. Only the
    vertices of neighbouring cells of that size are compared.
    """
    to, seam, foldover = np.arange(len(points)), np.zeros(len(points), bool), np.zeros(len(points), bool)
    cells: dict[tuple, list[int]] = {}
    for i in np.nonzero(_border(points, faces))[0].tolist():
        home = np.floor(points[i] / distance)  # far from the origin a cell is one place
        around = {(x, y, z) for x in (home[0] - 1, home[0], home[0] + 1) for y in (home[1] - 1, home[1], home[1] + 1) for z in (home[2] - 1, home[2], home[2] + 1)}
        welded = False
        for j in (j for c in around for j in cells.get(c, ())):
            if ((points[i] - points[j]) ** 2).sum() > distance * distance:
                continue
            if attributes is not None and not np.array_equal(attributes[i], attributes[j]):
                seam[[i, j]] = True
            elif not welded:
                to[i], welded = j, True
                foldover[j] = True
        if not welded:
            cells.setdefault(tuple(home), []).append(i)
    return to[faces], seam, foldover


def _edges(faces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.sort(np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]]), axis=1)
    return np.unique(e, axis=0, return_counts=True)


def _border(points: np.ndarray, faces: np.ndarray) -> np.ndarray:
    edges, times = _edges(faces)
    out = np.zeros(len(points), bool)
    out[edges[times == 1].reshape(-1)] = True
    return out


def _targets(points: np.ndarray, q: np.ndarray, edges: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each edge would collapse to, and at what error: the least point of its quadric, or an end or the middle."""
    both = q[edges[:, 0]] + q[edges[:, 1]]
    a, b = points[edges[:, 0]], points[edges[:, 1]]
    options = np.stack([a, b, (a + b) / 2], axis=1)
    homogeneous = np.concatenate([options, np.ones((*options.shape[:2], 1))], axis=2)
    errors = np.einsum("eoi,eij,eoj->eo", homogeneous, both, homogeneous)
    pick = errors.argmin(axis=1)
    where, error = options[np.arange(len(edges)), pick], errors[np.arange(len(edges)), pick]
    inner = both[:, :3, :3]
    solvable = (np.abs(np.linalg.det(inner)) > 1e-12) & ~(border[edges[:, 0]] & border[edges[:, 1]])
    if solvable.any():
        best = np.linalg.solve(inner[solvable], -both[solvable, :3, 3:])[:, :, 0]
        h = np.column_stack([best, np.ones(len(best))])
        where[solvable], error[solvable] = best, np.einsum("ei,eij,ej->e", h, both[solvable], h)
    return where, np.abs(error)


def _across(p: np.ndarray) -> np.ndarray:
    """Normals, as long as twice the area, of triangles (n, 3, 3)."""
    u, v = p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]
    return u[:, [1, 2, 0]] * v[:, [2, 0, 1]] - u[:, [2, 0, 1]] * v[:, [1, 2, 0]]


def _turns_over(points: np.ndarray, faces: np.ndarray, left: list[int], moved: tuple[int, int], to: np.ndarray) -> bool:
    """Whether one of the faces left would turn over or collapse if two of its corners moved."""
    if not left:
        return False
    tri = faces[left]
    p = points[tri]
    r = np.where(((tri == moved[0]) | (tri == moved[1]))[:, :, None], to, p)
    before, after = _across(p), _across(r)
    lengths = np.sqrt((((r[:, 1] - r[:, 0]) ** 2).sum(axis=1)) * ((r[:, 2] - r[:, 0]) ** 2).sum(axis=1))
    size = np.sqrt((after * after).sum(axis=1))
    return bool(((lengths == 0) | (size < 1e-3 * lengths) | ((before * after).sum(axis=1) < 0.2 * np.sqrt((before * before).sum(axis=1)) * size)).any())


def decimate(points: np.ndarray, faces: np.ndarray, target: int, options: Options = Options(), attributes: np.ndarray | None = None, fixed_threshold: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Fewer triangles by collapsing edges of least quadric error: (points, faces, attributes).

    Each round collapses edges whose error is under a threshold that grows from round to round (or stays fixed) and whose
    faces no other collapse of the round has touched, until ``target`` faces are left. Attributes (n, k) of another length than
    the points are left out. No triangle turns over. Border vertices at one place are linked first: with equal attributes they
    become one, with others they are a seam, whose vertices stay so that no gap opens.
    """
    points, faces = np.array(points, float), np.array(faces, int).reshape(-1, 3)
    if attributes is not None and len(attributes) != len(points):
        attributes = None
    attributes = None if attributes is None else np.array(attributes, float)
    seam = foldover = np.zeros(len(points), bool)
    if options.link and len(faces):
        faces, seam, foldover = _link(points, faces, attributes, options.link_distance)
    faces = faces[(faces[:, 0] != faces[:, 1]) & (faces[:, 1] != faces[:, 2]) & (faces[:, 2] != faces[:, 0])]
    if options.preserve_seams and len(points):
        used = np.unique(faces)
        _, inverse, times = np.unique(points[used], axis=0, return_inverse=True, return_counts=True)
        seam = seam.copy()
        seam[used] |= times[inverse.reshape(-1)] > 1
    fixed = seam | foldover if options.preserve_foldovers else seam
    q = None
    changed = True  # since edges and their errors were last worked out
    for i in range(options.max_iterations):
        if len(faces) <= target:
            break
        threshold = fixed_threshold if fixed_threshold is not None else 1e-9 * (i + 3) ** options.aggressiveness
        if changed:
            if q is None or i >= rebuild:
                q = _quadrics(points, faces) + _border_quadrics(points, faces)
                border = _border(points, faces)
                rebuild = i + options.rebuild_every
            edges, _ = _edges(faces)
            allowed = (border[edges[:, 0]] == border[edges[:, 1]]) & ~fixed[edges].any(axis=1)
            if options.preserve_border:
                allowed &= ~border[edges[:, 0]]
            edges = edges[allowed]
            if not len(edges):
                break
            where, error = _targets(points, q, edges, border)
            if options.preserve_curvature:
                p = points[faces]
                n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
                n /= np.linalg.norm(n, axis=1, keepdims=True) + 1e-300
                mean = np.zeros_like(points)
                for k in range(3):
                    np.add.at(mean, faces[:, k], n)
                mean /= np.linalg.norm(mean, axis=1, keepdims=True) + 1e-300
                bend = (1 - (mean[edges[:, 0]] * mean[edges[:, 1]]).sum(axis=1)) / 2
                error = error + bend * np.linalg.norm(points[edges[:, 0]] - points[edges[:, 1]], axis=1)
            changed = False
        chosen = np.nonzero(error < threshold)[0]
        if not len(chosen):
            if fixed_threshold is not None:
                break
            continue
        around: list[set[int]] = [set() for _ in range(len(points))]
        for f, tri in enumerate(faces.tolist()):
            for v in tri:
                around[v].add(f)
        touched: set[int] = set()
        dead: set[int] = set()
        for k in chosen[np.argsort(error[chosen], kind="stable")].tolist():
            a, b = edges[k].tolist()
            if len(faces) - len(dead) <= target:
                break
            near = around[a] | around[b]
            if near & touched:
                continue
            gone = around[a] & around[b]
            if _turns_over(points, faces, sorted(near - gone), (a, b), where[k]):
                continue
            if attributes is not None:
                d = points[b] - points[a]
                t = float(np.clip((where[k] - points[a]) @ d / (d @ d + 1e-300), 0, 1))
                attributes[a] = attributes[a] * (1 - t) + attributes[b] * t
            points[a] = where[k]
            q[a] = q[a] + q[b]
            for f in around[b] - gone:
                faces[f][faces[f] == b] = a
            dead |= gone
            touched |= near
        if not dead:
            if fixed_threshold is not None:
                break
            continue
        changed = True
        faces = np.delete(faces, sorted(dead), axis=0)
        faces = faces[(faces[:, 0] != faces[:, 1]) & (faces[:, 1] != faces[:, 2]) & (faces[:, 2] != faces[:, 0])]
    used, faces = np.unique(faces, return_inverse=True) if len(faces) else (np.empty(0, int), faces)
    return points[used], faces.reshape(-1, 3), None if attributes is None else attributes[used]


def decimate_lossless(points: np.ndarray, faces: np.ndarray, options: Options = Options(), attributes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Only collapses that change the surface by next to nothing."""
    return decimate(points, faces, 0, options, attributes, fixed_threshold=1e-3)


MESHES = "mesh long, points array<array<double>>, faces array<array<int>>"


def simplify(meshes: DataFrame, ratio: float, options: Options = Options(), lossless: bool = False) -> DataFrame:
    """meshes: mesh, points, faces (one row a mesh; a mesh's collapses follow each other). Each with ``ratio`` of its faces or,
    lossless, with those that the surface needs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for m, p, f in zip(batch["mesh"], batch["points"], batch["faces"], strict=True):
                points, faces = np.array([list(x) for x in p], float).reshape(-1, 3), np.array([list(x) for x in f], int).reshape(-1, 3)
                points, faces, _ = decimate_lossless(points, faces, options) if lossless else decimate(points, faces, int(len(faces) * ratio), options)
                rows.append((m, points.tolist(), faces.tolist()))
            yield pd.DataFrame(rows, columns=["mesh", "points", "faces"])

    return spread(meshes.select("mesh", "points", "faces"), "mesh").mapInPandas(run, MESHES)
