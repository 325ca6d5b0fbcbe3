"""Points near points, and points in regions, through adaptive coverings.

A region (a ball around a point, or a polygon) is covered by grid cells, fine where that pays and coarse elsewhere. Cells
wholly inside the region are told apart from cells on its boundary: a point that meets an inside cell in the equi-join on
cells is accepted at once, one that meets a boundary cell is tested exactly. The finest cell that holds a ball's centre lies
inside the ball wherever the centre is in it, so every covering has an inside cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapoint.session import BROADCAST_ROWS, cut_lineage, join_dimension

AXES = ("x", "y", "z")
#: Edges of the cells of each level, in radii, and the number of points beyond which a cell is split into the next level's.
#: The last level's diagonal is below a radius.
EDGES = (8.0, 2.0, 0.5)
CROWDED = 64
#: Points of one cell of the last level that one task compares; more are salted.
SALT_ROWS = 4096
#: Coordinates from here on are too coarse for cells of whole numbers; their points are a part of their own.
FARTHEST = 1e15


def _key(level: int, *cell: Column) -> Column:
    return F.xxhash64(F.col("group"), F.lit(level), *cell)


def _cell(v: str, edge: float) -> Column:
    return F.floor(F.col(v) / F.lit(edge))


def _crowded(points: DataFrame, level: int, edge: float, least: int) -> tuple[DataFrame | None, int]:
    """Keys of the cells of this level with more than ``least`` points (n each), and how many there are."""
    keys = points.groupBy(_key(level, *[_cell(v, edge) for v in AXES]).alias("cell")).count().where(F.col("count") > least)
    keys = cut_lineage(keys.withColumnRenamed("count", "n"))
    n = keys.count()
    return (keys, n) if n else (None, 0)


def _mark(df: DataFrame, keys: DataFrame | None, name: str) -> DataFrame:
    """df with ``name``: n of its cell in keys, else null. Keys are broadcast up to a counted size."""
    if keys is None:
        return df.withColumn(name, F.lit(None).cast("long"))
    return join_dimension(df, keys.withColumnRenamed("n", name), "cell", "left")


def pairs_within(points: DataFrame, radius: float, tell: bool = False, strict: bool = False) -> DataFrame:
    """points: id (unique), group, x, y, z. All pairs of one group at most ``radius`` apart (``strict``: nearer than it): id_a
    < id_b and, if asked to tell, the group and ``sure``: whether an inside cell accepted the pair without a test.

    Points with a null, NaN or infinite coordinate or a null id or group have no place. The covering of a point's ball: the
    cell of the last level that holds the point is inside, and points that share it are pairs by the equi-join alone. Around it
    stand cells of the level that the surroundings' crowding asks for; of the last level, those wholly inside accept at
    once too, and all others are tested exactly. Of a pair, only the ball whose covering reaches
    forward (in the order of cells) to the other point's cell finds it, so each comes out once. Equal points are a pair at
    distance 0. Join keys are hashes of cells; a collision only adds a candidate, and inside cells are compared by value.
    Points with a coordinate of 1e15 or more are joined on cells of doubles, apart from the others.
    """
    ok = [F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf) for v in AXES]
    placed = points.select("id", "group", *[F.col(v).cast("double").alias(v) for v in AXES]).where(F.col("id").isNotNull() & F.col("group").isNotNull() & ok[0] & ok[1] & ok[2])
    placed = placed.persist()
    p = placed.where(~_beyond("", FARTHEST))
    edges = [e * radius for e in EDGES]
    last = len(edges) - 1
    crowded: list[DataFrame | None] = []
    part = p
    for level, edge in enumerate(edges):
        keys, n = _crowded(part, level, edge, CROWDED if level < last else SALT_ROWS)
        crowded.append(keys)
        if keys is None:
            break
        if level < last:
            here = part.withColumn("cell", _key(level, *[_cell(v, edge) for v in AXES]))
            part = (here.join(F.broadcast(keys), "cell", "left_semi") if n <= BROADCAST_ROWS else here.join(keys, "cell", "left_semi")).drop("cell")
    crowded += [None] * (len(edges) - len(crowded))
    found = [_sharing(p, edges[last], last, crowded[last])]

    cells = [f"c{v}" for v in AXES]
    reach = radius * 1.001  # covers the rounding of cells; the exact test has the last word
    home_parts, cover_parts = [], []
    homes = p
    covers = p.withColumn("forward", F.lit(False))
    parent = None
    for level, edge in enumerate(edges):
        homes = homes.withColumn("cell", _key(level, *[_cell(v, edge) for v in AXES]))
        homes = _mark(homes, crowded[level], "n")
        for v, c in zip(AXES, cells, strict=True):
            low, high = F.floor((F.col(v) - reach) / edge), F.floor((F.col(v) + reach) / edge)
            if parent is not None:  # only inside the cell that is split
                ratio = round(parent / edge)
                low, high = F.greatest(low, F.col(c) * ratio), F.least(high, F.col(c) * ratio + (ratio - 1))
            covers = covers.withColumn(f"_{c}", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
        covers = covers.drop(*cells).withColumnsRenamed({f"_{c}": c for c in cells})
        own = [_cell(v, edge) for v in AXES]
        step = [F.col(c) - o for c, o in zip(cells, own, strict=True)]
        ahead = (step[0] > 0) | ((step[0] == 0) & ((step[1] > 0) | ((step[1] == 0) & (step[2] > 0))))
        same = (step[0] == 0) & (step[1] == 0) & (step[2] == 0)
        meet = F.col("forward") | ahead if level == last else F.col("forward") | ahead | same  # the finest cell of the centre is done
        covers = covers.where(meet).withColumn("forward", F.col("forward") | ahead)
        near = [F.greatest(F.lit(0.0), F.col(c) * edge - F.col(v), F.col(v) - (F.col(c) + 1) * edge) for c, v in zip(cells, AXES, strict=True)]
        far = [F.greatest(F.abs(F.col(c) * edge - F.col(v)), F.abs((F.col(c) + 1) * edge - F.col(v))) for c, v in zip(cells, AXES, strict=True)]
        square = lambda d: d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        covers = covers.where(square(near) <= reach * reach)
        covers = covers.withColumn("cell", _key(level, *[F.col(c) for c in cells]))
        covers = _mark(covers, crowded[level], "n")
        if level < last:
            stay_h, stay_c = homes.where("n is null"), covers.where("n is null")
        else:
            stay_h, stay_c = homes, covers
        inside = (square(far) <= (radius * 0.999) ** 2) if level == last else F.lit(False)
        salts = F.ceil(F.coalesce("n", F.lit(0)) / SALT_ROWS).cast("int") if level == last else F.lit(1)
        salts = F.greatest(salts, F.lit(1))
        home_parts.append(stay_h.select("cell", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), F.col("id").alias("a"), F.col("group").alias("ga"), *[F.col(v).alias(f"a{v}") for v in AXES]))
        salt = F.explode(F.sequence(F.lit(0), salts - 1)) if level == last else F.lit(0)
        cover_parts.append(
            stay_c.select("cell", "id", "group", *AXES, "forward", inside.alias("inside"), *[F.col(c) for c in cells], F.lit(edge).alias("edge"), salt.alias("salt"))
            .select("cell", "salt", F.col("id").alias("b"), F.col("group").alias("gb"), *[F.col(v).alias(f"b{v}") for v in AXES], "forward", *(["inside", *cells] if level == last else []))
        )
        if crowded[level] is None or level == last:
            break
        homes = homes.where("n is not null").drop("n", "cell")
        covers = covers.where("n is not null").drop("n", "cell")
        parent = edge

    apart = ~_same_cell(edges[last])
    distance = sum((F.col(f"a{v}") - F.col(f"b{v}")) * (F.col(f"a{v}") - F.col(f"b{v}")) for v in AXES)
    for h, c in zip(home_parts, cover_parts, strict=True):  # cells of different levels never meet
        joined = h.join(c, ["cell", "salt"]).where((F.col("ga") == F.col("gb")) & (F.col("forward") | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b")))
        exact, hit = distance < radius * radius if strict else distance <= radius * radius, F.lit(False)
        if "inside" in c.columns:
            hit = F.col("inside")
            for v, k in zip(AXES, cells, strict=True):
                hit = hit & (F.floor(F.col(f"a{v}") / edges[last]) == F.col(k))
            exact = F.when(hit, True).otherwise(exact)
        else:
            exact = exact & apart
        found.append(joined.where(exact).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), F.col("ga").alias("group"), hit.alias("sure")))
    if not placed.where(_beyond("", FARTHEST)).isEmpty():
        found.append(_far_pairs(placed, radius, strict).withColumn("sure", F.lit(False)))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out if tell else out.drop("group", "sure")


def _same_cell(edge: float) -> Column:
    same = F.lit(True)
    for v in AXES:
        same = same & (F.floor(F.col(f"a{v}") / edge) == F.floor(F.col(f"b{v}") / edge))
    return same


def _sharing(points: DataFrame, edge: float, level: int, crowded: DataFrame | None) -> DataFrame:
    """Pairs of points that share a cell whose diagonal is below the radius: no test of distances."""
    cells = points.select("id", "group", *[_cell(v, edge).alias(v) for v in AXES]).withColumn("cell", _key(level, *[F.col(v) for v in AXES]))
    cells = _mark(cells, crowded, "n")
    salts = F.greatest(F.ceil(F.coalesce("n", F.lit(0)) / SALT_ROWS).cast("int"), F.lit(1))
    of = ("id", "group", *AXES)
    a = cells.select("cell", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), *[F.col(c).alias(f"a_{c}") for c in of])
    b = cells.select("cell", (F.lit(0) if crowded is None else F.explode(F.sequence(F.lit(0), salts - 1))).alias("salt"), *[F.col(c).alias(f"b_{c}") for c in of])
    same = F.col("a_id") < F.col("b_id")
    for c in of[1:]:
        same = same & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    return a.join(b, ["cell", "salt"]).where(same).select(F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"), F.col("a_group").alias("group"), F.lit(True).alias("sure"))


def _beyond(side: str, least: float) -> Column:
    return F.greatest(*[F.abs(f"{side}{v}") for v in AXES]) >= least


def _far_pairs(points: DataFrame, radius: float, strict: bool) -> DataFrame:
    """Pairs of which a point is beyond ``FARTHEST``. Cells of two radii stay doubles, so neighbours may be the same cell."""
    near_or_beyond = points.where(_beyond("", FARTHEST - 2 * radius))
    cells = [f"c{v}" for v in AXES]
    homes = near_or_beyond.withColumns({c: F.rint(F.col(v) / (2 * radius)) + 0.0 for v, c in zip(AXES, cells, strict=True)})
    covers = homes
    for c in cells:
        covers = covers.withColumn(c, F.explode(F.array_distinct(F.array(*[F.col(c) + k for k in (-1.0, 0.0, 1.0)]))))
    homes, covers = [df.withColumn("cell", _key(-1, *[F.col(c) for c in cells])) for df in (homes, covers)]
    crowded = cut_lineage(homes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SALT_ROWS))
    homes, covers = _mark(homes, crowded, "n"), _mark(covers, crowded, "n")
    salts = F.greatest(F.ceil(F.coalesce("n", F.lit(0)) / SALT_ROWS).cast("int"), F.lit(1))
    h = homes.select("cell", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), *[F.col(c).alias(f"a{c}") for c in ("id", "group", *AXES, *cells)])
    c = covers.select("cell", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), *[F.col(c).alias(f"b{c}") for c in ("id", "group", *AXES, *cells)])
    same = F.col("agroup") == F.col("bgroup")
    for k in cells:
        same = same & (F.col(f"a{k}") == F.col(f"b{k}"))
    distance = sum((F.col(f"a{v}") - F.col(f"b{v}")) * (F.col(f"a{v}") - F.col(f"b{v}")) for v in AXES)
    joined = h.join(c, ["cell", "salt"]).where(same & (F.col("aid") < F.col("bid")) & (_beyond("a", FARTHEST) | _beyond("b", FARTHEST)))
    near = distance < radius * radius if strict else distance <= radius * radius
    return joined.where(near).select(F.col("aid").alias("id_a"), F.col("bid").alias("id_b"), F.col("agroup").alias("group"))


# ---- polygons ----

_SIDES = ", ".join(f"{c} array<double>" for c in ("ax", "ay", "bx", "by"))
COVER = f"region_id long, level int, cx long, cy long, inside boolean, crossed int, {_SIDES}"


def _inside(px: float, py: float, xs: list[float], ys: list[float]) -> bool:
    odd, j = False, len(xs) - 1
    for i in range(len(xs)):
        if (ys[i] > py) != (ys[j] > py) and px < (xs[j] - xs[i]) * (py - ys[i]) / (ys[j] - ys[i]) + xs[i]:
            odd = not odd
        j = i
    return odd


def _meets(x0: float, y0: float, x1: float, y1: float, ax: float, ay: float, bx: float, by: float) -> bool:
    """Whether segment a-b touches the box (by clipping it)."""
    t0, t1, dx, dy = 0.0, 1.0, bx - ax, by - ay
    for d, low, high in ((dx, x0 - ax, x1 - ax), (dy, y0 - ay, y1 - ay)):
        if d == 0:
            if low > 0 or high < 0:
                return False
            continue
        u, v = low / d, high / d
        t0, t1 = max(t0, min(u, v)), min(t1, max(u, v))
        if t0 > t1:
            return False
    return True


def cover_polygon(xs: list[float], ys: list[float], edge: float, levels: int) -> Iterator[tuple[int, int, int, bool]]:
    """(level, cx, cy, inside) of disjoint cells that cover the polygon; cells of level k have the edge ``edge / 2**k``.

    A cell that no side of the polygon touches is inside or left out; one that is touched is split, down to the last level.
    """
    if len(xs) < 3:
        return
    sides = [(xs[i - 1], ys[i - 1], xs[i], ys[i]) for i in range(len(xs))]
    for cx in range(math.floor(min(xs) / edge), math.floor(max(xs) / edge) + 1):
        for cy in range(math.floor(min(ys) / edge), math.floor(max(ys) / edge) + 1):
            stack = [(0, cx, cy, sides)]
            while stack:
                level, x, y, near = stack.pop()
                e = edge / 2**level
                slack = e * 1e-9
                touched = [s for s in near if _meets(x * e - slack, y * e - slack, (x + 1) * e + slack, (y + 1) * e + slack, *s)]
                if not touched:
                    if _inside((x + 0.5) * e, (y + 0.5) * e, xs, ys):
                        yield level, x, y, True
                elif level == levels:
                    yield level, x, y, False
                else:
                    stack += [(level + 1, 2 * x + i, 2 * y + j, touched) for i in (0, 1) for j in (0, 1)]


def _sides_right_of(sides: np.ndarray, x0: float, y0: float, x1: float, y1: float, slack: float) -> tuple[int, np.ndarray]:
    """What a ray to the right from any point of the cell meets: the number of sides that each ray crosses, and the sides of
    which that depends on the point. Sides are rows ax, ay, bx, by."""
    low, high = np.minimum(sides[:, 1], sides[:, 3]), np.maximum(sides[:, 1], sides[:, 3])
    maybe = (high > y0 - slack) & (low <= y1 + slack) & (np.maximum(sides[:, 0], sides[:, 2]) >= x0 - slack)
    always = maybe & (low <= y0 - slack) & (high > y1 + slack) & (np.minimum(sides[:, 0], sides[:, 2]) > x1 + slack)
    return int(always.sum()), sides[maybe & ~always]


def points_in_regions(points: DataFrame, regions: DataFrame, edge: float, levels: int = 5) -> DataFrame:
    """points: id, x, y. regions: region_id, xs, ys (a simple ring, without the closing point). Pairs (id, region_id).

    The even-odd rule decides, with the lower and left sides in. ``edge`` should be near the regions' size. Points with null or
    NaN coordinates, and rings of fewer than three points or with nulls, are nowhere. A border cell brings along the few sides
    that the rule still asks for in it, so no ring is joined. Points aren't shuffled while the covering, sides included,
    is small (counted); beyond that they are, on (level, cell) and a salt.
    """

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for region, xs, ys in zip(batch["region_id"], batch["xs"], batch["ys"], strict=True):
                ends = np.column_stack([xs, ys])
                sides = np.column_stack([ends, np.roll(ends, 1, axis=0)])
                for level, cx, cy, inside in cover_polygon(list(xs), list(ys), edge, levels):
                    e = edge / 2**level
                    always, near = (0, sides[:0]) if inside else _sides_right_of(sides, cx * e, cy * e, (cx + 1) * e, (cy + 1) * e, e * 1e-9)
                    rows.append((region, level, cx, cy, inside, always, *[near[:, k].tolist() for k in range(4)]))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    names = [c.split()[0] for c in COVER.split(", ")]
    rings = regions.where("region_id is not null and size(xs) >= 3 and size(xs) = size(ys) and not exists(xs, v -> v is null) and not exists(ys, v -> v is null)").select("region_id", "xs", "ys")
    cells = cut_lineage(rings.mapInPandas(cover, COVER))
    placed = points.where("id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)").select("id", "x", "y")
    level = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    keyed = placed.withColumn("level", level).select("id", "x", "y", "level", *[F.floor(F.col(v) / (F.lit(edge) / F.pow(F.lit(2.0), "level"))).alias(f"c{v}") for v in ("x", "y")])
    if (cells.agg(F.sum(F.size("ax") + 1)).first()[0] or 0) <= BROADCAST_ROWS:
        met = keyed.join(F.broadcast(cells), ["level", "cx", "cy"])
    else:
        salted = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        met = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(salted, ["level", "cx", "cy", "salt"])
    crossings = F.expr(
        """aggregate(arrays_zip(ax, ay, bx, by), crossed, (n, s) -> n + case when (s.ay > y) <> (s.by > y)
        and x < (s.bx - s.ax) * (y - s.ay) / (s.by - s.ay) + s.ax then 1 else 0 end)"""
    )
    return met.where(F.when(F.col("inside"), True).otherwise(crossings % 2 == 1)).select("id", "region_id")
