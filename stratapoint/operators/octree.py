"""Octree and quadtree over points: root box, node paths, level-of-detail thinning, pruning and the tile tree.

Points: columns ``x, y, z`` and whatever else; ``arrival`` names the columns that put rows in a total order. A node is the
string of its digits; the root is ''. Every step is one shuffle on node keys; boxes are carried, never joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratapoint.functions import geometry as G
from stratapoint.operators.proximity import pairs_within
from stratapoint.session import cut_lineage, spread

AXES = ("x", "y", "z")
LEAF_CAPACITY = 20_000
PRUNE_BELOW = 100
MIN_SPACING = 0.001
#: A place that more than one in STACK_SHARE points share is handled apart.
STACK_SHARE = 1000
WORKING = ("node", "cell", "kept", "lx", "ly", "lz", "inner_node", "_d", "_bx", "_by", "_bz", "_f", "_m", "_s", "_near", "_refused")


@dataclass(frozen=True)
class Root:
    """The root box in the coordinates of the points, its spacing and the scale between them and the source's."""

    low: tuple[float, float, float]
    high: tuple[float, float, float]
    scale: float = 1.0

    @property
    def spacing(self) -> float:
        return math.dist(self.low, self.high) / 125

    @property
    def last_level(self) -> int:
        """The level whose spacing is at the limit: its nodes keep all points."""
        return max(1, math.ceil(math.log2(self.spacing / (MIN_SPACING * self.scale))))

    def sizes(self, level: int) -> tuple[float, float, float]:
        size = [b - a for a, b in zip(self.low, self.high, strict=True)]
        for k in range(level):
            flat = self.flat(size)
            size = [size[0] / 2, size[1] / 2, size[2] if flat else size[2] / 2]
        return tuple(size)

    @staticmethod
    def flat(size: Sequence[float]) -> bool:
        return size[2] / min(size[0], size[1]) < 0.5

    def flat_at(self, level: int) -> bool:
        """Whether nodes of this level are split in four."""
        return self.flat(self.sizes(level))


def file_bounds(points: DataFrame, file: str) -> DataFrame:
    """Bounds and count of each file: partial per task, one row a file after the shuffle."""
    return points.groupBy(file).agg(*[F.min(v).alias(f"min_{v}") for v in AXES], *[F.max(v).alias(f"max_{v}") for v in AXES], F.count(F.lit(1)).alias("n"))


def root_statistics(points: DataFrame, file: str) -> DataFrame:
    """One row: bounds, mean over files of each file's minimum, count, spacing, whether flat, scale."""
    b = file_bounds(points, file).agg(
        *[F.min(f"min_{v}").alias(f"min_{v}") for v in AXES], *[F.max(f"max_{v}").alias(f"max_{v}") for v in AXES],
        *[F.avg(f"min_{v}").alias(f"avg_min_{v}") for v in AXES], F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"),
    )
    low = [F.col(f"min_{v}") for v in AXES]
    high = [G.valid_high(F.col(f"min_{v}"), F.col(f"max_{v}")) for v in AXES]
    size = [h - a for a, h in zip(low, high, strict=True)]
    s = G.spacing(low, high)
    return b.withColumns({"spacing": s, "flat": G.is_flat(*size), "scale": G.root_scale(s)})


def root_of(points: DataFrame, scale: float = 1.0) -> Root | None:
    """The root box of float points; None of an empty table."""
    row = points.agg(*[F.min(F.col(v).cast("float")).cast("double").alias(f"a{v}") for v in AXES], *[F.max(F.col(v).cast("float")).cast("double").alias(f"b{v}") for v in AXES]).first()
    if row["ax"] is None:
        return None
    low, high = [row[f"a{v}"] for v in AXES], [row[f"b{v}"] for v in AXES]
    return Root(tuple(low), tuple(b if b > a else a + G.MIN_BOX_SIZE for a, b in zip(low, high, strict=True)), scale)


def _lows(root: Root) -> list[Column]:
    return [F.lit(v) for v in root.low]


def descend(points: DataFrame, root: Root, level: int) -> DataFrame:
    """node grown by one digit; lx, ly, lz (the node's lower corner) moved along.

    Of a flat node the height's centre is its upper bound, so only points at the very top get an odd digit.
    """
    size, flat = root.sizes(level), root.flat_at(level)
    low = [F.col(f"l{v}") for v in AXES]
    center = [((a + (a + s)) * 0.5).cast("float") for a, s in zip(low, size, strict=True)]
    if flat:
        center[2] = (low[2] + size[2]).cast("float")
    digit = G.child_index([F.col(v).cast("float") for v in AXES], center)
    moved = points.withColumn("_d", digit)
    steps = {
        f"l{v}": F.col(f"l{v}") + F.when(F.col("_d").bitwiseAND(w) > 0, s * 0.5).otherwise(0.0)
        for v, w, s in zip(AXES, (4, 2, 1), size, strict=True) if not (v == "z" and flat)
    }
    return moved.withColumns(steps).withColumn("node", F.concat("node", F.col("_d").cast("string"))).drop("_d")


def with_nodes(points: DataFrame, root: Root, levels: int) -> DataFrame:
    """points with the name and lower corner of their node of the given level."""
    out = points.withColumns({"node": F.lit(""), **{f"l{v}": F.lit(a) for v, a in zip(AXES, root.low, strict=True)}})
    for level in range(levels):
        out = descend(out, root, level)
    return out


def cell_of(root: Root, level: int, cells: int = 3) -> Column:
    """Packed grid cell of a point in its node."""
    size = root.sizes(level)
    return G.cell_key([F.col(v) for v in AXES], [F.col(f"l{v}") for v in AXES], [F.lit(float(np.float32(s))) for s in size], cells)


def first_of_cells(points: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """The first arrived point of each (node, cell): a minimum of rows, so it is reduced before the shuffle."""
    row = F.min(F.struct(*arrival, *[c for c in points.columns if c not in (*arrival, "node", "cell")])).alias("_row")
    return points.groupBy("node", "cell").agg(row).select("node", "cell", "_row.*")


def conflict_pairs(points: DataFrame, key: str, distance: float) -> DataFrame:
    """Pairs (node, cell, a, b) of points of one (node, cell) nearer than ``distance``, by the near-points operator, which
    splits crowded places. ``key`` is unique."""
    placed = points.select(F.col(key).alias("id"), F.struct("node", "cell").alias("group"), *[F.col(v).cast("double").alias(v) for v in AXES])
    pairs = pairs_within(placed, distance, tell=True, strict=True)
    return pairs.select("group.node", "group.cell", F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def conflicts(points: DataFrame, key: str, distance: float) -> DataFrame:
    """node, cell, key, conflicts, first: each point that is nearer than ``distance`` to others of its (node, cell), with their number
    and the first of them. Pairs are counted where they are found and never written out."""
    pairs = conflict_pairs(points, key, distance)
    both = F.explode(F.array(F.struct(F.col("a").alias("k"), F.col("b").alias("o")), F.struct(F.col("b").alias("k"), F.col("a").alias("o")))).alias("p")
    sides = pairs.select("node", "cell", both)
    return sides.groupBy("node", "cell", F.col("p.k").alias(key)).agg(F.count(F.lit(1)).alias("conflicts"), F.min("p.o").alias("first"))


# ---- level of detail ----


#: Rows of one cell of one node that a task sorts and visits. Fuller cells are relieved of rows that are surely refused first.
CELL_ROWS = 20_000_000
#: Parts of one crowded box in the relief's join.
SALTS = 16


def _thin(spacing: float, position: list[int], keys: list[int]):  # noqa: ANN202
    """Greedy thinning of rows sorted by (node, cell, arrival), streamed: only kept points are remembered, and of those
    only the cell's at hand, whose number is bounded by its size over the spacing.

    Space is cut into boxes whose diagonal is below the spacing. A box with a kept point refuses all others at a glance, and a
    point in another is compared with those kept in the 124 boxes around its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit, edge = spacing * spacing, spacing / 3**0.5 * (1 - 1e-6)
        now, kept = None, {}
        reach = (0, -1, 1, -2, 2)
        around = [(i << 80) + (j << 40) + k for i in reach for j in reach for k in reach][1:]
        for batch in batches:
            node, cell = batch.column(keys[0]), batch.column(keys[1]).to_numpy(zero_copy_only=False)
            same_node = pc.equal(node.slice(1), node.slice(0, max(len(node) - 1, 0))).to_numpy(zero_copy_only=False)
            begins = np.concatenate([[0], np.nonzero(~(same_node & (cell[1:] == cell[:-1])))[0] + 1]).tolist() if len(node) else []
            xyz = np.stack([batch.column(p).to_numpy(zero_copy_only=False).astype(np.float64) for p in position], axis=1)
            flags = np.zeros(len(node), bool)
            for begin, end in zip(begins, [*begins[1:], len(node)], strict=True):
                key = (node[begin].as_py(), int(cell[begin]))
                if key != now:
                    now, kept, origin = key, {}, np.floor(xyz[begin] / edge)
                # a cell is some 70 boxes wide; points outside the root box may lie further off
                place = np.clip(np.floor(xyz[begin:end] / edge) - origin, -(2.0**38), 2.0**38).astype(np.int64).tolist()
                boxes = [(i << 80) + (j << 40) + k for i, j, k in place]
                for at, (box, (x, y, z)) in enumerate(zip(boxes, xyz[begin:end].tolist(), strict=True), begin):
                    if box in kept:
                        continue
                    for step in around:
                        near = kept.get(box + step)
                        if near is not None and (x - near[0]) * (x - near[0]) + (y - near[1]) * (y - near[1]) + (z - near[2]) * (z - near[2]) < limit:
                            break
                    else:
                        kept[box] = (x, y, z)
                        flags[at] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags)], [*batch.schema.names, "kept"])

    return run


def _surely_refused(inner: DataFrame, arrival: Sequence[str], spacing: float) -> tuple[DataFrame, DataFrame]:
    """(rows left, rows surely refused) of points with node and cell: refused ones are nearer than the spacing to a point that
    surely is kept, because nothing in reach arrived before it.

    Boxes of the spacing's size and their first arrivals are bounded by geometry, not by the points; these are reduced before
    every shuffle, and a box of very many points is salted. Visiting the rows left in order gives the same points as visiting all.
    """
    edge = spacing / 3**0.5
    boxes = [f"_b{v}" for v in AXES]
    where = ["node", "cell", *boxes]
    placed = inner.withColumns({b: F.floor(F.col(v).cast("double") / edge) for v, b in zip(AXES, boxes, strict=True)})
    order = F.struct(*arrival)
    first = cut_lineage(placed.groupBy(*where).agg(F.min(F.struct(order.alias("a"), *[F.col(v).cast("double").alias(v) for v in AXES])).alias("_f")))
    earliest = first.select(*where, F.col("_f.a").alias("_m"))
    for b in boxes:  # the earliest arrival within two boxes each way, axis by axis
        earliest = earliest.withColumn(b, F.explode(F.array(*[F.col(b) + k for k in (-2, -1, 0, 1, 2)]))).groupBy(*where).agg(F.min("_m").alias("_m"))
    sure = first.join(earliest, where).where(F.col("_m") == F.col("_f.a")).select(*where, "_f")
    reach = sure
    for b in boxes:
        reach = reach.withColumn(b, F.explode(F.array(*[F.col(b) + k for k in (-2, -1, 0, 1, 2)])))
    near = reach.groupBy(*where).agg(F.collect_list("_f").alias("_near")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # one a box, so 125 at most
    salted = placed.withColumn("_s", F.pmod(F.xxhash64(*arrival), F.lit(SALTS)).cast("int"))
    gap = lambda k: sum((F.col(v).cast("double") - k[v]) * (F.col(v).cast("double") - k[v]) for v in AXES)
    refused = F.coalesce(F.exists("_near", lambda k: (gap(k) < spacing * spacing) & (k["a"] < order)), F.lit(False))
    marked = cut_lineage(salted.join(near, [*where, "_s"], "left").withColumn("_refused", refused).select(*inner.columns, "_refused"))
    return marked.where("not _refused").drop("_refused"), marked.where("_refused").drop("_refused")


def _relieved(inner: DataFrame, arrival: Sequence[str], spacing: float) -> tuple[DataFrame, DataFrame | None]:
    """inner without rows that are surely refused, and these, as long as some cell is fuller than ``CELL_ROWS`` and that helps."""
    refused = None
    before = None
    while True:
        fullest = inner.groupBy("node", "cell").count().agg(F.max("count")).first()[0] or 0
        if fullest <= CELL_ROWS or (before is not None and fullest > 0.9 * before):
            return inner, refused
        before = fullest
        inner, more = _surely_refused(inner, arrival, spacing)
        refused = more if refused is None else refused.unionByName(more)


def build_lod(points: DataFrame, arrival: Sequence[str], root: Root, leaf_capacity: int = LEAF_CAPACITY) -> DataFrame:
    """Every point with the node that shows it: the columns of points (x, y, z as float) and node.

    Level by level: nodes with fewer than ``leaf_capacity`` points, or whose spacing is at the limit, keep all of theirs; the
    others keep, cell by cell and in arrival order, each point at least ``spacing`` from those kept, and hand the rest to their
    children. The root keeps none. A node's diagonal is 125 spacings, so one of 3 x 3 x 3 cells holds at most some 22 000 points a
    spacing apart, and finer cells are never called for. Points with a null or NaN coordinate are left out; an empty table gives none. Input columns
    named like the working ones (``WORKING``) are dropped.
    """
    points = points.drop(*WORKING)
    ok = F.lit(True)
    for v in AXES:
        ok = ok & F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))
    columns = points.columns
    placed = points.where(ok).withColumns({v: F.col(v).cast("float") for v in AXES})
    placed, tail, stacks = _set_stacks_apart(placed, arrival, root.last_level)
    pending = cut_lineage(with_nodes(placed, root, 1))
    stacks = None if stacks is None else cut_lineage(with_nodes(stacks, root, 1))
    done: DataFrame | None = None
    ended: DataFrame | None = None
    level = 1
    while True:
        spacing = root.spacing / 2**level
        counts = pending.groupBy("node").count()
        if stacks is not None:
            counts = counts.unionByName(stacks.select("node", F.col("n").alias("count"))).groupBy("node").agg(F.sum("count").alias("count"))
        last = level >= root.last_level
        internal = cut_lineage(counts.where(F.lit(not last) & (F.col("count") >= leaf_capacity)).select(F.col("node").alias("inner_node")))
        n = internal.count()
        if n == 0:
            leaves = pending.select(*columns, "node")
            done = leaves if done is None else done.unionByName(leaves)
            if stacks is None:
                return done
            ended = stacks.select(*AXES, "node") if ended is None else ended.unionByName(stacks.select(*AXES, "node"))
            return done.unionByName(tail.join(F.broadcast(ended), list(AXES)).select(*columns, "node"))
        # inner nodes hold at least leaf_capacity points each; the optimizer broadcasts their names while they are few
        leaves = pending.join(internal, pending.node == internal.inner_node, "left_anti").select(*columns, "node")
        inner = pending.join(internal, pending.node == internal.inner_node, "left_semi").withColumn("cell", cell_of(root, level))
        inner, refused = _relieved(inner, arrival, spacing)
        ordered = spread(inner, "node", "cell").sortWithinPartitions("node", "cell", *arrival)
        names = ordered.columns
        schema = T.StructType([*ordered.schema.fields, T.StructField("kept", T.BooleanType())])
        thinned = cut_lineage(ordered.mapInArrow(_thin(spacing, [names.index(v) for v in AXES], [names.index("node"), names.index("cell")]), schema))
        shown = leaves.unionByName(thinned.where("kept").select(*columns, "node"))
        done = shown if done is None else done.unionByName(shown)
        rest = thinned.where("not kept").drop("kept", "cell")
        pending = cut_lineage(descend(rest if refused is None else rest.unionByName(refused.drop("cell", "inner_node")), root, level))
        if stacks is not None:
            still = stacks.join(internal, stacks.node == internal.inner_node, "left_anti").select(*AXES, "node")
            ended = still if ended is None else ended.unionByName(still)
            stacks = cut_lineage(descend(stacks.join(internal, stacks.node == internal.inner_node, "left_semi"), root, level))
        level += 1


def _set_stacks_apart(placed: DataFrame, arrival: Sequence[str], levels: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(points to thin, the rest, its places with their counts), where one place holds more than a thousandth of all points.

    Of points at one place a node keeps at most one, the first that arrived, so no more than one a level is ever kept above the
    last node: the first ``MAX_LEVEL + 1`` of each such place take part in the thinning, the others go to the place's last
    node at once. Such places are fewer than ``STACK_SHARE``; they are found through counts per hash bucket, reduced before
    the shuffle, and exact counts within the full buckets alone.
    """
    bucket = F.pmod(F.xxhash64(*AXES), F.lit(65_536))
    sizes = cut_lineage(placed.groupBy(bucket.alias("_b")).count())
    total = sizes.agg(F.sum("count")).first()[0] or 0
    least = max(total / STACK_SHARE, 2 * levels)
    full = sizes.where(F.col("count") > least).select("_b")
    if full.isEmpty():
        return placed, None, None
    within = placed.withColumn("_b", bucket).join(F.broadcast(full), "_b", "left_semi")
    places = cut_lineage(within.groupBy(*AXES).count().where(F.col("count") > least).select(*AXES))
    if places.isEmpty():
        return placed, None, None
    stacked = placed.join(F.broadcast(places), list(AXES), "left_semi")
    order = F.struct(*arrival)
    first = stacked.withColumn("_r", F.row_number().over(Window.partitionBy(*AXES).orderBy(*arrival))).where(F.col("_r") <= levels + 1)
    until = cut_lineage(first.groupBy(*AXES).agg(F.max(order).alias("_until")))
    marked = placed.join(F.broadcast(until), list(AXES), "left")
    thin = marked.where(F.col("_until").isNull() | (order <= F.col("_until"))).select(*placed.columns)
    tail = marked.where(order > F.col("_until")).select(*placed.columns)
    return thin, tail, cut_lineage(tail.groupBy(*AXES).agg(F.count(F.lit(1)).alias("n")))


def prune_map(counts: DataFrame, least: int = PRUNE_BELOW) -> DataFrame:
    """counts: node, n. Gives node, target and total: where a node's points go, and the points of the node after merging.

    Bottom up: a node deeper than level 1 with fewer than ``least`` points, merged ones included, gives all to its parent.
    A node may be its own target; a merged one's target is the nearest ancestor that stays.
    """
    nodes = cut_lineage(counts.select("node", F.col("n").cast("long").alias("n"), F.length("node").alias("level")))
    depth = nodes.agg(F.max("level")).first()[0] or 0
    carried = None  # parent, extra
    layers: list[DataFrame] = []
    for level in range(depth, 0, -1):
        layer = nodes.where(F.col("level") == level)
        if carried is not None:
            layer = layer.join(carried, layer.node == carried.parent, "full_outer").select(F.coalesce("node", "parent").alias("node"), (F.coalesce("n", F.lit(0)) + F.coalesce("extra", F.lit(0))).alias("n"))
        layer = cut_lineage(layer.select("node", "n", (F.lit(level > 1) & (F.col("n") < least)).alias("merged")))
        layers.append(layer)
        carried = layer.where("merged").groupBy(F.substring("node", F.lit(1), F.length("node") - 1).alias("parent")).agg(F.sum("n").alias("extra"))
    if not layers:
        return nodes.select("node", F.col("node").alias("target"), F.col("n").alias("total"))
    known = None
    for layer in reversed(layers):  # top down: a merged node goes where its parent goes
        if known is None:
            step = layer.select("node", F.col("node").alias("target"), F.col("n").alias("total"))
        else:
            up = known.select(F.col("node").alias("p"), F.col("target").alias("pt"))
            step = layer.join(up, F.substring(layer.node, F.lit(1), F.length(layer.node) - 1) == up.p, "left").select(
                "node", F.when(F.col("merged"), F.coalesce("pt", F.substring("node", F.lit(1), F.length("node") - 1))).otherwise(F.col("node")).alias("target"), F.col("n").alias("total")
            )
        last = cut_lineage(step)
        known = last if known is None else known.unionByName(last)
    return known


def tile_tree(shown: DataFrame, root: Root) -> DataFrame:
    """Tiles of shown points (after pruning): node, parent, level, n, geometric_error, bounds of all points in and below the
    tile, has_content, inner_tile (it has tiles below).

    The error is ten spacings over the scale; of a tile without children 0. Nodes that keep no points of their own but have
    tiles below them stay as tiles without content.
    """
    own = shown.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *[F.min(v).cast("double").alias(f"min_{v}") for v in AXES], *[F.max(v).cast("double").alias(f"max_{v}") for v in AXES])
    lifted = own.withColumn("up", F.explode(G.prefixes(F.col("node"))))
    all_nodes = lifted.groupBy("up").agg(
        F.sum(F.when(F.col("up") == F.col("node"), F.col("n")).otherwise(0)).alias("n"), F.max(F.length("node")).alias("deepest"),
        *[F.min(f"min_{v}").alias(f"min_{v}") for v in AXES], *[F.max(f"max_{v}").alias(f"max_{v}") for v in AXES],
    )
    level = F.length("up")
    inner = F.col("deepest") > level
    return all_nodes.select(
        F.col("up").alias("node"), F.when(level > 0, F.substring("up", F.lit(1), level - 1)).alias("parent"), level.alias("level"), "n",
        F.when(inner, node_error(root, level)).otherwise(F.lit(0.0)).alias("geometric_error"), *[f"min_{v}" for v in AXES], *[f"max_{v}" for v in AXES], (F.col("n") > 0).alias("has_content"), inner.alias("inner_tile"),
    )


def node_spacing(root: Root, level: Column) -> Column:
    """Spacing of the nodes of a level: half of the level above."""
    return F.lit(root.spacing) / F.pow(F.lit(2.0), level)


def node_error(root: Root, level: Column) -> Column:
    """Geometric error of the tiles of a level that have children: ten spacings in the source's units."""
    return node_spacing(root, level) * 10 / root.scale


def ready_nodes(nodes: DataFrame, active: DataFrame) -> DataFrame:
    """Nodes of which no active node is an ancestor (or the node itself): they are final and may be written.

    The prefixes of a node are as many as its depth, so the ancestor test is an equi-join on them.
    """
    up = nodes.select("node", F.explode(G.prefixes(F.col("node"))).alias("up"))
    blocked = up.join(active.select(F.col("node").alias("a")).distinct(), F.col("up") == F.col("a"), "left_semi").select(F.col("node").alias("b")).distinct()
    return nodes.join(blocked, nodes.node == blocked.b, "left_anti")


def prefix_counts(counts: DataFrame, levels: int) -> DataFrame:
    """counts: node, n. Points of every ancestor down to ``levels``: prefix, n."""
    at = F.explode(F.sequence(F.lit(0), F.least(F.lit(levels), F.length("node")))).alias("k")
    return counts.select("node", "n", at).groupBy(F.expr("substring(node, 1, k)").alias("prefix")).agg(F.sum("n").alias("n"))


def by_weight(features: DataFrame, weight: str, *ties: str) -> DataFrame:
    """Features from the heaviest on, those without weight last; equal weights by the columns of ties."""
    return features.orderBy(F.col(weight).desc_nulls_last(), *ties)


def first_per_tile(features: DataFrame, tile: Sequence[str], order: Sequence[Column], keep: int) -> DataFrame:
    """The first ``keep`` features of each tile with their rank; the others are handed down."""
    w = Window.partitionBy(*tile).orderBy(*order)
    return features.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def feature_quadtree(features: DataFrame, edge: float, keep: int = 20) -> DataFrame:
    """features: id (unique), x, y, weight. The tile that shows each feature: a top grid of ``edge``, and below it halves.

    Each tile shows its ``keep`` heaviest (ties by id) and hands the rest to its four children; one window a level. Equal
    places never part, so a tile whose features all stand at one place shows them all. Features with a null or NaN coordinate
    are left out.
    """
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan(F.col("x").cast("double")) & ~F.isnan(F.col("y").cast("double"))
    pending = features.where(ok).withColumns({"level": F.lit(0), "tx": F.floor(F.col("x") / edge), "ty": F.floor(F.col("y") / edge)})
    done = None
    order = [F.col("weight").desc_nulls_last(), F.col("id")]
    level = 0
    while True:
        pending = cut_lineage(pending)
        place = F.struct("x", "y")
        sizes = pending.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("a"), F.max(place).alias("b"))
        single = cut_lineage(sizes.where((F.col("n") > keep) & (F.col("a") == F.col("b"))).select(F.col("tx").alias("_tx"), F.col("ty").alias("_ty")))
        here = (F.col("tx") == F.col("_tx")) & (F.col("ty") == F.col("_ty"))
        parted = pending
        if not single.isEmpty():
            stacked = pending.join(single, here, "left_semi")
            parted = pending.join(single, here, "left_anti")
            done = stacked if done is None else done.unionByName(stacked)
        # a rank with a limit: Spark takes each task's first ones before the shuffle, so a tile of very many features is no load
        shown = cut_lineage(first_per_tile(parted, ["tx", "ty"], order, keep).drop("rank"))
        done = shown if done is None else done.unionByName(shown)
        rest = parted.join(shown.select(F.col("id").alias("_shown")), F.col("id") == F.col("_shown"), "left_anti")
        if rest.isEmpty():
            return done
        level += 1
        e = edge / 2**level
        pending = rest.withColumns({"level": F.lit(level), "tx": F.floor(F.col("x") / e), "ty": F.floor(F.col("y") / e)})


def seeded_sample(points: DataFrame, per_file: DataFrame, file: str, arrival: Sequence[str], seed: int) -> DataFrame:
    """Exactly ``take`` (column of per_file) points of each file, drawn with replacement, repeatable by the seed.

    Draws are row numbers made from the seed; the rows are numbered by a hash of their order, in ranges: a file's rows are
    counted per hash bucket first, so no task numbers a whole file.
    """
    bucket = F.pmod(F.xxhash64(*arrival), F.lit(1024)).cast("int")
    rows = points.withColumn("_b", bucket)
    sizes = rows.groupBy(file, "_b").count()
    w = Window.partitionBy(file).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("count").over(w), F.lit(0))).drop("count")
    inside = Window.partitionBy(file, "_b").orderBy(*arrival)
    numbered = rows.withColumn("_k", F.row_number().over(inside) - 1).join(starts, [file, "_b"]).withColumn("_n", F.col("_k") + F.col("_start"))
    totals = sizes.groupBy(file).agg(F.sum("count").alias("_total")).join(per_file.select(file, "take"), file).where("take > 0 and _total > 0")
    draws = totals.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("take").cast("int"))))
    draws = draws.withColumn("_n", F.pmod(F.xxhash64(F.lit(seed), F.col(file), F.col("_i")), F.col("_total"))).select(file, "_n")
    return draws.join(numbered, [file, "_n"]).drop("_b", "_k", "_n", "_start")
