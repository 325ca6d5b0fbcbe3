"""Queries for the operators on point clouds, tiles and meshes, each with its SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapoint.functions import crs, dtypes
from stratapoint.functions import geometry as G
from stratapoint.operators import drift, octree, records, tiles
from stratapoint.plans import views
from stratapoint.plans.problem_sql import P3_POINTS
from stratapoint.plans.views import LI_ARRIVAL, PTS_EMB_SQL, PTS_LI_N_SQL, PTS_LI_SQL, TREE_SQL
from stratapoint.session import newest, table
from stratapoint.tileset import PREVIEW_POINTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
XYZ = ("x", "y", "z")
LEAF_CAPACITY = 2000


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 6):  # noqa: ANN001, ANN202
    return F.round(c, n)


# ---- points: root, paths, cells ----


@query(f"""WITH f AS (SELECT l_returnflag, min(x) AS ax, min(y) AS ay, min(z) AS az, max(x) AS bx, max(y) AS by_, max(z) AS bz, count(*) AS n FROM {PTS_LI_SQL} GROUP BY 1),
g AS (SELECT min(ax) AS ax, min(ay) AS ay, min(az) AS az, max(bx) AS bx, max(by_) AS by_, max(bz) AS bz, avg(ax) AS mx, avg(ay) AS my, avg(az) AS mz, sum(n)::BIGINT AS n, count(*) AS files FROM f),
s AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) + (bz - az) * (bz - az)) / 125 AS sp FROM g)
SELECT ax AS min_x, ay AS min_y, az AS min_z, bx AS max_x, by_ AS max_y, bz AS max_z, round(mx, 6) AS avg_min_x, round(my, 6) AS avg_min_y, round(mz, 6) AS avg_min_z, n, files,
 round(sp, 6) AS spacing, (bz - az) / least(bx - ax, by_ - ay) < 0.5 AS flat, CASE WHEN sp > 10 THEN 0.01 WHEN sp > 1 THEN 0.1 ELSE 1.0 END::DOUBLE AS scale FROM s""")
def root_stats(spark: SparkSession, d: str) -> DataFrame:
    s = octree.root_statistics(views.pts_li(spark, d), "file")
    return s.withColumns({c: _r(F.col(c)) for c in ("avg_min_x", "avg_min_y", "avg_min_z", "spacing")})


@query(f"SELECT l_returnflag, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, count(*) AS n FROM {PTS_LI_SQL} GROUP BY 1")
def file_bounds(spark: SparkSession, d: str) -> DataFrame:
    return octree.file_bounds(views.pts_li(spark, d), "l_returnflag")


@query(f"""SELECT l_orderkey, l_linenumber, round((((x::FLOAT)::DOUBLE - 1) * 0.1::DOUBLE)::FLOAT::DOUBLE, 4) AS x, round((((y::FLOAT)::DOUBLE - 900) * 0.1::DOUBLE)::FLOAT::DOUBLE, 2) AS y,
 round((((z::FLOAT)::DOUBLE - 0) * 0.1::DOUBLE)::FLOAT::DOUBLE, 6) AS z FROM {PTS_LI_SQL}""")
def offset_scale_f32(spark: SparkSession, d: str) -> DataFrame:
    p = views.pts_li(spark, d)
    moved = {v: _r(G.offset_scaled(F.col(v), F.lit(o), F.lit(0.1)).cast("double"), n) for v, o, n in zip(XYZ, (1.0, 900.0, 0.0), (4, 2, 6), strict=True)}
    return p.select("l_orderkey", "l_linenumber", *[c.alias(v) for v, c in moved.items()])


def _placed(points: DataFrame, levels: int) -> tuple[DataFrame, octree.Root]:
    root = octree.root_of(points)
    return octree.with_nodes(points, root, levels), root


@query(f"WITH {views.path_sql(PTS_LI_SQL, 1, '*')} SELECT node, count(*) AS n FROM placed GROUP BY 1")
def octree_child_hist(spark: SparkSession, d: str) -> DataFrame:
    return _placed(views.pts_li(spark, d), 1)[0].groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {views.path_sql(PTS_LI_N_SQL, 4, '*')} SELECT node, count(*) AS n FROM placed GROUP BY 1")
def octree_path4_hist(spark: SparkSession, d: str) -> DataFrame:
    return _placed(views.pts_li_n(spark, d), 4)[0].groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {views.path_sql(PTS_EMB_SQL, 3, '*')} SELECT vec_id, node FROM placed")
def octree_path3(spark: SparkSession, d: str) -> DataFrame:
    return _placed(views.pts_emb(spark, d), 3)[0].select("vec_id", "node")


@query(f"""WITH {views.path_sql(PTS_LI_SQL, 3, 'node')} SELECT substr(node, 1, k) AS prefix, count(*) AS n FROM placed, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1""")
def node_rollup(spark: SparkSession, d: str) -> DataFrame:
    counts = _placed(views.pts_li(spark, d), 3)[0].groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return octree.prefix_counts(counts, 3)


@query(f"WITH {views.path_sql(PTS_LI_N_SQL, 1, '*')} SELECT node, {views.cell_sql()} AS cell, count(*) AS n FROM placed GROUP BY 1, 2")
def grid_cell_key(spark: SparkSession, d: str) -> DataFrame:
    p, root = _placed(views.pts_li_n(spark, d), 1)
    return p.withColumn("cell", octree.cell_of(root, 1)).groupBy("node", "cell").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {views.path_sql(PTS_LI_N_SQL, 1, '*')}, c AS (SELECT node, {views.cell_sql()} AS cell, count(*) AS n FROM placed GROUP BY 1, 2)
SELECT node, max(n) AS fullest, count(*) AS cells FROM c GROUP BY 1 HAVING max(n) > 100""")
def crowded_cells(spark: SparkSession, d: str) -> DataFrame:
    g = grid_cell_key(spark, d).groupBy("node").agg(F.max("n").alias("fullest"), F.count(F.lit(1)).alias("cells"))
    return g.where("fullest > 100")


@query(f"""WITH {views.path_sql(PTS_EMB_SQL, 1, '*')}, c AS (SELECT *, {views.cell_sql()} AS cell FROM placed)
SELECT node, cell, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY node, cell ORDER BY vec_id) AS rn FROM c) WHERE rn = 1""")
def cell_first_point(spark: SparkSession, d: str) -> DataFrame:
    p, root = _placed(views.pts_emb(spark, d), 1)
    return octree.first_of_cells(p.withColumn("cell", octree.cell_of(root, 1)), ["vec_id"]).select("node", "cell", "vec_id")


@query(f"""WITH {views.path_sql(PTS_EMB_SQL, 1, '*')}, c AS (SELECT vec_id, node, {views.cell_sql()} AS cell, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM placed)
SELECT a.node, a.cell, a.vec_id, count(*) AS conflicts, min(b.vec_id) AS first FROM c a JOIN c b ON a.node = b.node AND a.cell = b.cell AND a.vec_id <> b.vec_id
WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.09 GROUP BY 1, 2, 3""")
def cell_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Points too near to others of their cell: how many these are, and the first of them."""
    p, root = _placed(views.pts_emb(spark, d), 1)
    return octree.conflicts(p.withColumn("cell", octree.cell_of(root, 1)), "vec_id", 0.3)


# ---- level of detail ----


def _lod(spark: SparkSession, d: str) -> tuple[DataFrame, octree.Root]:
    p = views.pts_li_n(spark, d)
    root = octree.root_of(p)
    slim = p.select(*LI_ARRIVAL, *XYZ)
    return octree.build_lod(slim, LI_ARRIVAL, root, LEAF_CAPACITY), root


# deep enough for a few hundred thousand points
LOD_SQL_LEVELS = 6
_LOD_SQL = views.lod_sql(PTS_LI_N_SQL, ", ".join(LI_ARRIVAL), LEAF_CAPACITY, LOD_SQL_LEVELS)


@query(f"WITH {_LOD_SQL} SELECT l_orderkey, l_linenumber, shown_in AS node FROM shown")
def lod_points(spark: SparkSession, d: str) -> DataFrame:
    """Every point with the node that shows it."""
    return _lod(spark, d)[0].select("l_orderkey", "l_linenumber", "node")


@query(f"WITH {_LOD_SQL} SELECT shown_in AS node, count(*) AS n FROM shown GROUP BY 1")
def lod_node_counts(spark: SparkSession, d: str) -> DataFrame:
    return _lod(spark, d)[0].groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LOD_SQL}, {views.prune_sql(LOD_SQL_LEVELS, octree.PRUNE_BELOW)},
e AS (SELECT t.*, EXISTS (SELECT 1 FROM tiles u WHERE length(u.node) > length(t.node) AND starts_with(u.node, t.node)) AS inner_tile FROM tiles t)
SELECT node, level::INTEGER AS level, n, round(CASE WHEN inner_tile THEN 10 * sqrt(sx * sx + sy * sy + sz * sz) / 125 / pow(2, level) ELSE 0 END, 4) AS geometric_error FROM e, s0""")
def lod_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The tile tree after pruning."""
    shown, root = _lod(spark, d)
    counts = shown.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    target = octree.prune_map(counts).select(F.col("node").alias("from"), "target")
    moved = shown.join(target, shown.node == F.col("from")).withColumn("node", F.col("target"))
    return octree.tile_tree(moved, root).select("node", "level", "n", _r("geometric_error", 4).alias("geometric_error"))


@query(f"""WITH {views.path_sql(PTS_LI_N_SQL, 1, '*')} SELECT node, count(*) AS n, round((min(x) + max(x)) / 2, 4) AS center_x, round((min(y) + max(y)) / 2, 4) AS center_y, round((min(z) + max(z)) / 2, 4) AS center_z,
 round((max(x) - min(x)) / 2, 4) AS half_x, round((max(y) - min(y)) / 2, 4) AS half_y, round((max(z) - min(z)) / 2, 4) AS half_z FROM placed GROUP BY 1""")
def node_box(spark: SparkSession, d: str) -> DataFrame:
    p = _placed(views.pts_li_n(spark, d), 1)[0]
    return p.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), *[_r((F.min(v) + F.max(v)) / 2, 4).alias(f"center_{v}") for v in XYZ], *[_r((F.max(v) - F.min(v)) / 2, 4).alias(f"half_{v}") for v in XYZ]
    )


_NODES_SQL = f"WITH {views.path_sql(PTS_EMB_SQL, 3, 'DISTINCT node')}, nodes AS (SELECT DISTINCT substr(node, 1, k) AS node FROM placed, (SELECT unnest([1, 2, 3]) AS k))"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    p = _placed(views.pts_emb(spark, d), 3)[0].select("node").distinct()
    return p.select(F.explode(G.prefixes(F.col("node"))).alias("node")).where("node != ''").distinct()


@query(_NODES_SQL + """, active AS (SELECT node FROM nodes WHERE length(node) = 2 AND node >= '4')
SELECT node FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM active a WHERE starts_with(n.node, a.node))""")
def frontier_ready_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    return octree.ready_nodes(nodes, nodes.where("length(node) = 2 and node >= '4'"))


@query(_NODES_SQL + """SELECT node || node || node || node AS name, CASE WHEN length(node) * 4 <= 8 THEN 'r' || node || node || node || node || '.pnts'
 ELSE substr(node || node || node || node, 1, 8) || '/r' || substr(node || node || node || node, 9) || '.pnts' END AS path FROM nodes""")
def node_path(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select(F.repeat("node", F.lit(4)).alias("name")).select("name", G.node_file(F.col("name"), ".pnts").alias("path"))


@query(_NODES_SQL + """, n AS (SELECT DISTINCT substr(node || node || node, 1, k) AS node FROM nodes, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 9]) AS k))
SELECT node, CASE WHEN length(node) = 0 THEN 0 WHEN length(node) <= 2 THEN 1 WHEN length(node) <= 4 THEN 2 WHEN length(node) <= 6 THEN 3 ELSE 5 END AS depth FROM n""")
def depth_policy(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).select(F.repeat("node", F.lit(3)).alias("t"), F.explode(F.array(*[F.lit(k) for k in (0, 1, 2, 3, 4, 5, 6, 7, 9)])).alias("k"))
    return n.select(F.expr("substring(t, 1, k)").alias("node")).distinct().withColumn("depth", G.task_depth(F.col("node")))


@query(_NODES_SQL + f", r AS (SELECT lx, ly, lz, sx, sy, sz FROM s0) SELECT node, round(10 * sqrt(sx * sx + sy * sy + sz * sz) / 125 / pow(2, length(node)), 6) AS geometric_error, round(sqrt(sx * sx + sy * sy + sz * sz) / 125 / pow(2, length(node)), 6) AS spacing FROM nodes, r")
def node_errors(spark: SparkSession, d: str) -> DataFrame:
    root = octree.root_of(views.pts_emb(spark, d))
    level = F.length("node")
    return _nodes(spark, d).select("node", _r(octree.node_error(root, level)).alias("geometric_error"), _r(octree.node_spacing(root, level)).alias("spacing"))


@query(f"SELECT l_returnflag, count(*) AS n, floor(count(*) * least(1.0::DOUBLE, {PREVIEW_POINTS}::DOUBLE / (SELECT count(*) FROM lineitem)))::BIGINT AS taken FROM {PTS_LI_SQL} GROUP BY 1")
def preview_count(spark: SparkSession, d: str) -> DataFrame:
    """Points of each file in a seeded preview of ``PREVIEW_POINTS`` points, drawn with replacement."""
    p = views.pts_li(spark, d)
    sizes = p.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    total = p.count()
    per_file = sizes.withColumn("take", F.floor(F.col("n") * min(1.0, PREVIEW_POINTS / max(total, 1))))
    drawn = octree.seeded_sample(p, per_file, "l_returnflag", LI_ARRIVAL, 7).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("taken"))
    return sizes.join(drawn, "l_returnflag")


# ---- features ----


@query("""WITH t AS (SELECT c_custkey, floor(c_nationkey / 5.0)::BIGINT AS tx, floor(c_acctbal / 2000.0)::BIGINT AS ty, row_number() OVER (PARTITION BY floor(c_nationkey / 5.0), floor(c_acctbal / 2000.0) ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer)
SELECT c_custkey, tx, ty, rank::INTEGER AS rank FROM t WHERE rank <= 20""")
def spatial_bucket20(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.floor(F.col("c_nationkey") / 5.0).alias("tx"), F.floor(F.col("c_acctbal") / 2000.0).alias("ty"))
    return octree.first_per_tile(c, ["tx", "ty"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 20).drop("c_acctbal")


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS id, c_nationkey::DOUBLE AS x, c_acctbal / 100 AS y, c_acctbal AS weight FROM customer),
q AS (SELECT id, x, y, weight, 0 AS level, floor(x / 50)::BIGINT AS tx, floor(y / 50)::BIGINT AS ty, row_number() OVER (PARTITION BY floor(x / 50), floor(y / 50) ORDER BY weight DESC NULLS LAST, id) AS rank FROM c
 UNION ALL SELECT id, x, y, weight, level + 1, floor(x / (50 / pow(2, level + 1)))::BIGINT, floor(y / (50 / pow(2, level + 1)))::BIGINT,
  row_number() OVER (PARTITION BY floor(x / (50 / pow(2, level + 1))), floor(y / (50 / pow(2, level + 1))) ORDER BY weight DESC NULLS LAST, id) FROM q WHERE rank > 20)
SELECT id, level, tx, ty FROM q WHERE rank <= 20""")
def feature_quadtree(spark: SparkSession, d: str) -> DataFrame:
    """The tile that shows each customer; no twenty-one of the given ones stand at one place."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("x"), (F.col("c_acctbal") / 100).alias("y"), F.col("c_acctbal").alias("weight"))
    return octree.feature_quadtree(c, 50.0).select("id", "level", "tx", "ty")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount >= 0.02 AND l_discount < 0.05")
def points_in_tile(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem")
    return p.where(G.in_tile([F.col("l_quantity"), F.col("l_discount")], [10, 0.02], [20, 0.05])).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("SELECT p_partkey, p_retailprice AS weight FROM part ORDER BY p_retailprice DESC, p_partkey")
def by_weight(spark: SparkSession, d: str) -> DataFrame:
    return octree.by_weight(table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("weight")), "weight", "p_partkey")


# ---- tile trees ----


@query(f"""WITH RECURSIVE t AS (SELECT * FROM {TREE_SQL}), down AS (SELECT parent_id AS tile_id, tile_id AS descendant, 1::BIGINT AS distance FROM t WHERE parent_id IS NOT NULL
 UNION ALL SELECT t.parent_id, d.descendant, d.distance + 1 FROM down d JOIN t ON t.tile_id = d.tile_id WHERE t.parent_id IS NOT NULL) SELECT * FROM down""")
def tile_descendants(spark: SparkSession, d: str) -> DataFrame:
    from stratapoint.operators.hierarchy import descendants, resolve_hierarchy

    t = views.tree(spark, d).select(F.col("tile_id").alias("id"), F.col("parent_id").alias("parent"))
    return descendants(resolve_hierarchy(t, with_path=True)).select(F.col("ancestor").alias("tile_id"), F.col("id").alias("descendant"), "distance")


@query(f"SELECT p.tile_id AS parent, c.tile_id AS child FROM {TREE_SQL} c JOIN {TREE_SQL} p ON c.parent_id = p.tile_id")
def tile_children(spark: SparkSession, d: str) -> DataFrame:
    return tiles.children(views.tree(spark, d))


@query(f"""WITH RECURSIVE t AS (SELECT * FROM {TREE_SQL}), r AS (SELECT tile_id, refine FROM t WHERE parent_id IS NULL UNION ALL SELECT t.tile_id, coalesce(t.refine, r.refine) FROM r JOIN t ON t.parent_id = r.tile_id)
SELECT tile_id, refine FROM r""")
def refine_inherited(spark: SparkSession, d: str) -> DataFrame:
    return tiles.inherited(views.tree(spark, d), "refine")


@query(f"""WITH RECURSIVE t AS (SELECT * FROM {TREE_SQL}), r AS (SELECT tile_id, refine FROM t WHERE parent_id IS NULL UNION ALL SELECT t.tile_id, coalesce(t.refine, r.refine) FROM r JOIN t ON t.parent_id = r.tile_id)
SELECT coalesce(sum(t.tile_id % 7), 0)::BIGINT AS n FROM t JOIN r ON t.tile_id = r.tile_id WHERE t.tile_id NOT IN (SELECT parent_id FROM t WHERE parent_id IS NOT NULL) OR r.refine = 'ADD'""")
def refine_points(spark: SparkSession, d: str) -> DataFrame:
    return tiles.shown_points(views.tree(spark, d).withColumn("n", F.col("tile_id") % 7))


@query(f"""WITH RECURSIVE t AS (SELECT * FROM {TREE_SQL}), down AS (SELECT parent_id AS tile_id, value FROM t WHERE parent_id IS NOT NULL
 UNION ALL SELECT t.parent_id, d.value FROM down d JOIN t ON t.tile_id = d.tile_id WHERE t.parent_id IS NOT NULL) SELECT tile_id, max(value) AS below, count(*) AS n_below FROM down GROUP BY 1""")
def tree_error_propagation(spark: SparkSession, d: str) -> DataFrame:
    return tiles.subtree_max(views.tree(spark, d), "value")


_TILES_SQL = """newest AS (SELECT * FROM (SELECT tile_id, CASE WHEN parent_id >= 0 THEN parent_id END AS parent_id, elem_max_size, has_content, transform, box, row_number() OVER (PARTITION BY tile_id ORDER BY written_at DESC, parent_id DESC NULLS LAST) AS rn FROM tile_info) WHERE rn = 1)"""


def _tile_info(spark: SparkSession, d: str) -> DataFrame:
    t = newest(table(spark, d, "tile_info").select("tile_id", "written_at", "parent_id", "elem_max_size", "has_content", "transform", "box"), "tile_id", "written_at")
    return t.withColumn("parent_id", F.when(F.col("parent_id") >= 0, F.col("parent_id")))


@query(f"""WITH RECURSIVE {_TILES_SQL}, up AS (SELECT t.*, p.tile_id AS parent FROM newest t LEFT JOIN newest p ON t.parent_id = p.tile_id),
tree AS (SELECT tile_id FROM up WHERE parent IS NULL UNION ALL SELECT u.tile_id FROM tree t JOIN up u ON u.parent = t.tile_id),
down AS (SELECT parent AS tile_id, tile_id AS below FROM up WHERE parent IS NOT NULL AND tile_id IN (SELECT tile_id FROM tree)
 UNION ALL SELECT u.parent, d.below FROM down d JOIN up u ON u.tile_id = d.tile_id WHERE u.parent IS NOT NULL),
agg AS (SELECT d.tile_id, max(CASE WHEN b.has_content THEN b.elem_max_size END) AS error, bool_or(b.has_content) AS filled FROM down d JOIN up b ON b.tile_id = d.below GROUP BY 1)
SELECT u.tile_id, coalesce(a.error, 0)::DOUBLE AS geometric_error, coalesce(u.has_content, false) OR coalesce(a.filled, false) AS kept FROM up u JOIN tree USING (tile_id) LEFT JOIN agg a ON a.tile_id = u.tile_id""")
def tile_errors(spark: SparkSession, d: str) -> DataFrame:
    return tiles.geometric_errors(_tile_info(spark, d))


_CORNERS = "(SELECT unnest([-1.0, 1.0])::DOUBLE AS sx) a, (SELECT unnest([-1.0, 1.0])::DOUBLE AS sy) b, (SELECT unnest([-1.0, 1.0])::DOUBLE AS sz) c"


@query(f"""WITH {_TILES_SQL}, k AS (SELECT parent_id, tile_id, box[1] + sx * box[4] + sy * box[7] + sz * box[10] AS x, box[2] + sx * box[5] + sy * box[8] + sz * box[11] AS y, box[3] + sx * box[6] + sy * box[9] + sz * box[12] AS z
 FROM newest, {_CORNERS} WHERE box IS NOT NULL AND parent_id IS NOT NULL)
SELECT parent_id, count(DISTINCT tile_id) AS n, round((min(x) + max(x)) / 2, 4) AS cx, round((min(y) + max(y)) / 2, 4) AS cy, round((min(z) + max(z)) / 2, 4) AS cz,
 round((max(x) - min(x)) / 2, 4) AS hx, round((max(y) - min(y)) / 2, 4) AS hy, round((max(z) - min(z)) / 2, 4) AS hz FROM k GROUP BY 1""")
def box_union_corners(spark: SparkSession, d: str) -> DataFrame:
    t = _tile_info(spark, d).where("box is not null and parent_id is not null").withColumn("transform", F.lit(None).cast("array<double>"))
    return _box_columns(tiles.box_of_children(t))


def _box_columns(df: DataFrame) -> DataFrame:
    e = lambda k: _r(F.element_at("box", k + 1), 4)
    return df.select("parent_id", "n", e(0).alias("cx"), e(1).alias("cy"), e(2).alias("cz"), e(3).alias("hx"), e(7).alias("hy"), e(11).alias("hz"))


_T = "coalesce(transform, [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]::DOUBLE[])"


@query(f"""WITH {_TILES_SQL}, k AS (SELECT parent_id, tile_id, {_T} AS m, box[1] + sx * box[4] + sy * box[7] + sz * box[10] AS x, box[2] + sx * box[5] + sy * box[8] + sz * box[11] AS y, box[3] + sx * box[6] + sy * box[9] + sz * box[12] AS z
 FROM newest, {_CORNERS} WHERE box IS NOT NULL AND parent_id IS NOT NULL),
w AS (SELECT parent_id, tile_id, m[1] * x + m[5] * y + m[9] * z + m[13] AS x, m[2] * x + m[6] * y + m[10] * z + m[14] AS y, m[3] * x + m[7] * y + m[11] * z + m[15] AS z FROM k)
SELECT parent_id, count(DISTINCT tile_id) AS n, round((min(x) + max(x)) / 2, 3) AS cx, round((min(y) + max(y)) / 2, 3) AS cy, round((min(z) + max(z)) / 2, 3) AS cz,
 round((max(x) - min(x)) / 2, 3) AS hx, round((max(y) - min(y)) / 2, 3) AS hy, round((max(z) - min(z)) / 2, 3) AS hz FROM w GROUP BY 1""")
def obb_transform(spark: SparkSession, d: str) -> DataFrame:
    b = _box_columns(tiles.box_of_children(_tile_info(spark, d)))
    return b.withColumns({c: F.round(c, 3) for c in ("cx", "cy", "cz", "hx", "hy", "hz")})


@query(f"""WITH {_TILES_SQL}, c AS (SELECT tile_id, box[1] AS x, box[2] AS y, box[3] AS z, transform AS m FROM newest WHERE box IS NOT NULL AND transform IS NOT NULL),
w AS (SELECT *, m[4] * x + m[8] * y + m[12] * z + m[16] AS w FROM c)
SELECT tile_id, round((m[1] * x + m[5] * y + m[9] * z + m[13]) / w, 4) AS x, round((m[2] * x + m[6] * y + m[10] * z + m[14]) / w, 4) AS y, round((m[3] * x + m[7] * y + m[11] * z + m[15]) / w, 4) AS z FROM w""")
def projective_transform(spark: SparkSession, d: str) -> DataFrame:
    t = _tile_info(spark, d).where("box is not null and transform is not null")
    p = G.affine([F.element_at("box", k) for k in (1, 2, 3)], F.col("transform"))
    return t.select("tile_id", *[_r(c, 4).alias(v) for c, v in zip(p, XYZ, strict=True)])


# ---- schemas, sets, joins ----


@query("""SELECT x, y, coalesce(intensity, 0)::DOUBLE AS intensity, coalesce(classification, 0)::INTEGER AS classification FROM
(SELECT l_quantity AS x, l_extendedprice AS y, l_tax AS intensity, NULL AS classification FROM lineitem WHERE l_returnflag = 'A' UNION ALL
 SELECT l_quantity, l_extendedprice, NULL, l_linenumber FROM lineitem WHERE l_returnflag <> 'A')""")
def merge_fill_zero(spark: SparkSession, d: str) -> DataFrame:
    p = views.pts_li(spark, d)
    return tiles.merge_zero_filled([p.where("file = 'A'").select("x", "y", "intensity"), p.where("file != 'A'").select("x", "y", "classification")])


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def merge_strict(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select("l_returnflag", "l_tax")
    return tiles.merge_strict([p.where("l_returnflag = 'A'"), p.where("l_returnflag = 'R'"), p.where("l_returnflag is null or l_returnflag not in ('A', 'R')")]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events)""")
def attr_on_all_groups(spark: SparkSession, d: str) -> DataFrame:
    return tiles.on_every_group(table(spark, d, "events"), "event_type", "user_id")


@query("""WITH f AS (SELECT p_partkey % 50 AS t, p_partkey // 50 AS k, [1, 2, 4, 8][(p_size % 4) + 1]::BIGINT AS item, 1 + p_size % 3 AS width FROM part),
a AS (SELECT t, k, item, item * width * 3 AS size FROM f), r AS (
 WITH RECURSIVE o AS (SELECT t, k, 0::BIGINT AS byte_offset, size AS byte_length FROM a WHERE k = (SELECT min(k) FROM a b WHERE b.t = a.t)
 UNION ALL SELECT a.t, a.k, (ceil((o.byte_offset + o.byte_length)::DOUBLE / a.item) * a.item)::BIGINT, a.size FROM o JOIN a ON a.t = o.t AND a.k = o.k + 1) SELECT * FROM o)
SELECT t::BIGINT AS t, k::INTEGER AS k, byte_offset, byte_length::BIGINT AS byte_length FROM r""")
def batch_offsets(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("t"), F.expr("cast(p_partkey div 50 as int)").alias("k"), F.element_at(F.array(*[F.lit(v) for v in (1, 2, 4, 8)]), (F.col("p_size") % 4 + 1).cast("int")).cast("long").alias("item"), (1 + F.col("p_size") % 3).alias("width"), F.lit(3).alias("n"))
    return tiles.batch_offsets(p, "t", "k")


@query("SELECT p_partkey, ((8 - p_partkey % 8) % 8)::BIGINT AS padding, '_' || upper(p_brand) AS mangled, lower(p_brand) AS plain, regexp_matches(p_name, '^[a-zA-Z_][a-zA-Z0-9_]*$') AS valid_id FROM part")
def names_and_padding(spark: SparkSession, d: str) -> DataFrame:
    m = G.mangled(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", G.padding(F.col("p_partkey"), 8).alias("padding"), m.alias("mangled"), G.plain(m).alias("plain"), G.is_identifier(F.col("p_name")).alias("valid_id"))


@query("""SELECT n_regionkey AS class_id, n_nationkey, (row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1)::BIGINT AS instance FROM nation""")
def bth_instances(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("class_id"), "n_nationkey")
    return tiles.class_instances(n, "class_id", [F.col("n_nationkey")])


@query("""WITH r AS (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region), n AS (SELECT n_nationkey, n_regionkey, (SELECT count(*) FROM region) + row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT n.i::BIGINT AS instance, r.i::BIGINT AS parent_instance FROM n JOIN r ON n.n_regionkey = r.r_regionkey""")
def bth_parent_ids(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select(F.lit(0).alias("class_id"), F.col("r_regionkey").alias("key"), F.lit(None).cast("int").alias("up"))
    n = table(spark, d, "nation").select(F.lit(1).alias("class_id"), F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("up"))
    i = tiles.class_instances(r.unionByName(n), "class_id", [F.col("key")])
    parents = i.where("class_id = 0").select(F.col("key").alias("up"), F.col("instance").alias("parent_instance"))
    return i.where("class_id = 1").join(parents, "up").select("instance", "parent_instance")


@query("""WITH n AS (SELECT file_id, extra_fields FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY loaded_at DESC) AS rn FROM reader_metadata) WHERE rn = 1),
e AS (SELECT trim(e.name) AS name, regexp_replace(lower(trim(e.dtype)), '^[<>|=]', '') AS t FROM (SELECT unnest(extra_fields) AS e FROM n)),
k AS (SELECT name, CASE t WHEN 'int8' THEN 'i1' WHEN 'int16' THEN 'i2' WHEN 'int32' THEN 'i4' WHEN 'uint8' THEN 'u1' WHEN 'uint16' THEN 'u2' WHEN 'uint32' THEN 'u4' WHEN 'float32' THEN 'f4' WHEN 'float64' THEN 'f8' ELSE t END AS t FROM e),
b AS (SELECT name, string_agg(DISTINCT t, ',' ORDER BY t) AS types, max(CASE WHEN t[1] = 'f' THEN t[2]::INT END) AS f, max(CASE WHEN t[1] = 'i' THEN t[2]::INT END) AS i, max(CASE WHEN t[1] = 'u' THEN t[2]::INT END) AS u FROM k GROUP BY 1)
SELECT name, types, CASE
 WHEN f IS NOT NULL THEN CASE WHEN f = 8 OR greatest(coalesce(i, 0), coalesce(u, 0)) >= 4 THEN 'f8' ELSE 'f4' END
 WHEN i IS NULL THEN 'u' || u WHEN u IS NULL OR u < i THEN 'i' || i ELSE 'i' || u * 2 END AS promoted FROM b""")
def dtype_promotion(spark: SparkSession, d: str) -> DataFrame:
    files = newest(table(spark, d, "reader_metadata").select("file_id", "loaded_at", "extra_fields"), "file_id", "loaded_at")
    f = files.select(F.explode("extra_fields").alias("f")).select(F.trim("f.name").alias("name"), drift.type_key(F.col("f.dtype")).alias("type"))
    return dtypes.unify_fields(f).select("name", "types", "promoted")


@query("SELECT crs_in, count(DISTINCT file_id) AS files FROM reader_metadata WHERE crs_in IS NOT NULL GROUP BY 1")
def crs_in_use(spark: SparkSession, d: str) -> DataFrame:
    return crs.in_use(table(spark, d, "reader_metadata"), "file_id", "crs_in").withColumnRenamed("crs", "crs_in")


# ---- coordinates and colours ----

_GEO = "(SELECT event_id, (user_id % 360 - 180)::DOUBLE AS lon, (event_id % 160 - 80)::DOUBLE AS lat, value AS h FROM events)"


def _geo(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", (F.col("user_id") % 360 - 180).cast("double").alias("x"), (F.col("event_id") % 160 - 80).cast("double").alias("y"), F.col("value").alias("z"))


@query(f"SELECT event_id, round(radians(lon) * 6378137.0::DOUBLE, 3) + 0.0 AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0::DOUBLE, 3) + 0.0 AS y FROM {_GEO}")
def webmercator(spark: SparkSession, d: str) -> DataFrame:
    return crs.reproject(_geo(spark, d), 4326, 3857).select("event_id", *[(F.round(v, 3) + 0.0).alias(v) for v in ("x", "y")])


@query(f"""WITH g AS (SELECT event_id, radians(lon) AS lo, radians(lat) AS la, h, 0.0066943799901413165::DOUBLE AS e2 FROM {_GEO}), n AS (SELECT *, 6378137.0::DOUBLE / sqrt(1 - e2 * sin(la) * sin(la)) AS n FROM g)
SELECT event_id, round((n + h) * cos(la) * cos(lo), 3) + 0.0 AS x, round((n + h) * cos(la) * sin(lo), 3) + 0.0 AS y, round((n * (1 - e2) + h) * sin(la), 3) + 0.0 AS z FROM n""")
def ecef(spark: SparkSession, d: str) -> DataFrame:
    return crs.reproject(_geo(spark, d), 4326, 4978).select("event_id", *[(F.round(v, 3) + 0.0).alias(v) for v in XYZ])


@query("SELECT count(*) AS n, 0::BIGINT AS off FROM events")
def conic_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Degrees to a conic zone, to a transverse Mercator zone, and back: rows that come back more than a millimetre off."""
    g = table(spark, d, "events").select("event_id", (F.col("event_id") % 7).cast("double").alias("x"), (F.col("event_id") % 10 + 41).cast("double").alias("y"), F.lit(0.0).alias("z"))
    there = crs.reproject(crs.reproject(g.withColumns({"gx": F.col("x"), "gy": F.col("y")}), 4326, 3950), 3950, 32631)
    back = crs.reproject(there, 32631, 4326)
    off = (F.abs(F.col("x") - F.col("gx")) > 2e-8) | (F.abs(F.col("y") - F.col("gy")) > 2e-8)
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("off"))


@query(f"SELECT l_orderkey, l_linenumber, floor(least(greatest(y * 1.5, 0), 65535) / 256)::INTEGER AS red, floor(least(greatest(x * 5.1::DOUBLE, 0), 255))::INTEGER AS green FROM {PTS_LI_SQL}")
def color_scale(spark: SparkSession, d: str) -> DataFrame:
    p = views.pts_li(spark, d)
    return p.select("l_orderkey", "l_linenumber", G.colour(F.col("y"), 1.5, 65535.0, 256.0).alias("red"), G.colour(F.col("x"), 5.1, 255.0).alias("green"))


@query("SELECT p_partkey, round(p_size + (p_partkey % 60) / 60.0::DOUBLE + (p_partkey % 59) / 3600.0::DOUBLE + (p_partkey % 1000) / 3600e6::DOUBLE, 7) AS degrees FROM part")
def dms_to_deg(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", F.round(G.dms_degrees(F.col("p_size"), k % 60, k % 59, k % 1000), 7).alias("degrees"))


@query("""WITH m AS (SELECT p_partkey, (p_size / 50.0)::DOUBLE AS s, (p_partkey % 1100)::DOUBLE AS ns FROM part), l AS (SELECT *, 0.2125::DOUBLE * s + 0.7154::DOUBLE * s * 0.1::DOUBLE + 0.0721::DOUBLE * s * 0.1::DOUBLE AS lum FROM m)
SELECT p_partkey, round(least(greatest(1 - ns / 1000, 0), 1) * CASE WHEN lum < 0.1 THEN 1 - lum ELSE 1 END, 12) AS roughness, round(s, 6) AS metallic FROM l""")
def luminance_roughness(spark: SparkSession, d: str) -> DataFrame:
    from stratapoint.sources.obj import material_columns

    m = table(spark, d, "part").select("p_partkey", F.array(F.col("p_size") / 50.0, F.col("p_size") / 50.0 * 0.1, F.col("p_size") / 50.0 * 0.1).alias("specular"), (F.col("p_partkey") % 1100).cast("double").alias("shininess"), F.lit(1.0).alias("opacity"))
    c = material_columns(F.col("specular"), F.col("shininess"), F.col("opacity"))
    return m.select("p_partkey", _r(c["roughness"], 12).alias("roughness"), _r(c["metallic"]).alias("metallic"))


# ---- delimited points ----

_READABLE = f"""(SELECT file_id, x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y, z::FLOAT::DOUBLE AS z, intensity::FLOAT::DOUBLE AS intensity, classification FROM ({P3_POINTS}))"""


def _xyz_points(spark: SparkSession, d: str) -> DataFrame:
    """All points of the delimited files, coordinates and intensity in single precision; repeated rows count once."""
    lines = table(spark, d, "xyz_lines").select("line_id", "file_id", "line_no", "line").distinct()
    good = records.read_records(lines, table(spark, d, "xyz_files")).where("reason is null")
    return good.select("file_id", *[F.col(v).cast("float").alias(v) for v in (*XYZ, "intensity")], "classification")


@query(f"SELECT file_id, x, y, z, intensity, classification FROM {_READABLE}")
def xyz_scan(spark: SparkSession, d: str) -> DataFrame:
    return _xyz_points(spark, d).select("file_id", *[F.col(v).cast("double").alias(v) for v in (*XYZ, "intensity")], "classification")


@query(f"SELECT file_id, count(*) AS n, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM {_READABLE} GROUP BY 1")
def xyz_metadata(spark: SparkSession, d: str) -> DataFrame:
    b = octree.file_bounds(_xyz_points(spark, d), "file_id")
    return b.select("file_id", "n", *[F.col(f"{m}_{v}").cast("double").alias(f"{m}_{v}") for m in ("min", "max") for v in XYZ])


# the other groups of queries add themselves
from stratapoint.plans import contents, files, meshes, trees  # noqa: E402, F401
