"""Queries that write the test tables to files of the kinds that are read and written here, and read them back.

Files go to a new folder below the shared one (``session.shared_folder``), one per supplier, region or tileset, written by tasks.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapoint import export as X
from stratapoint import tileset as T
from stratapoint.codecs import b3dm, batch_table, glb, pnts
from stratapoint.convert import PointTiler, convert
from stratapoint.functions import matrices as M
from stratapoint.operators import tiles
from stratapoint.plans.catalogue import query
from stratapoint.session import new_folder, table
from stratapoint.sources import las, named_crs, obj, ply, step, wkb


def _written(df: DataFrame, key: str, write: Callable[[pd.DataFrame], str]) -> list[str]:
    """The files that ``write`` makes of each key's rows, in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [write(pdf)]})

    return sorted(r.path for r in df.groupBy(key).applyInPandas(run, "path string").collect())  # one short row a file; a sort by ranges would write them twice


def _number(path: str = "path") -> Column:
    """The key in a file's name, as 00017.las."""
    return F.regexp_extract(path, r"([0-9]+)\.[a-z]+$", 1).cast("long")


def _by_supplier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("l_suppkey"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")


def _las_files(spark: SparkSession, d: str, suffix: str = "las") -> list[str]:
    folder = new_folder(spark, "las")

    def write(pdf: pd.DataFrame) -> str:
        key = int(pdf["l_suppkey"].iloc[0])
        path = os.path.join(folder, f"{key:08d}.{suffix}")
        pdf = pdf.sort_values(["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
        xyz = pdf[["l_quantity", "l_extendedprice", "l_discount"]].to_numpy(float)
        las.write(path, xyz, np.column_stack([pdf["l_linenumber"] * 256, pdf["l_quantity"] * 256, np.full(len(pdf), 65535)]).astype(int), scale=0.01, crs=3857 if key % 2 else None, intensity=pdf["l_orderkey"].to_numpy() % 60000, point_source_id=key % 60000)
        return path

    return _written(_by_supplier(spark, d), "l_suppkey", write)


_LAS_SQL = """SELECT l_suppkey::BIGINT AS file, round(l_quantity, 2) AS x, round(l_extendedprice, 2) AS y, round(l_discount, 2) AS z, l_linenumber::INTEGER AS red, l_quantity::INTEGER AS green, 255 AS blue, (l_orderkey % 60000)::INTEGER AS intensity FROM lineitem"""


def _las_points(spark: SparkSession, files: list[str]) -> DataFrame:
    points = las.scan(spark, files, ("intensity",))
    return points.select(_number().alias("file"), *[F.round(v, 2).alias(v) for v in "xyz"], *[F.col(c).cast("int").alias(c) for c in ("red", "green", "blue")], "intensity")


@query(_LAS_SQL)
def las_scan(spark: SparkSession, d: str) -> DataFrame:
    return _las_points(spark, _las_files(spark, d))


@query(_LAS_SQL)
def laz_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same, compressed."""
    return _las_points(spark, _las_files(spark, d, "laz"))


@query("""SELECT l_suppkey::BIGINT AS file, count(*) AS point_count, CASE WHEN l_suppkey % 2 = 1 THEN 'EPSG:3857' ELSE '' END AS crs, true AS has_color, round(min(l_quantity), 2) AS low_x, round(max(l_extendedprice), 2) AS high_y FROM lineitem GROUP BY l_suppkey""")
def las_metadata(spark: SparkSession, d: str) -> DataFrame:
    files = _las_files(spark, d)
    m = las.metadata(spark, files).drop("crs_in").join(named_crs(spark, files), "path")
    return m.select(_number().alias("file"), "point_count", F.coalesce("crs", F.lit("")).alias("crs"), "has_color", F.round(F.element_at("aabb", 1), 2).alias("low_x"), F.round(F.element_at("aabb", 5), 2).alias("high_y"))


@query("""SELECT l_suppkey::BIGINT AS file, l_quantity AS x, round(l_extendedprice::FLOAT::DOUBLE, 2) AS y, round(l_discount, 2) AS z, (l_linenumber * 30)::INTEGER AS red, l_orderkey::DOUBLE AS order_key FROM lineitem""")
def ply_scan(spark: SparkSession, d: str) -> DataFrame:
    """A third each as text, little and big endian; the property comes out under another name."""
    folder = new_folder(spark, "ply")

    def write(pdf: pd.DataFrame) -> str:
        key = int(pdf["l_suppkey"].iloc[0])
        path = os.path.join(folder, f"{key:08d}.ply")
        red = (pdf["l_linenumber"] * 30).to_numpy(np.uint8)
        columns = {"x": pdf["l_quantity"].to_numpy(float), "y": pdf["l_extendedprice"].to_numpy(np.float32), "z": pdf["l_discount"].to_numpy(float), "red": red, "green": red, "blue": red, "key": pdf["l_orderkey"].to_numpy(np.int32)}
        ply.write(path, columns, ("", "<", ">")[key % 3])
        return path

    points = ply.with_renamed_property(ply.scan(spark, _written(_by_supplier(spark, d), "l_suppkey", write), ("key",)), "key", "order_key")
    return points.select(_number().alias("file"), "x", F.round("y", 2).alias("y"), F.round("z", 2).alias("z"), F.col("red").cast("int").alias("red"), "order_key")


@query("""SELECT s_suppkey::BIGINT AS file, f::BIGINT AS face, c::INTEGER AS corner, 'm' || (s_nationkey % 3) AS material, CASE WHEN c = 0 THEN 0 ELSE f + c END::DOUBLE AS x, (s_nationkey)::DOUBLE AS y, CASE WHEN c = 0 THEN 0 ELSE -(f + c) END::DOUBLE AS v
FROM supplier, range(3) a(f), range(3) b(c)""")
def obj_scan(spark: SparkSession, d: str) -> DataFrame:
    """One fan of five corners a supplier: three triangles, un-indexed, the second texture axis turned."""
    folder = new_folder(spark, "obj")

    def write(pdf: pd.DataFrame) -> str:
        key, nation = int(pdf["s_suppkey"].iloc[0]), int(pdf["s_nationkey"].iloc[0])
        lines = [f"v {k} {nation} 0" for k in range(5)] + [f"vt 0.5 {k}" for k in range(5)] + ["o thing", f"usemtl m{nation % 3}", "f " + " ".join(f"{k}/{k}" for k in range(1, 6))]
        path = os.path.join(folder, f"{key:08d}.obj")
        with open(path, "w", encoding="utf-8") as f:
            f.write("\n".join(lines))
        return path

    files = _written(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey", write)
    c = obj.scan(spark, files)
    return c.select(_number().alias("file"), "face", "corner", "material", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col("v").cast("double") + 0.0).alias("v"))


@query("SELECT s_suppkey::BIGINT AS file, 4 AS n_points, round(s_nationkey + 1.0, 3) AS width FROM supplier")
def wkb_directory(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "wkb")

    def write(pdf: pd.DataFrame) -> str:
        w = float(pdf["s_nationkey"].iloc[0]) + 1
        path = os.path.join(folder, f"{int(pdf['s_suppkey'].iloc[0]):08d}.wkb")
        with open(path, "wb") as f:
            f.write(wkb.write([[[(0.0, 0.0, 1.0), (w, 0.0, 1.0), (w, 2.0, 1.0), (0.0, 2.0, 1.0)]]], "<"))
        return path

    _written(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey", write)
    files = wkb.directory(spark, folder)
    per = wkb.points(files).groupBy("geom_id").agg(F.count(F.lit(1)).cast("int").alias("n_points"), F.round(F.max("x") - F.min("x"), 3).alias("width"))
    return files.select("geom_id", _number().alias("file")).join(per, "geom_id").select("file", "n_points", "width")


@query("SELECT s_suppkey::BIGINT AS tile, CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 93 END AS size FROM supplier")
def tile_contents(spark: SparkSession, d: str) -> DataFrame:
    """Tiles with their content by its address; every third one's is missing."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("tile"))
    folder = new_folder(spark, "a.b+c")  # signs that mean something in patterns

    def write(pdf: pd.DataFrame) -> str:
        path = os.path.join(folder, "sub", f"{int(pdf['tile'].iloc[0])}.bin")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(b"x" * 93)
        return path

    _written(s.where("tile % 3 != 0"), "tile", write)
    found = tiles.with_contents(s.withColumn("content_uri", F.concat(F.lit("sub/"), F.col("tile").cast("string"), F.lit(".bin"))), folder)
    return found.select("tile", F.coalesce(F.length("content"), F.lit(-1)).alias("size"))


# ---- tilesets ----


def _region_sets(spark: SparkSession, d: str, folder: str) -> list[str]:
    """A tileset a region: a tile a nation, as wide as its key, moved along with the region; a content of points at the root."""

    def write(pdf: pd.DataFrame) -> str:
        region = int(pdf["n_regionkey"].iloc[0])
        root = T.Tile(100.0, transform=M.translation([1000.0 * region, 0, 0]), refine=T.REPLACE, content_uri="root.pnts")
        for nation in sorted(pdf["n_nationkey"]):
            low = np.array([10.0 * nation, 0.0, 0.0])
            child = T.Tile(float(nation), T.box_from_bounds(low, low + [1 + nation % 4, 2, 3]), M.translation([0, float(region), 0]))
            root.add_child(child)
        path = os.path.join(folder, f"{region:08d}")
        os.makedirs(path, exist_ok=True)
        p = np.array([[10.0 * n, 1.0, 2.0] for n in sorted(pdf["n_nationkey"])], np.float32)
        with open(os.path.join(path, "root.pnts"), "wb") as f:
            f.write(pnts.encode(pnts.from_arrays(p, np.full((len(p), 3), region, np.uint8), {"nation": p[:, 0]})))
        T.TileSet(root, 200.0).write(os.path.join(path, "tileset.json"))
        return os.path.join(path, "tileset.json")

    return _written(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey", write)


@query("""SELECT n_regionkey::BIGINT AS region, count(*) AS tiles, count(*) AS shown, round(1000.0 * n_regionkey + min(10 * n_nationkey), 3)::DOUBLE AS low_x, round(1000.0 * n_regionkey + max(10 * n_nationkey + 1 + n_nationkey % 4), 3)::DOUBLE AS high_x,
 round(n_regionkey, 3)::DOUBLE AS low_y, max(n_nationkey)::DOUBLE AS error, 'REPLACE' AS refine FROM nation GROUP BY 1, n_regionkey""")
def tileset_files(spark: SparkSession, d: str) -> DataFrame:
    """Tilesets written, read back, their contents fetched, and their files deleted again."""
    folder = new_folder(spark, "tilesets")
    files = _region_sets(spark, d, folder)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                ts = T.TileSet.read(path)
                corners = T.box_corners(ts.root.world_box())
                shown = sum(len(c[1]) for _, c in ts.contents())
                below = list(ts.root.descendants())
                rows.append((int(os.path.basename(os.path.dirname(path))), len(below), shown, round(corners[:, 0].min(), 3), round(corners[:, 0].max(), 3), round(corners[:, 1].min(), 3), max(t.geometric_error for t in below), ts.root.refine))
            yield pd.DataFrame(rows, columns=["region", "tiles", "shown", "low_x", "high_x", "low_y", "error", "refine"])

    found = spark.createDataFrame([(f,) for f in files], "path string").mapInPandas(read, "region long, tiles long, shown long, low_x double, high_x double, low_y double, error double, refine string")
    rows = found.collect()  # one a region, before the files go
    for f in files:
        T.TileSet.read(f).delete(f)
    if any(names for _, _, names in os.walk(folder)):
        raise RuntimeError(f"files left in {folder}")
    return spark.createDataFrame(rows, found.schema)


@query("""WITH b AS (SELECT n_regionkey, 1000.0::DOUBLE * n_regionkey + min(10 * n_nationkey) AS ax, 1000.0::DOUBLE * n_regionkey + max(10 * n_nationkey + 1 + n_nationkey % 4) AS bx, n_regionkey::DOUBLE AS ay, n_regionkey + 2.0::DOUBLE AS by_ FROM nation GROUP BY 1),
w AS (SELECT min(ax) AS ax, max(bx) AS bx, min(ay) AS ay, max(by_) AS by_, count(*) AS n FROM b)
SELECT n AS children, round((ax + bx) / 2, 3) AS center_x, round((ay + by_) / 2, 3) AS center_y, round(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) + 9), 3) AS error, (SELECT count(*) FROM nation) AS preview, (SELECT count(*) FROM nation) AS tiles FROM w""")
def tileset_merge(spark: SparkSession, d: str) -> DataFrame:
    """All regions' tilesets below a new root: its centre, error, preview points and the tiles reached through its links."""
    folder = new_folder(spark, "merged")
    merged = T.merge_files(_region_sets(spark, d, folder), os.path.join(folder, "tileset.json"))
    back = T.TileSet.read(os.path.join(folder, "tileset.json"))
    sample = back.fetch(back.root)[1]
    reached = sum(len(list(c[1].root.descendants())) for _, c in back.contents() if c[0] == "tileset")
    center = merged.root.transform[:3, 3]
    row = (len(back.root.children), round(float(center[0]), 3), round(float(center[1]), 3), round(back.root.geometric_error, 3), len(sample), reached)
    return spark.createDataFrame([row], "children long, center_x double, center_y double, error double, preview long, tiles long")


# ---- conversion ----


@query("SELECT (l_suppkey % 60000)::DOUBLE AS source, count(*) AS n, round(sum(l_quantity), 2)::DOUBLE AS x, sum((l_orderkey % 60000)::DOUBLE) AS intensity FROM lineitem GROUP BY 1")
def convert_points(spark: SparkSession, d: str) -> DataFrame:
    """Files to a tileset and back: per source file the points in all contents but the root's sample, with their fields."""
    out = os.path.join(new_folder(spark, "convert"), "out")
    ts = convert(spark, _las_files(spark, d), out, [PointTiler(fields=["intensity", "point_source_id"], force_crs_in=True, crs_in=3857)])
    # back from the tiles' own frame
    scale, offset = float(ts.root.transform[0, 0]), float(ts.root.transform[0, 3])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                c = pnts.decode(bytes(content))
                yield pd.DataFrame({"source": np.asarray(c.properties["point_source_id"], float), "x": c.positions[:, 0].astype(float) * scale + offset, "intensity": np.asarray(c.properties["intensity"], float)})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pnts").load(out).where("path not like '%/r.pnts'")
    points = files.select("content").mapInPandas(read, "source double, x double, intensity double")
    return points.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round("x", 1)), 2).alias("x"), F.sum("intensity").alias("intensity"))


def _squares(spark: SparkSession, d: str) -> DataFrame:
    """A standing-up square of each part's size, at a place of its own; y is up."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("geom_id"), F.col("p_size").cast("double").alias("w"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for g, w in zip(batch["geom_id"], batch["w"], strict=True):
                x, z = 60.0 * (g % 317), 60.0 * (g // 317)
                out.append(wkb.write([[[(x, 0.0, z), (x + w, 0.0, z), (x + w, 1.0, z + w), (x, 1.0, z + w)]]], "<"))
            yield batch.assign(wkb=out)[["geom_id", "wkb"]]

    return parts.mapInPandas(make, "geom_id long, wkb binary")


@query("""SELECT p_partkey::BIGINT AS geom_id, 60.0::DOUBLE * (p_partkey % 317) AS min_x, -(60.0::DOUBLE * (p_partkey // 317) + p_size) AS min_y, 0.0::DOUBLE AS min_z, -60.0::DOUBLE * (p_partkey // 317) + 0.0 AS max_y, 1.0::DOUBLE AS max_z,
 round(p_size::DOUBLE * p_size, 3) AS weight FROM part""")
def feature_boxes(spark: SparkSession, d: str) -> DataFrame:
    f, _ = X.features(_squares(spark, d))
    return f.select("geom_id", *[(F.col(c).cast("double") + 0.0).alias(c) for c in ("min_x", "min_y", "min_z", "max_y", "max_z")], F.round("weight", 3).alias("weight"))


@query("SELECT p_partkey::VARCHAR AS id, 6::BIGINT AS vertices, p_size::DOUBLE AS width FROM part")
def export_features(spark: SparkSession, d: str) -> DataFrame:
    """Polygons to a quadtree of batched models and back: every feature stands in one tile, with its triangles."""
    out = os.path.join(new_folder(spark, "export"), "out")
    X.export(_squares(spark, d), out, edge=2000.0)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                _, properties, data = b3dm.decode(bytes(content))
                gltf, body = glb.unpack(data)
                x, of = glb.attribute(gltf, body, "POSITION")[:, 0].astype(float), glb.attribute(gltf, body, "_BATCHID").reshape(-1).astype(int)
                yield pd.DataFrame([(i, int((of == k).sum()), float(np.round(np.ptp(x[of == k]), 2))) for k, i in enumerate(properties["id"])], columns=["id", "vertices", "width"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.b3dm").load(out).select("content").mapInPandas(read, "id string, vertices long, width double")


# ---- hierarchies, buildings, turns ----


@query("""SELECT n_regionkey::BIGINT AS region, 'Nation' AS class, n_nationkey::BIGINT AS key, n_regionkey::BIGINT AS above FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)
UNION ALL SELECT r_regionkey, 'Region', r_regionkey, -1 FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""")
def bth_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A hierarchy a region, encoded and decoded: each instance with its class and what its parent is."""

    def code(pdf: pd.DataFrame) -> pd.DataFrame:
        region = int(pdf["n_regionkey"].iloc[0])
        instances = [(0, {"key": region}, []), *[(1, {"key": int(n)}, [0]) for n in sorted(pdf["n_nationkey"])]]
        h = batch_table.encode_hierarchy([("Region", ["key"]), ("Nation", ["key"])], instances)
        found = batch_table.decode_hierarchy(h)
        return pd.DataFrame([(region, c, values["key"], found[up[0]][1]["key"] if up else -1) for c, values, up in found], columns=["region", "class", "key", "above"])

    return table(spark, d, "nation").select("n_nationkey", "n_regionkey").groupBy("n_regionkey").applyInPandas(code, "region long, class string, key long, above long")


_BUILDING = """ISO-10303-21;
DATA;
#1=IFCPROJECT('p',$,'Project',$,$,$,$,$,$);
#2=IFCSITE('s{key}',$,'Site',$,$,$,$,$,$,(48,30,0,0),(8,15,36),100.,$,$);
#10=IFCRELAGGREGATES('r1',$,$,$,#1,(#2));
#12=IFCRELCONTAINEDINSPATIALSTRUCTURE('r3',$,$,$,(#20),#2);
#20=IFCWALL('w{key}',$,'Wall',$,$,#30,#40,$);
#30=IFCLOCALPLACEMENT($,#31);
#31=IFCAXIS2PLACEMENT3D(#32,$,$);
#32=IFCCARTESIANPOINT(({x},0.,5.));
#40=IFCPRODUCTDEFINITIONSHAPE($,$,(#41));
#41=IFCSHAPEREPRESENTATION($,'Body','SweptSolid',(#42));
#42=IFCEXTRUDEDAREASOLID(#43,#44,#45,{height});
#43=IFCRECTANGLEPROFILEDEF(.AREA.,$,#46,2.,4.);
#44=IFCAXIS2PLACEMENT3D(#47,$,$);
#45=IFCDIRECTION((0.,0.,1.));
#46=IFCAXIS2PLACEMENT2D(#48,$);
#47=IFCCARTESIANPOINT((0.,0.,0.));
#48=IFCCARTESIANPOINT((0.,0.));
ENDSEC;
"""


@query("SELECT s_suppkey::BIGINT AS file, 12::BIGINT AS triangles, s_suppkey - 1.0::DOUBLE AS min_x, s_suppkey + 1.0::DOUBLE AS max_x, -2.0::DOUBLE AS min_y, 5.0::DOUBLE AS min_z, 6.0::DOUBLE + s_nationkey AS max_z, 's' || s_suppkey AS container FROM supplier")
def building_boxes(spark: SparkSession, d: str) -> DataFrame:
    """A building file a supplier: a wall in a site, moved, swept up, cut into triangles."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, nation in zip(batch["s_suppkey"], batch["s_nationkey"], strict=True):
                model = step.Model.parse(_BUILDING.format(key=key, x=f"{key}.", height=f"{nation + 1}."))
                for i, parent, _ in model.tree():
                    triangles, _ = model.element_triangles(i)
                    if triangles is not None and len(triangles):
                        p = triangles.reshape(-1, 3)
                        rows.append((key, len(triangles), p[:, 0].min(), p[:, 0].max(), p[:, 1].min(), p[:, 2].min(), p[:, 2].max(), model.entities[parent][1][0]))
            yield pd.DataFrame(rows, columns=["file", "triangles", "min_x", "max_x", "min_y", "min_z", "max_z", "container"])

    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return s.mapInPandas(read, "file long, triangles long, min_x double, max_x double, min_y double, min_z double, max_z double, container string")


@query("""WITH v AS (SELECT p_partkey, 1.0::DOUBLE AS ax, (p_size % 5 - 2)::DOUBLE AS ay, 3.0::DOUBLE AS az, (p_partkey % 7 - 3)::DOUBLE AS bx, 1.0::DOUBLE AS by_, 2.0::DOUBLE AS bz FROM part),
s AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) / sqrt(bx * bx + by_ * by_ + bz * bz) AS s FROM v) SELECT p_partkey, round(bx * s + 10, 6) AS x, round(by_ * s + 20, 6) AS y, round(bz * s + 30, 6) AS z FROM s""")
def rotations(spark: SparkSession, d: str) -> DataFrame:
    """A vector turned onto another's direction, and moved."""

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, size in zip(batch["p_partkey"], batch["p_size"], strict=True):
                a, b = np.array([1.0, size % 5 - 2, 3.0]), np.array([key % 7 - 3, 1.0, 2.0])
                m = np.eye(4)
                m[:3, :3] = M.rotation_between(a, b)
                rows.append((key, *np.round((M.translation([10.0, 20.0, 30.0]) @ m @ np.append(a, 1.0))[:3], 6)))
            yield pd.DataFrame(rows, columns=["p_partkey", "x", "y", "z"])

    return table(spark, d, "part").select("p_partkey", "p_size").mapInPandas(turn, "p_partkey long, x double, y double, z double")
