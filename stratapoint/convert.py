"""Point files to a tileset: read, reproject, partition, thin, prune, encode, write."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratapoint import sources
from stratapoint.codecs import glb, pnts
from stratapoint.errors import MissingCrs, NoTilerFound, TilingFailed
from stratapoint.functions import crs
from stratapoint.functions import geometry as G
from stratapoint.functions import matrices as M
from stratapoint.operators import octree
from stratapoint.session import spread
from stratapoint.tileset import ADD, REPLACE, Tile, TileSet, box_from_bounds

AXES = ("x", "y", "z")
COLOURS = ("red", "green", "blue")


class Tiler(Protocol):
    """What turns files of some kinds into contents and tiles."""

    name: str

    def supports(self, path: str) -> bool: ...

    def plan(self, spark: SparkSession, paths: Sequence[str], out: str) -> TileSet: ...


def assign(tilers: Sequence[Tiler], paths: Sequence[str]) -> dict[int, list[str]]:
    """Files by the first tiler (its place) that takes each; files that none takes raise NoTilerFound with all of them."""
    out: dict[int, list[str]] = {}
    lost = []
    for p in paths:
        k = next((k for k, t in enumerate(tilers) if t.supports(p)), None)
        if k is None:
            lost.append(p)
        else:
            out.setdefault(k, []).append(p)
    if lost:
        raise NoTilerFound(f"no tiler for {', '.join(lost)}")
    return out


def make_folder(path: str, overwrite: bool = False) -> None:
    """A folder that is new or empty; one with files is emptied only if asked, a file in its place never."""
    if os.path.isdir(path):
        if overwrite:
            shutil.rmtree(path)
        elif os.listdir(path):
            raise FileExistsError(f"{path} isn't empty")
    elif os.path.exists(path):
        raise FileExistsError(f"{path} is no folder")
    os.makedirs(path, exist_ok=True)


#: Points of one content. A node of more (points at one place never part) shows them as several.
CONTENT_POINTS = 1_000_000
#: Levels of tiles that one file of the tree holds: at most 1 + 8 + 64 + 512 tiles.
FILE_LEVELS = 3


def in_parts(points: DataFrame, counts: DataFrame, arrival: Sequence[str], most: int | None = None) -> DataFrame:
    """points with ``part``: 0 but in nodes of more than ``most`` points (counts: node, n), which are cut into even parts."""
    most = most or CONTENT_POINTS
    large = counts.where(F.col("n") > most).select(F.col("node").alias("_large"), F.ceil(F.col("n") / most).alias("_parts"))
    marked = points.join(large, points.node == F.col("_large"), "left")
    return marked.withColumn("part", F.coalesce(F.pmod(F.xxhash64(*arrival), F.col("_parts")), F.lit(0)).cast("int")).drop("_large", "_parts")


def part_file(node: Column, part: Column, suffix: str) -> Column:
    """The file of a node's content; further parts have their number before the suffix."""
    return F.when(part == 0, G.node_file(node, suffix)).otherwise(F.concat(G.node_file(node, ""), F.lit("."), part.cast("string"), F.lit(suffix)))


def encode_nodes(points: DataFrame, fields: Sequence[str], with_colours: bool, form: str = "pnts") -> DataFrame:
    """points: node, x, y, z, colours and fields, and part (see :func:`in_parts`; without, a node is one part). node, part, n,
    content: the points of each part as one content.
    """
    if "part" not in points.columns:
        points = points.withColumn("part", F.lit(0))

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        positions = pdf[list(AXES)].to_numpy(np.float32)
        colours = np.ascontiguousarray(pdf[list(COLOURS)].fillna(0).to_numpy(np.uint8)) if with_colours else None
        extras = {f: pdf[f].fillna(0).to_numpy(np.float32 if pdf[f].dtype.kind == "f" else np.int32) for f in fields}
        data = pnts.encode(pnts.from_arrays(positions, colours, extras)) if form == "pnts" else glb.from_points(positions, colours, extras)
        return pd.DataFrame({"node": [pdf["node"].iloc[0]], "part": [pdf["part"].iloc[0]], "n": [len(pdf)], "content": [data]})

    columns = ["node", "part", *AXES, *(COLOURS if with_colours else ()), *fields]
    return points.select(*columns).groupBy("node", "part").applyInPandas(encode, "node string, part int, n long, content binary")


def write_files(files: DataFrame, folder: str) -> None:
    """files: file, content (binary). Written by the tasks to a shared folder; a task that is run again writes the same bytes."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                path = os.path.join(folder, file)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path + ".part", "wb") as f:
                    f.write(content)
                os.replace(path + ".part", path)
            yield batch[["file"]]

    files.select("file", "content").mapInPandas(write, "file string").agg(F.count(F.lit(1))).first()


def write_contents(contents: DataFrame, folder: str, suffix: str) -> int:
    """Files of all contents (node, part, n, content); gives the points written, counted on what was written."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                path = os.path.join(folder, file)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path + ".part", "wb") as f:
                    f.write(content)
                os.replace(path + ".part", path)
            yield pd.DataFrame({"n": [int(batch["n"].sum())]})

    named = contents.withColumn("file", part_file(F.col("node"), F.col("part"), suffix))
    return named.select("file", "n", "content").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


TILE = "node string, parent string, level int, n long, parts int, geometric_error double, has_content boolean, inner_tile boolean, " + ", ".join(f"{m}_{v} double" for m in ("min", "max") for v in "xyz")


def tree_members(tiles: DataFrame, levels: int) -> DataFrame:
    """tiles with ``file_of``, the node whose file describes them, and ``as_root``: tiles of every ``levels``-th level that
    have tiles below stand in two files, as a link in the one above and as the root of their own."""
    level = F.col("level")
    above = F.substring("node", F.lit(1), F.floor((level - 1) / levels).cast("int") * levels)
    places = F.array(F.when(level > 0, F.struct(above.alias("file_of"), F.lit(False).alias("as_root"))), F.when((level % levels == 0) & (F.col("inner_tile") | (level == 0)), F.struct(F.col("node").alias("file_of"), F.lit(True).alias("as_root"))))
    return tiles.select("*", F.explode(F.array_compact(places)).alias("_f")).select(*tiles.columns, "_f.*")


def _file_tree(rows: list[dict], suffix: str, levels: int) -> Tile:
    """The tree of one file; tiles that have a file of their own are links to it."""
    by: dict[str, Tile] = {}
    top: Tile | None = None
    for r in sorted(rows, key=lambda r: (r["level"], r["node"])):
        box = box_from_bounds([r[f"min_{v}"] for v in AXES], [r[f"max_{v}"] for v in AXES])
        name = r["node"]
        link = r["level"] and r["level"] % levels == 0 and r["inner_tile"] and not r["as_root"]
        uri = f"tileset.{name}.json" if link else _node_file(name, suffix) if r["has_content"] or not r["level"] else None
        t = Tile(r["geometric_error"], box, refine=ADD if r["level"] else REPLACE, content_uri=uri, extras={"node": name} if r["level"] else {})
        if not link:  # the further parts of a content too large for one file
            t.children += [Tile(0.0, box, refine=ADD, content_uri=_node_file(name, f".{k}{suffix}")) for k in range(1, r["parts"])]
        if r["as_root"]:
            top = t
        else:
            by[r["parent"]].children.append(t)
        by[name] = t
    return top


def _node_file(node: str, suffix: str) -> str:
    """The same path as the column of :func:`geometry.node_file`."""
    cut = max(0, (len(node) - 1) // 8 * 8)
    return "/".join([*(node[k : k + 8] for k in range(0, cut, 8)), "r" + node[cut:] + suffix])


def write_tree(tiles: DataFrame, folder: str, suffix: str, version: str) -> Tile:
    """Files of a tile tree (columns of ``TILE``), each made and written by a task from the tiles it describes. Gives the root's
    tree down to the links, a bounded number of tiles; its file is left to the caller."""
    levels = FILE_LEVELS
    members = tree_members(tiles, levels)

    def describe(pdf: pd.DataFrame) -> pd.DataFrame:
        top = _file_tree(pdf.to_dict("records"), suffix, levels)
        ts = TileSet(top, top.geometric_error, version)
        return pd.DataFrame({"file": [f"tileset.{pdf['file_of'].iloc[0]}.json"], "content": [json.dumps(ts.to_dict(), separators=(",", ":")).encode()]})

    below = members.where("file_of != ''").groupBy("file_of").applyInPandas(describe, "file string, content binary")
    write_files(below, folder)
    return _file_tree([r.asDict() for r in members.where("file_of = ''").collect()], suffix, levels)


class PointTiler:
    name = "points"

    def __init__(
        self, crs_in: int | str | None = None, crs_out: int | str | None = None, fields: Sequence[str] = (), colours: bool = True, form: str = "pnts", leaf_capacity: int = octree.LEAF_CAPACITY, force_crs_in: bool = False
    ) -> None:
        self.crs_in, self.crs_out, self.fields, self.colours, self.form, self.leaf_capacity, self.force_crs_in = crs_in, crs_out, list(fields), colours, form, leaf_capacity, force_crs_in

    def source_crs(self, spark: SparkSession, paths: Sequence[str]) -> int | str | None:
        """The system that the points are in: the stated one or the one that files name. Files that name another than the
        stated one, or several, raise MixedCrs, unless the stated one is forced; a target without any raises MissingCrs."""
        if self.crs_in is not None and self.force_crs_in:
            return self.crs_in
        named = sources.named_crs(spark, paths)
        if self.crs_in is not None:
            stated = spark.createDataFrame([("", f"EPSG:{crs.code_of(self.crs_in)}")], "path string, crs string")
            named = named.unionByName(stated)
        found = crs.the_one(named, "path", "crs")
        if found is None and self.crs_out is not None:
            raise MissingCrs("a target system needs a source system, and no file names one")
        return found

    def supports(self, path: str) -> bool:
        return sources.suffix(path) in sources.READERS

    def plan(self, spark: SparkSession, paths: Sequence[str], out: str) -> TileSet:
        source = self.source_crs(spark, paths)
        points = sources.read_points(spark, paths, self.fields)
        points = crs.reproject(points, source, self.crs_out)
        points = points.where(" and ".join(f"{v} is not null and not isnan(double({v}))" for v in AXES)).persist()
        row = octree.root_statistics(points, "path").first()
        if not row or not row["n"]:
            raise TilingFailed("no points")
        offset, scale, total = [row[f"avg_min_{v}"] for v in AXES], row["scale"], row["n"]
        # earth-centred coordinates are turned so that up is z at the tiles' place
        geocentric = self.crs_out is not None and crs.known(self.crs_out).kind == "geocentric"
        rotation = M.local_frame(*offset) if geocentric else None
        fields = [f for f in self.fields if f in points.columns]
        colours = self.colours and all(c in points.columns for c in COLOURS)
        keep = ["path", "point_no", *AXES, *(COLOURS if colours else ()), *fields]
        moved = [(F.col(v).cast("double") - o) * scale for v, o in zip(AXES, offset, strict=True)]
        if rotation is not None:
            moved = [sum((float(r[k]) * moved[k] for k in range(3)), F.lit(0.0)) for r in rotation]
        placed = points.select(*keep).withColumns({v: m.cast("float") for v, m in zip(AXES, moved, strict=True)})
        root = octree.root_of(placed, scale)
        arrival = ["path", "point_no"]
        shown = kept = octree.build_lod(placed, arrival, root, self.leaf_capacity).persist()
        counts = shown.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        target = octree.prune_map(counts).select(F.col("node").alias("_from"), "target")
        shown = shown.join(target, shown.node == F.col("_from")).withColumn("node", F.col("target")).drop("_from", "target")
        # the root shows a sample of the first level, at twice its spacing
        first = shown.where("length(node) = 1").withColumn("_child", F.col("node"))
        at_root = octree.with_nodes(first.drop("node"), root, 0).withColumn("cell", octree.cell_of(root, 0))
        ordered = spread(at_root, "node", "cell").sortWithinPartitions("node", "cell", "_child", *arrival)
        names = ordered.columns
        schema = T.StructType([*ordered.schema.fields, T.StructField("kept", T.BooleanType())])
        sample = ordered.mapInArrow(octree._thin(root.spacing * 2, [names.index(v) for v in AXES], [names.index("node"), names.index("cell")]), schema).where("kept").select(*shown.columns)
        suffix = ".pnts" if self.form == "pnts" else ".glb"
        tiles = octree.tile_tree(shown, root)
        written = write_contents(encode_nodes(in_parts(shown, tiles.select("node", "n"), arrival), fields, colours, self.form), out, suffix)
        if written != total:
            raise TilingFailed(f"{total} points were read and {written} written")
        write_contents(encode_nodes(sample, fields, colours, self.form), out, suffix)
        version = "1.0" if self.form == "pnts" else "1.1"
        top = write_tree(tiles.withColumn("parts", F.greatest(F.ceil(F.col("n") / CONTENT_POINTS), F.lit(1)).cast("int")), out, suffix, version)
        top.transform = M.root_transform(offset, scale, rotation)
        top.geometric_error = 10 * root.spacing / scale
        points.unpersist()
        kept.unpersist()
        return TileSet(top, top.geometric_error, version, folder=out)


class MeshTiler:
    """OBJ and building files: one content per tile, tiles by the files' own hierarchy."""

    name = "meshes"

    def __init__(self, form: str = "b3dm") -> None:
        self.form = form

    def supports(self, path: str) -> bool:
        return sources.suffix(path) in sources.MESHES

    def plan(self, spark: SparkSession, paths: Sequence[str], out: str) -> TileSet:
        from stratapoint.meshes import mesh_tiles

        return mesh_tiles(spark, paths, out, self.form)


def convert(spark: SparkSession, paths: Sequence[str], out: str, tilers: Sequence[Tiler] | None = None, overwrite: bool = False) -> TileSet:
    """A tileset of all files in a new folder. Each tiler's files become one tree; several trees are put below a new root."""
    from stratapoint.tileset import combine

    tilers = tilers or [PointTiler(), MeshTiler()]
    parts = assign(tilers, paths)
    make_folder(out, overwrite)
    try:
        sets = []
        for k, files in parts.items():
            folder = out if len(parts) == 1 else os.path.join(out, tilers[k].name)
            os.makedirs(folder, exist_ok=True)
            ts = tilers[k].plan(spark, files, folder)
            if len(parts) > 1:
                ts.root.rebase(tilers[k].name)
            sets.append(ts)
    except Exception:
        shutil.rmtree(out, ignore_errors=True)
        raise
    whole = sets[0] if len(sets) == 1 else combine([s.root for s in sets])
    whole.write(os.path.join(out, "tileset.json"))
    return whole
