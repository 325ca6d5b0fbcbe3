"""Polygons to a quadtree of batched models."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapoint.codecs import b3dm, glb
from stratapoint.convert import make_folder
from stratapoint.errors import TilingFailed
from stratapoint.operators import mesh, octree
from stratapoint.sources import wkb
from stratapoint.tileset import ADD, Tile, TileSet, box_from_bounds

TOP_EDGE = 2000.0
PER_TILE = 20
TOP_ERROR = 500.0
AXES = ("x", "y", "z")


def features(geometries: DataFrame, swap_up: bool = True) -> tuple[DataFrame, DataFrame]:
    """geometries: geom_id, wkb (and weight). (features, triangles): boxes and weights, and corners of triangles.

    ``swap_up`` turns y-up input (x, y, z) to z-up (x, -z, y). Without a weight the area of the box counts.
    """
    points = wkb.points(geometries)
    t = mesh.triangles_of(points)
    if swap_up:
        t = t.withColumns({"y": -F.col("z"), "z": F.col("y")})
    boxes = t.groupBy("geom_id").agg(*[F.min(v).alias(f"min_{v}") for v in AXES], *[F.max(v).alias(f"max_{v}") for v in AXES])
    weight = F.col("weight") if "weight" in geometries.columns else F.lit(None).cast("double")
    weights = geometries.where("geom_id is not null").groupBy("geom_id").agg(F.max(weight).alias("weight"))
    area = (F.col("max_x") - F.col("min_x")).cast("double") * (F.col("max_y") - F.col("min_y"))
    out = boxes.join(weights, "geom_id").withColumn("weight", F.coalesce("weight", area))
    return out, t


def export(geometries: DataFrame, out: str, edge: float = TOP_EDGE, per_tile: int = PER_TILE, overwrite: bool = False) -> TileSet:
    """Each tile shows its heaviest features and hands the rest to its quarters; errors halve from level to level.

    Features go by their boxes' centres, so none is lost on an outer edge. The tileset is centred on all of them.
    """
    make_folder(out, overwrite)
    feats, triangles = features(geometries)
    feats = feats.persist()
    bounds = feats.agg(*[F.min(f"min_{v}").alias(f"a{v}") for v in AXES], *[F.max(f"max_{v}").alias(f"b{v}") for v in AXES], F.count(F.lit(1)).alias("n")).first()
    if not bounds["n"]:
        raise TilingFailed("no features")
    low = [float(bounds[f"a{v}"]) for v in AXES]
    center = np.array([(bounds[f"a{v}"] + bounds[f"b{v}"]) / 2 for v in AXES], float)
    placed = feats.select(
        F.col("geom_id").alias("id"), ((F.col("min_x") + F.col("max_x")) / 2 - low[0]).cast("double").alias("x"), ((F.col("min_y") + F.col("max_y")) / 2 - low[1]).cast("double").alias("y"), "weight",
        *[f"min_{v}" for v in AXES], *[f"max_{v}" for v in AXES],
    )
    tiles = octree.feature_quadtree(placed, edge, per_tile).persist()
    offset = center.tolist()

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        level, tx, ty = (int(pdf[c].iloc[0]) for c in ("level", "tx", "ty"))
        meshes, ids = [], []
        for g, part in pdf.sort_values(["geom_id", "polygon", "triangle", "corner"]).groupby("geom_id", sort=True):
            corners = part[list(AXES)].to_numpy(float) - offset
            tri = corners.reshape(-1, 3, 3)
            n = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
            size = np.linalg.norm(n, axis=1, keepdims=True)
            n = np.where(size > 0, n / np.where(size > 0, size, 1), [0.0, 0.0, 1.0])
            meshes.append(glb.Mesh(corners, normals=np.repeat(n, 3, axis=0).astype(np.float32)))
            ids.append(str(g))
        return pd.DataFrame({"level": [level], "tx": [tx], "ty": [ty], "content": [b3dm.from_meshes(meshes, {"id": ids}, glb.Z_UP_TO_Y_UP)]})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                path = os.path.join(out, f"{r.level}_{r.tx}_{r.ty}.b3dm")
                with open(path + ".part", "wb") as f:
                    f.write(r.content)
                os.replace(path + ".part", path)
            yield pd.DataFrame({"n": [len(batch)]})

    keyed = triangles.join(tiles.select(F.col("id").alias("geom_id"), "level", "tx", "ty"), "geom_id")
    keyed.groupBy("level", "tx", "ty").applyInPandas(encode, "level int, tx long, ty long, content binary").mapInPandas(write, "n long").agg(F.sum("n")).first()

    rows = tiles.groupBy("level", "tx", "ty").agg(*[F.min(f"min_{v}").alias(f"min_{v}") for v in AXES], *[F.max(f"max_{v}").alias(f"max_{v}") for v in AXES]).orderBy("level", "tx", "ty")
    root = Tile(TOP_ERROR, refine=ADD)
    by: dict[tuple[int, int, int], Tile] = {}
    for r in rows.toLocalIterator():
        key = (r["level"], r["tx"], r["ty"])
        t = Tile(TOP_ERROR / 2 ** (r["level"] + 1), box_from_bounds([r[f"min_{v}"] - c for v, c in zip(AXES, offset, strict=True)], [r[f"max_{v}"] - c for v, c in zip(AXES, offset, strict=True)]), refine=ADD, content_uri="{}_{}_{}.b3dm".format(*key))
        by[key] = t
        # every handed-down feature leaves a full tile above it
        (by[(key[0] - 1, key[1] // 2, key[2] // 2)] if key[0] else root).children.append(t)
    for t in by.values():
        if not t.children:
            t.geometric_error = 0.0
    move = np.eye(4)
    move[:3, 3] = np.round(center, 3)
    root.transform = move
    root.sync_boxes()
    feats.unpersist()
    tiles.unpersist()
    ts = TileSet(root, TOP_ERROR)
    ts.write(os.path.join(out, "tileset.json"))
    return ts
