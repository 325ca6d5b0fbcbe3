"""Mesh files to tiles."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from stratapoint import sources
from stratapoint.codecs import b3dm, glb
from stratapoint.errors import TilingFailed
from stratapoint.sources import obj, step
from stratapoint.tileset import ADD, Tile, TileSet, box_from_points


def pbr(m: dict) -> dict:
    """A glTF material of a traditional one."""
    light = 0.2125 * m["specular"][0] + 0.7154 * m["specular"][1] + 0.0721 * m["specular"][2]
    rough = min(max(1 - m["shininess"] / 1000, 0.0), 1.0) * (1 - light if light < 0.1 else 1)
    base = m["diffuse"] or m["ambient"] or [0.7, 0.7, 0.7]
    return {"pbrMetallicRoughness": {"baseColorFactor": [*base[:3], m["opacity"] or 1.0], "metallicFactor": m["specular"][0], "roughnessFactor": rough}, "emissiveFactor": m["emissive"][:3]}


def _encode(meshes: list[glb.Mesh], form: str) -> bytes:
    return b3dm.from_meshes(meshes, matrix=glb.Z_UP_TO_Y_UP) if form == "b3dm" else glb.encode(meshes, glb.Z_UP_TO_Y_UP)


def _write(path: str, data: bytes) -> None:
    with open(path + ".part", "wb") as f:  # a task that is run again writes the same bytes
        f.write(data)
    os.replace(path + ".part", path)


#: One row a tile: the file's number, the tile and its parent in it, its box about the file's offset, its content's file.
ROWS = "number int, id long, parent long, box array<double>, size double, content string, ox double, oy double, oz double, skipped int"


def _file_tiles(number: int, path: str, out: str, form: str) -> Iterator[tuple]:
    """Reads a file, writes its contents about its first vertex, and gives its tiles, a parent before its children."""
    suffix = ".b3dm" if form == "b3dm" else ".glb"
    parent: dict[int, int | None] = {}
    parts: dict[int, list[glb.Mesh]] = {}
    skipped = 0
    with open(path, encoding="utf-8", errors="replace") as f:
        text = f.read()
    if sources.suffix(path) == ".obj":
        library = {m["name"]: m for p in _libraries(path) for m in obj.read_materials(p)}
        names = [c.split()[0] for c in obj.CORNERS.split(", ")]
        corners = pd.DataFrame(list(obj._parse(path, text)), columns=names).sort_values(["mesh", "material", "face", "corner"], kind="stable")
        parent[0] = None
        for (_, material), part in corners.groupby(["mesh", "material"], sort=True):
            m = library.get(material)
            parts.setdefault(0, []).append(glb.Mesh(
                part[["x", "y", "z"]].to_numpy(float), part[["nx", "ny", "nz"]].to_numpy(np.float32) if part["nx"].notna().all() else None,
                part[["u", "v"]].to_numpy(np.float32) if part["u"].notna().all() else None,
                primitives=[glb.Primitive(material=pbr(m) if m else None, texture=os.path.basename(m["texture"]) if m and m["texture"] else None)], name=material,
            ))
            if m and m["texture"] and os.path.exists(m["texture"]):
                with open(m["texture"], "rb") as src:
                    _write(os.path.join(out, os.path.basename(m["texture"])), src.read())
    else:
        model = step.Model.parse(text)
        owner: dict[int, int] = {}
        for i, p, _ in model.tree():
            spatial = model.entities[i][0] in step.SPATIAL
            owner[i] = i if spatial else owner[p]
            if spatial:
                parent[i] = owner[p] if p is not None else None
            triangles, lost = model.element_triangles(i)
            skipped += lost
            if triangles is not None and len(triangles):
                parts.setdefault(owner[i], []).append(glb.Mesh(triangles.reshape(-1, 3), name=str(model.entities[i][1][2] or model.entities[i][1][0]), properties={"id": model.entities[i][1][0], "class": model.entities[i][0]}))
    first = next((parts[i][0].points[0] for i in parent if i in parts), None)
    offset = np.zeros(3) if first is None else np.array(first, float)
    for i, up in parent.items():
        box, size, name = None, 0.0, None
        if i in parts:
            name = f"{number}_{i}{suffix}"
            for m in parts[i]:
                m.points = (m.points - offset).astype(np.float32)
            points = np.concatenate([m.points for m in parts[i]]).astype(float)
            box = box_from_points(points).tolist()
            size = max(float(((m.points.max(axis=0) - m.points.min(axis=0)) / 2).max()) for m in parts[i])
            _write(os.path.join(out, name), _encode(parts[i], form))
        yield number, i, up, box, size, name, *offset.tolist(), skipped


def mesh_tiles(spark: SparkSession, paths: Sequence[str], out: str, form: str = "b3dm") -> TileSet:
    """One tree of all files' tiles, each file's about its first vertex. A file is a task's unit: it is read, encoded and written
    there, and only its tiles' boxes come back. Files are keyed by their place, so ids of several never mix.

    Geometry that no kernel here knows is left out and counted in the root's extras. Meshless branches are dropped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, path in zip(batch["number"], batch["path"], strict=True):
                yield pd.DataFrame(list(_file_tiles(int(number), path, out, form)), columns=names).astype({"parent": "Int64"})

    names = [c.split()[0] for c in ROWS.split(", ")]
    files = spark.createDataFrame(list(enumerate(paths)), "number int, path string").repartition(max(1, len(paths)), "number")
    by_file: dict[int, list] = {}
    for r in files.mapInPandas(run, ROWS).collect():  # one short row a tile
        by_file.setdefault(r.number, []).append(r)
    tops: list[Tile] = []
    for number in sorted(by_file):
        rows = by_file[number]
        tiles: dict[int, Tile] = {}
        below: dict[int, list[Tile]] = {}
        for r in reversed(rows):  # children before parents
            children = below.get(r.id, [])[::-1]
            if r.content is None and not children:
                continue
            t = Tile(max([max(c.extras["size"], c.geometric_error) for c in children], default=0.0), None if r.box is None else np.array(r.box), refine=ADD, content_uri=r.content, children=children, extras={"size": r["size"]})
            tiles[r.id] = t
            if r.parent is not None:
                below.setdefault(r.parent, []).append(t)
        own = [tiles[r.id] for r in rows if r.parent is None and r.id in tiles]
        if own:
            top = own[0] if len(own) == 1 else _above(own)
            top.transform[:3, 3] = rows[0].ox, rows[0].oy, rows[0].oz
            tops.append(top)
    if not tops:
        raise TilingFailed("no meshes")
    root = tops[0] if len(tops) == 1 else _above(tops)
    skipped = sum(rows[0].skipped for rows in by_file.values())
    root.sync_boxes()
    for t in [root, *root.descendants()]:
        t.extras = {k: v for k, v in t.extras.items() if k != "size"}
    root.extras |= {"skippedItems": skipped} if skipped else {}
    return TileSet(root, root.geometric_error or 1.0, "1.0" if form == "b3dm" else "1.1")


def _above(tiles: list[Tile]) -> Tile:
    error = max(max(t.extras["size"], t.geometric_error) for t in tiles)
    return Tile(error, refine=ADD, children=tiles, extras={"size": 0.0})


def _libraries(path: str) -> list[str]:
    with open(path, encoding="utf-8", errors="replace") as f:
        names = [ln.split(None, 1)[1].strip() for ln in f if ln.startswith("mtllib ")]
    files = [os.path.join(os.path.dirname(path), n) for n in names]
    return [f for f in files if os.path.exists(f)]
