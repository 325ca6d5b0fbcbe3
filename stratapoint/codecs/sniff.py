"""What a content is, by its first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratapoint.codecs import b3dm, glb, pnts
from stratapoint.errors import InvalidContent


def kind_of(content: Column) -> Column:
    """pnts, b3dm, gltf, json or null; the bytes alone decide."""
    magic = F.substring(content, F.lit(1), F.lit(4)).cast("string")
    return F.when(magic == "pnts", "pnts").when(magic == "b3dm", "b3dm").when(magic == "glTF", "gltf").when(F.substring(magic, 1, 1) == "{", "json")


def read(data: bytes) -> tuple[str, object]:
    """(kind, decoded): points of a pnts or a glTF of points, the parts of a b3dm, or a glTF's JSON and bytes."""
    if data[:4] == pnts.MAGIC:
        return "pnts", pnts.decode(data)
    if data[:4] == b3dm.MAGIC:
        return "b3dm", b3dm.decode(data)
    if data[:4] == glb.MAGIC:
        gltf, body = glb.unpack(data)
        return ("points", glb.to_points(data)) if is_points_mesh(gltf) else ("gltf", (gltf, body))
    raise InvalidContent(f"unknown content {data[:4]!r}")


def is_points_mesh(gltf: dict) -> bool:
    return bool(gltf.get("meshes")) and glb.is_points(gltf)


def describe(data: bytes) -> str:
    """A few lines about a content."""
    kind, x = read(data)
    lines = [f"kind: {kind}", f"bytes: {len(data)}"]
    if kind == "pnts":
        lines += [f"points: {len(x)}", f"fields: {', '.join(x.fields)}", f"properties: {', '.join(x.properties) or 'none'}"]
        if len(x):
            lines += [f"first point: {x.positions[0].tolist()}"]
    elif kind == "b3dm":
        gltf, _ = glb.unpack(x[2])
        lines += [f"features: {x[0].get('BATCH_LENGTH', 0)}", f"properties: {', '.join(x[1]) or 'none'}", f"vertices: {glb.vertex_count(gltf)}"]
    elif kind == "points":
        lines += [f"points: {len(x[0])}", f"properties: {', '.join(x[2]) or 'none'}"]
    else:
        lines += [f"meshes: {len(x[0].get('meshes', []))}", f"vertices: {glb.vertex_count(x[0])}"]
    return "\n".join(lines)
