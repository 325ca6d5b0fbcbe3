"""Binary glTF 2.0: meshes and points, written and read."""

from __future__ import annotations

import json
import struct
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from stratapoint.errors import InvalidContent

MAGIC = b"glTF"
# Component types, element types and primitive modes of the format.
COMPONENT = {"i1": 5120, "u1": 5121, "i2": 5122, "u2": 5123, "u4": 5125, "f4": 5126}
KIND = {v: k for k, v in COMPONENT.items()}
WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT2": 4, "MAT3": 9, "MAT4": 16}
ELEMENT = {1: "SCALAR", 2: "VEC2", 3: "VEC3", 4: "VEC4"}
POINTS, TRIANGLES = 0, 4
ARRAY_BUFFER, ELEMENT_BUFFER = 34962, 34963
STANDARD = ("POSITION", "NORMAL", "TANGENT", "TEXCOORD_0", "TEXCOORD_1", "COLOR_0")
#: Node matrix, column by column, that turns z-up content to the format's y-up.
Z_UP_TO_Y_UP = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
DEFAULT_MATERIAL = {"pbrMetallicRoughness": {"baseColorFactor": [1.0, 1.0, 1.0, 1.0], "metallicFactor": 0.0, "roughnessFactor": 1.0}}


@dataclass
class Primitive:
    indices: np.ndarray | None = None
    material: dict | None = None
    texture: str | None = None
    mode: int = TRIANGLES


@dataclass
class Mesh:
    """Vertex arrays, and the primitives that share them."""

    points: np.ndarray
    normals: np.ndarray | None = None
    uvs: np.ndarray | None = None
    colours: np.ndarray | None = None
    extras: dict[str, np.ndarray] = field(default_factory=dict)
    primitives: list[Primitive] = field(default_factory=list)
    name: str | None = None
    properties: dict | None = None


def mangled(name: str) -> str:
    return "_" + name.upper()


def plain(name: str) -> str:
    return name[1:].lower() if name.startswith("_") else name.lower()


def _fit(values: np.ndarray) -> np.ndarray:
    """An array in one of the format's component types: doubles and whole numbers of 32 bits and more become floats."""
    kind = f"{values.dtype.kind}{values.dtype.itemsize}"
    return values if kind in ("i1", "u1", "i2", "u2", "f4") else values.astype(np.float32)


def encode(meshes: Sequence[Mesh], matrix: Sequence[float] | None = None) -> bytes:
    """One node and mesh each, one buffer; material 0 is a default one. Shared vertex arrays are stored once a mesh."""
    body = bytearray()
    gltf: dict = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": list(range(len(meshes)))}], "nodes": [], "meshes": [],
        "materials": [DEFAULT_MATERIAL], "accessors": [], "bufferViews": [], "buffers": [],
    }
    known: dict[str, int] = {json.dumps(DEFAULT_MATERIAL, sort_keys=True): 0}
    images: dict[str, int] = {}

    def put(values: np.ndarray, target: int, bounds: bool = False) -> int:
        body.extend(b"\0" * (-len(body) % 4))
        raw = np.ascontiguousarray(values, values.dtype.newbyteorder("<"))
        width = raw.shape[1] if raw.ndim == 2 else 1
        gltf["bufferViews"].append({"buffer": 0, "byteOffset": len(body), "byteLength": raw.nbytes, "target": target})
        accessor = {"bufferView": len(gltf["bufferViews"]) - 1, "componentType": COMPONENT[f"{raw.dtype.kind}{raw.dtype.itemsize}"], "count": len(raw), "type": ELEMENT[width]}
        if bounds and len(raw):
            accessor |= {"min": raw.min(axis=0).tolist(), "max": raw.max(axis=0).tolist()}
        gltf["accessors"].append(accessor)
        body.extend(raw.tobytes())
        return len(gltf["accessors"]) - 1

    def material(p: Primitive) -> int:
        m = dict(p.material or DEFAULT_MATERIAL)
        if p.texture is not None:
            if p.texture not in images:
                images[p.texture] = len(images)
                gltf.setdefault("images", []).append({"uri": p.texture})
                gltf.setdefault("textures", []).append({"source": images[p.texture]})
            m["pbrMetallicRoughness"] = dict(m.get("pbrMetallicRoughness", {}), baseColorTexture={"index": images[p.texture]})
        key = json.dumps(m, sort_keys=True)
        if key not in known:
            known[key] = len(gltf["materials"])
            gltf["materials"].append(m)
        return known[key]

    for mesh in meshes:
        points = mesh.points if mesh.points.dtype == np.uint16 else mesh.points.astype(np.float32)
        attributes = {"POSITION": put(points, ARRAY_BUFFER, True)}
        for name, values in (("NORMAL", mesh.normals), ("TEXCOORD_0", mesh.uvs), ("COLOR_0", mesh.colours)):
            if values is not None:
                attributes[name] = put(_fit(values), ARRAY_BUFFER)
        for name, values in mesh.extras.items():
            attributes[mangled(name)] = put(_fit(values), ARRAY_BUFFER)
        primitives = []
        for p in mesh.primitives or [Primitive()]:
            entry: dict = {"attributes": attributes, "material": material(p), "mode": p.mode}
            if p.indices is not None:
                flat = np.asarray(p.indices).reshape(-1)
                kind = np.uint8 if len(mesh.points) <= 255 else np.uint16 if len(mesh.points) <= 65535 else np.uint32
                entry["indices"] = put(flat.astype(kind), ELEMENT_BUFFER)
            primitives.append(entry)
        m: dict = {"primitives": primitives}
        if mesh.name is not None:
            m["name"] = mesh.name
        if mesh.properties:
            m["extras"] = mesh.properties
        node: dict = {"mesh": len(gltf["meshes"])}
        if matrix is not None:
            node["matrix"] = list(matrix)
        gltf["meshes"].append(m)
        gltf["nodes"].append(node)
    gltf["buffers"].append({"byteLength": len(body)})
    return pack({k: v for k, v in gltf.items() if v != [] or k in ("scenes",)}, bytes(body))


def pack(gltf: dict, body: bytes) -> bytes:
    head = json.dumps(gltf, separators=(",", ":")).encode()
    head += b" " * (-len(head) % 4)
    body += b"\0" * (-len(body) % 4)
    chunks = struct.pack("<I4s", len(head), b"JSON") + head + (struct.pack("<I4s", len(body), b"BIN\0") + body if body else b"")
    return struct.pack("<4sII", MAGIC, 2, 12 + len(chunks)) + chunks


def unpack(data: bytes) -> tuple[dict, bytes]:
    if len(data) < 20 or data[:4] != MAGIC:
        raise InvalidContent("no binary glTF")
    _, version, total = struct.unpack_from("<4sII", data)
    if version != 2 or total > len(data):
        raise InvalidContent(f"version {version}, {total} bytes stated")
    at, head, body = 12, None, b""
    while at < total:
        size, kind = struct.unpack_from("<I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        head, body = (json.loads(part), body) if kind == b"JSON" else (head, part if kind == b"BIN\0" else body)
        at += 8 + size
    if head is None:
        raise InvalidContent("no JSON chunk")
    return head, body


def accessor(gltf: dict, body: bytes, index: int) -> np.ndarray:
    """Values of an accessor, of views with or without stride."""
    a = gltf["accessors"][index]
    view = gltf["bufferViews"][a["bufferView"]]
    kind, width = np.dtype("<" + KIND[a["componentType"]]), WIDTH[a["type"]]
    start = view.get("byteOffset", 0) + a.get("byteOffset", 0)
    stride = view.get("byteStride", kind.itemsize * width)
    rows = np.ndarray((a["count"], width), kind, body, start, (stride, kind.itemsize))
    return rows.copy() if width > 1 else rows[:, 0].copy()


def attribute(gltf: dict, body: bytes, name: str) -> np.ndarray | None:
    """An attribute over all primitives, gathered through their indices; None where none has it."""
    parts = []
    for mesh in gltf.get("meshes", ()):
        for p in mesh["primitives"]:
            if name in p["attributes"]:
                values = accessor(gltf, body, p["attributes"][name])
                parts.append(values[accessor(gltf, body, p["indices"])] if "indices" in p else values)
    return np.concatenate(parts) if parts else None


def own_attributes(gltf: dict) -> list[str]:
    """Names of attributes beyond the format's own that every primitive has."""
    sets = [set(p["attributes"]) for m in gltf.get("meshes", ()) for p in m["primitives"]]
    return sorted(set.intersection(*sets) - set(STANDARD)) if sets else []


def vertex_count(gltf: dict) -> int:
    """Vertices of the distinct position accessors."""
    used = {p["attributes"]["POSITION"] for m in gltf.get("meshes", ()) for p in m["primitives"]}
    return sum(gltf["accessors"][a]["count"] for a in used)


def from_points(positions: np.ndarray, colours: np.ndarray | None = None, extras: dict[str, np.ndarray] | None = None) -> bytes:
    """A single mesh of points, extras as attributes of their own; values stay z-up below a turning node. No points: an empty scene."""
    if not len(positions):
        return pack({"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": []}]}, b"")
    return encode([Mesh(positions, colours=colours, extras=extras or {}, primitives=[Primitive(mode=POINTS)])], Z_UP_TO_Y_UP)


def is_points(gltf: dict) -> bool:
    meshes = gltf.get("meshes", [])
    return not meshes or (len(meshes) == 1 and len(meshes[0]["primitives"]) == 1 and meshes[0]["primitives"][0].get("mode", TRIANGLES) == POINTS)


def to_points(data: bytes) -> tuple[np.ndarray, np.ndarray | None, dict[str, np.ndarray]]:
    gltf, body = unpack(data)
    if not is_points(gltf):
        raise InvalidContent("not a single mesh of points")
    positions = attribute(gltf, body, "POSITION")
    if positions is None:
        return np.empty((0, 3), np.float32), None, {}
    return positions, attribute(gltf, body, "COLOR_0"), {plain(n): attribute(gltf, body, n) for n in own_attributes(gltf)}


def merge_points(parts: Sequence[bytes]) -> bytes:
    """Points contents of the same attributes, end to end; bounds are made anew. Others raise InvalidContent."""
    decoded = [p for p in map(to_points, parts) if len(p[0])]
    if not decoded:
        return from_points(np.empty((0, 3), np.float32))
    if len({(c is None, tuple(sorted(e))) for _, c, e in decoded}) > 1:
        raise InvalidContent("attributes differ")
    colours = None if decoded[0][1] is None else np.concatenate([d[1] for d in decoded])
    return from_points(np.concatenate([d[0] for d in decoded]), colours, {k: np.concatenate([d[2][k] for d in decoded]) for k in decoded[0][2]})
