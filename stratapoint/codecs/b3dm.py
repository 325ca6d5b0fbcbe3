"""The batched model content of version 1.0: header, tables and an embedded binary glTF."""

from __future__ import annotations

import json
import struct
from collections.abc import Mapping

from stratapoint.codecs import batch_table, glb
from stratapoint.errors import InvalidBatchedModel

MAGIC = b"b3dm"
HEADER = struct.Struct("<4s6I")


def encode(gltf: bytes, properties: Mapping[str, object] | None = None, batch_length: int = 0, rtc_center: list[float] | None = None) -> bytes:
    features: dict[str, object] = {"BATCH_LENGTH": batch_length}
    if rtc_center is not None:
        features["RTC_CENTER"] = rtc_center
    ft = batch_table.padded_json(features, HEADER.size)
    bt, body = batch_table.encode(properties or {}, HEADER.size + len(ft))
    gltf += b"\0" * (-len(gltf) % 8)
    total = HEADER.size + len(ft) + len(bt) + len(body) + len(gltf)
    return HEADER.pack(MAGIC, 1, total, len(ft), 0, len(bt), len(body)) + ft + bt + body + gltf


def decode(data: bytes) -> tuple[dict, dict[str, object], bytes]:
    """Feature globals, properties, and the glTF's bytes."""
    if len(data) < HEADER.size:
        raise InvalidBatchedModel("shorter than a header")
    magic, version, total, ft, ft_body, bt, bt_body = HEADER.unpack_from(data)
    if magic != MAGIC or version != 1 or total != len(data) or HEADER.size + ft + ft_body + bt + bt_body > total:
        raise InvalidBatchedModel(f"magic {magic!r}, version {version}, {total} bytes stated for {len(data)}")
    at = HEADER.size
    features = json.loads(data[at : at + ft]) if data[at : at + ft].strip() else {}
    at += ft + ft_body
    n = features.get("BATCH_LENGTH", 0)
    properties = batch_table.decode(data[at : at + bt], data[at + bt : at + bt + bt_body], n)
    return features, properties, data[at + bt + bt_body :]


def from_meshes(meshes: list[glb.Mesh], properties: Mapping[str, object] | None = None, matrix: list[float] | None = None) -> bytes:
    """One feature per mesh, marked on its vertices."""
    import numpy as np

    for k, m in enumerate(meshes):
        m.extras.setdefault("batchid", np.full(len(m.points), k, np.float32))
    return encode(glb.encode(meshes, matrix), properties, len(meshes))
