"""The points content of version 1.0: header, feature table, batch table."""

from __future__ import annotations

import json
import struct
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from stratapoint.codecs import batch_table
from stratapoint.errors import InvalidPoints

MAGIC = b"pnts"
HEADER = struct.Struct("<4s6I")
# Fields of the feature table with their item type and width.
POSITIONS = {"POSITION": ("f4", 3), "POSITION_QUANTIZED": ("u2", 3)}
COLOURS = {"RGB": ("u1", 3), "RGBA": ("u1", 4), "RGB565": ("u2", 1)}
NORMALS = {"NORMAL": ("f4", 3), "NORMAL_OCT16P": ("u1", 2)}
OTHERS = {"BATCH_ID": ("u2", 1)}
FIELDS = POSITIONS | COLOURS | NORMALS | OTHERS


@dataclass
class Points:
    """Arrays of one points content: fields of the feature table by name, globals, and properties by name."""

    fields: dict[str, np.ndarray]
    globals: dict[str, object] = field(default_factory=dict)
    properties: dict[str, object] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(next(iter(self.fields.values()))) if self.fields else 0

    @property
    def positions(self) -> np.ndarray:
        """Float positions, quantized ones spread over their volume, about the centre they are relative to."""
        if "POSITION" in self.fields:
            p = self.fields["POSITION"]
        else:
            volume, start = np.array(self.globals["QUANTIZED_VOLUME_SCALE"]), np.array(self.globals["QUANTIZED_VOLUME_OFFSET"])
            p = self.fields["POSITION_QUANTIZED"] * volume / 65535 + start
        return p + np.array(self.globals["RTC_CENTER"]) if "RTC_CENTER" in self.globals else p

    @property
    def colours(self) -> np.ndarray | None:
        """Eight-bit colours; None without any."""
        if "RGB" in self.fields:
            return self.fields["RGB"]
        if "RGBA" in self.fields:
            return self.fields["RGBA"][:, :3]
        if "RGB565" in self.fields:
            c = self.fields["RGB565"].astype(np.uint32)
            parts = [(c >> 11 & 31) * 255 / 31, (c >> 5 & 63) * 255 / 63, (c & 31) * 255 / 31]
            return np.round(np.stack(parts, axis=1)).astype(np.uint8)
        return None

    @property
    def normals(self) -> np.ndarray | None:
        if "NORMAL" in self.fields:
            return self.fields["NORMAL"]
        if "NORMAL_OCT16P" not in self.fields:
            return None
        xy = self.fields["NORMAL_OCT16P"] / 127.5 - 1
        z = 1 - np.abs(xy).sum(axis=1)
        folded = (1 - np.abs(xy[:, ::-1])) * np.where(xy >= 0, 1, -1)
        n = np.column_stack([np.where((z < 0)[:, None], folded, xy), z])
        return (n / np.linalg.norm(n, axis=1, keepdims=True)).astype(np.float32)


def from_arrays(positions: np.ndarray, colours: np.ndarray | None = None, properties: dict[str, object] | None = None, normals: np.ndarray | None = None) -> Points:
    """Arrays to fields by their types: float or 16-bit positions, 8-bit colours, or 16-bit packed ones."""
    name = {"f": "POSITION", "u": "POSITION_QUANTIZED"}.get(positions.dtype.kind)
    if name is None or positions.ndim != 2 or positions.shape[1] != 3:
        raise InvalidPoints("positions are (n, 3) of float or unsigned 16-bit numbers")
    fields = {name: positions.astype(np.float32) if name == "POSITION" else positions.astype(np.uint16)}
    if colours is not None:
        if colours.dtype == np.uint8:
            fields["RGBA" if colours.shape[1] == 4 else "RGB"] = colours
        elif colours.dtype == np.uint16 and colours.ndim == 1:
            fields["RGB565"] = colours
        else:
            raise InvalidPoints(f"no colours are made of {colours.dtype}")
    if normals is not None:
        fields["NORMAL_OCT16P" if normals.dtype == np.uint8 else "NORMAL"] = normals
    return Points(fields, {}, properties or {})


def encode(points: Points) -> bytes:
    n = len(points)
    header: dict[str, object] = {"POINTS_LENGTH": n, **points.globals}
    body = bytearray()
    for name, (kind, width) in FIELDS.items():
        if name not in points.fields:
            continue
        values = np.ascontiguousarray(points.fields[name], "<" + kind)
        if values.size != n * width:
            raise InvalidPoints(f"{name} has {values.size} numbers for {n} points")
        body += b"\0" * (-len(body) % values.itemsize)
        header[name] = {"byteOffset": len(body)}
        body += values.tobytes()
    body += b"\0" * (-len(body) % 8)
    ft = batch_table.padded_json(header, HEADER.size)
    bt, bt_body = batch_table.encode(points.properties, HEADER.size + len(ft) + len(body))
    total = HEADER.size + len(ft) + len(body) + len(bt) + len(bt_body)
    return HEADER.pack(MAGIC, 1, total, len(ft), len(body), len(bt), len(bt_body)) + ft + bytes(body) + bt + bt_body


def decode(data: bytes) -> Points:
    if len(data) < HEADER.size:
        raise InvalidPoints("shorter than a header")
    magic, version, total, ft, ft_body, bt, bt_body = HEADER.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise InvalidPoints(f"magic {magic!r}, version {version}")
    if total != len(data) or HEADER.size + ft + ft_body + bt + bt_body != total:
        raise InvalidPoints("its lengths don't add up")
    at = HEADER.size
    header = json.loads(data[at : at + ft])
    body = data[at + ft : at + ft + ft_body]
    n = header["POINTS_LENGTH"]
    if not any(k in header for k in POSITIONS):
        raise InvalidPoints("no positions")
    fields = {}
    for name, (kind, width) in FIELDS.items():
        if name in header:
            kind = ID_TYPES.get(header[name].get("componentType"), kind) if name == "BATCH_ID" else kind
            values = np.frombuffer(body, "<" + kind, n * width, header[name]["byteOffset"])
            fields[name] = values.reshape(n, width) if width > 1 else values
    rest = {k: v for k, v in header.items() if k not in FIELDS and k not in ("POINTS_LENGTH", "extensions", "extras")}
    at += ft + ft_body
    return Points(fields, rest, batch_table.decode(data[at : at + bt], data[at + bt : at + bt + bt_body], n))


ID_TYPES = {"UNSIGNED_BYTE": "u1", "UNSIGNED_SHORT": "u2", "UNSIGNED_INT": "u4"}


def merge(parts: Sequence[Points]) -> Points:
    """Contents of the same fields, end to end; other fields raise InvalidPoints."""
    first = parts[0]
    for p in parts[1:]:
        if set(p.fields) != set(first.fields) or p.globals != first.globals:
            raise InvalidPoints(f"fields differ: {sorted(set(p.fields) ^ set(first.fields))}")
    fields = {k: np.concatenate([p.fields[k] for p in parts]) for k in first.fields}
    return Points(fields, dict(first.globals), batch_table.merge([p.properties for p in parts]) if first.properties or any(p.properties for p in parts) else {})
