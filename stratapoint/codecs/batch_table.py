"""Per-feature properties: JSON lists and binary columns, and class hierarchies."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np

from stratapoint.errors import InvalidContent
from stratapoint.functions.dtypes import COMPONENTS

# Components of each vector type.
WIDTHS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}
_NAME_OF = {kind: name for name, kind in COMPONENTS.items()}
_TYPE_OF = {width: name for name, width in WIDTHS.items()}


def padded_json(value: object, before: int = 0, unit: int = 8) -> bytes:
    """Compact JSON, filled with blanks so that ``before`` and it together are a multiple of ``unit`` bytes."""
    raw = json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()
    return raw + b" " * (-(before + len(raw)) % unit)


def encode(properties: Mapping[str, object], before: int = 0) -> tuple[bytes, bytes]:
    """properties: name to a list (kept as JSON) or an array (n,) or (n, 2..4) of a binary type. Gives header and body.

    Each binary property begins at a multiple of its item's size, and its stated offset is where its bytes are. 64-bit whole
    numbers have no binary form: ValueError. No properties: nothing at all.
    """
    if not properties:
        return b"", b""
    header: dict[str, object] = {}
    body = bytearray()
    for name, values in properties.items():
        if not isinstance(values, np.ndarray):
            header[name] = values
            continue
        kind = f"{values.dtype.kind}{values.dtype.itemsize}"
        width = values.shape[1] if values.ndim == 2 else 1
        if kind not in _NAME_OF or width not in _TYPE_OF:
            raise InvalidContent(f"no binary form for {name}: {values.dtype}, width {width}")
        body += b"\0" * (-len(body) % values.dtype.itemsize)
        header[name] = {"byteOffset": len(body), "componentType": _NAME_OF[kind], "type": _TYPE_OF[width]}
        body += np.ascontiguousarray(values, values.dtype.newbyteorder("<")).tobytes()
    body += b"\0" * (-len(body) % 8)
    return padded_json(header, before), bytes(body)


def decode(header: bytes, body: bytes, n: int) -> dict[str, object]:
    """Properties by name; ``extensions`` and ``extras`` are none."""
    if not header.strip():
        return {}
    out: dict[str, object] = {}
    for name, entry in json.loads(header).items():
        if name in ("extensions", "extras"):
            continue
        if isinstance(entry, dict):
            width = WIDTHS[entry["type"]]
            values = np.frombuffer(body, "<" + COMPONENTS[entry["componentType"]], n * width, entry["byteOffset"])
            out[name] = values.reshape(n, width) if width > 1 else values
        else:
            out[name] = entry
    return out


def binary_property(properties: Mapping[str, object], name: str) -> np.ndarray:
    """A binary property; one kept as JSON raises InvalidContent."""
    if name not in properties:
        raise KeyError(name)
    if not isinstance(properties[name], np.ndarray):
        raise InvalidContent(f"{name} is kept as JSON")
    return properties[name]


def merge(tables: Sequence[Mapping[str, object]]) -> dict[str, object]:
    """Tables of the same properties, forms and types, end to end; any difference raises InvalidContent."""
    first = tables[0]
    for t in tables[1:]:
        if set(t) != set(first):
            raise InvalidContent(f"properties differ: {sorted(set(t) ^ set(first))}")
        for k, v in t.items():
            f = first[k]
            if isinstance(v, np.ndarray) != isinstance(f, np.ndarray):
                raise InvalidContent(f"{k} is binary in one table and JSON in the other")
            if isinstance(v, np.ndarray) and (v.dtype != f.dtype or v.shape[1:] != f.shape[1:]):
                raise InvalidContent(f"{k} has several types")
    return {k: np.concatenate([t[k] for t in tables]) if isinstance(v, np.ndarray) else [x for t in tables for x in t[k]] for k, v in first.items()}


def encode_hierarchy(classes: Sequence[tuple[str, Sequence[str]]], instances: Sequence[tuple[int, Mapping[str, object], Sequence[int]]]) -> dict[str, object]:
    """classes: (name, property names). instances in order: (class, properties, indexes of parents). The hierarchy's JSON.

    Instances are numbered as given; their parents may be several or none (an instance without parents has count 0).
    """
    members: list[list[Mapping[str, object]]] = [[] for _ in classes]
    for class_id, properties, parents in instances:
        if not 0 <= class_id < len(classes) or any(not 0 <= p < len(instances) for p in parents):
            raise InvalidContent("an instance refers to a class or parent that isn't there")
        members[class_id].append(properties)
    out: dict[str, object] = {
        "classes": [{"name": name, "length": len(m), "instances": {p: [i.get(p) for i in m] for p in names}} for (name, names), m in zip(classes, members, strict=True)],
        "instancesLength": len(instances),
        "classIds": [c for c, _, _ in instances],
    }
    if any(p for _, _, p in instances):
        out["parentCounts"] = [len(p) for _, _, p in instances]
        out["parentIds"] = [x for _, _, p in instances for x in p]
    return out


def decode_hierarchy(h: Mapping[str, object]) -> list[tuple[str, dict[str, object], list[int]]]:
    """(class name, properties, parents) of each instance."""
    seen = [0] * len(h["classes"])
    counts = h.get("parentCounts") or ([1] * h["instancesLength"] if "parentIds" in h else [0] * h["instancesLength"])
    parents = iter(h.get("parentIds", ()))
    out = []
    for at, c in enumerate(h["classIds"]):
        k = seen[c]
        seen[c] += 1
        cls = h["classes"][c]
        up = [next(parents) for _ in range(counts[at])]
        out.append((cls["name"], {p: v[k] for p, v in cls["instances"].items()}, [p for p in up if p != at]))
    return out
