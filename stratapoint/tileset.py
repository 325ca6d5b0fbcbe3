"""Tiles and tilesets as small driver-side objects: JSON in and out, boxes, bases, merging, deletion, counting.

Large trees stay tables (``operators.tiles``, ``operators.octree``); these objects are for what is written to or read from one
tileset.json.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

from stratapoint.codecs import glb, pnts, sniff
from stratapoint.errors import BoxMissing, InvalidTileset, UnknownExtension

ADD, REPLACE = "ADD", "REPLACE"
SPLIT_CHARS = 100_000
PREVIEW_POINTS = 50_000

# ---- boxes: twelve numbers ----


def box_from_bounds(low: Sequence[float], high: Sequence[float]) -> np.ndarray:
    c, h = (np.array(low, float) + high) / 2, (np.array(high, float) - low) / 2
    return np.array([*c, h[0], 0, 0, 0, h[1], 0, 0, 0, h[2]])


def box_from_points(points: np.ndarray) -> np.ndarray:
    return box_from_bounds(points.min(axis=0), points.max(axis=0))


def check_box(box: object) -> np.ndarray:
    b = np.asarray(box, float)
    if b.shape != (12,):
        raise InvalidTileset(f"a box has twelve numbers, not {b.shape}")
    return b


def box_corners(box: np.ndarray) -> np.ndarray:
    signs = np.array([(x, y, z) for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)])
    return box[:3] + signs @ box[3:].reshape(3, 3)


def box_transformed(box: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """``matrix`` is a usual 4x4 matrix (rows first)."""
    center = matrix @ np.append(box[:3], 1.0)
    return np.concatenate([center[:3] / center[3], (box[3:].reshape(3, 3) @ matrix[:3, :3].T).reshape(-1)])


def box_union(boxes: Sequence[np.ndarray]) -> np.ndarray:
    """A single box as it is; of several the axis-aligned box around all corners."""
    return boxes[0] if len(boxes) == 1 else box_from_points(np.concatenate([box_corners(b) for b in boxes]))


# ---- extensions ----

_EXTENSIONS: dict[str, Callable[[dict], object]] = {}


def register_extension(name: str, build: Callable[[dict], object]) -> None:
    _EXTENSIONS[name] = build


def is_registered(name: str) -> bool:
    return name in _EXTENSIONS


def build_extension(name: str, value: dict) -> object:
    """The registered form of an extension; of an unknown one its JSON as it is."""
    return _EXTENSIONS[name](value) if name in _EXTENSIONS else value


def _plain(value: object) -> object:
    return value.to_dict() if hasattr(value, "to_dict") else value


@dataclass
class Tile:
    geometric_error: float = 0.0
    box: np.ndarray | None = None
    transform: np.ndarray = field(default_factory=lambda: np.eye(4))
    refine: str | None = None  # None: as the parent
    content_uri: str | None = None
    children: list[Tile] = field(default_factory=list)
    extras: dict = field(default_factory=dict)
    extensions: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: dict) -> Tile:
        volume = d.get("boundingVolume")
        if not volume:
            raise BoxMissing("a tile without bounding volume")
        if "box" not in volume:
            raise NotImplementedError(f"bounding volume {sorted(volume)}")
        content = d.get("content") or {}
        refine = d.get("refine")
        if refine is not None and refine.upper() not in (ADD, REPLACE):
            raise InvalidTileset(f"refine {refine!r}")
        return cls(
            float(d.get("geometricError", 0)), check_box(volume["box"]), np.array(d["transform"], float).reshape(4, 4).T if "transform" in d else np.eye(4),
            refine.upper() if refine else None, content.get("uri", content.get("url")), [cls.from_dict(c) for c in d.get("children") or []],
            dict(d.get("extras", {})), {k: build_extension(k, v) for k, v in d.get("extensions", {}).items()},
        )

    def to_dict(self, root: bool = False) -> dict:
        if self.box is None:
            raise BoxMissing("a tile without bounding volume")
        out: dict = {"boundingVolume": {"box": self.box.tolist()}, "geometricError": self.geometric_error}
        if self.refine or root:
            out["refine"] = self.refine or ADD
        if not np.array_equal(self.transform, np.eye(4)):
            out["transform"] = self.transform.T.reshape(-1).tolist()
        if self.content_uri is not None:
            out["content"] = {"uri": self.content_uri}
        if self.children:
            out["children"] = [c.to_dict() for c in self.children]
        if self.extras:
            out["extras"] = self.extras
        if self.extensions:
            out["extensions"] = {k: _plain(v) for k, v in self.extensions.items()}
        return out

    def descendants(self) -> Iterator[Tile]:
        """All tiles below, a tile before its children."""
        stack = self.children[::-1]
        while stack:
            t = stack.pop()
            yield t
            stack += t.children[::-1]

    def add_child(self, child: Tile) -> None:
        """A child; the box grows by the child's, in this tile's frame."""
        self.children.append(child)
        if child.box is not None:
            moved = box_transformed(child.box, child.transform)
            self.box = moved if self.box is None else box_union([self.box, moved])

    def sync_boxes(self) -> None:
        """Boxes grown to hold those of the tiles below, from the leaves up; own boxes are kept and extended."""
        for t in [*list(self.descendants())[::-1], self]:
            boxes = ([t.box] if t.box is not None else []) + [box_transformed(c.box, c.transform) for c in t.children if c.box is not None]
            if boxes:
                t.box = box_union(boxes)

    def world_box(self) -> np.ndarray:
        return box_transformed(self.box, self.transform)

    def rebase(self, prefix: str) -> None:
        """Content paths of this tile and those below, seen from a folder above."""
        for t in [self, *self.descendants()]:
            if t.content_uri is not None and not os.path.isabs(t.content_uri) and "://" not in t.content_uri:
                t.content_uri = os.path.join(prefix, t.content_uri).replace(os.sep, "/")


@dataclass
class TileSet:
    root: Tile = field(default_factory=Tile)
    geometric_error: float = 500.0
    version: str = "1.0"
    tileset_version: str | None = None
    folder: str | None = None
    extensions_used: set[str] = field(default_factory=set)
    extensions_required: set[str] = field(default_factory=set)
    extras: dict = field(default_factory=dict)
    extensions: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: dict, folder: str | None = None) -> TileSet:
        missing = set(d.get("extensionsRequired", ())) - set(_EXTENSIONS)
        if missing:
            raise UnknownExtension(", ".join(sorted(missing)))
        asset = d.get("asset", {})
        if not isinstance(d.get("root"), dict):
            raise InvalidTileset("no root tile")
        return cls(
            Tile.from_dict(d["root"]), float(d.get("geometricError", 0)), str(asset.get("version", "1.0")), asset.get("tilesetVersion"), folder,
            set(d.get("extensionsUsed", ())), set(d.get("extensionsRequired", ())), dict(d.get("extras", {})), {k: build_extension(k, v) for k, v in d.get("extensions", {}).items()},
        )

    @classmethod
    def read(cls, path: str) -> TileSet:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f), os.path.dirname(os.path.abspath(path)))

    def to_dict(self) -> dict:
        self.root.sync_boxes()
        asset = {"version": self.version} | ({"tilesetVersion": self.tileset_version} if self.tileset_version else {})
        out: dict = {"asset": asset, "geometricError": self.geometric_error, "root": self.root.to_dict(root=True)}
        if self.extensions_used:
            out["extensionsUsed"] = sorted(self.extensions_used)
        if self.extensions_required:
            out["extensionsRequired"] = sorted(self.extensions_required)
        if self.extras:
            out["extras"] = self.extras
        if self.extensions:
            out["extensions"] = {k: _plain(v) for k, v in self.extensions.items()}
        return out

    def write(self, path: str) -> None:
        """JSON without blanks; a subtree with children and a long JSON goes to a file of its own beside it."""
        folder = os.path.dirname(os.path.abspath(path))
        for name, tile in list(_named(self.root))[::-1]:
            if name and tile.children and len(json.dumps(tile.to_dict(), separators=(",", ":"))) > SPLIT_CHARS:
                file = f"tileset.{name}.json"
                part = TileSet(Tile(tile.geometric_error, tile.box, np.eye(4), ADD, tile.content_uri, tile.children), tile.geometric_error, self.version)
                with open(os.path.join(folder, file), "w", encoding="utf-8") as f:
                    json.dump(part.to_dict(), f, separators=(",", ":"))
                tile.content_uri, tile.children = file, []
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f, separators=(",", ":"))
        self.folder = folder

    def fetch(self, tile: Tile) -> tuple[str, object] | None:
        """A tile's content: None without one, a tileset of a .json, else what ``sniff.read`` gives. Nothing is kept."""
        if tile.content_uri is None:
            return None
        if self.folder is None and not os.path.isabs(tile.content_uri):
            raise InvalidTileset("a relative content needs the tileset's folder")
        path = os.path.join(self.folder or "", tile.content_uri.split("?")[0])
        if path.endswith(".json"):
            return "tileset", TileSet.read(path)
        with open(path, "rb") as f:
            return sniff.read(f.read())

    def contents(self) -> Iterator[tuple[Tile, tuple[str, object]]]:
        for t in [self.root, *self.root.descendants()]:
            c = self.fetch(t)
            if c is not None:
                yield t, c

    def count_points(self) -> int:
        """Points a viewer sees at full detail: of leaves and of tiles that refine by adding; nested tilesets are followed."""
        total = 0
        stack = [(self.root, self.root.refine or ADD)]
        while stack:
            t, mode = stack.pop()
            content = self.fetch(t)
            if content and content[0] == "tileset":
                total += content[1].count_points()
            elif content and (not t.children or mode == ADD):
                kind, x = content
                total += len(x) if kind == "pnts" else len(x[0]) if kind == "points" else glb.vertex_count(glb.unpack(x[2])[0] if kind == "b3dm" else x[0])
            stack += [(c, c.refine or mode) for c in t.children]
        return total

    def delete(self, path: str, nested: bool = False) -> None:
        """The tileset's file and contents; nested tilesets only if asked."""
        for t in [self.root, *self.root.descendants()]:
            if t.content_uri is None:
                continue
            file = os.path.join(self.folder or os.path.dirname(path), t.content_uri)
            if file.endswith(".json"):
                if nested and os.path.exists(file):
                    TileSet.read(file).delete(file, True)
            elif os.path.exists(file):
                os.remove(file)
        os.remove(path)


def _named(tile: Tile, name: str = "") -> Iterator[tuple[str, Tile]]:
    yield name, tile
    for k, c in enumerate(tile.children):
        yield from _named(c, f"{name}{c.extras.get('node', '')[-1:] or k}")


def preview(tilesets: Sequence[TileSet], to_root: np.ndarray, seed: int = 0) -> pnts.Points | None:
    """A seeded sample, with replacement, of the tilesets' root contents in the frame of a new root; missing properties are 0.

    Each root's full transform is applied. At most ``PREVIEW_POINTS``, shared by size.
    """
    parts = []
    for ts in tilesets:
        content = ts.fetch(ts.root)
        if content and content[0] in ("pnts", "points"):
            x = content[1]
            positions, colours, extras = (x.positions, x.colours, {k: v for k, v in x.properties.items() if isinstance(v, np.ndarray)}) if content[0] == "pnts" else x
            parts.append((positions, colours, extras, to_root @ ts.root.transform))
    total = sum(len(p[0]) for p in parts)
    if not total:
        return None
    rng, ratio = np.random.default_rng(seed), min(1.0, PREVIEW_POINTS / total)
    names = sorted({n for p in parts for n in p[2]})
    positions, colours, extras = [], [], {n: [] for n in names}
    for p, c, e, m in parts:
        pick = rng.integers(0, len(p), int(len(p) * ratio))
        h = np.column_stack([p[pick], np.ones(len(pick))]) @ m.T
        positions.append((h[:, :3] / h[:, 3:]).astype(np.float32))
        colours.append(c[pick] if c is not None else np.zeros((len(pick), 3), np.uint8))
        for n in names:
            extras[n].append(e[n][pick] if n in e else np.zeros(len(pick), np.float32))
    return pnts.from_arrays(np.concatenate(positions), np.concatenate(colours), {n: np.concatenate(v) for n, v in extras.items()})


def combine(roots: Sequence[Tile], version: str = "1.0") -> TileSet:
    """One tileset of several root tiles: a new root moved to the centre of all boxes, the tiles re-based on it; its error is
    the box's diagonal."""
    if not roots:
        raise ValueError("nothing to combine")
    root = Tile(refine=REPLACE)
    for t in roots:
        root.add_child(t)
    move = np.eye(4)
    move[:3, 3] = root.box[:3]
    back = np.linalg.inv(move)
    root.box = box_transformed(root.box, back)
    root.transform = move
    for t in roots:
        t.transform = back @ t.transform
    c = box_corners(root.box)
    root.geometric_error = float(np.linalg.norm(c[-1] - c[0]))
    return TileSet(root, root.geometric_error, version)


def merge_files(paths: Sequence[str], out: str, seed: int = 0) -> TileSet:
    """A tileset that refers to those of ``paths`` (below the new one's folder), with a sampled preview at its root."""
    folder = os.path.dirname(os.path.abspath(out))
    sets = [TileSet.read(p) for p in paths]
    tiles = [Tile(s.root.geometric_error, s.root.world_box(), np.eye(4), REPLACE, os.path.relpath(p, folder).replace(os.sep, "/")) for s, p in zip(sets, paths, strict=True)]
    merged = combine(tiles)
    sample = preview(sets, np.linalg.inv(merged.root.transform), seed)
    if sample is not None:
        merged.root.content_uri = "preview.pnts"
        with open(os.path.join(folder, "preview.pnts"), "wb") as f:
            f.write(pnts.encode(sample))
    merged.write(out)
    return merged
