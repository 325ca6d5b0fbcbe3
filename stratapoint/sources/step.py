"""Building files (STEP text): entities, the spatial tree, properties and simple geometry."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from stratapoint.errors import InvalidIfc

_ENTITY = re.compile(r"#(\d+)\s*=\s*([A-Za-z0-9_]+)\s*\(")
# Types that begin a tile of their own.
SPATIAL = ("IFCPROJECT", "IFCSITE", "IFCBUILDING", "IFCBUILDINGSTOREY", "IFCSPACE")
# Parts of a curve by numbers of points, lengths of prefixed units, and corners of a full turn.
CURVE_PARTS = ("IFCLINEINDEX", "IFCARCINDEX")
PREFIXES = {"EXA": 1e18, "PETA": 1e15, "TERA": 1e12, "GIGA": 1e9, "MEGA": 1e6, "KILO": 1e3, "HECTO": 1e2, "DECA": 1e1, "DECI": 1e-1, "CENTI": 1e-2, "MILLI": 1e-3, "MICRO": 1e-6, "NANO": 1e-9}
TURN = 24
ENTITIES = "path string, id long, type string, args string"
TREE = "path string, id long, parent_id long, depth int, type string, name string, guid string"


@dataclass(frozen=True)
class Ref:
    id: int


@dataclass(frozen=True)
class Word:
    text: str


def statements(text: str) -> Iterator[tuple[int, str, str]]:
    """(id, type, arguments) of each entity of the data section; strings may hold any sign."""
    at = text.find("DATA;")
    while True:
        m = _ENTITY.search(text, at)
        if not m:
            return
        k, depth, quoted = m.end(), 1, False
        while depth and k < len(text):
            c = text[k]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c == "(") - (c == ")")
            k += 1
        yield int(m[1]), m[2].upper(), text[m.end() : k - 1]
        at = k


def arguments(text: str) -> list:
    """Arguments as Python values: references, strings, numbers, words, lists, None for $ and *."""
    out, at = _list(text, 0)
    return out


def _list(text: str, at: int) -> tuple[list, int]:
    out: list = []
    while at < len(text):
        c = text[at]
        if c in " \t\r\n,":
            at += 1
        elif c == ")":
            return out, at + 1
        elif c == "(":
            value, at = _list(text, at + 1)
            out.append(value)
        elif c == "'":
            end = at + 1
            while True:
                end = text.index("'", end)
                if text[end + 1 : end + 2] != "'":
                    break
                end += 2
            out.append(text[at + 1 : end].replace("''", "'"))
            at = end + 1
        elif c == "#":
            m = re.compile(r"\d+").match(text, at + 1)
            out.append(Ref(int(m[0])))
            at = m.end()
        elif c in "$*":
            out.append(None)
            at += 1
        elif c == ".":
            end = text.find(".", at + 1)
            out.append(Word(text[at + 1 : end]))
            at = end + 1
        else:
            m = re.compile(r"[-+0-9.eE]+").match(text, at)
            if m:
                out.append(float(m[0]) if any(x in m[0] for x in ".eE") else int(m[0]))
                at = m.end()
            else:
                m = re.compile(r"[A-Za-z0-9_]+\s*").match(text, at)
                if not m:
                    at += 1
                    continue
                at = m.end()
                if text[at : at + 1] == "(":  # a typed value; of parts of curves the type tells what they are
                    value, at = _list(text, at + 1)
                    out += [(m[0].strip().upper(), value[0])] if m[0].strip().upper() in CURVE_PARTS else value
    return out, at


@dataclass
class Model:
    entities: dict[int, tuple[str, list]] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Model:
        return cls({i: (kind, arguments(args)) for i, kind, args in statements(text)})

    def of(self, *kinds: str) -> list[int]:
        return [i for i, (k, _) in self.entities.items() if k in kinds]

    def get(self, ref: Ref | int | None) -> tuple[str, list]:
        return self.entities.get(ref.id if isinstance(ref, Ref) else ref, ("", []))

    def links(self) -> list[tuple[int, int]]:
        """(parent, child) by aggregation, then by spatial containment."""
        out = [(a[4].id, c.id) for k in ("IFCRELAGGREGATES", "IFCRELNESTS") for i in self.of(k) for a in [self.entities[i][1]] for c in a[5]]
        return out + [(a[5].id, c.id) for i in self.of("IFCRELCONTAINEDINSPATIALSTRUCTURE") for a in [self.entities[i][1]] for c in a[4]]

    def tree(self) -> Iterator[tuple[int, int | None, int]]:
        """(id, parent, depth) from the one project down, breadth first; an element reached twice counts where first met."""
        projects = self.of("IFCPROJECT")
        if len(projects) != 1:
            raise InvalidIfc(f"{len(projects)} projects")
        below: dict[int, list[int]] = {}
        for p, c in self.links():
            below.setdefault(p, []).append(c)
        layer: list[tuple[int, int | None]] = [(projects[0], None)]
        seen, depth = {projects[0]}, 0
        while layer:
            following = []
            for i, p in layer:
                yield i, p, depth
                for c in below.get(i, ()):
                    if c not in seen:
                        seen.add(c)
                        following.append((c, i))
            layer, depth = following, depth + 1

    # -- geometry: swept, tessellated, bounded by faces, cut by planes, mapped --

    def placement(self, ref: Ref | None) -> np.ndarray:
        kind, a = self.get(ref)
        if kind == "IFCLOCALPLACEMENT":
            return self.placement(a[0]) @ self.placement(a[1])
        m = np.eye(4)
        if kind == "IFCAXIS2PLACEMENT3D":
            z = self._direction(a[1], (0.0, 0.0, 1.0))
            x = self._direction(a[2], (1.0, 0.0, 0.0))
            x = x - z * (x @ z)
            x /= np.linalg.norm(x) or 1.0
            m[:3, 0], m[:3, 1], m[:3, 2], m[:3, 3] = x, np.cross(z, x), z, self._point(a[0])
        elif kind == "IFCAXIS2PLACEMENT2D":
            x = self._direction(a[1] if len(a) > 1 else None, (1.0, 0.0))
            m[:2, 0], m[:2, 1], m[:2, 3] = x[:2], (-x[1], x[0]), self._point(a[0])[:2]
        return m

    def _point(self, ref: Ref) -> np.ndarray:
        c = [float(v) for v in self.get(ref)[1][0]]
        return np.array(c + [0.0] * (3 - len(c)))

    def _direction(self, ref: Ref | None, default: tuple[float, ...]) -> np.ndarray:
        c = np.array([float(v) for v in self.get(ref)[1][0]] if ref is not None else default)
        return c / (np.linalg.norm(c) or 1.0)

    def unit(self) -> float:
        """Metres of one unit of length; 1 if the file names none."""
        for i in self.of("IFCUNITASSIGNMENT"):
            for u in self.entities[i][1][0]:
                kind, a = self.get(u)
                if kind == "IFCSIUNIT" and a[1] == Word("LENGTHUNIT"):
                    return PREFIXES.get(a[2].text, 1.0) if isinstance(a[2], Word) else 1.0
                if kind == "IFCCONVERSIONBASEDUNIT" and a[1] == Word("LENGTHUNIT"):
                    factor, of = self.get(a[3])[1][:2]
                    base = self.get(of)[1]
                    return float(factor) * (PREFIXES.get(base[2].text, 1.0) if len(base) > 2 and isinstance(base[2], Word) else 1.0)
        return 1.0

    def curve(self, ref: Ref) -> np.ndarray | None:
        """Points of a closed curve in the plane, the last one joined to the first; None of a kind that isn't known."""
        kind, a = self.get(ref)
        if kind == "IFCPOLYLINE":
            ring = np.array([self._point(p)[:2] for p in a[0]])
        elif kind == "IFCINDEXEDPOLYCURVE":
            points = np.array([[float(v) for v in p][:2] for p in self.get(a[0])[1][0]])
            if a[1] is None:
                ring = points
            else:
                parts = []
                for name, at in a[1]:
                    p = points[np.array(at, int) - 1]
                    parts.append(p[:-1] if name == "IFCLINEINDEX" else _arc(*p)[:-1])
                ring = np.concatenate(parts)
        elif kind in ("IFCCIRCLE", "IFCELLIPSE"):
            angle = np.linspace(0, 2 * math.pi, TURN, endpoint=False)
            ring = _placed(np.column_stack([float(a[1]) * np.cos(angle), float(a[-1]) * np.sin(angle)]), self.placement(a[0]))
        else:
            return None
        return ring[:-1] if len(ring) > 1 and np.allclose(ring[0], ring[-1]) else ring

    def rings(self, ref: Ref) -> list[np.ndarray] | None:
        """The outer ring of a profile and its holes, or None of a kind that isn't known. Rounded edges of beams are left out."""
        kind, a = self.get(ref)
        if kind in ("IFCARBITRARYCLOSEDPROFILEDEF", "IFCARBITRARYPROFILEDEFWITHVOIDS"):
            rings = [self.curve(c) for c in [a[2], *(a[3] if kind.endswith("VOIDS") else ())]]
            return None if any(r is None for r in rings) else _wound(rings)
        size = [float(v) if isinstance(v, int | float) else 0.0 for v in a[3:9]] + [0.0] * 6
        box = lambda w, h: np.array([[-w, -h], [w, -h], [w, h], [-w, h]]) / 2
        angle = np.linspace(0, 2 * math.pi, TURN, endpoint=False)
        round_ = lambda rx, ry: np.column_stack([rx * np.cos(angle), ry * np.sin(angle)])
        if kind in ("IFCRECTANGLEPROFILEDEF", "IFCROUNDEDRECTANGLEPROFILEDEF"):
            rings = [box(size[0], size[1])]
            if kind.startswith("IFCROUNDED"):
                r = size[2]
                quarter = np.linspace(0, math.pi / 2, TURN // 4 + 1)
                turned = [np.column_stack([r * np.cos(quarter + k * math.pi / 2), r * np.sin(quarter + k * math.pi / 2)]) for k in range(4)]
                rings = [np.concatenate([t + c for t, c in zip(turned, box(size[0] - 2 * r, size[1] - 2 * r)[[2, 3, 0, 1]], strict=True)])]
        elif kind == "IFCRECTANGLEHOLLOWPROFILEDEF":
            rings = [box(size[0], size[1]), box(size[0] - 2 * size[2], size[1] - 2 * size[2])]
        elif kind == "IFCCIRCLEPROFILEDEF":
            rings = [round_(size[0], size[0])]
        elif kind == "IFCCIRCLEHOLLOWPROFILEDEF":
            rings = [round_(size[0], size[0]), round_(size[0] - size[1], size[0] - size[1])]
        elif kind == "IFCELLIPSEPROFILEDEF":
            rings = [round_(size[0], size[1])]
        elif kind == "IFCISHAPEPROFILEDEF":
            w, h, t, f = size[0] / 2, size[1] / 2, size[2] / 2, size[3]
            rings = [np.array([[-w, -h], [w, -h], [w, f - h], [t, f - h], [t, h - f], [w, h - f], [w, h], [-w, h], [-w, h - f], [-t, h - f], [-t, f - h], [-w, f - h]])]
        elif kind == "IFCLSHAPEPROFILEDEF":
            h, w, t = size[0] / 2, (size[1] or size[0]) / 2, size[2]
            rings = [np.array([[-w, -h], [w, -h], [w, t - h], [t - w, t - h], [t - w, h], [-w, h]])]
        elif kind == "IFCTSHAPEPROFILEDEF":
            h, w, t, f = size[0] / 2, size[1] / 2, size[2] / 2, size[3]
            rings = [np.array([[-t, -h], [t, -h], [t, h - f], [w, h - f], [w, h], [-w, h], [-w, h - f], [-t, h - f]])]
        elif kind == "IFCUSHAPEPROFILEDEF":
            h, w, t, f = size[0] / 2, size[1] / 2, size[2], size[3]
            rings = [np.array([[-w, -h], [w, -h], [w, f - h], [t - w, f - h], [t - w, h - f], [w, h - f], [w, h], [-w, h]])]
        else:
            return None
        return _wound([_placed(r, self.placement(a[2])) for r in rings])

    def _faces(self, shell: Ref) -> np.ndarray:
        """Triangles of a shell's faces, each of an outer bound and holes."""
        from stratapoint.operators.mesh import triangulate

        out = []
        for f in self.get(shell)[1][0]:
            rings = [np.array([self._point(p) for p in self.get(self.get(b)[1][0])[1][0]]) for b in self.get(f)[1][0]]
            out.append(triangulate(rings))
        return np.concatenate(out) if out else np.empty((0, 3, 3))

    def operator(self, ref: Ref) -> np.ndarray:
        """The matrix of a transformation operator: axes, origin and scales."""
        kind, a = self.get(ref)
        m = np.eye(4)
        if not kind.startswith("IFCCARTESIANTRANSFORMATIONOPERATOR3D"):
            return m
        x = self._direction(a[0], (1.0, 0.0, 0.0))
        z = self._direction(a[4] if len(a) > 4 else None, (0.0, 0.0, 1.0)) if a[1] is None or (len(a) > 4 and a[4] is not None) else None
        if z is None:
            z = np.cross(x, self._direction(a[1], (0.0, 1.0, 0.0)))
        x = x - z * (x @ z)
        x /= np.linalg.norm(x) or 1.0
        y = np.cross(z, x)
        if a[1] is not None and y @ self._direction(a[1], (0.0, 1.0, 0.0)) < 0:
            y = -y  # mirrored
        s = float(a[3]) if a[3] is not None else 1.0
        more = [float(v) if v is not None else s for v in a[5:7]] if kind.endswith("NONUNIFORM") else [s, s]
        m[:3, 0], m[:3, 1], m[:3, 2], m[:3, 3] = x * s, y * more[0], z * more[1], self._point(a[2])
        return m

    def triangles(self, ref: Ref) -> np.ndarray | None:
        """Triangles (n, 3, 3) of a shape item, or None of a kind that isn't known (the caller reports it)."""
        from stratapoint.operators.mesh import triangulate

        kind, a = self.get(ref)
        if kind == "IFCEXTRUDEDAREASOLID":
            rings = self.rings(a[0])
            if rings is None or len(rings[0]) < 3:
                return None
            along = self._direction(a[2], (0.0, 0.0, 1.0)) * float(a[3])
            low = [np.column_stack([r, np.zeros(len(r))]) for r in rings]
            return _moved(_swept(low, [r + along for r in low], triangulate), self.placement(a[1]))
        if kind == "IFCREVOLVEDAREASOLID":
            rings = self.rings(a[0])
            if rings is None or len(rings[0]) < 3:
                return None
            axis = self.get(a[2])[1]
            at, along, angle = self._point(axis[0]), self._direction(axis[1], (0.0, 0.0, 1.0)), float(a[3])
            steps = max(1, math.ceil(abs(angle) / (2 * math.pi / TURN)))
            flat = [np.column_stack([r, np.zeros(len(r))]) for r in rings]
            layers = [[_turned(r, at, along, angle * k / steps) for r in flat] for k in range(steps + 1)]
            whole = abs(abs(angle) - 2 * math.pi) < 1e-6
            sides = [_swept(p, q, None) for p, q in zip(layers, layers[1:], strict=False)]
            caps = [] if whole else [triangulate(layers[0])[:, ::-1], triangulate(layers[-1])]
            return _moved(np.concatenate([*sides, *caps]), self.placement(a[1]))
        if kind in ("IFCTRIANGULATEDFACESET", "IFCPOLYGONALFACESET"):
            points = np.array([[float(v) for v in p] for p in self.get(a[0])[1][0]])
            if kind == "IFCTRIANGULATEDFACESET":
                return points[np.array(a[3], int) - 1]
            faces = [np.array(self.get(f)[1][0], int) - 1 for f in a[2]]
            return np.concatenate([triangulate([points[f]]) for f in faces])
        if kind == "IFCFACETEDBREP":
            return self._faces(a[0])
        if kind == "IFCFACETEDBREPWITHVOIDS":
            return np.concatenate([self._faces(shell) for shell in [a[0], *a[1]]])
        if kind in ("IFCSHELLBASEDSURFACEMODEL", "IFCFACEBASEDSURFACEMODEL"):
            return np.concatenate([self._faces(shell) for shell in a[0]])
        if kind in ("IFCBOOLEANCLIPPINGRESULT", "IFCBOOLEANRESULT"):
            half, h = self.get(a[2])
            surface, plane = self.get(h[0]) if half == "IFCHALFSPACESOLID" else ("", [])
            solid = self.triangles(a[1]) if a[0] == Word("DIFFERENCE") and surface == "IFCPLANE" else None
            if solid is None:
                return None
            m = self.placement(plane[0])
            # the half below the plane is taken away if the half space agrees with the plane's normal
            out = -m[:3, 2] if h[1] in (Word("F"), False) else m[:3, 2]
            return _cut(solid, m[:3, 3], out, triangulate)
        if kind == "IFCMAPPEDITEM":
            source = self.get(a[0])[1]
            parts = [self.triangles(i) for i in self.get(source[1])[1][3]]
            parts = [p for p in parts if p is not None]
            return _moved(np.concatenate(parts), self.operator(a[1]) @ np.linalg.inv(self.placement(source[0]))) if parts else None
        return None

    def element_triangles(self, element: int) -> tuple[np.ndarray | None, int]:
        """World triangles of an element in metres, and how many of its shape items are of unknown kinds. Openings are not cut."""
        kind, a = self.entities[element]
        if len(a) < 7 or not isinstance(a[6], Ref) or self.get(a[6])[0] != "IFCPRODUCTDEFINITIONSHAPE":
            return None, 0
        m = np.diag([self.unit()] * 3 + [1.0]) @ self.placement(a[5])
        out, skipped = [], 0
        for r in self.get(a[6])[1][2]:
            rep = self.get(r)[1]
            if len(rep) > 3 and rep[1] in (None, "Body", "Facetation"):
                for item in rep[3]:
                    t = self.triangles(item)
                    if t is None:
                        skipped += 1
                    else:
                        out.append(t @ m[:3, :3].T + m[:3, 3])
        return (np.concatenate(out) if out else None), skipped


def _placed(ring: np.ndarray, m: np.ndarray) -> np.ndarray:
    return ring @ m[:2, :2].T + m[:2, 3]


def _wound(rings: list[np.ndarray]) -> list[np.ndarray]:
    """The outer ring to the left, holes to the right, so that what is swept looks outwards."""
    area = [float((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum()) for r in rings]
    return [r[::-1] if (s < 0) == (k == 0) and s != 0 else r for k, (r, s) in enumerate(zip(rings, area, strict=True))]


def _moved(triangles: np.ndarray, m: np.ndarray) -> np.ndarray:
    return triangles @ m[:3, :3].T + m[:3, 3]


def _arc(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Points of the arc from a through b to c."""
    (x1, y1), (x2, y2) = b - a, c - a
    d = 2 * (x1 * y2 - y1 * x2)
    if abs(d) < 1e-12:
        return np.array([a, b, c])
    r1, r2 = x1 * x1 + y1 * y1, x2 * x2 + y2 * y2
    center = a + np.array([y2 * r1 - y1 * r2, x1 * r2 - x2 * r1]) / d
    at = [math.atan2(*(p - center)[::-1]) for p in (a, b, c)]
    turn = (at[2] - at[0]) % (2 * math.pi)
    if (at[1] - at[0]) % (2 * math.pi) > turn:
        turn -= 2 * math.pi
    angles = at[0] + np.linspace(0, turn, max(2, math.ceil(abs(turn) / (2 * math.pi / TURN)) + 1))
    return center + np.linalg.norm(a - center) * np.column_stack([np.cos(angles), np.sin(angles)])


def _turned(points: np.ndarray, at: np.ndarray, along: np.ndarray, angle: float) -> np.ndarray:
    p = points - at
    c, s = math.cos(angle), math.sin(angle)
    return at + p * c + np.cross(along, p) * s + np.outer(p @ along, along) * (1 - c)


def _swept(low: list[np.ndarray], high: list[np.ndarray], triangulate) -> np.ndarray:  # noqa: ANN001
    """Triangles between two places of a profile's rings and, with a triangulation, of both ends."""
    out = [] if triangulate is None else [triangulate(high), triangulate(low)[:, ::-1]]
    for a, b in zip(low, high, strict=True):
        after = np.roll(np.arange(len(a)), -1)
        out += [np.stack([a, a[after], b[after]], axis=1), np.stack([a, b[after], b], axis=1)]
    return np.concatenate(out)


def _cut(triangles: np.ndarray, at: np.ndarray, out: np.ndarray, triangulate) -> np.ndarray:  # noqa: ANN001
    """The part of a closed surface on the side of a plane that ``out`` points to, closed along the plane."""
    kept, edges = [], []
    for t in triangles:
        d = (t - at) @ out
        d[np.abs(d) < 1e-9] = 0.0
        if (d >= 0).all():
            kept.append(t)
            continue
        if (d <= 0).all():
            continue
        ring, crossed = [], []
        for k in range(3):
            p, q, dp, dq = t[k], t[(k + 1) % 3], d[k], d[(k + 1) % 3]
            if dp >= 0:
                ring.append(p)
                if dp == 0:
                    crossed.append(p)
            if dp * dq < 0:
                x = p + (q - p) * (dp / (dp - dq))
                ring.append(x)
                crossed.append(x)
        kept += [np.array([ring[0], ring[k], ring[k + 1]]) for k in range(1, len(ring) - 1)]
        if len(crossed) == 2:
            edges.append(crossed)
    loops = _loops(edges)
    if loops:
        loops.sort(key=lambda r: -np.linalg.norm(np.cross(r - r[0], np.roll(r, -1, axis=0) - r[0]).sum(axis=0)))
        # loops inside the largest are holes, others close for themselves
        cap = triangulate(loops) if len(loops) > 1 and all(_within(r[0], loops[0], out) for r in loops[1:]) else np.concatenate([triangulate([r]) for r in loops])
        if len(cap) and np.cross(cap[0, 1] - cap[0, 0], cap[0, 2] - cap[0, 0]) @ out > 0:
            cap = cap[:, ::-1]
        kept += list(cap)
    return np.array(kept).reshape(-1, 3, 3)


def _loops(edges: list) -> list[np.ndarray]:
    """Closed rings of edges that share ends."""
    key = lambda p: tuple(np.round(p, 7) + 0.0)
    around: dict[tuple, list[tuple]] = {}
    place: dict[tuple, np.ndarray] = {}
    for p, q in edges:
        a, b = key(p), key(q)
        if a != b and b not in around.get(a, ()):
            place[a], place[b] = p, q
            around.setdefault(a, []).append(b)
            around.setdefault(b, []).append(a)
    out = []
    while around:
        start = at = next(iter(around))
        ring = []
        while at in around and around[at]:
            ring.append(place[at])
            after = around[at].pop()
            if not around[at]:
                del around[at]
            if after in around and at in around[after]:
                around[after].remove(at)
                if not around[after]:
                    del around[after]
            at = after
            if at == start:
                break
        around.pop(start, None) if start in around and not around[start] else None
        if at == start and len(ring) > 2:
            out.append(np.array(ring))
    return out


def _within(p: np.ndarray, ring: np.ndarray, out: np.ndarray) -> bool:
    axes = [k for k in range(3) if k != int(np.argmax(np.abs(out)))]
    (x, y), r = p[axes], ring[:, axes]
    a, b = r, np.roll(r, -1, axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = ((a[:, 1] > y) != (b[:, 1] > y)) & (x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0])
    return bool(hit.sum() % 2)


def degrees(parts: list | None) -> float | None:
    """Degrees of a compound angle: degrees, minutes, seconds and millionths."""
    if not parts:
        return None
    d, m, s, us = [*parts, 0, 0][:4]
    return d + m / 60 + s / 3600 + us / 3600e6


def entities(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, id, type, args of every entity."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(path, *s) for s in statements(content.decode("utf-8", "replace"))], columns=["path", "id", "type", "args"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(read, ENTITIES)


def spatial_tree(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, id, parent_id, depth, type, name, guid of every element below the project. Ids are unique within a path."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                model = Model.parse(content.decode("utf-8", "replace"))
                rows = [(path, i, p, depth, model.entities[i][0], model.entities[i][1][2], model.entities[i][1][0]) for i, p, depth in model.tree()]
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in TREE.split(", ")])
                out["parent_id"] = out["parent_id"].astype("Int64")
                yield out

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(read, TREE)
