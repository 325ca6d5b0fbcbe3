"""Small 4x4 matrices on the driver (rows first)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


def scaling(s: Sequence[float] | float) -> np.ndarray:
    return np.diag([*np.broadcast_to(np.asarray(s, float), 3), 1.0])


def translation(v: Sequence[float]) -> np.ndarray:
    m = np.eye(4)
    m[:3, 3] = v
    return m


def rotation_between(a: Sequence[float], b: Sequence[float]) -> np.ndarray:
    """The 3x3 rotation that turns direction a to direction b; for opposite ones half a turn about a perpendicular axis."""
    u, v = np.asarray(a, float) / np.linalg.norm(a), np.asarray(b, float) / np.linalg.norm(b)
    c = float(u @ v)
    if c > 1 - 1e-15:
        return np.eye(3)
    if c < -1 + 1e-12:
        axis = np.cross(u, [1.0, 0, 0] if abs(u[0]) < 0.9 else [0, 1.0, 0])
        axis /= np.linalg.norm(axis)
        return 2 * np.outer(axis, axis) - np.eye(3)
    w = np.cross(u, v)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    return np.eye(3) + k + k @ k / (1 + c)


def local_frame(x: float, y: float, z: float) -> np.ndarray:
    """Rotation from earth-centred axes to east, north and up at a place (given earth-centred)."""
    lon, lat = math.atan2(y, x), math.atan2(z, math.hypot(x, y))
    east = [-math.sin(lon), math.cos(lon), 0.0]
    north = [-math.sin(lat) * math.cos(lon), -math.sin(lat) * math.sin(lon), math.cos(lat)]
    up = [math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)]
    return np.array([east, north, up])


def column_major(m: np.ndarray) -> list[float]:
    return m.T.reshape(-1).tolist()


def root_transform(offset: Sequence[float], scale: float, rotation: np.ndarray | None = None) -> np.ndarray:
    """From tile to world coordinates: turned back, scaled back, moved back."""
    turn = np.eye(4)
    if rotation is not None:
        turn[:3, :3] = np.linalg.inv(rotation)
    return translation(offset) @ scaling(1 / scale) @ turn
