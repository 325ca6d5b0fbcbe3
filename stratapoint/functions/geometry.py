"""Column expressions on points, boxes, matrices and colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
MIN_BOX_SIZE = 1e-5


def spacing(low: Sequence[Column], high: Sequence[Column]) -> Column:
    """Distance between kept points at the root: the box diagonal over 125."""
    return F.sqrt(sum(((b - a) * (b - a) for a, b in zip(low, high, strict=True)), F.lit(0.0))) / 125


def is_flat(dx: Column, dy: Column, dz: Column) -> Column:
    """Whether a box is split as a quadtree: its height is under half of its shorter side."""
    return dz / F.least(dx, dy) < 0.5


def valid_high(low: Column, high: Column) -> Column:
    """The upper bound, moved a little where the box has no extent."""
    return F.when(low == high, high + MIN_BOX_SIZE).otherwise(high)


def cubic_high(low: Sequence[Column], high: Sequence[Column]) -> list[Column]:
    side = F.greatest(*[b - a for a, b in zip(low, high, strict=True)])
    return [a + side for a in low]


def root_scale(root_spacing: Column) -> Column:
    return F.when(root_spacing > 10, F.lit(0.01)).when(root_spacing > 1, F.lit(0.1)).otherwise(F.lit(1.0))


def child_index(point: Sequence[Column], center: Sequence[Column]) -> Column:
    """Octant of float points about float centers: x is bit 2, y bit 1, z bit 0."""
    bits = [(p >= c).cast("int") * w for p, c, w in zip(point, center, (4, 2, 1), strict=True)]
    return bits[0] + bits[1] + bits[2]


def child_box(low: Sequence[Column], high: Sequence[Column], index: Column, flat: Column) -> tuple[list[Column], list[Column]]:
    """Bounds of a child; of a flat box the height: lower bound to the middle plus a half, so all of it, whatever the index."""
    half = [(b - a) * 0.5 for a, b in zip(low, high, strict=True)]
    in_x, in_y, in_z = (index.bitwiseAND(4) > 0), (index.bitwiseAND(2) > 0), (index.bitwiseAND(1) > 0) & ~flat
    lo = [a + F.when(up, h).otherwise(0.0) for a, h, up in zip(low, half, (in_x, in_y, in_z), strict=True)]
    hi = [a + h + F.when(up, h).otherwise(0.0) for a, h, up in zip(low, half, (in_x, in_y, in_z | flat), strict=True)]
    return lo, hi


def cell_key(point: Sequence[Column], low: Sequence[Column], size: Sequence[Column], cells: int = 3) -> Column:
    """Packed number of the grid cell: float differences, double products, cut to a whole number, kept in the grid."""
    shift = max(0, (cells - 1).bit_length())
    parts = []
    for k, (p, a, s) in enumerate(zip(point, low, size, strict=True)):
        inverse = (F.lit(1.0) / s).cast("float")
        place = (F.lit(float(cells)) * inverse.cast("double")) * (p.cast("float") - a.cast("float")).cast("double")
        parts.append(F.shiftleft(F.least(F.greatest(place.cast("long"), F.lit(0)), F.lit(cells - 1)).cast("int"), shift * k))
    return parts[0] + parts[1] + parts[2]


def offset_scaled(value: Column, offset: Column, scale: Column) -> Column:
    """Parsed as float, moved and scaled in double, kept as float."""
    return ((value.cast("float").cast("double") - offset) * scale).cast("float")


def affine(point: Sequence[Column], matrix: Column) -> list[Column]:
    """Point times a 4x4 matrix stored column by column; the weight is divided out."""
    m = lambda r, c: F.element_at(matrix, 4 * c + r + 1)
    x, y, z = point
    rows = [m(r, 0) * x + m(r, 1) * y + m(r, 2) * z + m(r, 3) for r in range(4)]
    return [r / rows[3] for r in rows[:3]]


def box_corners(box: Column) -> list[list[Column]]:
    """The eight corners of an oriented box: centre and three half axes, twelve numbers."""
    e = lambda k: F.element_at(box, k + 1)
    return [
        [e(k) + sx * e(3 + k) + sy * e(6 + k) + sz * e(9 + k) for k in range(3)]
        for sx in (-1.0, 1.0) for sy in (-1.0, 1.0) for sz in (-1.0, 1.0)
    ]


def box_bounds(box: Column) -> tuple[list[Column], list[Column]]:
    """Axis-aligned bounds of an oriented box."""
    e = lambda k: F.element_at(box, k + 1)
    reach = [F.abs(e(3 + k)) + F.abs(e(6 + k)) + F.abs(e(9 + k)) for k in range(3)]
    return [e(k) - reach[k] for k in range(3)], [e(k) + reach[k] for k in range(3)]


def bounds_box(low: Sequence[Column], high: Sequence[Column]) -> Column:
    """The twelve numbers of an axis-aligned box."""
    zero = F.lit(0.0)
    center = [(a + b) / 2 for a, b in zip(low, high, strict=True)]
    half = [(b - a) / 2 for a, b in zip(low, high, strict=True)]
    return F.array(*center, half[0], zero, zero, zero, half[1], zero, zero, zero, half[2])


def transformed_box(box: Column, matrix: Column) -> Column:
    """An oriented box under a 4x4 matrix: the centre is moved as a point, the half axes as directions."""
    e = lambda k: F.element_at(box, k + 1)
    m = lambda r, c: F.element_at(matrix, 4 * c + r + 1)
    center = affine([e(0), e(1), e(2)], matrix)
    axes = [m(r, 0) * e(3 * a) + m(r, 1) * e(3 * a + 1) + m(r, 2) * e(3 * a + 2) for a in (1, 2, 3) for r in range(3)]
    return F.array(*center, *axes)


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def triangle_normal(p: Sequence[Sequence[Column]]) -> list[Column]:
    """Unit normal of a triangle; (0, 0, 1) of one without area."""
    n = cross([b - a for a, b in zip(p[0], p[1], strict=True)], [b - a for a, b in zip(p[0], p[2], strict=True)])
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return [F.when(size == 0, F.lit(d)).otherwise(c / size) for c, d in zip(n, (0.0, 0.0, 1.0), strict=True)]


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def colour(value: Column, scale: float = 1.0, top: float = 255.0, divisor: float = 1.0) -> Column:
    """A colour scaled, clipped to its source's range and narrowed to 8 bits; a missing one is 0."""
    return F.floor(clamp(F.coalesce(value.cast("double"), F.lit(0.0)) * scale, 0.0, top) / divisor).cast("int")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2125 * r + 0.7154 * g + 0.0721 * b


def dms_degrees(d: Column, m: Column, s: Column, us: Column) -> Column:
    return d + m / 60 + s / 3600 + us / 3600e6


def padding(n: Column, k: int) -> Column:
    return F.pmod(F.lit(k) - F.pmod(n, F.lit(k)), F.lit(k))


def node_file(name: Column, suffix: str, width: int = 8) -> Column:
    """Path of a node: its name cut into folders of ``width`` digits, the last part behind an r in the file name."""
    tail = F.pmod(F.length(name) - 1, F.lit(width)) + 1
    last = F.substring(name, F.length(name) - tail + 1, tail)
    folders = F.regexp_replace(F.substring(name, F.lit(1), F.length(name) - tail), f"(.{{{width}}})", "$1/")
    return F.when(F.length(name) == 0, F.lit("r" + suffix)).otherwise(F.concat(folders, F.lit("r"), last, F.lit(suffix)))


def prefixes(name: Column) -> Column:
    """All prefixes of a node name, the empty one and itself included: the names of its ancestors."""
    return F.transform(F.sequence(F.lit(0), F.length(name)), lambda n: F.substring(name, F.lit(1), n))


def task_depth(name: Column) -> Column:
    """Levels below a node that one task may handle, by the length of its name."""
    n = F.length(name)
    return F.when(n == 0, 0).when(n <= 2, 1).when(n <= 4, 2).when(n <= 6, 3).otherwise(5)


def in_tile(point: Sequence[Column], low: Sequence[Column | float], high: Sequence[Column | float]) -> Column:
    """Whether a point stands in a tile: at the lower bounds or above, and below the upper ones."""
    inside = F.lit(True)
    for p, a, b in zip(point, low, high, strict=True):
        inside = inside & (p >= a) & (p < b)
    return inside


#: What names of classes and properties look like.
IDENTIFIER = "^[a-zA-Z_][a-zA-Z0-9_]*$"


def is_identifier(name: Column) -> Column:
    return name.rlike(IDENTIFIER)


def mangled(name: Column) -> Column:
    """The attribute name of a property: a line below and capitals."""
    return F.concat(F.lit("_"), F.upper(name))


def plain(attribute: Column) -> Column:
    """The property name of an attribute: small letters without the line below in front."""
    return F.lower(F.regexp_replace(attribute, "^_", ""))
