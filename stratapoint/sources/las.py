"""LAS and LAZ point files: headers and points are read by tasks, the latter by portions (of compressed files, chunks)."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapoint.errors import FormatNotSupported
from stratapoint.session import cut_lineage
from stratapoint.sources import laz

PORTION = 1_000_000
BATCH = 100_000
#: Points of one chunk of the compressed files written here.
CHUNK = 50_000

# The fields of the point record formats, in order.
_BASE = [("X", "i4"), ("Y", "i4"), ("Z", "i4"), ("intensity", "u2"), ("bit_fields", "u1"), ("classification", "u1"), ("scan_angle_rank", "i1"), ("user_data", "u1"), ("point_source_id", "u2")]
_BASE6 = [("X", "i4"), ("Y", "i4"), ("Z", "i4"), ("intensity", "u2"), ("bit_fields", "u2"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "i2"), ("point_source_id", "u2"), ("gps_time", "f8")]
_TIME, _RGB, _NIR = [("gps_time", "f8")], [("red", "u2"), ("green", "u2"), ("blue", "u2")], [("nir", "u2")]
_WAVE = [("wave_index", "u1"), ("wave_offset", "u8"), ("wave_size", "u4"), ("wave_location", "f4"), ("x_t", "f4"), ("y_t", "f4"), ("z_t", "f4")]
FORMATS = {
    0: _BASE, 1: _BASE + _TIME, 2: _BASE + _RGB, 3: _BASE + _TIME + _RGB, 4: _BASE + _TIME + _WAVE, 5: _BASE + _TIME + _RGB + _WAVE,
    6: _BASE6, 7: _BASE6 + _RGB, 8: _BASE6 + _RGB + _NIR, 9: _BASE6 + _WAVE, 10: _BASE6 + _RGB + _NIR + _WAVE,
}


@dataclass(frozen=True)
class Header:
    path: str
    version: tuple[int, int]
    count: int
    offset: int
    record: int
    point_format: int
    scales: tuple[float, float, float]
    offsets: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    crs: str | None = None  # "EPSG:" and its code, if the file names one
    coding: laz.Coding | None = None  # of compressed points

    @property
    def dtype(self) -> np.dtype:
        d = np.dtype([(n, "<" + k) for n, k in FORMATS[self.point_format]])
        return np.dtype({"names": d.names, "formats": [d[n] for n in d.names], "offsets": [d.fields[n][1] for n in d.names], "itemsize": self.record})

    @property
    def has_colour(self) -> bool:
        return "red" in self.dtype.names

    @property
    def extra_fields(self) -> list[tuple[str, str]]:
        return [(n, k) for n, k in FORMATS[self.point_format] if n not in ("X", "Y", "Z", "red", "green", "blue")]


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        raw = f.read(375)
    if raw[:4] != b"LASF":
        raise FormatNotSupported(f"{path} is no LAS file")
    major, minor = raw[24], raw[25]
    offset, _, kind, record, count = struct.unpack_from("<IIBHI", raw, 96)
    if kind & 0x40 or (kind & 0x3F) not in FORMATS:
        raise FormatNotSupported(f"{path} has points of format {kind}")
    v = struct.unpack_from("<12d", raw, 131)
    if (major, minor) >= (1, 4):
        count = struct.unpack_from("<Q", raw, 247)[0] or count
    return Header(path, (major, minor), count, offset, record, kind & 0x3F, v[0:3], v[3:6], (v[7], v[9], v[11]), (v[6], v[8], v[10]), _crs(path, raw), _coding(path, raw, offset, record) if kind & 0x80 else None)


def _coding(path: str, head: bytes, offset: int, record: int) -> laz.Coding:
    described = dict(_records(path, head, b"laszip encoded")).get(laz.RECORD)
    if described is None:
        raise FormatNotSupported(f"{path} doesn't say how its points are compressed")
    items, chunk = laz.describe(described)
    if sum(size for _, size in items) != record:
        raise FormatNotSupported(f"{path} has points of {record} bytes in parts {items}")
    return laz.Coding(items, chunk, laz.chunk_starts(path, offset))


# Records that hold the reference system, the keys of its codes in the first, and the code for "defined here".
GEO_KEYS, WKT = 34735, 2112
PROJECTED, GEOGRAPHIC, USER_DEFINED = 3072, 2048, 32767
#: A reference system is a few thousand characters at most; larger records are not looked into.
LARGEST_RECORD = 1 << 20


def _records(path: str, head: bytes, of: bytes = b"LASF_Projection") -> Iterator[tuple[int, bytes]]:
    """(id, content) of the records of one user, the projection's if not told otherwise, behind the header and, from version 1.4, behind the points."""
    size, _, n = struct.unpack_from("<HII", head, 94)
    runs = [(size, n, "<H16sHH32x")]
    if (head[24], head[25]) >= (1, 4) and len(head) >= 247:
        runs.append((*struct.unpack_from("<QI", head, 235), "<H16sHQ32x"))
    with open(path, "rb") as f:
        for at, n, form in runs:
            for _ in range(n):
                f.seek(at)
                lead = f.read(struct.calcsize(form))
                if len(lead) < struct.calcsize(form):
                    break
                _, user, number, length = struct.unpack(form, lead)
                if user.rstrip(b"\0") == of and length <= LARGEST_RECORD:
                    yield number, f.read(length)
                at += len(lead) + length


def _crs(path: str, head: bytes) -> str | None:
    """The reference system's code from the file's geographic keys or text; the header tells which of them counts if it has both."""
    found = dict(_records(path, head))
    text = wkt_code(found[WKT].split(b"\0")[0].decode("utf-8", "replace")) if WKT in found else None
    code = None
    if GEO_KEYS in found:
        raw = found[GEO_KEYS]
        keys = struct.unpack(f"<{len(raw) // 2}H", raw[: len(raw) // 2 * 2])
        own = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}  # the value stands in the key itself
        code = next((own[k] for k in (PROJECTED, GEOGRAPHIC) if own.get(k, 0) not in (0, USER_DEFINED)), None)
    by_text = struct.unpack_from("<H", head, 6)[0] & 16
    best = (text or code) if by_text else (code or text)
    return None if best is None else f"EPSG:{best}"


_WKT_PART = re.compile(r'"(?:[^"]|"")*"|[A-Za-z_][A-Za-z_0-9]*\s*[\[(]|[\])]|,|[^\s,\[\]()"]+')


def wkt_code(text: str) -> int | None:
    """The EPSG code of a reference system in well-known text: that of its outermost system or, of a compound one, its
    horizontal part. None without one."""
    path: list[list] = []
    found: dict[int, int] = {}  # depth of the system: its code
    compound = False
    for m in _WKT_PART.finditer(text):
        part = m[0]
        if part[-1] in "[(":
            name = part[:-1].strip().upper()
            if not path:
                compound = name.startswith("COMP")
            path.append([name, []])
        elif part in ")]":
            if not path:
                return None
            name, values = path.pop()
            if name in ("AUTHORITY", "ID") and len(values) > 1 and values[0].upper() == "EPSG" and values[1].isdigit():
                system = path[-1][0] if path else ""
                vertical = any(n.startswith("VERT") for n, _ in path)
                if re.fullmatch(r"(PROJ|GEOG|GEOC|GEOD|BASEGEOG)(CS|CRS|ETICCRS|ICCRS|RAPHICCRS)|PROJECTEDCRS", system) and not vertical:
                    found.setdefault(len(path), int(values[1]))
        elif part != "," and path:
            path[-1][1].append(part.strip('"'))
    depth = 2 if compound else 1
    return found.get(depth)


HEADS = "path string, point_count long, aabb array<double>, crs_in string, has_color boolean, extra_fields array<struct<name: string, dtype: string>>, portion long"


def _heads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file from its header, read by the tasks; portion: points of one unit of work."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.column(0).to_pylist():
                h = read_header(p)
                fields = [{"name": n, "dtype": k} for n, k in h.extra_fields]
                rows.append((p, h.count, [*h.low, *h.high], h.crs, h.has_colour, fields, h.coding.chunk if h.coding else PORTION))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.int64(), pa.list_(pa.float64()), pa.string(), pa.bool_(), pa.list_(pa.struct([("name", pa.string()), ("dtype", pa.string())])), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in HEADS.replace("array<struct<name: string, dtype: string>>", "x").split(", ")])

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(max(1, min(len(paths), 1000)), "path").mapInArrow(read, HEADS)


def metadata(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file from its header alone, the points unread."""
    return _heads(spark, paths).drop("portion")


_TYPES = {"u1": "smallint", "i1": "tinyint", "u2": "int", "i2": "smallint", "u4": "bigint", "i4": "int", "u8": "bigint", "f4": "float", "f8": "double"}


def scan(spark: SparkSession, paths: list[str], fields: tuple[str, ...] = ("intensity", "classification")) -> DataFrame:
    """path, point_no, x, y, z, red, green, blue (8 bits; 0 without colours) and the asked fields (0 in files that lack them).

    16-bit colours are divided by 256; a file whose colours all stay below 256 is taken as 8-bit. Only the asked fields leave
    the reader. Portions of a million points, or chunks of compressed ones, are the tasks' units.
    """
    heads = cut_lineage(_heads(spark, paths))
    named = heads.select(F.explode("extra_fields").alias("f")).where(F.col("f.name").isin(*fields)).select("f.name", "f.dtype").distinct().collect()  # a few kinds a field
    kinds = {}
    for f in fields:
        found = [np.dtype(r.dtype) for r in named if r.name == f]
        if found:
            k = np.result_type(*found)
            kinds[f] = f"{k.kind}{k.itemsize}"
    schema = "path string, point_no long, x double, y double, z double, red smallint, green smallint, blue smallint" + "".join(f", {f} {_TYPES[k]}" for f, k in kinds.items())
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("point_count") - 1, F.col("portion"))).alias("start")
    portions = heads.where("point_count > 0").select("path", "has_color", "point_count", "portion", begin)
    units = portions.select("path", "start", F.least("portion", F.col("point_count") - F.col("start")).alias("n"), "has_color")
    n_units, n_points = heads.agg(F.sum(F.ceil(F.col("point_count") / F.col("portion"))), F.sum("point_count")).first()
    # a portion a task; portions of many small files share tasks
    tasks = max(1, min(int(n_units or 0), 2 * spark.sparkContext.defaultParallelism + int(n_points or 0) // BATCH))
    units = units.repartition(tasks, "path", "start")
    small = units.where("has_color").mapInArrow(_large_colours, "path string, large boolean").groupBy("path").agg((~F.max("large")).alias("eight_bit"))
    units = units.join(small, "path", "left").select("path", "start", "n", F.coalesce("eight_bit", F.lit(False)).alias("eight_bit")).repartition(tasks, "path", "start")
    types = {"smallint": pa.int16(), "tinyint": pa.int8(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, n, eight_bit in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                h = read_header(path)
                for at, rows in _rows(h, start, n):
                    k = len(rows)
                    xyz = [rows[a] * s + o for a, s, o in zip("XYZ", h.scales, h.offsets, strict=True)]
                    rgb = [(rows[c] // (1 if eight_bit else 256)).astype(np.int16) if h.has_colour else np.zeros(k, np.int16) for c in ("red", "green", "blue")]
                    extra = [pa.array((rows[f] if f in rows.dtype.names else np.zeros(k)).astype(types[_TYPES[t]].to_pandas_dtype())) for f, t in kinds.items()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * k), pa.array(np.arange(at, at + k)), *map(pa.array, xyz), *map(pa.array, rgb), *extra],
                        ["path", "point_no", "x", "y", "z", "red", "green", "blue", *kinds],
                    )

    return units.mapInArrow(read, schema)


def _large_colours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a portion has a colour above 255 (the format says 16 bits, some writers use 8); it ends at the first."""
    for batch in batches:
        paths, large = batch.column(0), []
        for path, start, n in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            large.append(any(max(int(rows[c].max()) for c in ("red", "green", "blue")) > 255 for _, rows in _rows(read_header(path), start, n) if len(rows)))
        yield pa.RecordBatch.from_arrays([paths, pa.array(large, pa.bool_())], ["path", "large"])


def _rows(h: Header, start: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first, point records) of a portion, in batches; of a compressed file a portion is a chunk."""
    if h.coding is None:
        for at in range(start, start + n, BATCH):
            yield at, np.fromfile(h.path, h.dtype, min(BATCH, start + n - at), offset=h.offset + at * h.record)
        return
    k = start // h.coding.chunk
    with open(h.path, "rb") as f:
        f.seek(h.coding.starts[k])
        data = f.read(h.coding.starts[k + 1] - h.coding.starts[k] if k + 1 < len(h.coding.starts) else -1)
    rows = np.frombuffer(laz.read_chunk(data, h.coding.items, n), h.dtype)
    for at in range(0, n, BATCH):
        yield start + at, rows[at : at + BATCH]


def write(path: str, xyz: np.ndarray, colours: np.ndarray | None = None, scale: float = 0.001, crs: int | str | None = None, **fields: np.ndarray) -> None:
    """A small LAS 1.2 file of format 0 or 2, compressed if its name ends in .laz; ``crs``: a projected system's code, or any
    system as text."""
    kind = 2 if colours is not None else 0
    dtype = np.dtype([(n, "<" + k) for n, k in FORMATS[kind]])
    rows = np.zeros(len(xyz), dtype)
    low = xyz.min(axis=0) if len(xyz) else np.zeros(3)
    high = xyz.max(axis=0) if len(xyz) else np.zeros(3)
    for k, a in enumerate("XYZ"):
        rows[a] = np.round((xyz[:, k] - low[k]) / scale)
    for k, c in enumerate(("red", "green", "blue") if colours is not None else ()):
        rows[c] = colours[:, k]
    for n, v in fields.items():
        rows[n] = v
    head = bytearray(227)
    record = b""
    if crs is not None:
        body = crs.encode() + b"\0" if isinstance(crs, str) else struct.pack("<8H", 1, 1, 0, 1, PROJECTED, 0, 1, crs)
        record = struct.pack("<H16sHH32x", 0, b"LASF_Projection", WKT if isinstance(crs, str) else GEO_KEYS, len(body)) + body
    compressed, n_records, points = path.lower().endswith(".laz"), int(bool(record)), rows.tobytes()
    if compressed:
        items = ((laz.POINT, 20), (laz.COLOUR, 6))[: 1 + (kind == 2)]
        body = laz.record(items, CHUNK)
        record += struct.pack("<H16sHH32x", 0, b"laszip encoded", laz.RECORD, len(body)) + body
        points = laz.coded([points[k : k + dtype.itemsize] for k in range(0, len(points), dtype.itemsize)], items, CHUNK, 227 + len(record))
    head[0:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HIIBHI", head, 94, 227, 227 + len(record), n_records + compressed, kind | 0x80 * compressed, dtype.itemsize, len(xyz))
    struct.pack_into("<12d", head, 131, scale, scale, scale, *low, high[0], low[0], high[1], low[1], high[2], low[2])
    with open(path, "wb") as f:
        f.write(bytes(head) + record + points)
        f.flush()
        os.fsync(f.fileno())
