"""PLY point files, text and binary of either byte order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapoint.errors import FormatNotSupported
from stratapoint.session import cut_lineage

PORTION = 1_000_000
#: Points read at once.
BATCH = 100_000
# Type names of the format.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
COLOURS = ("red", "green", "blue")


@dataclass(frozen=True)
class Header:
    path: str
    order: str  # "<", ">" or "" for text
    count: int
    offset: int
    fields: tuple[tuple[str, str], ...]
    skipped_lines: int = 0

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, (self.order or "<") + k) for n, k in self.fields])

    @property
    def extra_fields(self) -> list[tuple[str, str]]:
        return [(n, k) for n, k in self.fields if n not in ("x", "y", "z", *COLOURS)]

    @property
    def colour_divisor(self) -> float:
        """What brings a colour to 8 bits: by the size of whole numbers, 1 for floats (0 to 1, or 0 to 255, as given)."""
        kinds = [k for n, k in self.fields if n in COLOURS]
        if not kinds or kinds[0][0] == "f":
            return 1.0
        bits = 8 * (int(kinds[0][1]) - 1) - (kinds[0][0] == "i")
        return float(max(1, 2**bits if bits > 0 else 1))


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise FormatNotSupported(f"{path} is no PLY file")
        order, elements = None, []
        while True:
            line = f.readline()
            if not line:
                raise FormatNotSupported(f"{path} has no end of header")
            words = line.decode("ascii", "replace").split()
            if not words or words[0] in ("comment", "obj_info"):
                continue
            if words[0] == "format":
                order = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}[words[1]]
            elif words[0] == "element":
                elements.append((words[1], int(words[2]), []))
            elif words[0] == "property":
                elements[-1][2].append((words[-1], "list" if words[1] == "list" else TYPES[words[1]]))
            elif words[0] == "end_header":
                break
        offset = f.tell()
    skipped = 0
    for name, count, fields in elements:
        if name == "vertex":
            if not {"x", "y", "z"} <= {n for n, _ in fields} or any(k == "list" for _, k in fields):
                raise KeyError(f"{path}: vertices without x, y, z, or with lists")
            return Header(path, order, count, offset, tuple(fields), skipped)
        if any(k == "list" for _, k in fields):
            raise FormatNotSupported(f"{path}: lists before the vertices")
        skipped += count
        offset += count * np.dtype([(n, k) for n, k in fields]).itemsize if order else 0
    raise KeyError(f"{path} has no vertices")


HEADS = "path string, n long, text boolean, fields array<string>"


def _heads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file from its header, read by the tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [read_header(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.count for h in heads], pa.int64()), pa.array([not h.order for h in heads], pa.bool_()), pa.array([[n for n, _ in h.extra_fields] for h in heads], pa.list_(pa.string()))],
                ["path", "n", "text", "fields"],
            )

    files = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string")
    return files.repartition(max(1, min(len(paths), 2 * spark.sparkContext.defaultParallelism)), "path").mapInArrow(read, HEADS)


def _rows(h: Header, start: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first, points) of a portion, in batches: records, or a table of a text's numbers (which begins at 0). A file
    that ends before raises FormatNotSupported."""
    with open(h.path, "rb") as f:
        f.seek(h.offset)
        for at in range(start, start + n, BATCH):
            k = min(BATCH, start + n - at)
            if h.order:
                rows = np.fromfile(h.path, h.dtype, k, offset=h.offset + at * h.dtype.itemsize)
            else:  # no line beyond those asked for is read
                rows = np.loadtxt(f, skiprows=0 if at else h.skipped_lines, max_rows=k, ndmin=2)
            if len(rows) < k:
                raise FormatNotSupported(f"{h.path} ends after {at + len(rows)} of {h.count} points")
            yield at, rows


def scan(spark: SparkSession, paths: list[str], fields: tuple[str, ...] = ()) -> DataFrame:
    """path, point_no, x, y, z, red, green, blue (0 without) and the asked properties (0 in files that lack them), as doubles.

    Headers are read by tasks. A unit of work is a portion of a million points or, of a text, the whole file; many small ones
    share a task.
    """
    heads = cut_lineage(_heads(spark, paths))
    named = {r.f for r in heads.select(F.explode("fields").alias("f")).where(F.col("f").isin(*fields)).distinct().collect()}  # of those asked
    have = [f for f in fields if f in named]
    schema = "path string, point_no long, x double, y double, z double, red smallint, green smallint, blue smallint" + "".join(f", {f} double" for f in have)
    portion = F.when(F.col("text"), F.col("n")).otherwise(F.lit(PORTION))
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, portion)).alias("start")
    units = heads.where("n > 0").select("path", "n", portion.alias("portion"), begin).select("path", "start", F.least("portion", F.col("n") - F.col("start")).alias("n"))
    n_units, n_points = heads.where("n > 0").agg(F.sum(F.ceil(F.col("n") / portion)), F.sum("n")).first()
    tasks = max(1, min(int(n_units or 0), 2 * spark.sparkContext.defaultParallelism + int(n_points or 0) // PORTION))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                h = read_header(path)
                place = {c: k for k, (c, _) in enumerate(h.fields)}
                for at, rows in _rows(h, start, n):
                    k = len(rows)
                    get = (lambda c, rows=rows: rows[c].astype(np.float64)) if h.order else (lambda c, rows=rows: rows[:, place[c]])
                    rgb = [np.clip(get(c) // h.colour_divisor, 0, 255).astype(np.int16) if c in place else np.zeros(k, np.int16) for c in COLOURS]
                    extra = [get(c) if c in place else np.zeros(k) for c in have]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * k), pa.array(np.arange(at, at + k)), *[pa.array(get(c)) for c in "xyz"], *map(pa.array, rgb), *map(pa.array, extra)],
                        ["path", "point_no", "x", "y", "z", *COLOURS, *have],
                    )

    return units.repartition(tasks, "path", "start").mapInArrow(read, schema)


def with_renamed_property(points: DataFrame, old: str, new: str) -> DataFrame:
    """The points with a property under another name; a missing one raises KeyError."""
    if old not in points.columns:
        raise KeyError(old)
    return points.withColumnRenamed(old, new)


def write(path: str, columns: dict[str, np.ndarray], order: str = "<") -> None:
    """A small PLY file; ``order`` '' writes text."""
    names = {v: k for k, v in TYPES.items() if k in ("char", "uchar", "short", "ushort", "int", "uint", "float", "double")}
    n = len(next(iter(columns.values())))
    form = {"": "ascii", "<": "binary_little_endian", ">": "binary_big_endian"}[order]
    kinds = {c: f"{v.dtype.kind}{v.dtype.itemsize}" for c, v in columns.items()}
    head = f"ply\nformat {form} 1.0\nelement vertex {n}\n" + "".join(f"property {names[k]} {c}\n" for c, k in kinds.items()) + "end_header\n"
    with open(path, "wb") as f:
        f.write(head.encode())
        if order:
            rows = np.zeros(n, np.dtype([(c, order + k) for c, k in kinds.items()]))
            for c, v in columns.items():
                rows[c] = v
            f.write(rows.tobytes())
        else:
            for r in zip(*[v.tolist() for v in columns.values()], strict=True):
                f.write((" ".join(map(repr, r)) + "\n").encode())
