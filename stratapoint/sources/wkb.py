"""Well-known binary polygons."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapoint.errors import FormatNotSupported

# Geometry types of collections of polygons, flat and with heights.
FLAT, SOLID = (6, 15), (1006, 1015)
POINTS = "geom_id long, polygon int, ring int, point int, x float, y float, z float"


def parse(data: bytes) -> list[list[np.ndarray]]:
    """Polygons of rings of float points, the closing point dropped; points without height have two numbers."""
    try:
        order = "<" if data[0] else ">"
        kind, count = struct.unpack_from(order + "II", data, 1)
        if kind not in FLAT + SOLID:
            raise FormatNotSupported(f"geometry type {kind}")
        at, out = 9, []
        for _ in range(count):
            inner = "<" if data[at] else ">"
            part, rings = struct.unpack_from(inner + "II", data, at + 1)
            width = 3 if part >= 1000 else 2
            at += 9
            polygon = []
            for _ in range(rings):
                (n,) = struct.unpack_from(inner + "I", data, at)
                values = np.frombuffer(data, inner + "f8", n * width, at + 4).reshape(n, width)
                polygon.append(values[:-1].astype(np.float32))
                at += 4 + 8 * n * width
            out.append(polygon)
        return out
    except (struct.error, ValueError, IndexError) as e:
        if isinstance(e, FormatNotSupported):
            raise
        raise FormatNotSupported(f"broken geometry: {e}") from e


def write(polygons: Sequence[Sequence[Sequence[Sequence[float]]]], order: str = "<") -> bytes:
    """A multipolygon of rings given without their closing points."""
    width = len(polygons[0][0][0]) if polygons else 3
    mark, high = (b"\1" if order == "<" else b"\0"), 1000 if width == 3 else 0
    out = mark + struct.pack(order + "II", 6 + high, len(polygons))
    for p in polygons:
        out += mark + struct.pack(order + "II", 3 + high, len(p))
        for ring in p:
            closed = np.array([*ring, ring[0]], order + "f8")
            out += struct.pack(order + "I", len(closed)) + closed.tobytes()
    return out


def points(geometries: DataFrame) -> DataFrame:
    """geometries: geom_id, wkb. Their points in order: geom_id, polygon, ring, point, x, y, z (0 without height). Null
    geometries have none; broken ones fail the query."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for g, data in zip(batch["geom_id"], batch["wkb"], strict=True):
                for a, polygon in enumerate(parse(bytes(data))):
                    for b, ring in enumerate(polygon):
                        rows += [(g, a, b, c, float(p[0]), float(p[1]), float(p[2]) if len(p) > 2 else 0.0) for c, p in enumerate(ring)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in POINTS.split(", ")])

    return geometries.where("geom_id is not null and wkb is not null").select("geom_id", "wkb").mapInPandas(read, POINTS)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """Geometries of a directory's .wkb files: geom_id (a hash of the path), path, wkb."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wkb").load(path)
    return files.select(F.xxhash64("path").alias("geom_id"), "path", F.col("content").alias("wkb"))


def from_database(spark: SparkSession, url: str, geometry_table: str, geometry: str = "geom", properties: Sequence[str] = (), **options: str) -> DataFrame:
    """Geometries of a database table over JDBC, heaviest (by area) first: wkb, weight and properties.

    The area and the binary form are computed by the database; the rest of the work is Spark's.
    """
    columns = "".join(f", {p}" for p in properties)
    sql = f"(SELECT ST_AsBinary({geometry}) AS wkb, ST_Area({geometry}) AS weight{columns} FROM {geometry_table}) AS g"
    return spark.read.format("jdbc").options(url=url, dbtable=sql, **options).load().orderBy(F.desc("weight"))
