"""Readers that turn files into DataFrames, chosen by suffix."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapoint.errors import FormatNotSupported
from stratapoint.sources import las, ply, xyz

READERS = {".xyz": xyz.scan, ".csv": xyz.scan, ".las": las.scan, ".laz": las.scan, ".ply": ply.scan}
MESHES = (".obj", ".ifc")


def suffix(path: str) -> str:
    return os.path.splitext(path)[1].lower()


#: What is read beside places and colours where nothing is asked for.
USUAL_FIELDS = ("intensity", "classification")


def read_points(spark: SparkSession, paths: Iterable[str], fields: Iterable[str] = USUAL_FIELDS) -> DataFrame:
    """Points of files of any mix of suffixes, as one table; columns that some files lack are null. Readers of binary files give
    the asked fields; delimited files have those of their columns."""
    by: dict[str, list[str]] = {}
    for p in paths:
        by.setdefault(suffix(p), []).append(p)
    unknown = sorted(p for s, files in by.items() if s not in READERS for p in files)
    if unknown:
        raise FormatNotSupported(f"no reader for {', '.join(unknown)}")
    out = None
    for s, files in by.items():
        part = READERS[s](spark, files, tuple(fields)) if s in (".las", ".laz", ".ply") else READERS[s](spark, files)
        if "point_no" not in part.columns:
            part = part.withColumn("point_no", F.monotonically_increasing_id())
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def named_crs(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """path, crs: the reference system each file names (null if it names none; only LAS and LAZ files can). Headers alone are read."""
    paths = list(paths)
    las_files = [p for p in paths if suffix(p) in (".las", ".laz")]
    others = spark.createDataFrame([(p, None) for p in paths if p not in set(las_files)], "path string, crs string")
    return las.metadata(spark, las_files).select("path", F.col("crs_in").alias("crs")).unionByName(others) if las_files else others
