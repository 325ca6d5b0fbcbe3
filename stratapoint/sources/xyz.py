"""Delimited point files: dialects, column roles by position, and scans."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapoint.errors import FormatNotSupported

SNIFF_CHARS = 2048
SEPARATORS = (",", ";", "\t", " ")
# Roles of the columns by how many there are; of more than eight the rest is ignored.
ROLES = {
    3: ("x", "y", "z"), 4: ("x", "y", "z", "intensity"), 6: ("x", "y", "z", "red", "green", "blue"), 7: ("x", "y", "z", "intensity", "red", "green", "blue"),
    8: ("x", "y", "z", "intensity", "red", "green", "blue", "classification"),
}
TYPES = {"x": "float", "y": "float", "z": "float", "intensity": "float", "red": "smallint", "green": "smallint", "blue": "smallint", "classification": "bigint"}
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


@dataclass(frozen=True)
class Dialect:
    separator: str
    columns: int
    header: bool

    @property
    def roles(self) -> tuple[str, ...]:
        if self.columns < 3 or self.columns == 5:
            raise FormatNotSupported(f"{self.columns} columns have no roles")
        return ROLES[min(self.columns, 8)]


def sniff(head: str) -> Dialect:
    """The dialect by a file's first characters: the separator that cuts its first lines alike, and whether the first is a header."""
    lines = [ln.strip("\r") for ln in head[:SNIFF_CHARS].split("\n")]
    if len(lines) > 1 and len(head) >= SNIFF_CHARS:
        lines = lines[:-1]
    lines = [ln for ln in lines if ln.strip()][:20]
    if not lines:
        raise FormatNotSupported("an empty file")
    best = None
    for rank, s in enumerate(SEPARATORS):
        widths = [len(_cut(ln, s)) for ln in lines]
        width = max(set(widths), key=lambda w: (widths.count(w), w))
        alike = widths.count(width)
        if width >= 3 and (best is None or (alike, -rank) > best[0]):
            best = ((alike, -rank), s, width)
    if best is None:
        raise FormatNotSupported("no separator cuts its lines")
    first = _cut(lines[0], best[1])
    return Dialect(best[1], best[2], not all(_NUMBER.fullmatch(c.strip().strip('"')) for c in first[:3]))


def _cut(line: str, separator: str) -> list[str]:
    return line.split() if separator == " " else line.split(separator)


def columns_by_position(lines: DataFrame) -> DataFrame:
    """lines: line, separator, n_columns (and more). The points' typed columns in place of these; missing roles are null.

    Coordinates are parsed as float before any arithmetic.
    """
    parts = F.when(F.col("separator") == " ", F.split(F.trim("line"), " +")).otherwise(F.split("line", F.concat(F.lit("\\Q"), "separator", F.lit("\\E"))))
    cells = lines.withColumn("_c", parts)

    def role(name: str) -> Column:
        value = F.lit(None).cast("string")
        for n, names in ROLES.items():
            if name in names:
                width = (F.col("n_columns") >= n) if n == 8 else (F.col("n_columns") == n)
                value = F.when(width, F.try_element_at("_c", F.lit(names.index(name) + 1))).otherwise(value)
        return F.trim(value).try_cast(TYPES[name]).alias(name)

    rest = [c for c in lines.columns if c not in ("line", "separator", "n_columns", *TYPES)]
    return cells.select(*rest, *[role(n) for n in TYPES])


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Points of files: path, x, y, z, intensity, red, green, blue, classification.

    Each file's head is looked at on the driver; files of one dialect are one text scan, cut into splits by Spark. Lines that
    don't begin with three numbers are skipped (use ``read_records`` to have reasons).
    """
    by: dict[Dialect, list[str]] = {}
    for p in paths:
        with open(p, encoding="utf-8", errors="replace") as f:
            dialect = sniff(f.read(SNIFF_CHARS))
        dialect.roles  # noqa: B018
        by.setdefault(Dialect(dialect.separator, dialect.columns, False), []).append(p)
    parts = []
    for dialect, files in by.items():
        lines = spark.read.text(files).select(F.col("_metadata.file_path").alias("path"), F.rtrim(F.regexp_replace("value", "\r+$", "")).alias("line"))
        kept = lines.withColumns({"separator": F.lit(dialect.separator), "n_columns": F.lit(dialect.columns)})
        parts.append(columns_by_position(kept).where("x is not null and y is not null and z is not null"))
    return reduce(DataFrame.unionByName, parts)
