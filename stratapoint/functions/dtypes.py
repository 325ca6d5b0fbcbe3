"""NumPy's scalar types as Spark types, and the type that holds several of them."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spark types wide enough for each NumPy kind and size.
SPARK_TYPES = {
    "b1": "boolean", "i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "i8": "bigint",
    "u8": "decimal(20,0)", "f2": "float", "f4": "float", "f8": "double",
}

# Component names of binary tables, version 1.0 and 1.1.
COMPONENTS = {"BYTE": "i1", "UNSIGNED_BYTE": "u1", "SHORT": "i2", "UNSIGNED_SHORT": "u2", "INT": "i4", "UNSIGNED_INT": "u4", "FLOAT": "f4", "DOUBLE": "f8"}
COMPONENTS_NEXT = {"INT8": "i1", "UINT8": "u1", "INT16": "i2", "UINT16": "u2", "INT32": "i4", "UINT32": "u4", "INT64": "i8", "UINT64": "u8", "FLOAT32": "f4", "FLOAT64": "f8"}


def promoted(types: Iterable[str]) -> str:
    """The smallest NumPy type that every one of ``types`` casts to safely, as kind and size."""
    kinds = sorted(set(types))
    out = np.result_type(*[np.dtype(t) for t in kinds]) if len(kinds) > 1 else np.dtype(kinds[0])
    return f"{out.kind}{out.itemsize}"


def unify_fields(fields: DataFrame) -> DataFrame:
    """fields: name, type (kind and size). One row per name with the promoted type and Spark's.

    The distinct types of a name are few, so they are gathered per name and looked up in the lattice of subsets.
    """
    lattice = {",".join(s): promoted(s) for s in _subsets(sorted(SPARK_TYPES))}
    mapped = F.udf(lambda t: lattice.get(t), "string")
    grouped = fields.where("type is not null").groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    spark_type = F.create_map(*[F.lit(v) for kv in SPARK_TYPES.items() for v in kv])
    return grouped.withColumn("promoted", mapped("types")).withColumn("spark_type", spark_type[F.col("promoted")])


def _subsets(items: list[str]) -> Iterable[tuple[str, ...]]:
    for mask in range(1, 1 << len(items)):
        yield tuple(t for k, t in enumerate(items) if mask >> k & 1)
