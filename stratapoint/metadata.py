"""Metadata schemas of version 1.1: classes, properties and enumerations, as JSON and as Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from stratapoint.errors import InvalidMetadata
from stratapoint.functions.geometry import IDENTIFIER

# Component types and the numbers each composite type holds.
COMPONENTS = {
    "INT8": T.ByteType(), "UINT8": T.ShortType(), "INT16": T.ShortType(), "UINT16": T.IntegerType(), "INT32": T.IntegerType(), "UINT32": T.LongType(),
    "INT64": T.LongType(), "UINT64": T.DecimalType(20, 0), "FLOAT32": T.FloatType(), "FLOAT64": T.DoubleType(),
}
SIZES = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT2": 4, "MAT3": 9, "MAT4": 16}


def check_identifier(name: str) -> str:
    if name and not re.search(IDENTIFIER, name.replace("\n", " ")):
        raise InvalidMetadata(f"{name!r} is no identifier")
    return name


@dataclass
class Enumeration:
    values: dict[str, int]
    name: str | None = None
    description: str | None = None

    def to_dict(self) -> dict:
        out: dict = {k: v for k, v in (("name", self.name), ("description", self.description)) if v}
        return out | {"values": [{"name": n, "value": v} for n, v in self.values.items()]}


@dataclass
class Property:
    """``kind``: SCALAR, VECn, MATn (with a component type), BOOLEAN, STRING or ENUM (with the enumeration's name)."""

    kind: str
    component: str | None = None
    enum: str | None = None
    name: str | None = None
    description: str | None = None
    array: bool = False
    required: bool = False
    offset: object = None
    scale: object = None
    minimum: object = None
    maximum: object = None
    nodata: object = None
    default: object = None

    def __post_init__(self) -> None:
        if self.kind in SIZES and self.component not in COMPONENTS:
            raise InvalidMetadata(f"{self.kind} needs a component type, not {self.component!r}")
        if self.kind not in (*SIZES, "BOOLEAN", "STRING", "ENUM"):
            raise InvalidMetadata(f"unknown type {self.kind!r}")

    def to_dict(self) -> dict:
        """Members without value, and those that are false or 0, are left out."""
        out: dict = {"type": self.kind}
        if self.component:
            out["componentType"] = self.component
        if self.enum:
            out["enumType"] = self.enum
        rest = {"name": self.name, "description": self.description, "array": self.array, "required": self.required, "offset": self.offset, "scale": self.scale,
                "minimum": self.minimum, "maximum": self.maximum, "noData": self.nodata, "default": self.default}
        return out | {k: v for k, v in rest.items() if v is not None and (v if isinstance(v, bool | int | float | str) else len(v))}

    def spark_type(self) -> T.DataType:
        base = T.BooleanType() if self.kind == "BOOLEAN" else T.StringType() if self.kind == "STRING" else T.IntegerType() if self.kind == "ENUM" else COMPONENTS[self.component]
        if SIZES.get(self.kind, 1) > 1:
            base = T.ArrayType(base)
        return T.ArrayType(base) if self.array else base


@dataclass
class MetadataClass:
    properties: dict[str, Property] = field(default_factory=dict)
    name: str | None = None
    description: str | None = None

    def to_dict(self) -> dict:
        out: dict = {k: v for k, v in (("name", self.name), ("description", self.description)) if v}
        return out | {"properties": {check_identifier(k): p.to_dict() for k, p in self.properties.items()}}

    def spark_type(self) -> T.StructType:
        return T.StructType([T.StructField(k, p.spark_type(), not p.required) for k, p in self.properties.items()])


@dataclass
class Schema:
    id: str
    classes: dict[str, MetadataClass] = field(default_factory=dict)
    enums: dict[str, Enumeration] = field(default_factory=dict)
    name: str | None = None
    description: str | None = None
    version: str | None = None

    def to_dict(self) -> dict:
        for c in self.classes.values():
            for p in c.properties.values():
                if p.kind == "ENUM" and p.enum not in self.enums:
                    raise KeyError(p.enum)
        out: dict = {"id": check_identifier(self.id)} | {k: v for k, v in (("name", self.name), ("description", self.description), ("version", self.version)) if v}
        if self.classes:
            out["classes"] = {check_identifier(k): c.to_dict() for k, c in self.classes.items()}
        if self.enums:
            out["enums"] = {check_identifier(k): e.to_dict() for k, e in self.enums.items()}
        return out


def class_of(schema: T.StructType) -> MetadataClass:
    """A class with one property per column of a supported type; others raise InvalidMetadata."""
    names = {"byte": "INT8", "short": "INT16", "integer": "INT32", "long": "INT64", "float": "FLOAT32", "double": "FLOAT64"}
    out = {}
    for f in schema.fields:
        kind, array = f.dataType, False
        if isinstance(kind, T.ArrayType):
            kind, array = kind.elementType, True
        if isinstance(kind, T.BooleanType | T.StringType):
            out[f.name] = Property("BOOLEAN" if isinstance(kind, T.BooleanType) else "STRING", array=array, required=not f.nullable)
        elif kind.typeName() in names:
            out[f.name] = Property("SCALAR", names[kind.typeName()], array=array, required=not f.nullable)
        else:
            raise InvalidMetadata(f"no property type for {f.name}: {f.dataType.simpleString()}")
    return MetadataClass(out)
