"""OBJ mesh files and their materials."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapoint.functions.geometry import clamp, luminance

CORNERS = "path string, mesh string, material string, face long, corner int, x float, y float, z float, nx float, ny float, nz float, u float, v float"


def material_columns(specular: Column, shininess: Column, opacity: Column) -> dict[str, Column]:
    """Roughness, metallic and alpha of a traditional material: shininess of 0 to 1000 turned round, rougher where specular
    light is weak; metallic is the first specular part; an opacity of 0 counts as not stated."""
    light = luminance(F.element_at(specular, 1), F.element_at(specular, 2), F.element_at(specular, 3))
    rough = clamp(1 - shininess / 1000, 0.0, 1.0)
    return {
        "roughness": F.when(specular.isNotNull() & (light < 0.1), rough * (1 - light)).otherwise(rough),
        "metallic": F.element_at(specular, 1),
        "alpha": F.when(opacity == 0, F.lit(1.0)).otherwise(opacity),
    }


def _parse(path: str, text: str) -> Iterator[tuple]:
    v: list[tuple] = []
    n: list[tuple] = []
    t: list[tuple] = []
    mesh, material, face = "", "", 0
    for line in text.splitlines():
        w = line.split("#", 1)[0].split()
        if not w:
            continue
        if w[0] == "v":
            v.append(tuple(map(float, w[1:4])))
        elif w[0] == "vn":
            n.append(tuple(map(float, w[1:4])))
        elif w[0] == "vt":
            t.append((float(w[1]), -float(w[2]) if len(w) > 2 else 0.0))
        elif w[0] in ("o", "g"):
            mesh = " ".join(w[1:])
        elif w[0] == "usemtl":
            material = " ".join(w[1:])
        elif w[0] == "f":
            corners = [_corner(c, v, n, t) for c in w[1:]]
            for k in range(1, len(corners) - 1):  # a fan
                for at, c in enumerate((corners[0], corners[k], corners[k + 1])):
                    yield (path, mesh, material, face, at, *c)
                face += 1


def _corner(word: str, v: list, n: list, t: list) -> tuple:
    parts = (word.split("/") + ["", ""])[:3]

    def pick(values: list, index: str, width: int) -> tuple:
        if not index:
            return (None,) * width
        k = int(index)
        return values[k - 1 if k > 0 else k]

    return (*pick(v, parts[0], 3), *pick(n, parts[2], 3), *pick(t, parts[1], 2))


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Corners of all triangles, un-indexed: path, mesh, material, face, corner, x, y, z, normal and texture place (v turned).

    A file is one unit: its faces refer to vertices by their place in it.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CORNERS.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(list(_parse(path, content.decode("utf-8", "replace"))), columns=names)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(read, CORNERS)


def read_materials(path: str) -> list[dict]:
    """Materials of an .mtl file: name, diffuse, specular, ambient, emissive, shininess, opacity, texture."""
    out: list[dict] = []
    keys = {"Kd": "diffuse", "Ks": "specular", "Ka": "ambient", "Ke": "emissive"}
    with open(path, encoding="utf-8", errors="replace") as f:
        for line in f:
            w = line.split("#", 1)[0].split()
            if not w:
                continue
            if w[0] == "newmtl":
                out.append({"name": " ".join(w[1:]), "diffuse": [0.8, 0.8, 0.8], "specular": [0.0, 0.0, 0.0], "ambient": None, "emissive": [0.0, 0.0, 0.0], "shininess": 0.0, "opacity": 1.0, "texture": None})
            elif out and w[0] in keys:
                out[-1][keys[w[0]]] = [float(x) for x in w[1:4]]
            elif out and w[0] == "Ns":
                out[-1]["shininess"] = float(w[1])
            elif out and w[0] in ("d", "Tr"):
                out[-1]["opacity"] = float(w[1]) if w[0] == "d" else 1 - float(w[1])
            elif out and w[0] == "map_Kd":
                out[-1]["texture"] = os.path.join(os.path.dirname(path), w[-1])
    return out
