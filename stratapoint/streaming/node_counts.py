"""Running bounds and counts per node over a stream of point files, and thinning with state kept per cell."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapoint.operators.octree import AXES, Root, cell_of, with_nodes


def node_counts(points: DataFrame, root: Root, level: int) -> DataFrame:
    """Count and bounds of each node of a level. Works on a stream (output mode complete or update) and on a table alike.

    Points outside the root box go to its outermost nodes; nulls and NaN are left out.
    """
    ok = reduce(lambda a, b: a & b, [F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")) for v in AXES])
    placed = with_nodes(points.where(ok), root, level)
    return placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *[F.min(v).alias(f"min_{v}") for v in AXES], *[F.max(v).alias(f"max_{v}") for v in AXES])


def thin_stream(points: DataFrame, root: Root, level: int, columns: Sequence[str]) -> DataFrame:
    """Points of a stream that lie at least the level's spacing from all kept before in their (node, cell).

    The state of a cell is its kept points, whose number is bounded by the cell's size over the spacing. Within a micro-batch
    rows are taken in order of ``columns``; nulls and NaN are left out. Output: node, cell, columns, x, y, z of the kept points.
    """
    spacing = root.spacing / 2**level
    ok = reduce(lambda a, b: a & b, [F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")) for v in AXES])
    placed = with_nodes(points.where(ok), root, level).withColumn("cell", cell_of(root, level)).select("node", "cell", *columns, *AXES)
    limit = spacing * spacing

    near = [(i, j, k) for i in (0, -1, 1) for j in (0, -1, 1) for k in (0, -1, 1)]

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        kept = [tuple(p) for p in state.get[0]] if state.exists else []
        boxes: dict[tuple, list[tuple]] = {}  # kept points by boxes of the spacing, so that only neighbours are compared
        for p in kept:
            boxes.setdefault(tuple(math.floor(v / spacing) for v in p), []).append(p)
        rows = pd.concat(list(batches)).sort_values(list(columns), kind="stable")
        flags = []
        for x, y, z in zip(*[rows[v].astype(float).tolist() for v in AXES], strict=True):
            i, j, k = math.floor(x / spacing), math.floor(y / spacing), math.floor(z / spacing)
            far = all((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2 >= limit for u, v, w in near for a, b, c in boxes.get((i + u, j + v, k + w), ()))
            flags.append(far)
            if far:
                kept.append((x, y, z))
                boxes.setdefault((i, j, k), []).append((x, y, z))
        state.update(([list(p) for p in kept],))
        yield rows[flags]

    return placed.groupBy("node", "cell").applyInPandasWithState(keep, placed.schema, "kept array<array<double>>", "append", "NoTimeout")
