"""Tile trees as tables: links, boxes, errors, counts, merging and the sets of fields around them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapoint.functions import geometry as G
from stratapoint.operators.hierarchy import carry_down, fold_below, resolve_hierarchy
from stratapoint.session import cut_lineage, numbered


def children(tiles: DataFrame) -> DataFrame:
    """tiles: tile_id, parent_id. Each parent with each child; a parent of very many children is split by AQE's skew join."""
    p = tiles.select(F.col("tile_id").alias("parent"))
    c = tiles.select(F.col("parent_id").alias("parent"), F.col("tile_id").alias("child"))
    return c.join(p, "parent")


def box_of_children(tiles: DataFrame) -> DataFrame:
    """tiles: tile_id, parent_id, box, transform (null: identity). The axis-aligned union of the children's boxes in the
    parent's frame: parent_id, box, n. Partial minima are taken before the shuffle."""
    identity = F.array(*[F.lit(1.0 if k % 5 == 0 else 0.0) for k in range(16)])
    moved = tiles.where("parent_id is not null and box is not null").select("parent_id", G.transformed_box(F.col("box"), F.coalesce("transform", identity)).alias("b"))
    low, high = G.box_bounds(F.col("b"))
    grouped = moved.select("parent_id", *[a.alias(f"l{k}") for k, a in enumerate(low)], *[b.alias(f"h{k}") for k, b in enumerate(high)]).groupBy("parent_id").agg(
        *[F.min(f"l{k}").alias(f"l{k}") for k in range(3)], *[F.max(f"h{k}").alias(f"h{k}") for k in range(3)], F.count(F.lit(1)).alias("n")
    )
    return grouped.select("parent_id", G.bounds_box([F.col(f"l{k}") for k in range(3)], [F.col(f"h{k}") for k in range(3)]).alias("box"), "n")


def union_boxes(boxes: DataFrame, key: str) -> DataFrame:
    """boxes: key, box. One box stays as it is; several become the axis-aligned box of all corners."""
    low, high = G.box_bounds(F.col("box"))
    g = boxes.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("box").alias("one"),
        *[F.min(a).alias(f"l{k}") for k, a in enumerate(low)], *[F.max(b).alias(f"h{k}") for k, b in enumerate(high)],
    )
    whole = G.bounds_box([F.col(f"l{k}") for k in range(3)], [F.col(f"h{k}") for k in range(3)])
    return g.select(key, F.when(F.col("n") == 1, F.col("one")).otherwise(whole).alias("box"), "n")


def _links(tiles: DataFrame, *values: str | Column) -> DataFrame:
    return tiles.select(F.col("tile_id").alias("id"), F.col("parent_id").alias("parent"), *values)


def subtree_max(tiles: DataFrame, value: str) -> DataFrame:
    """tiles: tile_id (unique), parent_id and a value. For each tile with tiles below it their largest value and number.

    Tiles on or below circles are left out.
    """
    folded = fold_below(_links(tiles, F.col(value).alias("value"), F.lit(1).cast("long").alias("one")), {"value": "max", "one": "sum"})
    return folded.where("below_one > 0").select(F.col("id").alias("tile_id"), F.col("below_value").alias("below"), F.col("below_one").alias("n_below"))


def geometric_errors(tiles: DataFrame) -> DataFrame:
    """tiles: tile_id (unique), parent_id, elem_max_size, has_content. tile_id, geometric_error, kept.

    The error of a tile is the largest element size below it, 0 without any; a tile is kept if it or one below has content.
    Tiles on or below circles are left out.
    """
    filled = F.coalesce("has_content", F.lit(False))
    folded = fold_below(_links(tiles, F.when(filled, F.col("elem_max_size")).alias("size"), filled.alias("filled")), {"size": "max", "filled": "max"})
    return folded.select(F.col("id").alias("tile_id"), F.coalesce("below_size", F.lit(0.0)).alias("geometric_error"), (F.col("filled") | F.coalesce("below_filled", F.lit(False))).alias("kept"))


def inherited(tiles: DataFrame, value: str) -> DataFrame:
    """The value of each tile (unique), or that of its nearest ancestor that has one: tile_id, value."""
    return carry_down(_links(tiles, value), value).withColumnRenamed("id", "tile_id")


def shown_points(tiles: DataFrame) -> DataFrame:
    """tiles: tile_id, parent_id, refine, n. The tileset's points: tiles that are leaves or refine by adding count."""
    modes = inherited(tiles, "refine")
    parents = tiles.where("parent_id is not null").select(F.col("parent_id").alias("p")).distinct()
    counted = tiles.select("tile_id", "n").join(modes, "tile_id").join(parents, F.col("tile_id") == F.col("p"), "left")
    return counted.where("p is null or coalesce(refine, 'ADD') = 'ADD'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def merge_zero_filled(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of tables by name; a number missing on one side is 0."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.na.fill(0)


def merge_strict(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of tables of the same fields and types; anything else raises ValueError naming the difference."""
    first = dict(parts[0].dtypes)
    for p in parts[1:]:
        if dict(p.dtypes) != first:
            raise ValueError(f"fields differ: {sorted(set(first.items()) ^ set(p.dtypes))}")
    return merge_zero_filled(parts) if len(parts) == 1 else _union(parts)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def on_every_group(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Values that occur in every group (relational division): distinct pairs counted against the number of groups."""
    groups = rows.where(F.col(group).isNotNull()).select(group).distinct().count()
    pairs = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(group, value).distinct()
    return pairs.groupBy(value).count().where(F.col("count") == groups).select(value)


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables, lists = batch.columns
        of = pc.list_parent_indices(lists)
        k, items, sizes = lists.flatten().flatten()
        offsets, lengths, last, till = [], [], None, 0
        for t, item, size in zip(of.to_pylist(), items.to_pylist(), sizes.to_pylist(), strict=True):
            till = till or 0 if t == last else 0
            at = None if item is None else -(-till // item) * item
            last, till = t, None if at is None or size is None else at + size
            offsets.append(at)
            lengths.append(None if till is None else size)
        yield pa.RecordBatch.from_arrays([tables.take(of), k, pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["t", "k", "byte_offset", "byte_length"])


def batch_offsets(fields: DataFrame, table: str, order: str) -> DataFrame:
    """fields: a table's properties with ``item`` (bytes of one component), ``width`` and ``n``. Byte offset of each property,
    each padded to its item's size. The running sum is over the properties of one table, its work grows with their number."""
    size = F.col("item") * F.col("width") * F.col("n")
    entry = F.struct(F.col(order).cast("int").alias("k"), F.col("item").cast("long").alias("item"), size.cast("long").alias("size"))
    gathered = fields.groupBy(table).agg(F.array_sort(F.collect_list(entry)).alias("f"))
    laid_out = gathered.mapInArrow(_lay_out, f"t {gathered.schema[table].dataType.simpleString()}, k int, byte_offset long, byte_length long")
    return laid_out.withColumnsRenamed({"t": table, "k": order})


def class_instances(rows: DataFrame, class_id: str, order: Sequence[Column]) -> DataFrame:
    """Dense instance numbers over (class, order), from 0. Rows are cut into ranges of that order, so neither a class of very
    many rows nor very many classes meet in one task. Rows without a class are left out."""
    return numbered(rows.where(F.col(class_id).isNotNull()), "instance", class_id, *order)


def sync_boxes(tiles: DataFrame) -> DataFrame:
    """tiles: tile_id, parent_id, box, transform. tile_id, box: every box grown around those of the tiles below, from the
    leaves up, each child's in its parent's frame. One step a level of depth; tiles on circles are left out."""
    h = resolve_hierarchy(tiles.select(F.col("tile_id").alias("id"), F.col("parent_id").alias("parent")))
    levels = cut_lineage(tiles.join(h.where("kind in ('rooted', 'orphaned')").select(F.col("id").alias("tile_id"), "depth"), "tile_id").select("tile_id", "parent_id", "box", "transform", "depth"))
    deepest = levels.agg(F.max("depth")).first()[0]
    out = below = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        layer = levels.where(F.col("depth") == depth)
        if below is not None:
            grown = box_of_children(below).select(F.col("parent_id").alias("_p"), F.col("box").alias("_b"))
            low, high = G.box_bounds(F.col("box"))
            lo, hi = G.box_bounds(F.col("_b"))
            around = G.bounds_box([F.least(a, b) for a, b in zip(low, lo, strict=True)], [F.greatest(a, b) for a, b in zip(high, hi, strict=True)])
            joined = layer.join(grown, layer.tile_id == grown["_p"], "left")
            layer = joined.withColumn("box", F.when(F.col("_b").isNull(), F.col("box")).when(F.col("box").isNull(), F.col("_b")).otherwise(around)).drop("_p", "_b")
        below = cut_lineage(layer)
        out = below if out is None else out.unionByName(below)
    return tiles.select("tile_id", "box").where("false") if out is None else out.select("tile_id", "box")


def subtree_bounds(tiles: DataFrame) -> DataFrame:
    """tiles: tile_id (unique), parent_id, box. Bounds of each tile and all below it, transforms apart; tiles without any box
    in their subtree, and those on or below circles, have none."""
    low, high = G.box_bounds(F.col("box"))
    lows, highs = [f"l{k}" for k in range(3)], [f"h{k}" for k in range(3)]
    folded = fold_below(_links(tiles, *[a.alias(n) for a, n in zip(low, lows, strict=True)], *[b.alias(n) for b, n in zip(high, highs, strict=True)]), {n: "min" for n in lows} | {n: "max" for n in highs})
    ends = [F.least(n, f"below_{n}").alias(n) for n in lows] + [F.greatest(n, f"below_{n}").alias(n) for n in highs]
    return folded.select(F.col("id").alias("tile_id"), *ends).where("l0 is not null")


def with_metadata(tiles: DataFrame, metadata: DataFrame, key: str = "file_id") -> DataFrame:
    """Tiles with their file's metadata; tiles of a file without any wait, that is, are left out."""
    from stratapoint.session import join_dimension

    return join_dimension(tiles, metadata, key)


def with_contents(tiles: DataFrame, folder: str) -> DataFrame:
    """tiles: content_uri. Each with the bytes of its file below ``folder`` (null without)."""
    spark = tiles.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    keyed = files.where(F.col("path").startswith(base)).select(F.substring("path", len(base) + 1, 1 << 30).alias("content_uri"), "content")
    return tiles.join(keyed, "content_uri", "left")


def gathered(indices: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """indices: key, at (array of places). values: key, place and columns. One row per index, in place n of the array."""
    each = indices.select(key, F.posexplode("at").alias("n", "place"))
    return each.join(values, [key, "place"])


def zipped(rows: DataFrame, *arrays: str) -> DataFrame:
    """Arrays of one row side by side, by position; shorter ones end with nulls."""
    rest = [c for c in rows.columns if c not in arrays]
    return rows.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("n", "_z")).select(*rest, "n", *[F.col(f"_z.{a}").alias(a) for a in arrays])


def largest_half(boxes: DataFrame, key: str) -> DataFrame:
    """The largest half size among a tile's boxes: key, elem_max_size."""
    low, high = G.box_bounds(F.col("box"))
    half = F.greatest(*[(b - a) / 2 for a, b in zip(low, high, strict=True)])
    return boxes.where("box is not null").groupBy(key).agg(F.max(half).alias("elem_max_size"))
