"""Further queries on tile trees, indexes and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapoint.operators import tiles
from stratapoint.plans.catalogue import _TILES_SQL, _tile_info, query
from stratapoint.session import newest, table


@query(f"""WITH RECURSIVE {_TILES_SQL}, up AS (SELECT t.tile_id, p.tile_id AS parent, t.box FROM newest t LEFT JOIN newest p ON t.parent_id = p.tile_id),
tree AS (SELECT tile_id FROM up WHERE parent IS NULL UNION ALL SELECT u.tile_id FROM tree t JOIN up u ON u.parent = t.tile_id),
over AS (SELECT tile_id, tile_id AS below FROM tree UNION ALL SELECT u.parent, o.below FROM over o JOIN up u ON u.tile_id = o.tile_id WHERE u.parent IS NOT NULL),
b AS (SELECT tile_id, box[1] AS x, box[2] AS y, box[3] AS z, abs(box[4]) + abs(box[7]) + abs(box[10]) AS rx, abs(box[5]) + abs(box[8]) + abs(box[11]) AS ry, abs(box[6]) + abs(box[9]) + abs(box[12]) AS rz FROM newest WHERE box IS NOT NULL)
SELECT o.tile_id, round(min(x - rx), 4) AS l0, round(min(y - ry), 4) AS l1, round(min(z - rz), 4) AS l2, round(max(x + rx), 4) AS h0, round(max(y + ry), 4) AS h1, round(max(z + rz), 4) AS h2
FROM over o JOIN b ON b.tile_id = o.below GROUP BY 1""")
def subtree_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = tiles.subtree_bounds(_tile_info(spark, d))
    return b.select("tile_id", *[F.round(c, 4).alias(c) for c in ("l0", "l1", "l2", "h0", "h1", "h2")])


@query(f"""WITH {_TILES_SQL} SELECT parent_id, round(max(greatest(abs(box[4]) + abs(box[7]) + abs(box[10]), abs(box[5]) + abs(box[8]) + abs(box[11]), abs(box[6]) + abs(box[9]) + abs(box[12]))), 4) AS elem_max_size
FROM newest WHERE box IS NOT NULL AND parent_id IS NOT NULL GROUP BY 1""")
def elem_max_size(spark: SparkSession, d: str) -> DataFrame:
    t = _tile_info(spark, d).where("parent_id is not null")
    return tiles.largest_half(t, "parent_id").withColumn("elem_max_size", F.round("elem_max_size", 4))


@query("""SELECT p.point_id, m.point_count, m.has_color FROM (SELECT DISTINCT point_id, file_id FROM xyz_points) p
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY loaded_at DESC) AS rn FROM reader_metadata) WHERE rn = 1) m USING (file_id)""")
def points_with_file(spark: SparkSession, d: str) -> DataFrame:
    m = newest(table(spark, d, "reader_metadata").select("file_id", "loaded_at", "point_count", "has_color"), "file_id", "loaded_at").select("file_id", "point_count", "has_color")
    p = table(spark, d, "xyz_points").select("point_id", "file_id").distinct()
    return tiles.with_metadata(p, m).select("point_id", "point_count", "has_color")


@query("""WITH i AS (SELECT vec_id, unnest([0, 2, 2, 63, 5]) AS place, unnest([0, 1, 2, 3, 4]) AS n FROM embeddings)
SELECT vec_id, n, place, round(embedding[place + 1]::DOUBLE, 6) AS value FROM i JOIN embeddings USING (vec_id)""")
def gather_indices(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    values = e.select("vec_id", F.posexplode("embedding").alias("place", "value"))
    at = e.select("vec_id", F.array(*[F.lit(k) for k in (0, 2, 2, 63, 5)]).alias("at"))
    return tiles.gathered(at, values, "vec_id").select("vec_id", "n", "place", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("""WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY written_at DESC, parent_id DESC NULLS LAST) AS rn FROM tile_info) WHERE rn = 1 AND box IS NOT NULL AND transform IS NOT NULL)
SELECT tile_id, k::INTEGER AS n, box[k + 1] AS box, transform[k + 1] AS transform FROM n, range(16) r(k)""")
def zip_positions(spark: SparkSession, d: str) -> DataFrame:
    t = _tile_info(spark, d).where("box is not null and transform is not null").select("tile_id", "box", "transform")
    return tiles.zipped(t, "box", "transform")
