"""Queries p1_ to p5_ over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapoint.operators import drift, hierarchy, nested, proximity, records
from stratapoint.plans.problem_sql import MORE
from stratapoint.session import newest, table

RADIUS = 0.25


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift_report(table(spark, d, "reader_metadata"), table(spark, d, "field_terms"))


def p1_schema(spark: SparkSession, d: str) -> DataFrame:
    """One row per alternative of each path of the union schema."""
    u = drift.union_schema(table(spark, d, "reader_metadata"), table(spark, d, "field_terms"))
    return u.select("quantity", "canonical", F.array_join("spellings", "|").alias("spellings"), F.inline("alternatives"))


def p1_branches(spark: SparkSession, d: str) -> DataFrame:
    """The branches a value doesn't stand in are 0 or empty here; tag names the one it does."""
    t = drift.tagged_values(table(spark, d, "extra_samples"), table(spark, d, "field_terms"))
    return t.withColumn("big", F.col("big").cast("string")).na.fill({"whole": 0, "big": "", "real": 0.0, "flag": False, "text": ""})


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified_table(table(spark, d, "reader_metadata"), table(spark, d, "extra_samples"), table(spark, d, "field_terms"))


def _tile_links(spark: SparkSession, d: str) -> DataFrame:
    tiles = newest(table(spark, d, "tile_info").select("tile_id", "written_at", "parent_id"), "tile_id", "written_at")
    return tiles.select(F.col("tile_id").alias("id"), F.col("parent_id").alias("parent"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.resolve_hierarchy(_tile_links(spark, d))
    return h.select(F.col("id").alias("tile_id"), F.col("root").alias("root_id"), "depth", "kind")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.resolve_hierarchy(_tile_links(spark, d), with_path=True)
    return h.select(F.col("id").alias("tile_id"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "depth", "kind")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.resolve_hierarchy(_tile_links(spark, d), with_path=True)
    return hierarchy.descendants(h).select(F.col("ancestor").alias("tile_id"), F.col("id").alias("descendant_id"), "distance")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return records.read_records(table(spark, d, "xyz_lines"), table(spark, d, "xyz_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).where("reason is not null").select("line_id", "reason", "field").distinct()


def p3_points(spark: SparkSession, d: str) -> DataFrame:
    good = _records(spark, d).where("reason is null")
    return good.select("line_id", "file_id", "line_no", "x", "y", "z", "intensity", "red", "green", "blue", "classification").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.tiles_with_contents(table(spark, d, "tilesets"))


def p4_tiles(spark: SparkSession, d: str) -> DataFrame:
    return nested.tile_table(table(spark, d, "tilesets"))


def p4_contents(spark: SparkSession, d: str) -> DataFrame:
    return nested.content_table(table(spark, d, "tilesets"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "xyz_points").select("point_id", "loaded_at", "campaign_id", "x", "y", "z")
    fixed = newest(p, "point_id", "loaded_at").where(
        "x is not null and y is not null and z is not null and not isnan(x) and not isnan(y) and not isnan(z) and not (x = 0 and y = 0 and z = 0)"
    )
    return fixed.select(F.col("point_id").alias("id"), F.col("campaign_id").alias("group"), "x", "y", "z")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = proximity.pairs_within(_placed(spark, d), RADIUS)
    return pairs.select(F.col("id_a").alias("point_id_a"), F.col("id_b").alias("point_id_b"))


def p5_regions(spark: SparkSession, d: str) -> DataFrame:
    """Points inside the L-shaped work area of each site: 60 by 60 with the upper right quarter left out."""
    o = lambda *steps: F.array(*[F.col(c) + s for c, s in steps])
    x, y = "origin_x", "origin_y"
    areas = table(spark, d, "sites").select(
        F.col("site_id").cast("long").alias("region_id"),
        o((x, 5.0), (x, 65.0), (x, 65.0), (x, 35.0), (x, 35.0), (x, 5.0)).alias("xs"),
        o((y, 5.0), (y, 5.0), (y, 35.0), (y, 35.0), (y, 65.0), (y, 65.0)).alias("ys"),
    )
    found = proximity.points_in_regions(_placed(spark, d), areas, edge=64.0)
    return found.select(F.col("id").alias("point_id"), F.col("region_id").alias("site_id"))


QUERIES = {f.__name__: f for f in (p1_found, p1_schema, p1_branches, p1_table, p2_found, p2_paths, p2_descendants, p3_found, p3_points, p4_found, p4_tiles, p4_contents, p5_found, p5_regions)}

_NEWEST_POINTS = """(SELECT point_id, campaign_id, x, y, z FROM
  (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY loaded_at DESC NULLS LAST, campaign_id DESC NULLS LAST, x DESC NULLS LAST, y DESC NULLS LAST, z DESC NULLS LAST) AS rn
   FROM xyz_points WHERE point_id IS NOT NULL)
  WHERE rn = 1 AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)
    AND NOT (x = 0 AND y = 0 AND z = 0))"""

_FIELDS = """
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY loaded_at DESC) AS rn FROM reader_metadata) WHERE rn = 1),
readable AS (SELECT file_id, extra_fields, lead(file_id) OVER (PARTITION BY series_id ORDER BY delivered_at, file_id) AS next_id
  FROM newest WHERE extra_fields IS NOT NULL),
entries AS (SELECT file_id, next_id, unnest(range(len(extra_fields))) AS i, unnest(extra_fields) AS e FROM readable),
named AS (SELECT file_id, next_id, i, trim(e.name) AS name, regexp_replace(lower(e.name), '[^\\pL\\pN]', '', 'g') AS key,
  regexp_replace(lower(trim(e.dtype)), '^[<>|=]', '') AS t FROM entries),
terms AS (SELECT DISTINCT regexp_replace(lower(term), '[^\\pL\\pN]', '', 'g') AS key, quantity FROM field_terms),
typed AS (SELECT n.file_id, n.next_id, n.i, n.name, coalesce('q:' || q.quantity, n.key) AS quantity,
  CASE t WHEN 'int8' THEN 'i1' WHEN 'int16' THEN 'i2' WHEN 'int32' THEN 'i4' WHEN 'int64' THEN 'i8' WHEN 'uint8' THEN 'u1' WHEN 'uint16' THEN 'u2'
   WHEN 'uint32' THEN 'u4' WHEN 'uint64' THEN 'u8' WHEN 'float16' THEN 'f2' WHEN 'float32' THEN 'f4' WHEN 'float64' THEN 'f8' ELSE t END AS type
  FROM named n LEFT JOIN terms q ON n.key = q.key),
fields AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, quantity ORDER BY i) AS rn FROM typed) WHERE rn = 1),
pairs AS (SELECT r.next_id AS file_id, r.file_id AS prev_id FROM readable r WHERE r.next_id IS NOT NULL),
both_sides AS (SELECT coalesce(o.file_id, n.file_id) AS file_id, o.name AS old_name, o.type AS old_type, n.name AS new_name, n.type AS new_type
  FROM (SELECT p.file_id, f.quantity, f.name, f.type FROM pairs p JOIN fields f ON f.file_id = p.prev_id) o
  FULL JOIN (SELECT p.file_id, f.quantity, f.name, f.type FROM pairs p JOIN fields f ON f.file_id = p.file_id) n
  ON o.file_id = n.file_id AND o.quantity = n.quantity)"""

ORACLES = {
    "p1_found": f"""WITH {_FIELDS}
SELECT file_id, 'added' AS change, '' AS old_name, new_name FROM both_sides WHERE old_name IS NULL
UNION ALL SELECT file_id, 'removed', old_name, '' FROM both_sides WHERE new_name IS NULL
UNION ALL SELECT file_id, 'renamed', old_name, new_name FROM both_sides WHERE old_name <> new_name
UNION ALL SELECT file_id, 'retyped', old_name, new_name FROM both_sides WHERE old_type <> new_type""",
    "p2_found": """WITH RECURSIVE newest AS (SELECT tile_id, CASE WHEN parent_id >= 0 THEN parent_id END AS parent_id FROM
  (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY written_at DESC, parent_id DESC NULLS LAST) AS rn FROM tile_info) WHERE rn = 1),
linked AS (SELECT t.tile_id, t.parent_id, t.parent_id IS NOT NULL AND p.tile_id IS NULL AS orphan, p.tile_id AS up FROM newest t LEFT JOIN newest p ON t.parent_id = p.tile_id),
down AS (SELECT tile_id, tile_id AS root_id, 0::BIGINT AS depth, CASE WHEN orphan THEN 'orphaned' ELSE 'rooted' END AS kind FROM linked WHERE up IS NULL
  UNION ALL SELECT l.tile_id, d.root_id, d.depth + 1, d.kind FROM down d JOIN linked l ON l.up = d.tile_id),
endless AS (SELECT l.tile_id, l.up FROM linked l WHERE l.tile_id NOT IN (SELECT tile_id FROM down)),
chase AS (SELECT tile_id AS node, up AS reached FROM endless UNION SELECT c.node, e.up FROM chase c JOIN endless e ON e.tile_id = c.reached),
cyc AS (SELECT node AS tile_id, min(reached) AS root_id FROM chase WHERE node IN (SELECT c2.node FROM chase c2 WHERE c2.reached = c2.node) GROUP BY node),
below AS (SELECT tile_id, root_id, 0::BIGINT AS depth FROM cyc
  UNION ALL SELECT e.tile_id, b.root_id, b.depth + 1 FROM below b JOIN endless e ON e.up = b.tile_id WHERE e.tile_id NOT IN (SELECT tile_id FROM cyc))
SELECT tile_id, root_id, depth, kind FROM down
UNION ALL SELECT tile_id, root_id, depth, CASE WHEN depth = 0 THEN 'on_cycle' ELSE 'below_cycle' END FROM below""",
    "p5_found": f"""WITH p AS {_NEWEST_POINTS},
c AS (SELECT *, TRY_CAST(floor(x / 0.25) AS BIGINT) AS cx, TRY_CAST(floor(y / 0.25) AS BIGINT) AS cy, TRY_CAST(floor(z / 0.25) AS BIGINT) AS cz FROM p),
n AS (SELECT c.*, cx + i AS nx, cy + j AS ny, cz + k AS nz FROM c, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k))
SELECT a.point_id AS point_id_a, b.point_id AS point_id_b FROM c a JOIN n b
ON a.campaign_id = b.campaign_id AND a.cx = b.nx AND a.cy = b.ny AND a.cz = b.nz AND a.point_id < b.point_id
WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.0625""",
    "p5_regions": f"""WITH p AS {_NEWEST_POINTS}
SELECT p.point_id, s.site_id::BIGINT AS site_id FROM p JOIN sites s
ON p.x >= s.origin_x + 5 AND p.x < s.origin_x + 65 AND p.y >= s.origin_y + 5 AND p.y < s.origin_y + 65
WHERE p.x < s.origin_x + 35 OR p.y < s.origin_y + 35""",
} | MORE
