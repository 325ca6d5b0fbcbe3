"""SQL counterparts of the queries p1_ to p5_, written apart from the operators."""

from __future__ import annotations

_TERMS = """terms AS (SELECT key, min(quantity) AS quantity FROM (
  SELECT regexp_replace(lower(term), '[^\\pL\\pN]', '', 'g') AS key, quantity FROM field_terms) GROUP BY 1),
own AS (SELECT DISTINCT regexp_replace(lower(quantity), '[^\\pL\\pN]', '', 'g') AS key, quantity || '_' AS quantity FROM field_terms
  WHERE regexp_replace(lower(quantity), '[^\\pL\\pN]', '', 'g') NOT IN (SELECT key FROM terms)),
meant AS (SELECT * FROM terms UNION ALL SELECT * FROM own)"""

_VALUES = f"""{_TERMS},
s AS (SELECT DISTINCT file_id, point_no, payload FROM extra_samples WHERE payload IS NOT NULL),
k AS (SELECT file_id, point_no, payload, unnest(json_keys(payload)) AS name FROM s),
v AS (SELECT file_id, point_no, name, json_extract_string(payload, '$."' || name || '"') AS value, regexp_replace(lower(name), '[^\\pL\\pN]', '', 'g') AS key FROM k),
q AS (SELECT v.*, coalesce(m.quantity, v.key) AS quantity FROM v LEFT JOIN meant m ON v.key = m.key),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, point_no, quantity ORDER BY value IS NULL, name, value) AS rn FROM q) WHERE rn = 1),
t AS (SELECT *, CASE WHEN value IS NULL THEN 'null' WHEN regexp_full_match(trim(value), '[+-]?[0-9]{{1,38}}') THEN CASE WHEN TRY_CAST(trim(value) AS BIGINT) IS NOT NULL THEN 'whole' ELSE 'big' END
  WHEN regexp_full_match(trim(value), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'real' WHEN trim(value) IN ('true', 'false') THEN 'flag' ELSE 'text' END AS tag FROM o)"""

P1_BRANCHES = f"""WITH {_VALUES}
SELECT file_id, point_no, quantity, tag, CASE WHEN tag = 'whole' THEN trim(value)::BIGINT ELSE 0 END AS whole, CASE WHEN tag = 'big' THEN ltrim(trim(value), '+') ELSE '' END AS big,
 CASE WHEN tag = 'real' THEN trim(value)::DOUBLE ELSE 0 END AS real, tag = 'flag' AND trim(value) = 'true' AS flag, CASE WHEN tag = 'text' THEN value ELSE '' END AS text FROM t"""

_SCHEMA = """files AS (SELECT file_id, delivered_at, extra_fields FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY loaded_at DESC) AS rn FROM reader_metadata) WHERE rn = 1 AND extra_fields IS NOT NULL),
listed AS (SELECT file_id, delivered_at, unnest(range(len(extra_fields))) AS i, unnest(extra_fields) AS e FROM files),
spelled AS (SELECT file_id, delivered_at, i, trim(e.name) AS name, regexp_replace(lower(trim(e.dtype)), '^[<>|=]', '') AS t, regexp_replace(lower(e.name), '[^\\pL\\pN]', '', 'g') AS key FROM listed WHERE e.name IS NOT NULL),
kinds AS (SELECT * FROM (VALUES ('int8', 'i1'), ('int16', 'i2'), ('int32', 'i4'), ('int64', 'i8'), ('uint8', 'u1'), ('uint16', 'u2'), ('uint32', 'u4'), ('uint64', 'u8'), ('float16', 'f2'), ('float32', 'f4'), ('float64', 'f8'), ('bool', 'b1')) k(long, short)),
typed AS (SELECT s.*, coalesce(k.short, s.t) AS type, coalesce(m.quantity, s.key) AS quantity FROM spelled s LEFT JOIN kinds k ON s.t = k.long LEFT JOIN meant m ON s.key = m.key),
first_fields AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, quantity ORDER BY i) AS rn FROM typed) WHERE rn = 1),
canon AS (SELECT quantity, string_agg(DISTINCT name, '|' ORDER BY name) AS spellings, CASE WHEN bool_and(type = 'b1') THEN 'boolean' WHEN bool_and(regexp_full_match(type, '[iu][124]|i8|b1')) THEN 'bigint'
  WHEN bool_and(regexp_full_match(type, '[iu][1248]|b1')) THEN 'decimal(20,0)' ELSE 'double' END AS canonical FROM first_fields GROUP BY 1)"""

P1_SCHEMA = f"""WITH {_TERMS}, {_SCHEMA}
SELECT f.quantity, f.type, c.canonical, c.spellings, count(*) AS n_files, arg_min(f.file_id, (f.delivered_at, f.file_id)) AS first_file, arg_max(f.file_id, (f.delivered_at, f.file_id)) AS last_file
FROM first_fields f JOIN canon c USING (quantity) GROUP BY 1, 2, 3, 4"""

# One column a quantity, whichever there are; numbers of all columns are doubles here.
P1_TABLE = f"""WITH {_VALUES}, {_SCHEMA},
points AS (SELECT DISTINCT file_id, point_no FROM extra_samples WHERE file_id IS NOT NULL AND point_no IS NOT NULL),
numbers AS (SELECT file_id, point_no, quantity, tag, CASE WHEN tag IN ('whole', 'big', 'real') THEN trim(value)::DOUBLE WHEN tag = 'flag' THEN (trim(value) = 'true')::INT::DOUBLE END AS x FROM t),
columns_ AS (SELECT quantity, canonical FROM canon UNION ALL SELECT quantity, CASE WHEN bool_or(tag = 'real') THEN 'double' ELSE 'bigint' END FROM numbers WHERE quantity NOT IN (SELECT quantity FROM canon) GROUP BY 1),
cells AS (SELECT n.file_id, n.point_no, n.quantity, CASE WHEN c.canonical = 'double' OR n.x = floor(n.x) THEN n.x END AS x FROM numbers n JOIN columns_ c USING (quantity)
 UNION ALL SELECT file_id, point_no, (SELECT min(quantity) FROM columns_), NULL FROM points
 UNION ALL SELECT (SELECT min(file_id) FROM points), (SELECT min(point_no) FROM points WHERE file_id = (SELECT min(file_id) FROM points)), quantity, NULL FROM columns_),
long AS (SELECT file_id, point_no, 'q_' || quantity AS q, x FROM cells)
PIVOT long ON q USING max(x) GROUP BY file_id, point_no"""

_LINKS = """newest AS (SELECT tile_id, CASE WHEN parent_id >= 0 THEN parent_id END AS parent_id FROM
  (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY written_at DESC, parent_id DESC NULLS LAST) AS rn FROM tile_info) WHERE rn = 1),
linked AS (SELECT t.tile_id, t.parent_id IS NOT NULL AND p.tile_id IS NULL AS orphan, p.tile_id AS up FROM newest t LEFT JOIN newest p ON t.parent_id = p.tile_id),
down AS (SELECT tile_id, [tile_id] AS path, CASE WHEN orphan THEN 'orphaned' ELSE 'rooted' END AS kind FROM linked WHERE up IS NULL
  UNION ALL SELECT l.tile_id, list_append(d.path, l.tile_id), d.kind FROM down d JOIN linked l ON l.up = d.tile_id),
endless AS (SELECT l.tile_id, l.up FROM linked l WHERE l.tile_id NOT IN (SELECT tile_id FROM down)),
chase AS (SELECT tile_id AS node, up AS reached FROM endless UNION SELECT c.node, e.up FROM chase c JOIN endless e ON e.tile_id = c.reached),
cyc AS (SELECT DISTINCT node AS tile_id FROM chase WHERE node = reached),
below AS (SELECT tile_id, [tile_id] AS path, 'on_cycle' AS kind FROM cyc
  UNION ALL SELECT e.tile_id, list_append(b.path, e.tile_id), 'below_cycle' FROM below b JOIN endless e ON e.up = b.tile_id WHERE e.tile_id NOT IN (SELECT tile_id FROM cyc)),
paths AS (SELECT * FROM down UNION ALL SELECT * FROM below)"""

P2_PATHS = f"WITH RECURSIVE {_LINKS} SELECT tile_id, array_to_string(path, '/') AS path, (len(path) - 1)::BIGINT AS depth, kind FROM paths"
P2_DESCENDANTS = f"""WITH RECURSIVE {_LINKS}, e AS (SELECT tile_id AS descendant_id, len(path) AS n, unnest(path) AS tile_id, unnest(range(len(path))) AS i FROM paths)
SELECT tile_id, descendant_id, (n - 1 - i)::BIGINT AS distance FROM e WHERE i < n - 1"""


def _token_sql(separator: str) -> str:
    if separator == " ":
        return """regexp_extract_all(trim(s, ' ') || ' ', '("(?:[^"]|"")*"|[^" ]+) +')"""
    return f"""regexp_extract_all(s || '{separator}', '( *"(?:[^"]|"")*" *|[^"{separator}]*){separator}')"""


_DECIMAL = "regexp_full_match({v}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(coalesce(TRY_CAST({v} AS DOUBLE), 'inf'::DOUBLE))"
_WHOLE = "regexp_full_match({v}, '\\+?[0-9]+') AND coalesce(TRY_CAST(ltrim({v}, '+') AS HUGEINT), 99999999999) <= {most}"
_BAD = " ".join(
    f"WHEN NOT ({(_DECIMAL if k < 4 else _WHOLE).format(v=f'f[{k + 1}]', most=255 if k < 7 else 4294967295)}) THEN '{name}'"
    for k, name in enumerate(("x", "y", "z", "I", "R", "G", "B", "class"))
)
_RECORDS = f"""l AS (SELECT DISTINCT line_id, file_id, line_no, line FROM xyz_lines),
r AS (SELECT line_id, l.file_id, line_no, regexp_replace(line, '\\r+$', '') AS s, separator, n_columns FROM l JOIN xyz_files USING (file_id)
  WHERE line IS NOT NULL AND NOT regexp_full_match(line, '[ \\t\\r]*') AND NOT (has_header AND line_no = 1)),
t AS (SELECT *, CASE separator WHEN ' ' THEN {_token_sql(" ")} WHEN ',' THEN {_token_sql(",")} WHEN ';' THEN {_token_sql(";")} ELSE {_token_sql(chr(9))} END AS tokens,
  CASE WHEN separator = ' ' THEN trim(s, ' ') ELSE s END || separator AS whole FROM r),
q AS (SELECT *, array_to_string(tokens, '') <> whole AS broken, list_transform(tokens, lambda x: trim(CASE WHEN separator = ' ' THEN x ELSE left(x, len(x) - 1) END, ' ')) AS bare FROM t),
v AS (SELECT *, list_transform(bare, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM q),
c AS (SELECT *, CASE WHEN broken THEN 'quoting' WHEN len(f) <> n_columns THEN 'columns' END AS early FROM v),
b AS (SELECT *, CASE WHEN early IS NOT NULL THEN NULL {_BAD} END AS bad FROM c)"""

P3_FOUND = f"WITH {_RECORDS} SELECT line_id, coalesce(early, 'value') AS reason, coalesce(bad, '') AS field FROM b WHERE early IS NOT NULL OR bad IS NOT NULL"
P3_POINTS = f"""WITH {_RECORDS} SELECT line_id, file_id, line_no, f[1]::DOUBLE + 0.0 AS x, f[2]::DOUBLE + 0.0 AS y, f[3]::DOUBLE + 0.0 AS z, f[4]::DOUBLE + 0.0 AS intensity, ltrim(f[5], '+')::INTEGER AS red, ltrim(f[6], '+')::INTEGER AS green,
 ltrim(f[7], '+')::INTEGER AS blue, ltrim(f[8], '+')::BIGINT AS classification FROM b WHERE early IS NULL AND bad IS NULL"""

_TILES = """docs AS (SELECT tileset_id, doc FROM (SELECT *, row_number() OVER (PARTITION BY tileset_id ORDER BY loaded_at DESC NULLS LAST, doc DESC NULLS LAST) AS rn FROM tilesets) WHERE rn = 1
  AND doc IS NOT NULL AND json_valid(doc) AND NOT regexp_matches(doc, ',\\s*[}\\]]') AND NOT regexp_matches(doc, '[:,\\[]\\s*-?(NaN|Infinity)')),
tree AS (SELECT tileset_id, 'root' AS tile_path, '' AS parent_path, json_extract(doc, '$.root') AS j FROM docs WHERE json_type(doc, '$.root') = 'OBJECT'
  UNION ALL SELECT tileset_id, tile_path || '/' || i, tile_path, c FROM
   (SELECT t.tileset_id, t.tile_path, unnest(range(json_array_length(t.j, '$.children')::BIGINT)) AS i, unnest(json_extract(t.j, '$.children[*]')) AS c FROM tree t WHERE json_type(t.j, '$.children') = 'ARRAY')
  WHERE json_type(c) = 'OBJECT'),
base AS (SELECT *, coalesce(round(TRY_CAST(json_extract_string(j, '$.geometricError') AS DOUBLE) * 1000)::BIGINT, -1) AS error_milli,
  CASE WHEN json_type(j, '$.boundingVolume.box') = 'ARRAY' THEN json_array_length(j, '$.boundingVolume.box')::BIGINT ELSE 0 END AS n_box FROM tree)"""

_URIS = """CASE
  WHEN json_type(j, '$.content.uri') = 'VARCHAR' THEN [json_extract_string(j, '$.content.uri')] WHEN json_type(j, '$.content.url') = 'VARCHAR' THEN [json_extract_string(j, '$.content.url')]
  WHEN json_type(j, '$.contents') = 'ARRAY' THEN list_filter(json_extract_string(j, '$.contents[*].uri'), lambda x: x IS NOT NULL) ELSE [] END"""
# Labels without a walk: before a tile is entered, all tiles of smaller places were entered, all of these but its ancestors
# left, and their contents passed twice; inside it stand those whose path goes on from its own.
_LABELLED = f"""{_TILES},
held AS (SELECT tileset_id, tile_path, parent_path, error_milli, n_box, {_URIS} AS uris, len(string_split(tile_path, '/')) - 1 AS level, list_transform(string_split(tile_path, '/')[2:], lambda x: x::INTEGER) AS place FROM base),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tileset_id ORDER BY place) - 1 AS r, coalesce(sum(len(uris)) OVER (PARTITION BY tileset_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM held),
inner_ AS (SELECT a.tileset_id, a.tile_path, count(*) - 1 AS tiles, sum(len(b.uris)) AS contents FROM held a JOIN held b ON a.tileset_id = b.tileset_id AND starts_with(b.tile_path || '/', a.tile_path || '/') GROUP BY 1, 2),
labelled AS (SELECT r.*, (2 * r - level + 2 * passed)::BIGINT AS pre, (2 * r - level + 2 * passed + 1 + 2 * i.tiles + 2 * i.contents)::BIGINT AS post FROM ranked r JOIN inner_ i USING (tileset_id, tile_path))"""

P4_TILES = f"WITH RECURSIVE {_LABELLED} SELECT tileset_id, pre, post, level::BIGINT AS level, tile_path, parent_path, error_milli, n_box FROM labelled"
P4_CONTENTS = f"""WITH RECURSIVE {_LABELLED}, each AS (SELECT tileset_id, pre AS tile_pre, tile_path, unnest(uris) AS uri, unnest(range(len(uris))) AS k FROM labelled)
SELECT tileset_id, (tile_pre + 1 + 2 * k)::BIGINT AS pre, (tile_pre + 2 + 2 * k)::BIGINT AS post, tile_pre, tile_path, uri FROM each"""
P4_FOUND = f"""WITH RECURSIVE {_TILES}, u AS (SELECT tileset_id, tile_path, parent_path, error_milli, n_box, {_URIS} AS uris FROM base)
SELECT DISTINCT tileset_id, tile_path, parent_path, error_milli, n_box, unnest(CASE WHEN len(uris) = 0 THEN [''] ELSE uris END) AS uri FROM u"""

MORE = {"p1_schema": P1_SCHEMA, "p1_branches": P1_BRANCHES, "p1_table": P1_TABLE, "p2_paths": P2_PATHS, "p2_descendants": P2_DESCENDANTS, "p3_found": P3_FOUND, "p3_points": P3_POINTS, "p4_found": P4_FOUND, "p4_tiles": P4_TILES, "p4_contents": P4_CONTENTS}
