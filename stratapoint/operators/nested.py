"""Deeply nested JSON documents to flat tables of tiles and contents, linked by interval labels.

A depth-first walk numbers every tile and content when it is entered (pre) and left (post). One node lies below another
exactly if its interval lies inside; the deepest tile around a node is its parent.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratapoint.session import newest

NODES = "tileset_id long, kind string, pre long, post long, level long, tile_path string, error_milli long, n_box long, uri string"

_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_BLANK = re.compile(r"[ \t\n\r]*")
_DECIMAL = re.compile(r"\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*")


def _refuse(name: str) -> None:
    raise ValueError(name)


def parse_deep(text: str) -> object:
    """Strict JSON of any depth, without recursion. Raises ValueError."""
    blank, scan = _BLANK.match, json.decoder.scanstring
    words = {"true": True, "false": False, "null": None}
    stack: list[tuple[object, str | None]] = []
    at, value, key = blank(text, 0).end(), None, None

    def string(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError(f"name expected at {at}")
        return scan(text, at + 1, True)

    def named(at: int) -> tuple[str, int]:
        name, at = string(at)
        at = blank(text, at).end()
        if text[at : at + 1] != ":":
            raise ValueError(f"colon expected at {at}")
        return name, blank(text, at + 1).end()

    while True:
        c = text[at : at + 1]
        if c == "{" or c == "[":
            value = {} if c == "{" else []
            at = blank(text, at + 1).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                stack.append((value, key))
                key = None
                if c == "{":
                    key, at = named(at)
                continue
            at += 1
        elif c == '"':
            value, at = string(at)
        elif m := _NUMBER.match(text, at):
            value, at = (float if m[1] or m[2] else int)(m[0]), m.end()
        else:
            for word, value in words.items():
                if text.startswith(word, at):
                    at += len(word)
                    break
            else:
                raise ValueError(f"value expected at {at}")
        while True:
            at = blank(text, at).end()
            if not stack:
                if at != len(text):
                    raise ValueError(f"extra data at {at}")
                return value
            holder, outer = stack[-1]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            c = text[at : at + 1]
            if c == ",":
                at = blank(text, at + 1).end()
                key = None
                if isinstance(holder, dict):
                    key, at = named(at)
                break
            if c != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(f"comma or end expected at {at}")
            at += 1
            value, key = stack.pop()
            value, key = holder, outer


def parse_strict(text: str) -> object:
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return parse_deep(text)


def _error_milli(tile: dict) -> int:
    """Thousandths, halves away from zero; -1 without a number. What is beyond a long is the nearest long."""
    e = tile.get("geometricError")
    if isinstance(e, str):
        e = float(e) if _DECIMAL.fullmatch(e) else None
    if isinstance(e, bool) or not isinstance(e, int | float):
        return -1
    m = e * 1000
    if abs(m) >= 2**63:
        return 2**63 - 1 if m > 0 else -(2**63)
    whole = int(m)
    return whole + (m > 0) - (m < 0) if abs(m - whole) == 0.5 else round(m)


def _uris(tile: dict) -> list[str]:
    def uri(c: object) -> str | None:
        if not isinstance(c, dict):
            return None
        return next((c[k] for k in ("uri", "url") if isinstance(c.get(k), str)), None)

    one = uri(tile.get("content"))
    many = tile.get("contents")
    found = [one] if one is not None else [uri(c) for c in many] if isinstance(many, list) else []
    return [u for u in found if u is not None]


def walk(doc: object) -> Iterator[tuple]:
    """(kind, pre, post, level, tile_path, error_milli, n_box, uri) of each tile and content, as it is left."""
    root = doc.get("root") if isinstance(doc, dict) else None
    if not isinstance(root, dict):
        return
    clock = 1
    stack: list[list] = [[root, "root", 0, None, 0]]  # tile, path, pre, children still to come, level
    while stack:
        tile, path, pre, rest, level = top = stack[-1]
        if rest is None:
            for u in _uris(tile):
                yield ("content", clock, clock + 1, level + 1, None, None, None, u)
                clock += 2
            children = tile.get("children")
            top[3] = rest = iter(enumerate(children) if isinstance(children, list) else ())
        for place, child in rest:
            if isinstance(child, dict):
                stack.append([child, f"{path}/{place}", clock, None, level + 1])
                clock += 1
                break
        else:
            volume = tile.get("boundingVolume")
            box = volume.get("box") if isinstance(volume, dict) else None
            yield ("tile", pre, clock, level, path, _error_milli(tile), len(box) if isinstance(box, list) else 0, None)
            clock += 1
            stack.pop()


def _flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in NODES.split(", ")]
    types = {"pre": "Int64", "post": "Int64", "level": "Int64", "error_milli": "Int64", "n_box": "Int64"}
    for batch in batches:
        rows: list[tuple] = []
        for tileset_id, doc in zip(batch["tileset_id"], batch["doc"], strict=True):
            try:
                parsed = parse_strict(doc)
            except ValueError:
                continue
            for node in walk(parsed):
                rows.append((tileset_id, *node))
                if len(rows) >= 50_000:
                    yield pd.DataFrame(rows, columns=names).astype(types)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names).astype(types)


def node_table(tilesets: DataFrame) -> DataFrame:
    """All tiles and contents of the newest delivery of each tileset, with interval labels.

    A null document or one that is no strict JSON (NaN and Infinity are none), or without an object as root, gives no rows.
    Foreign members (extras, extensions) are not searched. Mistyped members count as absent; entries of children that are no
    objects are no tiles but keep their place. A geometricError is rounded with halves away from zero, and one whose
    thousandths are beyond a long is the nearest long.
    """
    docs = newest(tilesets.select("tileset_id", "loaded_at", "doc"), "tileset_id", "loaded_at").where("doc is not null")
    return docs.select("tileset_id", "doc").mapInPandas(_flatten, NODES)


def linked(nodes: DataFrame) -> DataFrame:
    """nodes with parent_pre and parent_path, the labels of the deepest tile whose interval holds the node's.

    Among the tiles one level up, the containing one is the last that was entered before: a running maximum over the nodes of
    one level of one document, as many as one input row held.
    """
    tiles = nodes.where("kind = 'tile'").select("tileset_id", F.col("level").alias("of"), F.col("pre").alias("at"), F.struct("pre", "post", "tile_path").alias("tile"), F.lit(None).cast(nodes.schema).alias("node"))
    below = nodes.select("tileset_id", (F.col("level") - 1).alias("of"), F.col("pre").alias("at"), F.lit(None).cast(tiles.schema["tile"].dataType).alias("tile"), F.struct(*nodes.columns).alias("node"))
    seen = Window.partitionBy("tileset_id", "of").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = tiles.unionByName(below).withColumn("tile", F.last("tile", ignorenulls=True).over(seen)).where("node is not null")
    inside = (F.col("tile.pre") < F.col("node.pre")) & (F.col("node.post") < F.col("tile.post"))
    return found.select("node.*", F.when(inside, F.col("tile.pre")).alias("parent_pre"), F.when(inside, F.col("tile.tile_path")).alias("parent_path"))


def tile_table(tilesets: DataFrame) -> DataFrame:
    """tileset_id, pre, post, level, tile_path, parent_path ('' for the root), error_milli, n_box."""
    t = linked(node_table(tilesets)).where("kind = 'tile'")
    return t.select("tileset_id", "pre", "post", "level", "tile_path", F.coalesce("parent_path", F.lit("")).alias("parent_path"), "error_milli", "n_box")


def content_table(tilesets: DataFrame) -> DataFrame:
    """tileset_id, pre, post, tile_pre, tile_path, uri: each content with the tile that holds it."""
    c = linked(node_table(tilesets)).where("kind = 'content'")
    return c.select("tileset_id", "pre", "post", F.col("parent_pre").alias("tile_pre"), F.col("parent_path").alias("tile_path"), "uri")


def tiles_with_contents(tilesets: DataFrame) -> DataFrame:
    """One row per tile and content; a tile without content has uri ''."""
    both = linked(node_table(tilesets))
    key = F.when(F.col("kind") == "tile", F.col("pre")).otherwise(F.col("parent_pre"))
    tile = F.max(F.when(F.col("kind") == "tile", F.struct("tile_path", F.coalesce("parent_path", F.lit("")).alias("parent_path"), "error_milli", "n_box")))
    uris = F.collect_set(F.when(F.col("kind") == "content", F.col("uri")))
    grouped = both.groupBy("tileset_id", key.alias("tile_pre")).agg(tile.alias("t"), uris.alias("uris"))
    return grouped.select(
        "tileset_id", "t.tile_path", "t.parent_path", "t.error_milli", "t.n_box", F.explode(F.when(F.size("uris") == 0, F.array(F.lit(""))).otherwise(F.col("uris"))).alias("uri")
    )
