"""Queries that encode points to tile contents and read them back, and the streaming counterpart of node counts."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapoint.codecs import b3dm, glb, pnts, sniff
from stratapoint.convert import encode_nodes
from stratapoint.operators import octree
from stratapoint.plans import views
from stratapoint.plans.catalogue import query
from stratapoint.plans.views import PTS_EMB_SQL, PTS_LI_N_SQL
from stratapoint.session import shared_folder
from stratapoint.streaming.node_counts import node_counts, thin_stream

POINTS = "node string, x double, y double, z double, red int, green int, blue int, classification double"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    p = views.pts_emb(spark, d).withColumns({"red": F.pmod("classification", F.lit(256)).cast("smallint"), "green": F.pmod("vec_id", F.lit(256)).cast("smallint"), "blue": F.lit(7).cast("smallint"), "classification": F.col("classification").cast("float")})
    return octree.with_nodes(p, octree.root_of(p), 1)


def read_points(contents: DataFrame) -> DataFrame:
    """contents: node, content (pnts, or glTF of points). One row per point."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, content in zip(batch["node"], batch["content"], strict=True):
                kind, x = sniff.read(bytes(content))
                p, c, e = (x.positions, x.colours, x.properties) if kind == "pnts" else x
                yield pd.DataFrame({"node": node, **{v: p[:, k].astype(float) for k, v in enumerate("xyz")}, **{v: c[:, k].astype(np.int32) for k, v in enumerate(("red", "green", "blue"))}, "classification": np.asarray(e["classification"], float)})

    return contents.select("node", "content").mapInPandas(read, POINTS)


_SHOWN = f"WITH {views.path_sql(PTS_EMB_SQL, 1, '*')} SELECT node, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, (label % 256)::INTEGER AS red, (vec_id % 256)::INTEGER AS green, 7 AS blue, label::DOUBLE AS classification FROM placed"


@query(_SHOWN)
def pnts_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return read_points(encode_nodes(_nodes(spark, d), ["classification"], True, "pnts"))


@query(_SHOWN)
def glb_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return read_points(encode_nodes(_nodes(spark, d), ["classification"], True, "glb"))


@query(f"WITH {views.path_sql(PTS_EMB_SQL, 1, '*')} SELECT node, count(*) AS n, 'pnts' AS kind FROM placed GROUP BY 1 UNION ALL SELECT node, count(*), 'gltf' FROM placed GROUP BY 1")
def content_kinds(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    both = encode_nodes(n, ["classification"], True, "pnts").unionByName(encode_nodes(n, ["classification"], True, "glb"))
    return both.select("node", "n", sniff.kind_of(F.col("content")).alias("kind"))


@query(f"WITH {views.path_sql(PTS_EMB_SQL, 1, '*')} SELECT node, 2 * count(*) AS n, 2 * sum(label)::DOUBLE AS total FROM placed GROUP BY 1")
def pnts_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each node's content merged with itself: twice the points."""

    def twice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(content=[pnts.encode(pnts.merge([pnts.decode(bytes(c))] * 2)) for c in batch["content"]])[["node", "content"]]

    merged = encode_nodes(_nodes(spark, d), ["classification"], True, "pnts").mapInPandas(twice, "node string, content binary")
    return read_points(merged).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("classification").alias("total"))


@query("SELECT p_size, 3 * count(*) AS vertices, count(*) AS features, sum(p_retailprice::FLOAT::DOUBLE) > 0 AS has_price FROM part GROUP BY 1")
def b3dm_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """One triangle a part, one content a size, read back."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = np.array([[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]])
        meshes = [glb.Mesh(corners + k, primitives=[glb.Primitive(indices=np.array([0, 1, 2]))]) for k in range(len(pdf))]
        data = b3dm.from_meshes(meshes, {"price": pdf["p_retailprice"].to_numpy(np.float32), "name": pdf["p_name"].tolist()})
        features, properties, gltf = b3dm.decode(data)
        return pd.DataFrame({"p_size": [pdf["p_size"].iloc[0]], "vertices": [glb.vertex_count(glb.unpack(gltf)[0])], "features": [features["BATCH_LENGTH"]], "has_price": [bool(properties["price"].sum() > 0 and len(properties["name"]) == len(pdf))]})

    from stratapoint.session import table

    p = table(spark, d, "part").select("p_size", "p_name", "p_retailprice")
    return p.groupBy("p_size").applyInPandas(make, "p_size int, vertices long, features long, has_price boolean")


@query(f"WITH {views.path_sql(PTS_LI_N_SQL, 2, '*')} SELECT node, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z FROM placed GROUP BY 1")
def stream_node_counts(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a stream of its file: running counts and bounds per node, which must equal those of the table."""
    batch = views.pts_li_n(spark, d)
    root = octree.root_of(batch)
    source = spark.readStream.schema(spark.read.parquet(f"{d}/lineitem.parquet").schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    points = source.select((F.col("l_quantity") * 2000).alias("x"), F.col("l_extendedprice").alias("y"), (F.col("l_discount") * 1e6).alias("z"))
    name = f"node_counts_{os.getpid()}_{abs(hash(d)) % 10**8}_{np.random.default_rng().integers(10**9)}"
    running = node_counts(points, root, 2).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name).withColumns({"min_z": F.round("min_z", 6), "max_z": F.round("max_z", 6)})


@query(f"WITH {views.path_sql(PTS_EMB_SQL, 1, '*')} SELECT node, 2 * count(*) AS n, 2 * sum(label)::DOUBLE AS total FROM placed GROUP BY 1")
def glb_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each node's glTF of points merged with itself: twice the points."""

    def twice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(content=[glb.merge_points([bytes(c)] * 2) for c in batch["content"]])[["node", "content"]]

    merged = encode_nodes(_nodes(spark, d), ["classification"], True, "glb").mapInPandas(twice, "node string, content binary")
    return read_points(merged).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("classification").alias("total"))


@query(f"WITH {views.thin_sql(PTS_EMB_SQL, 'vec_id', 1)} SELECT vec_id, node FROM k1 WHERE far")
def stream_thin(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as a stream of its file, thinned on the first level with state kept per cell."""
    root = octree.root_of(views.pts_emb(spark, d))
    source = spark.readStream.schema(spark.read.parquet(f"{d}/embeddings.parquet").schema).option("pathGlobFilter", "embeddings.parquet").parquet(d)
    points = source.select("vec_id", *[F.element_at("embedding", k + 1).alias(v) for k, v in enumerate("xyz")])
    name = f"thin_{os.getpid()}_{np.random.default_rng().integers(10**12)}"
    running = thin_stream(points, root, 1, ["vec_id"]).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name).select("vec_id", "node")
