"""Sessions, tables and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stratapoint")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """This package's code to the executors' Python workers, once per application, for those that don't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_stratapoint_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="code-"), "stratapoint.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("stratapoint", os.path.relpath(path, home)))
    sc.addPyFile(archive)
    sc._stratapoint_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the session's ``spark.checkpoint.dir``. Where none is set, tests and benchmarks on one
    machine (a local master) get a temporary one, and a cluster raises RuntimeError."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not hasattr(sc, "_stratapoint_folder"):
        sc._stratapoint_folder = tempfile.mkdtemp(prefix="shared-")
    return sc._stratapoint_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A new empty folder below the shared one, as a path of the file system."""
    base = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
    os.makedirs(path)
    return path


CONSTRAINTS = "spark.sql.constraintPropagation.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there.

    What the optimizer knows about the values (its constraints) is cut as well: it would be carried along, and in a loop of
    unions and joins grow with the power of the rounds.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    usual = spark.conf.get(CONSTRAINTS)
    spark.conf.set(CONSTRAINTS, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(CONSTRAINTS, usual)


def cut_counted(df: DataFrame, *conditions: str) -> tuple[DataFrame, int | tuple[int, ...]]:
    """``cut_lineage`` and the numbers of rows that meet each condition (one number of one), counted while they are written.

    Should the counts not arrive with the job's end, the written rows are counted.
    """
    seen = Observation()
    counts = [F.count_if(F.expr(c)).alias(f"n{k}") for k, c in enumerate(conditions)]
    out = cut_lineage(df.observe(seen, *counts))
    got: list[dict] = []
    waiting = threading.Thread(target=lambda: got.append(seen.get), daemon=True)
    waiting.start()
    waiting.join(10)
    n = tuple(got[0].values()) if got and len(got[0]) == len(conditions) else tuple(out.agg(*counts).first())
    return out, n[0] if len(n) == 1 else n


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` shuffled by keys into ``spark.sql.shuffle.partitions`` parts for work that costs more than its bytes tell.

    A stated number keeps the optimizer from merging parts of few bytes whose rows take long in Python.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def newest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The row of each ``key`` with the latest ``at``.

    Rows without a key are dropped. A null ``at`` is older than any time. Equal times are decided by the largest of the
    remaining columns in their order, so that the result does not depend on the order of the rows; these must therefore be
    orderable (no maps). The maximum is taken before the shuffle as well as after it, so a key with very many deliveries
    moves one row a task.
    """
    rest = [c for c in df.columns if c not in (key, at)]
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(F.struct(at, *rest)).alias("_row"))
        .select(key, *[F.col(f"_row.`{c}`").alias(c) for c in (at, *rest)])
    )


#: Rows up to which a side of short, fixed columns is broadcast; beyond it the join is salted.
BROADCAST_ROWS = 200_000


def join_dimension(facts: DataFrame, dimension: DataFrame, key: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """``facts`` ⋈ ``dimension`` (unique by ``key``, short columns), safe when one key holds a large part of all facts.

    The dimension's rows are counted: up to ``BROADCAST_ROWS`` it is broadcast, else both sides are shuffled on the key and a
    salt, the dimension once per salt.
    """
    if dimension.count() <= BROADCAST_ROWS:
        return facts.join(F.broadcast(dimension), key, how)
    salted = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rest = [c for c in facts.columns if c != key]
    picked = facts.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rest if "map" not in dict(facts.dtypes)[c]]), F.lit(salts)).cast("int"))
    return picked.join(salted, [key, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with ``name``: each row's place (from 0) in the order of the columns, without one task that sees all rows.

    Rows are cut into ranges of the order and written; the rows of each range are counted (one number a range) and the counts
    summed up. Equal rows get places in any order.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    written = cut_lineage(ranges.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    sizes = written.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    placed = written.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_row", "_start")
