"""Shared plumbing: intermediate tables in the shared folder, row ids, connected components.

Intermediate results are written as Parquet below ``spark.checkpoint.dir``, which the driver and
every executor can reach, so losing an executor costs a few re-run tasks and never a result.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.ship import ship_package

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only where that is unset (tests)."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        holder = tempfile.TemporaryDirectory(prefix="newsflow-")
        atexit.register(holder.cleanup)
        _own_dir = holder.name
    return f"file://{_own_dir}"


_scratch: ContextVar[str] = ContextVar("scratch", default="")


def new_path(spark: SparkSession, label: str, lasting: bool = False) -> str:
    folder = "" if lasting else _scratch.get()
    return f"{shared_dir(spark)}/newsflow/{folder}{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are written inside go at the end; what is to stay is written with ``lasting=True`` (or elsewhere) before that."""
    name = f"scratch-{uuid.uuid4().hex}/"
    token = _scratch.set(name)
    try:
        yield
    finally:
        _scratch.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/newsflow/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch while an intermediate table is written: a row may hold a whole text, and every task holds batches on both sides.
ARROW_ROWS = 1_000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, most: int = ARROW_ROWS) -> Iterator[None]:
    """Arrow batches of at most ``most`` rows for what is planned inside."""
    before = spark.conf.get(_ARROW)
    spark.conf.set(_ARROW, str(min(int(before), most) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(_ARROW, before)


def materialize(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label, lasting)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


#: Up to so many sources are sent to every executor; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def few(sources: DataFrame, most: int = BROADCAST_SOURCES) -> DataFrame:
    """``sources`` marked for broadcast if they are no more than ``most``."""
    return F.broadcast(sources) if sources.limit(most + 1).count() <= most else sources


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Up to so many links (16 bytes each) one task joins; more take distributed rounds.
SMALL_LINKS = 2_000_000


def least_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all links of a task: labels fall to the least neighbour's, halving paths, until they rest."""
    ends = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()], axis=1) for b in batches if b.num_rows]
    if not ends:
        return
    names, flat = np.unique(np.concatenate(ends), return_inverse=True)
    one, two = flat.reshape(-1, 2).T
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[one], label[two])
        new = label.copy()
        for at in (one, two, label[one], label[two]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    kept = np.flatnonzero(label != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[kept]), pa.array(names[label[kept]])], names=["node", "component"])


def components(edges: DataFrame, label: str = "components", max_rounds: int = 60, small: int = SMALL_LINKS) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, component)``, component = least node.

    Few links (a checked bound) are joined by one task.  More take alternating large-star and small-star rounds; each needs a map-side-combined minimum per node and
    one join on the node (which adaptive execution may split for a hub).  Least nodes and nodes without
    an edge to another are not listed.  Every round is a table in the shared folder.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = materialize(links, label)
    if links.count() <= small:
        ship_package(links.sparkSession)
        return materialize(links.coalesce(1).mapInArrow(least_members, "node long, component long"), label)
    links = materialize(links.distinct(), label)
    state = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # large star keeps a node's own link to its least neighbour through the neighbour's star
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        large = materialize(large, label)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array("a", "b")).alias("v"), "m").where("v <> m")
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        links = materialize(small, label)
        seen = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
                         F.countDistinct("a").alias("d")).first()
        if (seen["n"], seen["h"]) == state or seen["n"] == 0:
            break
        state = (seen["n"], seen["h"])
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
