"""What the operators share: table reading, shared-folder tables, sampling by hash, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An input of at most so many rows may be broadcast or collected; every caller checks or states its bound.
BOUND_ROWS = 200_000
#: Rows and bytes of an Arrow batch at most: a Python worker holds a batch of whole texts at once, and texts can be long.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20
#: Rows that a Parquet reader decodes at once, each column of them in one buffer that doubles as it grows: Spark's own 4,096
#: texts of 130 KB are more than an executor's heap.
READ_ROWS = 16


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow and Parquet batches; plans are made when a result is read, so the bounds stay for the
    session."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
    if int(spark.conf.get(key := "spark.sql.parquet.columnarReaderBatchSize")) > READ_ROWS:
        spark.conf.set(key, str(READ_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one on a
    single machine (tests), and an error on a cluster, whose executors would each write to a disk of their own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def stash(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/codeloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that no model may learn from: crc32 of the id as text, mod 5, is 0 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hash_unit(*cols: Column) -> Column:
    """A number in [0, 1) fixed by the columns' values, for samples that do not depend on partitioning."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (u long, v long): rows (node, component), component = smallest node.

    Each round every node takes the least random priority among itself and its neighbours, and the edges are
    contracted to those representatives; a round shrinks the graph by a constant factor whatever its shape, a long
    path included. Nothing but a count of edges reaches the driver. Each round is a table in the shared folder.
    """
    rank = lambda c, k: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("id"))
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = stash(both(edges.where("u <> v")).distinct(), "edges")
    maps: list[DataFrame] = []
    for k in range(max_rounds):
        if edges.isEmpty():
            break
        step = stash(
            edges.groupBy("u").agg(F.min(rank("v", k)).alias("m")).select(F.col("u").alias("node"), F.least(F.col("m"), rank("u", k)).getField("id").alias("to")),
            "map",
        )
        maps.append(step)
        near, far = step.toDF("u", "uu"), step.toDF("v", "vv")
        edges = stash(edges.join(near, "u").join(far, "v").where("uu <> vv").select(F.col("uu").alias("u"), F.col("vv").alias("v")).distinct(), "edges")
    else:
        raise RuntimeError("components: no end after the largest number of rounds")
    spark = edges.sparkSession
    if not maps:
        return spark.createDataFrame([], "node long, component long")
    whole = maps[-1]
    for step in reversed(maps[:-1]):
        whole = step.join(whole.toDF("to", "last"), "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    whole = stash(whole, "root")
    least = whole.groupBy("to").agg(F.min("node").alias("component"))
    return whole.join(least, "to").select("node", "component")
