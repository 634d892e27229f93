"""Shared pieces: input reading, lineage cuts, word patterns and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of a batch that is sent to a Python worker.
BATCH_BYTES = str(8 << 20)
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.  Only a local session may have none set, as in tests; it gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veilspark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a lost executor costs no recomputation, and lineage ends there."""
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut by a checkpoint in the shared folder: rows as they are, cheaper than Parquet for numbers that do not compress."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut` wrote and nothing reads any more, so that the shared folder holds what is in use only."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def lean(docs: DataFrame) -> DataFrame:
    """``docs``, to be sent to Python workers in batches of a few MB, whatever its texts' lengths: several copies of one are held at a time."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs


#: Sent to a task by a shuffle, where rows are a few numbers each.
TASK_BYTES = 16 << 20


def fine(spark: SparkSession) -> None:
    """Have partitions of at most ``TASK_BYTES`` made of what a shuffle sends: small rows take several times that in a task's sort."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > TASK_BYTES:
        spark.conf.set(name, str(TASK_BYTES))


def release(spark: SparkSession) -> None:
    """Let go of finished plans between the phases of a long job: Spark deletes shuffle files only when their plans are collected as
    garbage, which a driver with memory to spare puts off while the disks of the executors fill."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` has not, whatever it brings along."""
    taken = {c.lower() for c in df.columns}

    def free(name: str) -> str:
        return name if name.lower() not in taken else free(f"_{name}")

    return [free(n) for n in names]


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), use)[0]


def components(edges: DataFrame, left: str = "a", right: str = "b", most: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``: the smallest node that it reaches.

    Alternates large-star and small-star steps; each is one shuffle of the edges with map-side minima, and the number of
    rounds grows with the logarithm of the longest path.  No link or label reaches the driver: it only reads one
    counter a round.
    """
    e = cut(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .distinct()
    )
    before = None
    for _ in range(most):
        # large star: every larger neighbour of a node goes to the node's smallest neighbour (itself included)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and all its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = cut(small.filter("u <> v").distinct())
        drop(e)
        e = after
        # a star forest has each node once on the left, and never on both sides
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            break
        before = state
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).groupBy("node").agg(F.min("component").alias("component"))
