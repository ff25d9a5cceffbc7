"""What the training-data operators share: tables, lineage cuts and distributed successor ids."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The smallest bigint stands for a null id where rows must be ordered.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own in local mode, and an error on a cluster."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root and context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    if not root:
        if context.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quadrat-checkpoint-"))
        root = context.getCheckpointDir()
    return root


def cut(df: DataFrame) -> DataFrame:
    """df with its rows in the shared folder: lineage ends there and a lost executor costs no recomputation."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table of the shared folder, read again, and the table's path."""
    path = f"{shared_root(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the file system that Spark has for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def join_hot(rows: DataFrame, names: DataFrame, key: str, size: str, share: int = 1000) -> DataFrame:
    """rows joined with names (one row a key, size: rows of the key), without a task that gets a hot key's rows.

    A key of at least one share-th of all rows is hot: there are at most ``share`` of them, which bounds
    what is broadcast. The others are joined by shuffle. rows should be cut: they are read twice.
    """
    total = names.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * share >= total
    heavy = F.broadcast(names.filter(hot).drop(size))
    rest = rows.join(F.broadcast(names.filter(hot).select(key)), key, "left_anti")
    return rows.join(heavy, key).unionByName(rest.join(names.filter(~hot).drop(size), key))


def following(ids: DataFrame, key: str = "key", bits: int = 12) -> DataFrame:
    """Each distinct key with ``next_key``: the next smaller one, and the largest after the smallest.

    ids holds distinct non-null bigint keys. Keys fall in buckets of 2**bits neighbouring values, buckets
    in buckets of buckets, and so on, so that no window sees more than 2**bits rows however the keys are
    spread; only the minimum and maximum reach the driver. An empty table gives an empty result.
    """
    low, high = ids.agg(F.min(key), F.max(key)).first()
    if low is None:
        return ids.select(key, F.col(key).alias("next_key"))
    levels, span = 0, high - low
    while span >> (bits * (levels + 1)):
        levels += 1
    base = ids.select(F.col(key).alias("top"), F.col(key).alias("at"))
    stack = []
    for level in range(levels + 1):
        # at: the bucket number on this level (the key itself on level 0); top: the largest key in it
        here = base.withColumn("up", F.shiftright("at", bits))
        lead = F.lead("top").over(Window.partitionBy("up").orderBy(F.col("at").desc()))
        stack.append(here.withColumn("nearest", lead))
        base = here.groupBy("up").agg(F.max("top").alias("top")).select("top", F.col("up").alias("at"))
    # negative and positive keys may leave two top buckets (-1 and 0); the one left over is the last level
    last = base.withColumn("up", F.lit(0)).withColumn("nearest", F.lead("top").over(Window.partitionBy("up").orderBy(F.col("at").desc())))
    found = last.select(F.col("at").alias("up"), F.coalesce("nearest", F.lit(high)).alias("later"))
    for here in reversed(stack):
        found = here.join(found, "up").select(F.col("at").alias("up"), F.coalesce("nearest", "later").alias("later"))
    return found.select(F.col("up").alias(key), F.col("later").alias("next_key"))
